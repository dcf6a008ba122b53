from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lociweave.llm import mixing, sharding
from tests.llm.conftest import edge_texts


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def h60(key, text):
    k = str(key) if key is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(k.encode()).hexdigest()[:15], 16)


def filled(sizes, weights, most=3):
    """Targets by sharing what is left again and again."""
    total, target, open_ = sum(sizes.values()), {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.discard(s)
    return target


def test_report_matches_brute_force(edge):
    rows = [(i, t, s) for i, t, _, s in edge_texts()]
    sizes = Counter()
    for i, t, s in rows:
        sizes[s] += size(t)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    target = filled(sizes, {s: j % 3 + 1 for j, s in enumerate(order)})
    taken = {}
    for s in order:
        base = math.floor(target[s] / sizes[s]) if sizes[s] else 0
        rest, done, by = target[s] - base * sizes[s], 0, defaultdict(int)
        for i, t, own in rows:
            if own == s:
                by[h60(i, t)] += size(t)
        for h in sorted(by):
            taken[s, h] = base + (2 * done + by[h] < 2 * rest)
            done += by[h]
    got = mixing.report(edge).collect()
    assert len(got) == len(rows)
    want = Counter((i, size(t), sizes[s], round(target[s], 6), size(t) * taken[s, h60(i, t)]) for i, t, s in rows)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got) == want
    assert all(r["taken"] <= 3 * r["size"] for r in got)


def test_reruns_agree_and_larger_budgets_take_supersets(edge):
    a, b = (sorted((r["doc_id"] or -1, r["taken"]) for r in mixing.report(edge.repartition(n)).collect()) for n in (1, 5))
    assert a == b
    less = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.report(edge, share=0.4).collect()}
    more = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.report(edge, share=0.6).collect()}
    assert all(less[k] <= more[k] for k in less)


def test_mix_repeats_rows_and_keeps_columns(edge):
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns
    words = Counter()
    for r in mixed.select("doc_id", "text").collect():
        words[r["doc_id"]] += size(r["text"])
    want = Counter()
    for r in mixing.report(edge).collect():
        want[r["doc_id"]] += r["taken"]
    assert +words == +want


def test_empty(empty):
    assert mixing.report(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.assigned(empty).count() == 0
    assert sharding.with_shard(empty).count() == 0


def best(key, n, weights=None):
    def score(j):
        u = (int(hashlib.md5(f"{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -(weights[j] if weights else 1.0) / math.log(u)

    return max(range(n), key=score)


def test_assigned_matches_brute_force(edge):
    rows = [(i, t) for i, t, _, _ in edge_texts()]
    got = sharding.assigned(edge).collect()
    key = lambda i, t: str(i) if i is not None else "text:" + hashlib.md5((t or "").encode()).hexdigest()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key", best(key(i, t), 8), best(key(i, t), 9)) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)


def test_slots_do_not_depend_on_parts(edge, spark):
    a = {(r["doc_id"], r["size"], r["slot"]) for r in sharding.assigned(edge).collect()}
    rows = edge.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
    assert len(a) == rows.count()
    held = sharding.PART_ROWS
    try:
        sharding.slots.__defaults__ = (3,)
        assert {(r["doc_id"], r["size"], r["slot"]) for r in sharding.assigned(edge).collect()} == a
    finally:
        sharding.slots.__defaults__ = (held,)


@pytest.mark.parametrize("weights", [(1.0, 3.0), (2.0, 1.0, 1.0)])
def test_weights_set_shares(spark, weights):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    counts = {r["shard"]: r["count"] for r in sharding.with_shard(rows, weights).groupBy("shard").count().collect()}
    assert all(abs(counts[j] / 4000 - w / sum(weights)) < 0.04 for j, w in enumerate(weights))
