from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lociweave.llm import simhash
from tests.llm.conftest import edge_texts, rows_of, SCHEMA


def slow(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode("utf-8", "replace")) == slow(text.encode("utf-8", "replace").decode())


def united(pairs):
    """pairs: (id, fingerprint) to least reachable id of each fingerprint."""
    prints = {}
    for i, f in pairs:
        prints.setdefault(f, []).append(i)
    root = {f: f for f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(prints)
    for a in range(len(keys)):
        for b in range(a):
            if (keys[a] ^ keys[b]).bit_count() <= 2:
                root[find(keys[a])] = find(keys[b])
    groups = {}
    for f in keys:
        groups.setdefault(find(f), []).extend(i for i in prints[f] if i is not None)
    return {f: min(groups[find(f)], default=None) for f in keys}


def test_duplicates_match_brute_force(edge):
    rows = [(i, t) for i, t, _, _ in edge_texts()]
    least = united([(i, slow(t)) for i, t in rows])
    want = Counter((i, f"{slow(t):016x}", least[slow(t)]) for i, t in rows)
    assert Counter(tuple(r) for r in simhash.duplicates(edge).collect()) == want


def test_chain_of_links_is_one_component(spark):
    rng = random.Random(3)
    chains, rows = [], []
    for c in range(5):
        f = rng.getrandbits(64)
        for i in range(40):
            rows.append((c * 1000 + i, f - (1 << 64) if f >> 63 else f))
            f ^= (1 << (3 * i % 64)) | (1 << ((3 * i + 1) % 64))
        chains.append(c * 1000)
    rng.shuffle(rows)
    prints = spark.createDataFrame(rows, "id long, fp long")
    from pyspark.sql import functions as F

    got = {r["fp"]: r["least"] for r in simhash.grouped(prints, F.col("id")).collect()}
    want = united([(i, f & (2**64 - 1)) for i, f in rows])
    assert got == {f: want[f & (2**64 - 1)] for _, f in rows}


def test_hot_fingerprint_and_dense_ball(spark):
    base = 0x1234567890ABCDEF
    rows = [(i, base) for i in range(500)] + [(1000 + b, base ^ (1 << b)) for b in range(60)]
    from pyspark.sql import functions as F

    got = simhash.grouped(spark.createDataFrame(rows, "id long, fp long"), F.col("id")).collect()
    assert len(got) == 61 and {r["least"] for r in got} == {0}
    edges = simhash.links(spark.createDataFrame([(f,) for f in {f for _, f in rows}], "fp long"))
    assert edges.count() <= 61 * 65


def test_deduplicated_keeps_one_of_each_group(edge):
    kept = simhash.deduplicated(edge)
    assert kept.columns == edge.columns
    rows = [(i, t) for i, t, _, _ in edge_texts()]
    least = united([(i, slow(t)) for i, t in rows])
    got = kept.select("doc_id", "text").collect()
    assert len(got) == len({least[slow(t)] if least[slow(t)] is not None else ("none", slow(t)) for _, t in rows})
    assert all(least[slow(r["text"])] == r["doc_id"] for r in got)


def test_empty(empty):
    assert simhash.duplicates(empty).count() == 0
    assert simhash.deduplicated(empty).count() == 0


@pytest.mark.parametrize("rows", [[(1, None, "en", "a")], [(1, "x", "en", "a")] * 3])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows_of(rows), SCHEMA)
    assert {r["component_id"] for r in simhash.duplicates(docs).collect()} == {1}
    assert simhash.deduplicated(docs).count() == 1
