from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from lociweave.llm import nearcopies
from tests.llm.conftest import edge_texts


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def slow_kept(rows):
    """Of each component of texts with a Jaccard index of at least 0.8, the least key."""
    texts = list({t or "" for _, t in rows})
    sets = [slow_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
                root[find(a)] = find(b)
    of, least = {t: find(i) for i, t in enumerate(texts)}, {}
    for k, t in rows:
        least.setdefault(of[t or ""], []).append(k)
    return {min(v, key=lambda k: (k is None, k or 0)) for v in least.values()}


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"c{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("block", [1024, 8])
def test_stage_keeps_one_of_each_group(spark, monkeypatch, block):
    """Pairs from 0.8 to 1, chains, copies of one original that are no near copies of each other, and groups just too far apart."""
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in (30, 80, 200, 900):
        for _ in range(12):
            words = fresh(n)
            texts += [words, changed(rng, words, max(1, n // rng.choice([60, 70, 90, 200])))]
    for _ in range(3):
        words = fresh(150)
        for _ in range(8):
            texts.append(words)
            words = changed(rng, words, 3)
    for edits in (2, 3, 4):
        words = fresh(160)
        texts += [words, *(changed(rng, words, edits) for _ in range(40))]
    texts += [texts[0], texts[3], [], ["one"], ["One"]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(slow_kept(rows))


def close(a, b):
    """Whether a fingerprint of one text is within two bits of the other's of the same number."""
    return any((x ^ y).bit_count() <= 2 for x, y in zip(a, b))


def test_fingerprints_are_majorities_and_reach_near_copies():
    rng = random.Random(3)
    found = np.unique(np.array([rng.getrandbits(64) for _ in range(5001)], np.uint64))
    bits = np.concatenate([(nearcopies.fingerprints(found) >> i & 1)[:, None] for i in range(nearcopies.BITS)], 1)
    counts = sum(np.concatenate([(nearcopies.fingerprints(found[i : i + 1]) >> b & 1)[:, None] for b in range(nearcopies.BITS)], 1) for i in range(len(found)))
    assert (bits == (counts * 2 > len(found))).all() and nearcopies.fingerprints(found).tolist() == [p & 0xFFFFFFFF | i << 32 for i, p in enumerate(nearcopies.fingerprints(found).tolist())]
    near = {}
    for share in (0.8, 0.95):
        hits = 0
        for _ in range(200):
            a = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
            k = round(400 * (1 - share) / (1 + share))
            b = np.concatenate([a[k:], np.array([rng.getrandbits(64) for _ in range(k)], np.uint64)])
            hits += close(nearcopies.fingerprints(a).tolist(), nearcopies.fingerprints(b).tolist())
        near[share] = hits / 200
    assert near[0.95] > 0.98 and 0.5 < near[0.8] < 0.8
    far = [nearcopies.fingerprints(np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)).tolist() for _ in range(200)]
    assert not any(close(a, b) for i, a in enumerate(far) for b in far[:i])


def test_balls_link_all_close_fingerprints(spark):
    """Of candidates by ball hashing, those close enough are in one component as by all pairs, and each is close or joined by a third."""
    rng = random.Random(8)
    rows = []
    for _ in range(12):
        base = [rng.getrandbits(32) for _ in range(nearcopies.PRINTS)]
        for _ in range(rng.randint(1, 7)):
            rows.append([x ^ sum(1 << b for b in rng.sample(range(32), rng.choice([0, 1, 2, 3, 9]))) for x in base])
    rows = [(i, 100, [p | j << 32 for j, p in enumerate(r)]) for i, r in enumerate(rows)]
    rows += [(len(rows), 100, rows[0][2]), (len(rows) + 1, 300, rows[0][2])]  # the last is too long for a near copy
    got = {(r["a"], r["b"]) for r in nearcopies.balls(spark.createDataFrame(rows, "id long, n int, prints array<long>")).collect()}
    assert got and all(a < b for a, b in got) and len(rows) - 1 not in {x for p in got for x in p}

    def groups(pairs):
        root = list(range(len(rows)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return [frozenset(j for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))]

    assert groups(got) == groups((a[0], b[0]) for a in rows[:-1] for b in rows[: a[0]] if close(a[2], b[2]))


def test_links_by_fingerprints_alone(spark):
    """Where no band is shared, SimHash by ball hashing still finds near copies, and the exact index rejects what is none."""
    rng = random.Random(2)
    texts = []
    for _ in range(10):
        words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        texts += [words, changed(rng, words, 2), changed(rng, words, 90)]
    texts = [" ".join(t).encode() for t in texts]
    sets = [nearcopies.shingles(t) for t in texts]
    prints = [nearcopies.fingerprints(s).tolist() if i % 3 < 2 else nearcopies.fingerprints(sets[i - 2]).tolist() for i, s in enumerate(sets)]
    first = "first struct<_none boolean, least long, _digest long, _key string>"
    rows = [(i, (False, i, i, str(i)), len(s), p, [rng.getrandbits(63) for _ in range(nearcopies.BANDS)], b"") for i, (s, p) in enumerate(zip(sets, prints))]
    table = spark.createDataFrame(rows, f"id long, {first}, n int, prints array<long>, bands array<long>, sketch binary")
    own = spark.createDataFrame([(i, str(i), False, bytearray(t)) for i, t in enumerate(texts)], "id long, _key string, _none boolean, raw binary")
    got = {(r["node"], r["root"]) for r in nearcopies.rooted(table, own).collect()}
    assert got == {(i, i - i % 3) for i in range(30) if i % 3 < 2}


def test_edges(spark, edge, empty):
    got = nearcopies.deduplicated(edge)
    assert got.columns == edge.columns
    assert {r["doc_id"] for r in got.collect()} == slow_kept([(i, t) for i, t, _, _ in edge_texts()])
    assert nearcopies.deduplicated(empty).count() == 0
