from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociweave.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, key string, row string, q string, block string, place string"


def slow(rows, every, positives=5, negatives=10, low=30, high=90):
    one = {}
    for i, x, label, *_ in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        q = [math.floor(v * 256) for v in x]
        one[i] = min(one.get(i, (label, q)), (label, q))
    out = []
    for i, (label, q) in one.items():
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p)), j, other) for j, (other, p) in one.items() if j != i and len(p) == len(q)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            held = sorted(x[:2] for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(held[:negatives], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, *"xxxxx") for r in rows], SCHEMA).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(n, dim, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, [float(x) for x in (centres[i % 4] + rng.normal(size=dim) * 0.7) * scale * rng.lognormal(0, 0.4)], int(i % 5)) for i in range(n)]


@pytest.mark.parametrize(("dim", "cells"), [(6, 1 << 20), (6, 120), (16, 900), (1, 64)])
def test_matches_brute_force(spark, monkeypatch, dim, cells):
    monkeypatch.setattr(hardneg, "BLOCK_CELLS", cells)
    monkeypatch.setattr(hardneg, "ANCHOR_CELLS", cells)
    monkeypatch.setattr(hardneg, "FIRST_ROWS", 16)
    monkeypatch.setattr(hardneg, "TOGETHER", 3)
    rows = vectors(400, dim, dim)
    assert got(hardneg.mined(table(spark, rows), F.col("key") % 10 == 0)) == slow(rows, 10)


def test_edges(spark):
    rng = random.Random(4)
    rows = vectors(60, 3, 1) + [(100, [0.0, 0.0, 0.0], 1), (101, [0.0, 0.0, 0.0], 1), (102, [0.0, 0.0, 0.0], 2), (103, [1.0, 2.0], 1), (104, [1.0, 2.0], 1), (105, [0.5, 1.0], 3), (110, [], 1), (111, [], 1)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (200, None, 1), (201, [1.0, None, 1.0], 1), (202, [1.0, float("nan"), 1.0], 1), (203, [float("inf"), 1.0, 1.0], 1), (204, [1.0, 1.0, 1.0], None)]
    rows += [(300 + i, [0.5, 0.25, 1.0], i % 2) for i in range(12)]  # ties
    rows += [(0, [9.0, 9.0, 9.0], 4), rows[1], rows[1]]  # a key twice, equal rows
    rng.shuffle(rows)
    assert got(hardneg.mined(table(spark, rows), F.col("key") % 2 == 0)) == slow(rows, 2)
    assert hardneg.mined(table(spark, []), F.col("key") % 2 == 0).count() == 0


def test_large_components_stay_exact(spark):
    rows = vectors(50, 3, 3, scale=1e5)
    assert got(hardneg.mined(table(spark, rows), F.col("key") % 5 == 0)) == slow(rows, 5)


def test_ranges_leave_out_rows_and_lose_none():
    """Lists alone decide what is verified: few rows where one coordinate tells, never fewer than reach the threshold."""
    rng = np.random.default_rng(0)
    q = np.rint(rng.normal(size=(2000, 8)) * 40 + np.eye(8)[rng.integers(8, size=2000)] * 400).astype(int)
    row = {"n": len(q), "dim": 8, "keys": np.arange(len(q), dtype="<i8").tobytes(), "labels": bytes(8 * len(q)), "q": q.astype("<i8").tobytes(), "lists": np.argsort(hardneg.normalised(q), axis=0, kind="stable").T.astype("<i4").tobytes()}
    block = hardneg.Block(row)
    shares = []
    for i in range(0, 200, 10):
        scores = q @ q[i]
        for least in (-np.inf, -1000.0, 0.0, float(np.quantile(scores, 0.9)), float(scores.max()), float(scores.max()) * 4):
            found = set(block.candidates(q[i], least).tolist())
            assert set(np.flatnonzero(scores >= least).tolist()) <= found
        shares.append(len(block.candidates(q[i], float(np.quantile(scores, 0.9)))) / len(q))
    assert np.mean(shares) < 0.5
