"""Special functions against the standard library and sums."""

from __future__ import annotations

import math
import time

import pytest
from pyspark.sql import functions as F

from lociweave.functions import special


def close(got, want, tol=1e-9):
    return got == want if want is None or math.isinf(want) else abs(got - want) <= tol * max(1.0, abs(want))


def test_lgamma_and_erfc(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 3.25, 10.0, 171.5, 1e4, 1e9, 1e-8, 0.25, -0.5, -1.5, -7.3, 100.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.lgamma(F.col("x")).alias("y")).collect()
    assert all(close(r["y"], math.lgamma(r["x"])) for r in rows)
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.5, 2.0, 4.0, 8.0, 20.0, 30.0, -0.3, -1.0, -5.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.erfc(F.col("x")).alias("y")).collect()
    assert all(abs(r["y"] - math.erfc(r["x"])) <= 1e-9 * math.erfc(r["x"]) for r in rows)


@pytest.mark.parametrize("f", [special.lgamma, special.erfc])
def test_poles_and_undefined(spark, f):
    rows = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (-3.0,)], "x double").select("x", f(F.col("x")).alias("y")).collect()
    assert rows[0]["y"] is rows[1]["y"] is None
    assert f is special.erfc or rows[2]["y"] == rows[3]["y"] == math.inf


def test_incomplete_gamma(spark):
    cases = [(s, z) for s in (1, 2, 5, 30, 200, 5000) for z in (0.0, 1e-3, 0.5, 1.0, 4.0, 29.0, 31.0, 180.0, 4900.0, 5200.0)]
    rows = spark.createDataFrame([(float(s), z) for s, z in cases], "s double, z double").select("s", "z", special.gammap(F.col("s"), F.col("z")).alias("p"), special.gammaq(F.col("s"), F.col("z")).alias("q")).collect()
    for r in rows:
        want = math.fsum(math.exp(i * math.log(r["z"]) - r["z"] - math.lgamma(i + 1)) for i in range(int(r["s"]))) if r["z"] else 1.0
        assert abs(r["q"] - want) < 1e-9 and abs(r["p"] + r["q"] - 1) < 1e-12, r
    bad = spark.createDataFrame([(0.0, 1.0), (-1.0, 1.0), (1.0, -1.0), (None, 1.0)], "s double, z double").select(special.gammap(F.col("s"), F.col("z")).alias("p")).collect()
    assert [r["p"] for r in bad] == [None] * 4


def test_incomplete_beta(spark):
    cases = [(a, b, x) for a in (1, 3, 40, 700) for b in (1, 2, 55, 900) for x in (0.0, 1e-4, 0.2, 0.44, 0.5, 0.9, 1.0)]
    rows = spark.createDataFrame([(float(a), float(b), x) for a, b, x in cases], "a double, b double, x double").select("*", special.betai(F.col("a"), F.col("b"), F.col("x")).alias("y")).collect()
    for r in rows:
        a, b, x = int(r["a"]), int(r["b"]), r["x"]
        n = a + b - 1
        want = x if x in (0.0, 1.0) else math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(x) + (n - j) * math.log(1 - x)) for j in range(a, n + 1))
        assert abs(r["y"] - want) < 1e-9, r


def test_fisher(spark):
    tables = [(0, 0, 0, 0), (3, 1, 1, 3), (10, 2, 3, 15), (0, 10, 12, 2), (1, 0, 0, 0), (5, 5, 5, 5), (200, 150, 90, 310), (2000, 10, 5, 1900)]
    rows = spark.createDataFrame(tables, "a int, b int, c int, d int").select("*", special.fisher(*[F.col(x) for x in "abcd"]).alias("p"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for a, b, c, d, p in rows.collect():
        n, low, high = a + b + c + d, max(0, a - d), min(a + b, a + c)
        weight = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(low, high + 1)}
        whole = math.comb(n, a + c)
        share = lambda keep: sum(w for x, w in weight.items() if keep(x, w)) / whole
        for got, want in ((p["left"], share(lambda x, w: x <= a)), (p["right"], share(lambda x, w: x >= a)), (p["two_sided"], share(lambda x, w: w <= weight[a]))):
            assert abs(got - want) <= 1e-9 * max(want, 1e-300) or abs(got - want) < 1e-12


def test_many_rows(spark):
    """A batch takes as many steps as it needs: 20,000 rows of each function took over a minute when every row took the most steps."""
    began = time.monotonic()
    n = 200_000
    x = F.col("id")
    rows = spark.range(n).select(special.gammap(x % 20 + 1, (x % 40) / 2).alias("p"), special.gammaq(x % 20 + 1, (x % 40) / 2).alias("q"), special.betai(x % 15 + 1, x % 14 + 1, (x % 99 + 1) / 100).alias("i"), special.betai(x % 14 + 1, x % 15 + 1, 1 - (x % 99 + 1) / 100).alias("j"), special.erfc((x % 61 - 30) / 10).alias("e"))
    off = [F.max(F.abs(c)) for c in (F.col("p") + F.col("q") - 1, F.col("i") + F.col("j") - 1)]
    found = rows.agg(*off, F.count("e")).first()
    assert max(found[0], found[1]) < 1e-12 and found[2] == n and time.monotonic() - began < 60
