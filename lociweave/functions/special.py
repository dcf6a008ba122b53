"""Special functions as column expressions. The incomplete functions' series and continued fractions are numpy on batches of rows, in as
many steps as the batch's arguments need to settle; the rest is Spark's own expressions.

A null or undefined argument gives null; arguments outside of a function's domain give null too.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Lanczos' coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: What a continued fraction's parts are kept from zero by.
TINY = 1e-300


def _double(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _let(values: dict[str, Column], then: Callable[[Column], Column]) -> Column:
    """``then`` of a struct of values, each computed once."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), 1)


def _steps(size: np.ndarray) -> range:
    """1 to what a series of these sizes needs to settle."""
    return range(1, int(100 + 10 * math.sqrt(max(0.0, size.max(initial=0.0)))) + 1)


def _lanczos(x: Column) -> Column:
    """ln of gamma(x + 1), x of -1/2 or more."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (x + i)
    t = x + 7.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x + 0.5) * F.ln(t) - t + F.ln(series)


def lgamma(x: Column) -> Column:
    """ln |gamma(x)|; infinite at 0 and negative whole numbers."""

    def of(v: Column) -> Column:
        x = v["x"]
        turned = F.lit(math.log(math.pi)) - F.ln(F.abs(F.sin(F.lit(math.pi) * x))) - _lanczos(-x)
        return F.when((x <= 0) & (x == F.floor(x).cast("double")), float("inf")).when(x < 0.5, turned).otherwise(_lanczos(x - 1))

    return _let({"x": _double(x)}, of)


def _gamma_series(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Of the lower incomplete gamma function, what is multiplied by z^s e^-z / gamma(s + 1)."""
    total, term = np.ones_like(s), np.ones_like(s)
    for k in _steps(np.maximum(s, z)):
        term = term * z / (s + k)
        last, total = total, total + term
        if (total == last).all():
            break
    return total


def _fraction(steps: range, first: np.ndarray, parts: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """first + a1 / (b1 + a2 / (b2 + ...)), with parts(k) = (a_k, b_k), from the front: each step multiplies the value by the ratio of two
    tails' quotients."""
    safe = lambda x: np.where(np.abs(x) < TINY, TINY, x)
    value, d = safe(first), np.zeros_like(first)
    c, settled = value, 0
    for k in steps:
        a, b = parts(k)
        c, d = safe(b + a / c), 1 / safe(b + a * d)
        value = value * (c * d)
        # Odd and even parts may differ, so two steps must leave the value as it is.
        settled = settled + 1 if (np.abs(c * d - 1) < 4e-16).all() else 0
        if settled == 2:
            break
    return value


def _gamma_fraction(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Of the upper incomplete gamma function, what z^s e^-z / gamma(s) is divided by."""
    return _fraction(_steps(np.maximum(s, z)), z + 1 - s, lambda k: (k * (s - k), z + 2 * k + 1 - s))


def _incomplete_gamma(s: np.ndarray, z: np.ndarray, ln: np.ndarray, upper: bool) -> np.ndarray:
    out = np.full(len(s), np.nan)
    inside = (s > 0) & (z >= 0)
    out[inside & (z == 0)] = 1.0 if upper else 0.0
    near = (z <= 1) | (z < s)
    for of, series in ((inside & (z > 0) & near, True), (inside & (z > 0) & ~near, False)):
        x, y = s[of], z[of]
        front = x * np.log(y) - y - ln[of]
        found = np.exp(front - np.log(x)) * _gamma_series(x, y) if series else np.exp(front) / _gamma_fraction(x, y)
        out[of] = found if series != upper else 1 - found
    return out


@F.pandas_udf(DoubleType())
def _lower(s: pd.Series, z: pd.Series, ln: pd.Series) -> pd.Series:
    return pd.Series(_incomplete_gamma(*(x.to_numpy(float) for x in (s, z, ln)), False))


@F.pandas_udf(DoubleType())
def _upper(s: pd.Series, z: pd.Series, ln: pd.Series) -> pd.Series:
    return pd.Series(_incomplete_gamma(*(x.to_numpy(float) for x in (s, z, ln)), True))


@F.pandas_udf(DoubleType())
def _beta(a: pd.Series, b: pd.Series, x: pd.Series, ln: pd.Series) -> pd.Series:
    a, b, x, ln = (v.to_numpy(float) for v in (a, b, x, ln))
    out = np.full(len(a), np.nan)
    inside = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    ends = inside & ((x == 0) | (x == 1))
    out[ends] = x[ends]
    of = inside & ~ends
    a, b, x, ln = a[of], b[of], x[of], ln[of]
    front = np.exp(a * np.log(x) + b * np.log(1 - x) - ln)
    straight = x < (a + 1) / (a + b + 2)
    a, b, x = np.where(straight, a, b), np.where(straight, b, a), np.where(straight, x, 1 - x)

    def parts(k: int) -> tuple[np.ndarray, float]:
        m = k // 2
        return (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))), 1.0

    found = front / (a * _fraction(_steps(np.maximum(a, b)), np.ones_like(a), parts))
    out[of] = np.where(straight, found, 1 - found)
    return pd.Series(out)


def gammap(s: Column, z: Column) -> Column:
    """The regularised lower incomplete gamma function, for s > 0 and z >= 0."""
    return _lower(_double(s), _double(z), lgamma(s))


def gammaq(s: Column, z: Column) -> Column:
    """The regularised upper incomplete gamma function."""
    return _upper(_double(s), _double(z), lgamma(s))


def erfc(x: Column) -> Column:
    """The complementary error function."""
    half = gammaq(F.lit(0.5), _double(x) * _double(x))
    return F.when(x >= 0, half).when(x < 0, F.lit(2.0) - half)


def betai(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, for a, b > 0 and x of 0 to 1."""
    a, b = _double(a), _double(b)
    return _beta(a, b, _double(x), lgamma(a) + lgamma(b) - lgamma(a + b))


def fisher(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's exact test of counts a, b over c, d, as a struct: left and right (tables with the same margins and an a at most or at
    least this) and two_sided (tables that are no likelier).

    Tables' likelihoods are found relative to this one's, by the ratio of one table to the next in both directions.
    """

    def of(v: Column) -> Column:
        a, b, c, d = (v[x] for x in "abcd")
        none = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("all"), F.lit(0.0).alias("rare"))

        def sums(n: Column, ratio: Callable[[Column], Column]) -> Column:
            def step(s: Column, k: Column) -> Column:
                term = s["term"] * ratio(k)
                return F.struct(term.alias("term"), (s["all"] + term).alias("all"), (s["rare"] + F.when(term <= 1 + 1e-9, term).otherwise(0.0)).alias("rare"))

            return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), none, step)).otherwise(none)

        # To the table with k more, or fewer, in a.
        up = sums(F.least(b, c), lambda k: (b - k + 1) * (c - k + 1) / ((a + k) * (d + k)))
        down = sums(F.least(a, d), lambda k: (a - k + 1) * (d - k + 1) / ((b + k) * (c + k)))

        def shares(t: Column) -> Column:
            whole = t["up"]["all"] + t["down"]["all"] + 1
            share = lambda x: F.least(F.lit(1.0), x / whole)
            infinite = lambda x: F.when(x == float("inf"), 1.0).otherwise(share(x))
            return F.struct(infinite(t["down"]["all"] + 1).alias("left"), infinite(t["up"]["all"] + 1).alias("right"), share(t["up"]["rare"] + t["down"]["rare"] + 1).alias("two_sided"))

        return _let({"up": up, "down": down}, shares)

    return _let({n: _double(x) for n, x in zip("abcd", (a, b, c, d))}, of)
