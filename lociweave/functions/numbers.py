"""Scalar rules of the model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base pairs in a megabase, effective population size, bounds of recombination in cM/Mb.
MEGABASE, POPULATION, LEAST_RATE, MOST_RATE = 1e6, 20000, 0.1, 100.0
#: A jump probability stays so far from 0 and 1.
LEAST_JUMP = 1e-9


def rounded(x: Column, places: int) -> Column:
    """Half away from zero for values from 0; engines agree on it."""
    return F.floor(x * 10.0**places + 0.5) / 10.0**places


def stay(distance: Column) -> Column:
    """Probability of no jump over a physical distance, kept inside (0, 1); 1 before the first site of a chunk."""
    import math

    e = F.exp(-distance.cast("double") / MEGABASE)
    return F.least(F.greatest(e, F.lit(1.0 - math.exp(-LEAST_JUMP))), F.lit(math.exp(-LEAST_JUMP)))


def transitions(er: Column) -> list[Column]:
    """Probability that none, one given or both haplotypes jump."""
    return [(er * er).alias("r0"), (er * (1.0 - er)).alias("r1"), ((1.0 - er) * (1.0 - er)).alias("r2")]


def bounded_stay(er: Column, distance: Column, clusters: int) -> Column:
    """An estimated no-jump probability within what recombination rates allow over the distance."""
    generations = 4.0 * POPULATION / clusters
    low, high = (F.exp(-(generations * rate) * distance.cast("double") / 1e8) for rate in (MOST_RATE, LEAST_RATE))
    return F.least(F.greatest(er, low), high)


def clamped(x: Column, tol: float) -> Column:
    return F.least(F.greatest(x, F.lit(tol)), F.lit(1.0 - tol))


def normalised(values: Column, tol: float) -> Column:
    """An array clamped to [tol, 1 - tol] and divided by its sum."""
    held = F.transform(values, lambda x: clamped(x, tol))
    total = F.aggregate(held, F.lit(0.0), lambda a, x: a + x)
    return F.transform(held, lambda x: x / total)


def frequency(site: Column, cluster: Column) -> Column:
    """A fixed allele frequency for tests: differs by site and cluster, from 0.05 to 0.93."""
    return ((site * 31 + cluster * 17) % 89 + 5).cast("double") / 100.0
