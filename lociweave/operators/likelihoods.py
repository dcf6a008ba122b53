"""Emissions, allele-frequency EM and mixtures as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.session import forget, settled

#: No emission is less likely.
FLOOR = 1e-10


def pair_emission(p1: Column, p2: Column) -> Column:
    """Likelihood of a cell for two clusters of alternate frequencies ``p1`` and ``p2``."""
    return F.col("gl0") * (1.0 - p1) * (1.0 - p2) + F.col("gl1") * (p1 * (1.0 - p2) + (1.0 - p1) * p2) + F.col("gl2") * p1 * p2


def pairs(clusters: int) -> list[tuple[int, int]]:
    """Unordered pairs of clusters."""
    return [(a, b) for a in range(clusters) for b in range(a, clusters)]


def emissions(frequency, clusters: int) -> dict[tuple[int, int], Column]:
    """Unfloored emission of a cell for each unordered pair; the other order's is the same."""
    p = [frequency(F.col("site_idx"), F.lit(z)) for z in range(clusters)]
    return {(a, b): pair_emission(p[a], p[b]) for a, b in pairs(clusters)}


def ordered(values: dict[tuple[int, int], Column], clusters: int) -> Column:
    """An array of all ordered pairs' values, row by row."""
    return F.array(*[values[min(a, b), max(a, b)] for a in range(clusters) for b in range(clusters)])


def site_emissions(cells: DataFrame, clusters: int, frequency) -> DataFrame:
    """A row a site and ordered pair of clusters z1, z2: cells n, mean floored emission mean_e, and cost, minus the sum of its logarithms.

    All pairs are columns of one partial aggregate: a site's cells are not multiplied.
    """
    e = {k: F.greatest(x, F.lit(FLOOR)) for k, x in emissions(frequency, clusters).items()}
    sums = cells.groupBy("site_idx").agg(F.count(F.lit(1)).alias("n"), *[F.struct(F.avg(x).alias("mean_e"), (-F.sum(F.ln(x))).alias("cost")).alias(f"_{a}_{b}") for (a, b), x in e.items()])
    states = ordered({k: F.col(f"_{k[0]}_{k[1]}") for k in e}, clusters)
    return sums.select("site_idx", "n", F.posexplode(states).alias("z", "x")).select("site_idx", F.floor(F.col("z") / clusters).cast("int").alias("z1"), (F.col("z") % clusters).cast("int").alias("z2"), "n", "x.mean_e", "x.cost")


def grid_emissions(cells: DataFrame, keys: list[str], clusters: int, frequency) -> DataFrame:
    """A row a grid (of ``keys``): its cells n_cells, and e, the products of their emissions for all ordered pairs of clusters,
    normalised over the pairs, then floored."""
    logs = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), *[F.sum(F.ln(x)).alias(f"_{a}_{b}") for (a, b), x in emissions(frequency, clusters).items()])
    raw = logs.select(*keys, "n_cells", ordered({k: F.exp(f"_{k[0]}_{k[1]}") for k in pairs(clusters)}, clusters).alias("raw"))
    total = raw.withColumn("total", F.aggregate("raw", F.lit(0.0), lambda s, x: s + x))
    return total.select(*keys, "n_cells", F.transform("raw", lambda x: F.greatest(x / F.col("total"), F.lit(FLOOR))).alias("e"))


def allele_frequencies(cells: DataFrame, rounds: int, samples: int, start: float = 0.25, enough: float | None = None) -> DataFrame:
    """site_idx, af: EM under random mating over all ``samples``; one without reads expects the frequency itself. With ``enough``,
    ends when the root of the mean squared change is less."""
    now = cells.select("site_idx").distinct().withColumn("af", F.lit(start))
    for _ in range(rounds):
        af = F.col("af")
        het, hom = F.col("gl1") * 2.0 * af * (1.0 - af), F.col("gl2") * af * af
        share = (het + 2.0 * hom) / (2.0 * (F.col("gl0") * (1.0 - af) * (1.0 - af) + het + hom))
        sums = cells.join(now, "site_idx").groupBy("site_idx", "af").agg(F.sum(share).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
        new = settled(sums.select("site_idx", ((F.col("_sum") + (samples - F.col("_rows")) * af) / samples).alias("af")), "af")
        if enough is not None:
            change = new.join(now.withColumnRenamed("af", "old"), "site_idx").agg(F.sqrt(F.avg((F.col("af") - F.col("old")) ** 2))).first()[0]
            if change is not None and change < enough:
                return new
        forget(now)
        now = new
    return now


def mixed(shares: DataFrame, frequencies: DataFrame, keys: list[str]) -> DataFrame:
    """Cluster probabilities of samples: ``shares`` (sample_idx, k, q) times ``frequencies`` (site_idx, k, z, f), summed over k."""
    return shares.join(frequencies, "k").groupBy(*keys).agg(F.sum(F.col("q") * F.col("f")).alias("h"))
