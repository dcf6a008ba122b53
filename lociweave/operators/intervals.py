"""Interval joins, merged regions and position-wise merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.functions.variants import allele_kind

#: Base pairs in a bin of an interval join.
BIN = 16_384


def overlaps(points: DataFrame, regions: DataFrame, width: int = BIN) -> DataFrame:
    """Points (contig, pos, ...) with each region (contig, beg, end, ...) that they lie in, ends included.

    A region is sent to every bin that it touches and a point to one, so that the join is on equal bins.
    """
    binned = regions.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("beg") / width), F.floor(F.col("end") / width))))
    return points.withColumn("_bin", F.floor(F.col("pos") / width)).join(binned, ["contig", "_bin"]).where(F.col("pos").between(F.col("beg"), F.col("end"))).drop("_bin")


#: Times that the bins of a level are as wide as those of the level below, and levels.
STEP, LEVELS = 8, 12


def _level(width: int) -> Column:
    """The lowest level whose bins are as long as an interval, which then touches two of them at most."""
    length = F.col("end") - F.col("beg") + 1
    out = F.lit(LEVELS)
    for level in range(LEVELS - 1, -1, -1):
        out = F.when(length <= width * STEP**level, level).otherwise(out)
    return out


def _binned(rows: DataFrame, levels: list[int], width: int, above: bool) -> DataFrame:
    """Intervals in the bins that they touch, of their own level or of each level above it among ``levels``."""
    if above:
        rows = rows.withColumn("_at", F.explode(F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > F.col("_level"))))
    else:
        rows = rows.withColumn("_at", F.col("_level"))
    wide = F.pow(F.lit(float(STEP)), F.col("_at")).cast("long") * width
    first, last = F.floor(F.col("beg") / wide), F.floor(F.col("end") / wide)
    return rows.withColumns({"_first": first, "_bin": F.explode(F.sequence(first, last))})


def overlapping(a: DataFrame, b: DataFrame, width: int = BIN) -> DataFrame:
    """Every pair of an interval of ``a`` and one of ``b`` (contig, beg, end, ...) that overlap, ends included, once; columns of ``b`` but
    contig end in _b. Intervals whose end lies before their beginning overlap nothing.

    An interval is of the level whose bins are as long as it. Two intervals meet in the bins of the longer one's level, of which each
    touches two at most, and count in the first that they share; so a long interval isn't sent to the many bins of short
    ones, and short ones are sent only to levels, on contigs, where the other side has intervals.
    """
    a = a.where(F.col("beg") <= F.col("end")).withColumn("_level", _level(width))
    b = b.where(F.col("beg") <= F.col("end")).withColumn("_level", _level(width))
    present = [df.select("contig", F.col("_level").alias("_at")).distinct() for df in (a, b)]  # some levels a contig
    levels = [sorted(r[0] for r in p.select("_at").distinct().collect()) for p in present]  # 13 rows at most
    name = {c: f"{c}_b" for c in b.columns if c not in ("contig", "_level")}

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        other = y.withColumnsRenamed(name | {"_first": "_first_b"}).drop("_level")
        found = x.drop("_level").join(other, ["contig", "_at", "_bin"])
        once = F.col("_bin") == F.greatest("_first", "_first_b")
        return found.where(once & (F.col("beg") <= F.col("end_b")) & (F.col("beg_b") <= F.col("end"))).drop("_at", "_bin", "_first", "_first_b")

    own = lambda df: _binned(df, [], width, False)
    lifted = lambda df, side: _binned(df, levels[side], width, True).join(present[side], ["contig", "_at"], "left_semi")
    return met(own(a), own(b)).unionByName(met(lifted(a, 1), own(b))).unionByName(met(own(a), lifted(b, 0)))


def merged(regions: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Regions (contig, beg, end) joined where they overlap or touch: contig, beg, end, n.

    Regions are swept within spans of their first position; each span gets the furthest end and the number of groups of all
    spans before it, which are few rows.
    """
    placed = regions.withColumn("_span", F.floor(F.col("beg") / span))
    spans, inside = W.partitionBy("contig").orderBy("_span"), W.partitionBy("contig", "_span").orderBy("beg", "end")
    ends = placed.groupBy("contig", "_span").agg(F.max("end").alias("_end"))
    reached = ends.select("contig", "_span", F.max("_end").over(spans.rowsBetween(W.unboundedPreceding, -1)).alias("_reached"))
    furthest = F.greatest(F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.col("_reached"))
    begun = placed.join(reached, ["contig", "_span"]).withColumn("_new", F.when(F.col("beg") <= furthest + 1, 0).otherwise(1)).drop("_reached")
    counts = begun.groupBy("contig", "_span").agg(F.sum("_new").alias("_n"))
    before = counts.select("contig", "_span", (F.sum("_n").over(spans) - F.col("_n")).alias("_before"))
    grouped = begun.withColumn("_within", F.sum("_new").over(inside)).join(before, ["contig", "_span"]).withColumn("_group", F.col("_before") + F.col("_within"))
    return grouped.groupBy("contig", "_group").agg(F.min("beg").alias("beg"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("_group")


def synced(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two files' records (contig, pos, value) side by side at each position that either has."""
    return a.withColumnRenamed("value", "a").join(b.withColumnRenamed("value", "b"), ["contig", "pos"], "full_outer")


#: When two records at one position are of the same variant.
RULES = ("exact", "some", "snps", "indels", "any")


def paired(a: DataFrame, b: DataFrame, rule: str = "exact") -> DataFrame:
    """Records (contig, pos, ref, alts, ...) of two files side by side where they are of the same variant, and alone elsewhere;
    columns of ``b`` but contig and pos end in _b.

    exact: same REF and set of ALTs; some: same REF and an ALT in common; snps, indels: both have such an allele; any: same position.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    other = b.select("contig", "pos", *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in ("contig", "pos")])
    both = a.withColumnsRenamed({"contig": "_contig", "pos": "_pos"})
    same = (F.col("_contig") == F.col("contig")) & (F.col("_pos") == F.col("pos"))
    kind = lambda *kinds: F.exists("alts", lambda x: allele_kind(F.col("ref"), x).isin(*kinds)) & F.exists("alts_b", lambda x: allele_kind(F.col("ref_b"), x).isin(*kinds))
    match = {
        "exact": (F.col("ref") == F.col("ref_b")) & (F.array_sort("alts") == F.array_sort("alts_b")), "some": (F.col("ref") == F.col("ref_b")) & F.arrays_overlap("alts", "alts_b"),
        "snps": kind("SNP"), "indels": kind("INS", "DEL"), "any": F.lit(True),
    }
    found = both.join(other, same & match[rule], "full_outer")
    return found.withColumns({"contig": F.coalesce("contig", "_contig"), "pos": F.coalesce("pos", "_pos")}).drop("_contig", "_pos")
