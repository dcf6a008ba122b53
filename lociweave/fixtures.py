"""Genotype likelihoods from the given tables: a supplier is a sample, a part a site, a line item one sequencing read, which
carries the alternate allele if it was returned. Cells without reads say nothing and are not rows, so tables grow with reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators.sites import chunked
from lociweave.session import read

#: Read error, sites in a contig, in a chunk and in a grid.
ERROR, CONTIG, CHUNK, GRID = 0.01, 500, 120, 4


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, site_idx, pos."""
    key = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("c"), F.floor(key / CONTIG).cast("string")).alias("contig"), key.alias("site_idx"), (1000 * (key + 1) + 7 * F.col("p_size")).alias("pos"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, site_idx, pos, chunk_id, chunk_pos."""
    return chunked(markers(spark, sf_dir), CHUNK)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx of every sample, with or without reads; they are dense from 0."""
    return read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_idx"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_idx, sample_idx, depth n, alternate reads a, and the three genotype likelihoods, which sum to 1."""
    reads = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("site_idx"), F.col("l_suppkey").alias("sample_idx")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("a"))
    ref, alt = F.col("n") - F.col("a"), F.col("a")
    good, bad = F.lit(1 - ERROR), F.lit(ERROR)
    raw = reads.withColumns({"u0": F.pow(good, ref) * F.pow(bad, alt), "u1": F.pow(F.lit(0.5), F.col("n")), "u2": F.pow(bad, ref) * F.pow(good, alt)})
    total = F.col("u0") + F.col("u1") + F.col("u2")
    return raw.select("site_idx", "sample_idx", "n", "a", *[(F.col(f"u{g}") / total).alias(f"gl{g}") for g in range(3)])
