"""PLINK 1 hard calls to genotype-likelihood text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources import beagle, plink


def cells(spark: SparkSession, prefix: str) -> tuple[DataFrame, list[str]]:
    """site_idx, contig, pos, ref, alt, sample_idx and one-hot likelihoods (none for missing calls), and the sample names."""
    names = [r["name"] for r in plink.samples(spark, f"{prefix}.fam").orderBy("at").collect()]  # the header needs them all
    sites = plink.markers(spark, f"{prefix}.bim").select(F.col("at").alias("site_idx"), "contig", "pos", F.col("a1").alias("ref"), F.col("a2").alias("alt"))
    codes = plink.unpacked(plink.bed(spark, f"{prefix}.bed", len(names)).withColumnRenamed("site", "site_idx")).where(F.col("sample_idx") < len(names))
    called = plink.one_hot(codes.where(F.col("code") != plink.MISSING))
    return called.join(sites, "site_idx").select("site_idx", "contig", "pos", "ref", "alt", F.col("sample_idx").cast("long").alias("sample_idx"), "gl0", "gl1", "gl2"), names


def plink_to_beagle(spark: SparkSession, prefix: str, out: str) -> None:
    found, names = cells(spark, prefix)
    beagle.written(found, names, out)
