"""FASTA text and regions of it: an index of lines by the positions that they hold, and regions put together from the parts of the lines
that they overlap, however long lines and regions are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.operators import intervals, sweep
from lociweave.sources import text

#: Lines that are numbered together.
SPAN = 1 << 16


def indexed(lines: DataFrame, span: int = SPAN) -> DataFrame:
    """contig, beg, end (positions from 1, ends included), bases: lines (row, value) with where they stand. A contig's name is its header
    up to the first blank; bases before any header belong to none and are left out. White space within lines doesn't count."""
    header = F.col("value").startswith(">")
    rows = lines.select("row", F.when(header, F.regexp_extract("value", r"^>\s*(\S*)", 1)).alias("name"), F.when(header, "").otherwise(F.regexp_replace("value", r"\s+", "")).alias("bases"))
    rows = rows.withColumns({"all": F.lit(0), "start": F.when(F.col("name").isNotNull(), F.col("row"))})
    # The header before a line, and the bases before it in the whole text.
    known = sweep.swept(rows, ["all"], "row", [], {"contig": (F.col("name"), "last"), "of": (F.col("start"), "last"), "total": (F.length("bases").cast("long"), "sum")}, span=span)
    begun = known.where("name IS NOT NULL").select(F.col("row").alias("of"), F.col("total").alias("before"))  # a row a contig
    placed = known.where("name IS NULL AND contig IS NOT NULL AND bases <> ''").join(begun, "of")
    last = F.col("total") - F.col("before")
    return placed.select("contig", (last - F.length("bases") + 1).alias("beg"), last.alias("end"), "bases")


def read(spark: SparkSession, path: str) -> DataFrame:
    return indexed(text.numbered(spark, path))


def lengths(index: DataFrame) -> DataFrame:
    """contig, length."""
    return index.groupBy("contig").agg(F.max("end").alias("length"))


def regions(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (contig, beg, end, and columns that tell regions apart) with ``bases``: as much of each region as the contig has, null if
    it has none of it."""
    named = wanted.columns
    found = intervals.overlapping(wanted, index.select("contig", "beg", "end", "bases"))
    first, last = F.greatest("beg", "beg_b"), F.least("end", "end_b")
    parts = found.withColumn("part", F.substring(F.col("bases_b"), (first - F.col("beg_b") + 1).cast("int"), (last - first + 1).cast("int")))
    whole = parts.groupBy(*named).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("beg_b", "part"))), lambda x: x["part"]), "").alias("bases"))
    return wanted.distinct().join(whole, named, "left")
