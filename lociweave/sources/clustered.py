"""Tables in the order of positions, of which a region's reader opens few files and few row groups.

Rows are dealt by range of (contig, pos) and sorted, so that each file and row group holds a run of positions, whose bounds Parquet keeps.
Beside them an index, a row a file, has the bounds of each file, so that a region names its files before any is opened. A region is
told by plain comparisons of stored columns, which Spark hands down to the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group, and rows of the pages within it whose bounds are kept too.
GROUP_BYTES, PAGE_ROWS = 8 << 20, 20_000


def write(rows: DataFrame, path: str, parts: int | None = None, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """``rows`` (contig, pos, last position end, ...) in order, and their index; without ``parts``, as many files as adaptive
    execution finds fit."""
    order = ["contig", "pos", "end"]
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    options = {"parquet.block.size": group_bytes, "parquet.page.row.count.limit": page_rows, "parquet.block.row.count.limit": max(page_rows, 100 * page_rows)}
    dealt.sortWithinPartitions(*order).write.options(**options).parquet(f"{path}/rows")
    held = rows.sparkSession.read.parquet(f"{path}/rows").select("contig", "pos", "end", F.col("_metadata.file_path").alias("file"))
    bounds = held.groupBy("contig", "file").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("end").alias("furthest"), F.count(F.lit(1)).alias("n"))
    bounds.coalesce(1).write.parquet(f"{path}/index")


def files(spark: SparkSession, path: str, contig: str, beg: int, end: int) -> list[str]:
    """The files that hold rows of a region."""
    found = spark.read.parquet(f"{path}/index").where((F.col("contig") == contig) & (F.col("first") <= end) & (F.col("furthest") >= beg))
    return sorted(r["file"] for r in found.select("file").collect())  # the region's files


def region(spark: SparkSession, path: str, contig: str, beg: int, end: int) -> DataFrame:
    """The rows of positions ``beg`` to ``end`` or that reach into them."""
    named = files(spark, path, contig, beg, end)
    schema = spark.read.parquet(f"{path}/rows").schema
    rows = spark.read.schema(schema).parquet(*named) if named else spark.createDataFrame([], schema)
    return rows.where((F.col("contig") == contig) & (F.col("pos") <= end) & (F.col("end") >= beg))


def count(spark: SparkSession, path: str, contig: str | None = None) -> int:
    """How many rows there are, of a contig or in all, from the index alone."""
    index = spark.read.parquet(f"{path}/index")
    return (index if contig is None else index.where(F.col("contig") == contig)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
