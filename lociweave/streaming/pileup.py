"""Reads as a stream: running depth and alternate reads of each site and sample, from which likelihoods follow at any time.

State is one pair of counts a cell with reads; counts only grow, so update mode sends just the cells that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(reads: DataFrame) -> DataFrame:
    """``reads`` (site_idx, sample_idx, alternate BOOLEAN), a stream or a table, to n and a of each cell."""
    return reads.groupBy("site_idx", "sample_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("alternate").alias("a"))


def started(reads: DataFrame, checkpoint: str, each_batch):
    """A running query that hands every batch of changed cells to ``each_batch(df, number)``."""
    return counted(reads).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each_batch).start()
