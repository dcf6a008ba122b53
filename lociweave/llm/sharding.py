"""Sharding by rendezvous hashing: a record goes to the shard whose score for its key is highest. A further shard takes
records only into itself, and a shard's weight sets its share.

Slots number a shard's records without gaps in the order of their keys' hashes. The hash range is cut into as many parts
as the row count asks for; parts are counted, their counts summed up, and rows numbered within parts, so that no task
sees a whole shard. Wholly equal rows are counted first and numbered as one, so that they may be any number.

Defined results: a null text has no bytes and the checksum of the empty text; a null key is replaced by the text's digest;
equal rows get consecutive slots; an empty table gives no rows; with_shard replaces a column of the name given to the shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import hash60, record_key, saved, small

#: Production: eight shards of equal weight.
SHARDS = (1.0,) * 8
#: Rows that are numbered together.
PART_ROWS = 20_000


def score(key: Column, shard: int, weight: float) -> Column:
    """-weight / ln(u), u in (0, 1) from the hash of key and shard; the highest of several wins in proportion to weight."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.lit(-float(weight)) / F.ln(u)


def shard_of(key: Column, weights: tuple = SHARDS) -> Column:
    best = F.array_max(F.array(*[F.struct(score(key, j, w).alias("s"), F.lit(-j).alias("j")) for j, w in enumerate(weights)]))
    return (-best["j"]).cast("int")


def with_shard(docs: DataFrame, weights: tuple = SHARDS, key: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """``docs`` with the number of each record's shard; rows don't move."""
    return docs.withColumn(name, shard_of(record_key(key, text), weights))


def slots(rows: DataFrame, shard: str, order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` (a saved table) with ``slot``: gapless from 0 in each shard, by ``order``, whose first column is a 60-bit hash."""
    columns = rows.columns
    groups = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    parts = max(1, math.ceil(rows.count() / part_rows))
    groups = groups.withColumn("_part", F.floor(F.col(order[0]) / F.lit(2.0**60 / parts)).cast("int"))
    # By design as many rows as parts and shards: a window over each shard's parts.
    sums = rows.groupBy(shard, F.floor(F.col(order[0]) / F.lit(2.0**60 / parts)).cast("int").alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    starts = sums.select(F.col(shard).alias("_shard"), F.col("_part").alias("_of"), (F.sum("_rows").over(W.partitionBy(shard).orderBy("_part")) - F.col("_rows")).alias("_start"))
    within = W.partitionBy(shard, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    numbered = groups.withColumn("_before", F.sum("_n").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    placed = numbered.join(small(saved(starts, "slot-starts")), (F.col(shard) == F.col("_shard")) & (F.col("_part") == F.col("_of")))
    # Equal rows get their slots in two steps, so that any number of them is never one long array.
    step = F.ceil(F.sqrt("_n")).cast("long")
    begun = placed.withColumns({"_step": step, "_from": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / step)))})
    begun = begun.withColumns({"_low": F.col("_from") * F.col("_step"), "_high": F.least((F.col("_from") + 1) * F.col("_step"), F.col("_n")) - 1})
    return begun.withColumn("_at", F.explode(F.sequence("_low", "_high"))).select(*columns, (F.col("_start") + F.col("_before") + F.col("_at")).alias("slot"))


def assigned(docs: DataFrame, weights: tuple = SHARDS, key: str = "doc_id", text: str = "text", extra_weight: float = 1.0) -> DataFrame:
    """One row a record: key, size (bytes of the text and 1), checksum, law, shard, slot and the shard if there were one more."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    k = record_key(key, text)
    n = len(weights)
    best = F.array_max(F.array(*[F.struct(score(k, j, w).alias("s"), F.lit(-j).alias("j")) for j, w in enumerate(weights)]))
    rows = docs.select(F.col(key), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), hash60(k).alias("_h"), best.alias("_best"), score(k, n, extra_weight).alias("_extra"))
    rows = rows.select(key, "size", "text_crc32", "_h", (-F.col("_best.j")).cast("int").alias("shard"), F.when(F.col("_extra") > F.col("_best.s"), n).otherwise(-F.col("_best.j")).cast("int").alias("grown_shard"))
    numbered = slots(saved(rows, "shard-rows"), "shard", ["_h", key, "size", "text_crc32"])
    return numbered.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
