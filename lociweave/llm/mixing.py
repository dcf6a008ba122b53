"""Mixing sources to target weights by nested hash thresholds: histograms by source and hash bucket find how far each
source's budget reaches, only the bucket that the budget ends in is refined, and rows are then filtered by their hash.
No rows are sorted or sampled.

Every source gets a target in words. A source is taken whole ``floor(target / size)`` times; of the rest, each document is
taken once more if its hash is at most the source's threshold. Thresholds are nested: a larger budget takes a superset.

Defined results: a null or empty text has size 0 and takes 0 words; null sources are one source, after all others; a null
key is replaced by the text's digest; rows with equal keys are taken or left together; an empty table gives no rows;
other columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import WORD, hash60, record_key, renamed, saved, small

#: Sources by code point, null last, get these weights in turn.
WEIGHTS = (1, 2, 3)
#: No document is taken more often.
MOST = 3
#: Hash bits that each histogram resolves; five of them resolve all 60.
BITS = 12


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Narrow rows: key, source, size in words and the key's hash."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(text).alias("size"), hash60(record_key(key, text)).alias("h"))


def targets(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, share: float = 1.0) -> DataFrame:
    """For each source its size, target words, whole repeats and the words left for the threshold.

    Targets share ``share`` of all words by weight and stop at ``most`` times a source's size; the excess is reshared.
    That is water filling: sources by their cap over their weight, the first level that its own source can hold is the
    level of all that are not capped. The window runs over one row a source.
    """
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    return (
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(W.partitionBy()) * F.lit(share))
        .withColumn("capped", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("left", F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy()))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))))
        .withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
        .select("source", "source_size", "target", "repeats", "rest")
    )


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with each source's hash threshold (-1: no row is taken once more).

    A row is taken once more if half of its words still lie within the rest. ``rows`` and ``goals`` are saved tables.
    """
    edge = small(goals).select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    near = rows.select("source", "size", "h")
    for level in range(60 // BITS):
        shift = 60 - BITS * (level + 1)
        edge = edge.withColumnRenamed("source", "edge_source")
        inside = near.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        if level == 1:
            # Of all rows only those in the buckets that the budgets end in are looked at again.
            near = saved(inside.select("source", "size", "h"), "mix-edge")
            inside = near.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (F.shiftright("h", shift + BITS) == F.col("prefix")))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("start"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy("bucket")) + F.col("start")
        edge = (
            buckets.withColumn("after", upto)
            .where((F.col("after") - F.col("words") < F.col("rest")) & (F.col("rest") <= F.col("after")))
            .select("source", "rest", F.col("bucket").alias("prefix"), (F.col("after") - F.col("words")).alias("before"), "after")
        )
        if level == 0:
            edge = small(saved(edge, "mix-bounds"))
    last = edge.select(F.col("source").alias("edge_source"), (F.col("prefix") - F.when(F.col("before") + F.col("after") < 2 * F.col("rest"), 0).otherwise(1)).alias("threshold"))
    whole = F.when(F.col("rest") > F.col("source_size"), F.lit((1 << 60) - 1)).otherwise(F.lit(-1)).cast("long")
    joined = small(goals).join(last, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source")
    return saved(joined.withColumn("threshold", F.coalesce("threshold", whole)), "mix-thresholds")


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, most: int = MOST, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(measured rows, thresholds by source), both saved."""
    rows = saved(measured(docs, key, text, source), "mix-rows")
    goals = saved(targets(rows, weights, most, share), "mix-goals")
    return rows, thresholds(rows, goals)


def _with_goals(rows: DataFrame, limits: DataFrame, source: str) -> DataFrame:
    goals = small(limits.select(*[F.col(c).alias(f"_mix_{c}") for c in limits.columns]))
    return rows.join(goals, F.col(source).eqNullSafe(F.col("_mix_source")), "left")


def _copies(h: Column) -> Column:
    return F.col("_mix_repeats") + (h <= F.col("_mix_threshold")).cast("int")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """One row a document: its size, its source's size and target, and the words that the mix takes of it."""
    rows, limits = plan(docs, key, text, source, **how)
    taken = F.col("size") * _copies(F.col("h"))
    return _with_goals(rows, limits, "source").select(F.col("key").alias(key), "size", F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mixed documents, with the columns of ``docs``; a document that is taken twice is two rows."""
    names = docs.columns
    _, limits = plan(docs, key, text, source, **how)
    docs, name = renamed(docs)
    key, text, source = name[key], name[text], name[source]
    copies = _with_goals(docs, limits, source).withColumn("_mix_copies", _copies(hash60(record_key(key, text))))
    return copies.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*docs.columns).toDF(*names)
