"""The ordered dimension: chunks, distances and grids of sites, as windows over spans of a contig or over chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Values of an order key that are put in order together.
SPAN = 1 << 20


def ranked(rows: DataFrame, group: str, by: str, ties: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """``rows`` with ``rank``, from 0 within the group in order of the whole number ``by``, then of ``ties``.

    Rows are put in order within spans of ``by``, and the counts of the spans before are added, so that no group, however large,
    is one task.
    """
    placed = rows.withColumn("_span", F.floor(F.col(by) / span))
    counts = placed.groupBy(group, "_span").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(group, "_span", (F.sum("_n").over(W.partitionBy(group).orderBy("_span")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(W.partitionBy(group, "_span").orderBy(by, *ties)) - 1
    return placed.withColumn("_within", within).join(before, [group, "_span"]).withColumn("rank", F.col("_before") + F.col("_within")).drop("_span", "_before", "_within")


def chunked(markers: DataFrame, size: int) -> DataFrame:
    """``markers`` (contig, site_idx, ...) with chunk_id and chunk_pos: a new chunk at each contig and after every ``size`` sites.

    Chunks are numbered through all contigs, in the order of their first sites; only one row a contig meets in one task.
    """
    contigs = markers.groupBy("contig").agg(F.min("site_idx").alias("first"), F.ceil(F.count(F.lit(1)) / size).alias("chunks"))
    starts = contigs.select("contig", (F.sum("chunks").over(W.orderBy("first")) - F.col("chunks")).alias("start"))
    found = ranked(markers, "contig", "site_idx").join(starts, "contig")
    return found.withColumns({"chunk_id": (F.col("start") + F.floor(F.col("rank") / size)).cast("int"), "chunk_pos": (F.col("rank") % size).cast("int")}).drop("rank", "start")


def rebalanced(chunks: DataFrame, size: int) -> DataFrame:
    """Chunks of one contig filled up to ``size`` from those after them."""
    rank = F.col("rank")
    return ranked(chunks, "contig", "site_idx").withColumns({"chunk_in_contig": F.floor(rank / size).cast("int"), "chunk_pos": (rank % size).cast("int")}).drop("rank")


def thinned(chunks: DataFrame, step: int) -> DataFrame:
    """All chunks but every ``step``-th, from the first."""
    return chunks.where(F.col("chunk_id") % step != 0)


def in_chunk():
    return W.partitionBy("chunk_id").orderBy("chunk_pos")


def distance() -> Column:
    """Base pairs from the site before, 0 for a chunk's first."""
    return F.coalesce(F.col("pos") - F.lag("pos").over(in_chunk()), F.lit(0).cast("long"))


def grid_flags(size: int) -> Column:
    """True at the first and the last site of every grid; false everywhere if a grid is one site."""
    if size == 1:
        return F.lit(False)
    at, last = F.col("chunk_pos"), F.max("chunk_pos").over(W.partitionBy("chunk_id"))
    return (at % size == 0) | (at % size == size - 1) | (at == last)


def rate_flags(r2: Column, least: float) -> Column:
    """True where a double jump is less likely than ``least`` squared."""
    return F.sqrt(r2) < least


def grids(chunks: DataFrame, size: int) -> DataFrame:
    """One row a grid of ``size`` sites: chunk_id, grid_id, first and last place, sites, and the position of its middle site."""
    placed = chunks.withColumn("grid_id", F.floor(F.col("chunk_pos") / size).cast("int"))
    each = placed.groupBy("chunk_id", "grid_id").agg(F.min("chunk_pos").alias("start"), F.max("chunk_pos").alias("end"), F.count(F.lit(1)).alias("n_sites"), F.sort_array(F.collect_list("pos")).alias("positions"))
    return each.withColumn("middle", F.element_at("positions", (F.col("n_sites") / 2).cast("int") + 1))


def grid_distance() -> Column:
    """Base pairs between the middle sites of neighbouring grids, 0 for a chunk's first."""
    return F.coalesce(F.col("middle") - F.lag("middle").over(W.partitionBy("chunk_id").orderBy("grid_id")), F.lit(0).cast("long"))


def islands(chunks: DataFrame, flag: Column) -> DataFrame:
    """``chunks`` with ``island``: runs of flagged sites share a number, each other site has its own."""
    held = chunks.withColumn("flag", flag)
    begins = F.when(F.col("flag") & F.coalesce(F.lag("flag").over(in_chunk()), F.lit(False)), 0).otherwise(1)
    return held.withColumn("begins", begins).withColumn("island", (F.sum("begins").over(in_chunk()) - 1).cast("int")).drop("begins")
