"""Tiles: the likelihoods of a block of samples at a chunk's sites, the unit that tables and parameters are dealt by.

A tile names all samples of its block but holds only cells with reads; a cell without is as likely under each genotype. Blocks are
runs of samples in the order of their numbers. A chunk has tiles of the blocks that have reads at it only: a sample without any reads
at a chunk is as the model has it before any data, so what such samples add is found once a chunk, times their number or their shares,
and written out where a result has a row a sample (``without_tile``). Tiles have a bounded number of samples and cells, so a chunk of
any number of samples is spread over many tasks, and parameters reach a tile as one row of its chunk. Tiles of a chunk are
neighbours, so that the kernel handles some together, and a task adds up what it finds before it hands anything on.

Tiles are read in every pass, so they stay where they are: their table is bucketed by chunk and slot (some blocks of samples), and what a
pass needs, parameters by chunk and shares by block, is broadcast where it is small, and else sent to the buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave import session
from lociweave.operators.sites import ranked
from lociweave.session import bucketed, bytes_of, fits, forget, settled, small

#: Samples x sites in a tile, about, and samples.
TILE_CELLS, TILE_SAMPLES = 1 << 17, 64
#: Tiles of a chunk that share a slot, and so the parameters that are sent to it.
SLOT_TILES = 32
#: Samples x sites of the tiles in a bucket, about.
BUCKET_CELLS = 1 << 21
#: Samples x pairs of clusters, and samples x sites, that the kernel handles at once.
RUN_PAIRS, RUN_CELLS = 1 << 13, 1 << 18
#: Bytes of a table of sites that is broadcast, and pairs of a chunk and a block that a task writes out.
SITE_BYTES, TASK_PAIRS = 16 << 20, 1 << 12
#: Values that a task adds up by block before it hands them on.
HELD_VALUES = 1 << 22


def tiles(cells: DataFrame, sites: DataFrame, chunk: int, cells_a_tile: int = TILE_CELLS, samples: DataFrame | None = None) -> DataFrame:
    """chunk_id, slot, block, the block's samples in ascending order, and the cells (sample_idx, chunk_pos, gl0, gl1, gl2) of each.

    ``samples`` (sample_idx) names all samples; without it, they are those that have a cell. A pair of a chunk and a block is a tile if
    it has cells; a block without any has a tile without cells at the first chunk, so that tiles name all samples. ``settle`` writes
    them.
    """
    samples = (cells.select("sample_idx") if samples is None else samples.select("sample_idx")).distinct()
    size = max(1, min(TILE_SAMPLES, cells_a_tile // chunk))
    order = ranked(samples.withColumn("_all", F.lit(0)), "_all", "sample_idx")
    members = settled(order.select("sample_idx", F.floor(F.col("rank") / size).cast("int").alias("block")), "samples")
    blocks = settled(members.groupBy("block").agg(F.sort_array(F.collect_list("sample_idx")).alias("samples")), "blocks")
    placed = cells.join(small(sites.select("site_idx", "chunk_id", "chunk_pos"), SITE_BYTES), "site_idx").join(small(members, SITE_BYTES), "sample_idx")
    placed = settled(placed.select("chunk_id", "block", "sample_idx", "chunk_pos", "gl0", "gl1", "gl2"), "cells")
    pairs = settled(placed.select("chunk_id", "block").distinct(), "pairs")
    found = placed.groupBy("chunk_id", "block").agg(F.collect_list(F.struct("sample_idx", "chunk_pos", "gl0", "gl1", "gl2")).alias("cells"))
    silent = blocks.select("block").join(pairs.select("block").distinct(), "block", "left_anti")
    silent = silent.crossJoin(sites.agg(F.min("chunk_id").alias("chunk_id")).where(F.col("chunk_id").isNotNull()))
    found = found.unionByName(silent.select("chunk_id", "block", F.array().cast(found.schema["cells"].dataType).alias("cells")))
    slot = F.floor(F.col("block") / SLOT_TILES).cast("int")
    out = found.join(small(blocks), "block").select("chunk_id", slot.alias("slot"), "block", "samples", "cells")
    out._cells_a_tile, out._count, out._blocks, out._parts = size * chunk, pairs.count(), blocks, (members, placed, pairs)
    return out


def settle(found: DataFrame) -> DataFrame:
    """The table of tiles, from ``tiles`` or from files of them."""
    spark = found.sparkSession
    count = found._count if hasattr(found, "_count") else found.count()
    wanted = max(4 * spark.sparkContext.defaultParallelism, -(-count * getattr(found, "_cells_a_tile", TILE_CELLS) // BUCKET_CELLS))
    buckets = max(1, min(count, wanted, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))))
    out = bucketed(found, "tiles", buckets, ["chunk_id", "slot"], ["chunk_id", "slot", "block"])
    if hasattr(found, "_blocks"):
        out._blocks = found._blocks
    forget(*getattr(found, "_parts", ()))
    return out


def blocks_of(tiles: DataFrame) -> DataFrame:
    """block, samples: a row a block, from a table with all tiles."""
    if not hasattr(tiles, "_blocks"):
        tiles._blocks = settled(tiles.select("block", "samples").groupBy("block").agg(F.first("samples").alias("samples")), "blocks")
    return tiles._blocks


def pairs_of_tiles(tiles: DataFrame) -> DataFrame:
    """chunk_id, block: a row a tile."""
    if not hasattr(tiles, "_pairs"):
        tiles._pairs = settled(tiles.select("chunk_id", "block"), "pairs")
    return tiles._pairs


def outline(tiles: DataFrame, sizes: DataFrame) -> DataFrame:
    """chunk_id, block, samples, grids: a row a block, and a row a chunk of ``sizes`` (chunk_id, grids); what doesn't apply is null."""
    of_blocks = blocks_of(tiles).select(F.lit(None).cast("int").alias("chunk_id"), "block", "samples", F.lit(None).cast("int").alias("grids"))
    return of_blocks.unionByName(sizes.select("chunk_id", F.lit(None).cast("int").alias("block"), F.lit(None).cast("array<long>").alias("samples"), "grids"))


def lacking(tiles: DataFrame, by_chunk: DataFrame) -> DataFrame:
    """Rows of ``by_chunk``, one a chunk, with ``lacking``, how many samples have no tile of the chunk; only of chunks that lack some."""
    sizes = blocks_of(tiles).select("block", F.size("samples").alias("_n"))
    whole = sizes.agg(F.sum("_n")).first()[0] or 0
    have = pairs_of_tiles(tiles).join(small(sizes), "block").groupBy("chunk_id").agg(F.sum("_n").alias("_n"))
    return by_chunk.join(have, "chunk_id", "left").withColumn("lacking", F.lit(whole) - F.coalesce("_n", F.lit(0))).where("lacking > 0").drop("_n")


def without_tile(tiles: DataFrame, chunks: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """chunk_id, block, samples: the pairs of a chunk of ``chunks`` (chunk_id) and a block that have no tile. ``blocks``: all blocks, where
    ``tiles`` are those of some chunks."""
    blocks = blocks_of(tiles) if blocks is None else blocks
    every = chunks.select("chunk_id").distinct().crossJoin(small(blocks.select("block")))
    tasks = max(4 * tiles.sparkSession.sparkContext.defaultParallelism, -(-every.count() // TASK_PAIRS))
    return every.join(small(pairs_of_tiles(tiles)), ["chunk_id", "block"], "left_anti").repartition(tasks, "chunk_id", "block").join(small(blocks), "block").select("chunk_id", "block", "samples")


def whole(tiles: DataFrame, chunks: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """``tiles`` and, without cells, one of each pair of a chunk and a block that has none: for what differs by sample even without reads."""
    rest = without_tile(tiles, chunks, blocks)
    empty = F.array().cast(tiles.schema["cells"].dataType).alias("cells")
    return tiles.unionByName(rest.select("chunk_id", F.floor(F.col("block") / SLOT_TILES).cast("int").alias("slot"), "block", "samples", empty))


def supplied(tiles: DataFrame, by_chunk: list[DataFrame], q: DataFrame | None = None) -> DataFrame:
    """``tiles`` with the columns of tables that have a row a chunk, and of one that has a row a block (block, q)."""
    if q is not None and fits(q):
        return supplied(tiles, by_chunk).join(F.broadcast(q), "block")
    if q is None and sum(map(bytes_of, by_chunk)) <= session.BROADCAST_BYTES // 4:
        for table in by_chunk:
            tiles = tiles.join(F.broadcast(table), "chunk_id")
        return tiles
    sent = tiles.select("chunk_id", "slot").distinct()
    for table in by_chunk:
        sent = sent.join(table, "chunk_id")
    if q is None:
        return tiles.join(sent.hint("shuffle_hash"), ["chunk_id", "slot"])
    # The shares of a slot's blocks, some of them, go with its parameters.
    shares = tiles.select("slot", "block").distinct().join(q, "block").groupBy("slot").agg(F.collect_list(F.struct("block", "q")).alias("qs"))
    rows = tiles.join(sent.join(shares, "slot").hint("shuffle_hash"), ["chunk_id", "slot"])
    own = F.element_at(F.filter("qs", lambda x: x["block"] == F.col("block")), 1)
    return rows.withColumn("q", own["q"]).drop("qs")


def flat(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def runs(b: pa.RecordBatch, clusters: int) -> Iterator[tuple[int, range]]:
    """A chunk and rows of it that follow each other, as many as the kernel handles at once."""
    chunks, sites, counts = b.column("chunk_id").to_pylist(), b.column("sites").to_pylist(), np.diff(b.column("samples").offsets.to_numpy())
    first, held = 0, 0
    for i, chunk in enumerate(chunks):
        most = min(RUN_PAIRS * 2 // (clusters * (clusters + 1)), RUN_CELLS // max(1, sites[i]))
        if i > first and (chunk != chunks[first] or held + counts[i] > most):
            yield chunks[first], range(first, i)
            first, held = i, 0
        held += counts[i]
    if chunks:
        yield chunks[first], range(first, len(chunks))


def unpacked(b: pa.RecordBatch, rows: range, sites: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample numbers of tiles, one after another, and their likelihoods (n, S, 3)."""
    samples = [flat(b.column("samples"), i) for i in rows]
    gl = np.full((sum(map(len, samples)), sites, 3), 1 / 3)
    start = 0
    for i, own in zip(rows, samples):
        cells = b.column("cells")[i].values
        column = {f.name: cells.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(cells.type)}
        gl[start + np.searchsorted(own, column["sample_idx"]), column["chunk_pos"]] = np.stack([column[f"gl{g}"] for g in range(3)], 1)
        start += len(own)
    return np.concatenate(samples), gl


def lists(rows: np.ndarray) -> pa.Array:
    """(n, k) as n lists."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).ravel()))


def each_site(samples: np.ndarray, chunk: int, sites: int) -> list[pa.Array]:
    """Columns of samples, a chunk and its places, a row a sample and place."""
    n = len(samples)
    return [pa.array(np.repeat(samples, sites)), pa.array(np.full(n * sites, chunk, np.int32)), pa.array(np.tile(np.arange(sites, dtype=np.int32), n))]


def arrays_of(columns: dict[str, list[np.ndarray]]) -> list[pa.Array]:
    return [pa.array([x.ravel() for x in v], pa.list_(pa.float64())) for v in columns.values()]


def added(into: dict[str, np.ndarray], found: dict[str, np.ndarray]) -> None:
    for name, x in found.items():
        into[name] += x


def by_chunk(batches, clusters: int, counted: Callable[[pa.RecordBatch, range], dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sums of what ``counted`` gives for rows of a chunk, a row for each run of rows of one chunk: chunk_id and the names given."""
    now, sums = None, {}
    for b in batches:
        for chunk, rows in runs(b, clusters):
            found = counted(b, rows)
            if chunk == now:
                added(sums, found)
                continue
            if now is not None:
                yield sums_row(now, sums)
            now, sums = chunk, found
    if now is not None:
        yield sums_row(now, sums)


def sums_row(chunk: int, sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    plain = {c: x for c, x in sums.items() if np.ndim(x) == 0}
    whole = arrays_of({c: [x] for c, x in sums.items() if c not in plain})
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), *(pa.array([float(x)]) for x in plain.values()), *whole], ["chunk_id", *plain, *(c for c in sums if c not in plain)])


class Shares:
    """Sums by block, of arrays of one size a block; what is held is bounded."""

    def __init__(self) -> None:
        self.sums: dict[int, np.ndarray] = {}
        self.held = 0

    def add(self, block: int, values: np.ndarray) -> None:
        if block in self.sums:
            self.sums[block] += values
        else:
            self.sums[block] = values.copy()
            self.held += values.size

    def full(self) -> bool:
        return self.held > HELD_VALUES

    def taken(self) -> dict[int, np.ndarray]:
        out, self.sums, self.held = self.sums, {}, 0
        return out


def summed(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: numbers and arrays of numbers added up. ``rows`` has few rows a key."""
    chosen = rows.select(key, *columns)

    def run(batches):
        def row(k, values):
            return pa.RecordBatch.from_arrays([pa.array([k], kind), *(pa.array([x if np.ndim(x) else float(x)], t) for x, t in zip(values, kinds))], [key, *columns])

        now, sums, kind, kinds = None, [], None, []
        for b in batches:
            kind, kinds = b.schema.field(key).type, [b.schema.field(c).type for c in columns]
            for i, k in enumerate(b.column(key).to_pylist()):
                found = [flat(b.column(c), i) if pa.types.is_list(t) else b.column(c)[i].as_py() for c, t in zip(columns, kinds)]
                if k == now:
                    sums = [x + y for x, y in zip(sums, found)]
                    continue
                if now is not None:
                    yield row(now, sums)
                now, sums = k, found
        if now is not None:
            yield row(now, sums)

    return chosen.repartition(key).sortWithinPartitions(key).mapInArrow(run, chosen.schema)
