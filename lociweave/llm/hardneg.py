"""Hard negatives by pruned search for large inner products: blocks of rows of like length, each with a sorted list of every
coordinate; an anchor's largest coordinates name ranges of these lists outside which no row can reach its threshold, and only
rows within all ranges are verified.

Components are scaled and rounded down to integers, so scores are exact. Rows are put into buckets by dimension and length (a
factor ``RATIO`` apart), buckets are split by a hash of the key into blocks of bounded cells, and a block is one row of a saved
table with its coordinate lists. Anchors are packed likewise; every packed row of anchors meets every block of its dimension, in an
equi-join on the block's number, so that neither side is held whole anywhere.

For an anchor q and a threshold s, a row p of length at most m needs the cosine s / (|q| m), hence an angle to q of at most its arc
cosine t; as the angle between q and the axis f is known, p's to it differs from it by t at most, which is a range of p's normalised
coordinate f. Ranges are widened by ``SLACK`` against rounding. The first threshold is the score that enough of a block's
first rows reach. Rows in all ranges of the anchor's ``FOCUS`` largest coordinates are verified by their exact scores; where they are
most of the block, those of several anchors together.

Positives are found first (the best of the same label, one pass), then the negatives of all positives of an anchor (a second pass, between
the bounds that its positives' scores give).

Defined results: rows with a null key, a null label, a null vector or any null or non-finite component take no part; of rows with an equal
key the one with the least label, then the least vector takes part; an anchor without positives, and a positive without negatives in its
bounds, give no rows; a positive's score below zero has no bounds; vectors of unlike dimension have no score with each other; zero
vectors have the score 0 with all; ties go by the smaller key; an empty table gives no rows; other columns are not read. Scores that
could pass 63 bits stop the job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import forget, saved, small, small_batches

#: What components are multiplied by.
SCALE = 256
#: Ratio of lengths within a bucket; cells of a block and of a packed row of anchors.
RATIO, BLOCK_CELLS, ANCHOR_CELLS = 1.25, 1 << 20, 1 << 16
#: Coordinates of an anchor that select, rows of a block that give the first threshold, anchors that are verified together.
FOCUS, FIRST_ROWS, TOGETHER = 4, 256, 64
SLACK = 1e-7
#: Positives of an anchor, negatives of a positive, and the per cents of a positive's score that bound them.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90


def usable(rows: DataFrame, key: str, vector: str, label: str, scale: int = SCALE) -> DataFrame:
    """key, label, q (array of longs), dim and length of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))  # not a number compares as larger
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col(key).cast("long").alias("key"), F.struct(F.col(label).cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("q")).alias("row"))
    rows = rows.groupBy("key").agg(F.min("row").alias("row")).select("key", "row.*")
    return rows.withColumns({"dim": F.size("q"), "length": F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))})


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row for each of a column's arrays, which are equally long."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), len(flat) // len(column))


def _packed(lists: bool, extra: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Packs a group into one row: keys, labels and vectors as little-endian longs, by key; ``lists`` adds, for each coordinate, the rows
    in the order of its normalised value."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        dim = group.column("dim")[0].as_py()
        q = _matrix(group.column("q"))
        found = {"dim": dim, "block": group.column("block")[0].as_py(), "n": len(q), "keys": group.column("key").to_numpy().astype("<i8").tobytes(), "labels": group.column("label").to_numpy().astype("<i8").tobytes(), "q": q.astype("<i8").tobytes()}
        if lists:
            found["lists"] = np.argsort(normalised(q), axis=0, kind="stable").T.astype("<i4").tobytes()
        for name in extra:
            found[name] = _matrix(group.column(name)).astype("<i8").tobytes()
        return pa.Table.from_pylist([found], pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in list(found)[3:])]))

    return pack


def lengths(q: np.ndarray) -> np.ndarray:
    return np.sqrt((q.astype(float) ** 2).sum(axis=1))


def normalised(q: np.ndarray) -> np.ndarray:
    return q / np.maximum(lengths(q), 1)[:, None]


def packed(rows: DataFrame, cells: int, what: str, lists: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` in packed rows of about ``cells`` cells, of one dimension and one bucket of lengths each; numbered from 0 in each
    dimension; saved."""
    bucket = F.when(F.col("length") == 0, -1).otherwise(F.floor(F.log("length") / math.log(RATIO))).cast("int")
    rows = rows.withColumn("bucket", bucket)
    # A row a dimension and bucket: a few thousand for each dimension at most.
    sizes = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") * F.greatest("dim", F.lit(1)) / cells).cast("long"))
    starts = saved(sizes.withColumn("start", F.sum("parts").over(W.partitionBy("dim").orderBy("bucket")) - F.col("parts")).select("dim", "bucket", "start", "parts"), f"{what}-parts")
    rows = rows.join(small(starts), ["dim", "bucket"]).withColumn("block", F.col("start") + F.pmod(F.xxhash64("key"), F.col("parts")))
    kinds = "dim int, block long, n int, keys binary, labels binary, q binary" + ", lists binary" * lists + "".join(f", {c} binary" for c in extra)
    out = saved(rows.groupBy("dim", "block").applyInArrow(_packed(lists, list(extra)), kinds), what)
    forget(rows.sparkSession, starts)
    return out


def met(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every block with every packed row of anchors of its dimension."""
    numbers = blocks.groupBy("dim").agg(F.max("block").alias("last"))
    asking = anchors.join(F.broadcast(numbers), "dim").drop("block")  # a row a dimension
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
    named = asking.select("dim", "block", *[F.col(c).alias(f"a_{c}") for c in asking.columns if c not in ("dim", "block")])
    return blocks.join(named, ["dim", "block"])


class Block:
    """A block's rows and coordinate lists."""

    def __init__(self, row: dict):
        self.n, self.dim = row["n"], row["dim"]
        self.keys, self.labels = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.q = np.frombuffer(row["q"], "<i8").reshape(self.n, self.dim)
        self.lists = np.frombuffer(row["lists"], "<i4").reshape(self.dim, self.n)
        own = lengths(self.q)
        self.shortest, self.longest = own.min(), own.max()
        self.unit = normalised(self.q)
        self.exact = self.q.astype(float)
        self.sorted = np.take_along_axis(self.unit.T, self.lists, axis=1)

    def scores(self, rows: np.ndarray | slice, asked: np.ndarray) -> np.ndarray:
        """Exact inner products of some rows and of anchors."""
        most = self.longest * max(1.0, lengths(asked).max(initial=0))
        if most < 2**52:
            return np.rint(self.exact[rows] @ asked.T.astype(float)).astype(np.int64)
        if most >= 2**63:
            raise ValueError("scores pass 63 bits")
        return self.q[rows] @ asked.T

    def candidates(self, asked: np.ndarray, least: float) -> np.ndarray:
        """The rows within the ranges of an anchor's largest coordinates, hence all with a score of ``least`` or more."""
        length = math.sqrt(float((asked.astype(float) ** 2).sum()))
        other = self.longest if least > 0 else self.shortest
        if length == 0 or other == 0:
            return np.arange(self.n if least <= 0 else 0)
        need = least / (length * other)
        if need > 1 + SLACK:
            return np.arange(0)
        turn = math.acos(max(-1.0, min(1.0, need))) + SLACK
        unit = asked / length
        ranges = []
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = math.acos(max(-1.0, min(1.0, unit[f])))
            low, high = math.cos(min(math.pi, own + turn)) - SLACK, math.cos(max(0.0, own - turn)) + SLACK
            ranges.append((np.searchsorted(self.sorted[f], low, "left"), np.searchsorted(self.sorted[f], high, "right"), f, low, high))
        ranges.sort(key=lambda r: r[1] - r[0])
        start, end, f = ranges[0][:3]
        found = self.lists[f, start:end]
        for _, _, f, low, high in ranges[1:]:
            value = self.unit[found, f]
            found = found[(value >= low) & (value <= high)]
        return found

    def verified(self, asked: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each anchor its number, its candidates and their scores."""
        for at in range(0, len(asked), TOGETHER):
            group = asked[at : at + TOGETHER]
            found = [self.candidates(a, t) for a, t in zip(group, least[at : at + TOGETHER])]
            most = sum(map(len, found)) > self.n * len(group) // 4
            scores = self.scores(slice(None), group) if most else None
            for i, rows in enumerate(found):
                yield at + i, rows, scores[rows, i] if most else self.scores(rows, group[i : i + 1])[:, 0]


def first(scores: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest scores, ties by the smaller key."""
    at = np.arange(len(scores))
    if len(scores) > n:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - n)[len(scores) - n])
    return at[np.lexsort([keys[at], -scores[at]])[:n]]


def _searching(search: Callable[[Block, dict], Iterator[tuple]], schema: list[str]):
    def run(batches):
        block, name = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["dim"], row["block"]) != name:
                    block, name = Block(row), (row["dim"], row["block"])
                found = list(search(block, row))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * len(schema), schema)

    return run


def searched(pairs: DataFrame, search: Callable[[Block, dict], Iterator[tuple]], columns: list[str]) -> DataFrame:
    small_batches(pairs.sparkSession)
    return pairs.mapInArrow(_searching(search, columns), ", ".join(f"{c} long" for c in columns))


def _asked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["a_keys"], "<i8"), np.frombuffer(row["a_labels"], "<i8"), np.frombuffer(row["a_q"], "<i8").reshape(row["a_n"], row["dim"])


def positives_of(n: int) -> Callable[[Block, dict], Iterator[tuple]]:
    def search(block: Block, row: dict) -> Iterator[tuple]:
        keys, labels, asked = _asked(row)
        alike = lambda rows, i: (block.labels[rows] == labels[i]) & (block.keys[rows] != keys[i])
        begun = block.scores(slice(0, FIRST_ROWS), asked)
        own = alike(slice(0, FIRST_ROWS), np.arange(len(keys))[:, None]).T if block.n else np.zeros(begun.shape, bool)
        least = np.full(len(keys), -np.inf)
        if len(begun) >= n:
            least = np.partition(np.where(own, begun.astype(float), -np.inf), len(begun) - n, axis=0)[len(begun) - n]
        for i, rows, scores in block.verified(asked, least):
            same = alike(rows, i)
            rows, scores = rows[same], scores[same]
            for at in first(scores, block.keys[rows], n):
                yield int(keys[i]), int(block.keys[rows[at]]), int(scores[at])

    return search


def negatives_of(n: int, low: int, high: int) -> Callable[[Block, dict], Iterator[tuple]]:
    def search(block: Block, row: dict) -> Iterator[tuple]:
        keys, labels, asked = _asked(row)
        of, scored = (np.frombuffer(row[f"a_{c}"], "<i8").reshape(len(keys), -1) for c in ("positives", "positive_scores"))
        # Whole scores within the bounds; none where they cross.
        lows, highs = -(-low * scored // 100), high * scored // 100
        asks = (of >= 0) & (lows <= highs)
        begun = block.scores(slice(0, FIRST_ROWS), asked).astype(float)
        other = block.labels[:FIRST_ROWS, None] != labels[None, :]
        least = np.where(asks, lows.astype(float), np.inf)
        if len(begun) >= n:
            for j in range(of.shape[1]):
                within = np.where(other & (begun <= highs[:, j]), begun, -np.inf)
                least[:, j] = np.maximum(least[:, j], np.partition(within, len(begun) - n, axis=0)[len(begun) - n])
        some = np.flatnonzero(asks.any(axis=1))
        for place, rows, scores in block.verified(asked[some], least[some].min(axis=1)):
            i = some[place]
            unlike = block.labels[rows] != labels[i]
            rows, scores = rows[unlike], scores[unlike]
            for j in np.flatnonzero(asks[i]):
                at = np.flatnonzero((scores >= lows[i, j]) & (scores <= highs[i, j]))
                for k in at[first(scores[at], block.keys[rows[at]], n)]:
                    yield int(keys[i]), int(of[i, j]), int(block.keys[rows[k]]), int(scored[i, j]), int(scores[k])

    return search


def mined(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row of the condition ``anchors`` (over ``key``, the
    key as a long) and each of its positives, the first rows of other labels whose scores are ``low`` to ``high`` per cent of
    the positive's."""
    spark = rows.sparkSession
    known = saved(usable(rows, key, vector, label), "negatives-rows")
    asking = known.where(anchors)
    blocks, asked = packed(known, BLOCK_CELLS, "negatives-blocks", lists=True), packed(asking, ANCHOR_CELLS, "negatives-anchors")
    best = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = searched(met(blocks, asked), positives_of(positives), ["anchor_id", "positive_id", "positive_score"])
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    each = near.groupBy(F.col("anchor_id").alias("key")).agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("x"))  # so many at most
    filled = lambda c, rest: F.transform(F.sequence(F.lit(1), F.lit(positives)), lambda j: F.coalesce(F.try_element_at(F.col("x"), j)[c], F.lit(rest).cast("long")))
    each = saved(each.select("key", filled("positive_id", -1).alias("positives"), filled("positive_score", 0).alias("positive_scores")), "negatives-positives")
    wanting = packed(asking.join(each, "key"), ANCHOR_CELLS, "negatives-wanted", extra=("positives", "positive_scores"))
    found = searched(met(blocks, wanting), negatives_of(negatives, low, high), ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])
    best = W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    out = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = saved(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    for table in (known, blocks, asked, each, wanting):
        forget(spark, table)
    return out
