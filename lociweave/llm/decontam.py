"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

Short items are looked for inside long documents. A MinHash of a whole long document says nothing about a short item in it, so
both sides are partitioned by size: items by their number of shingles in classes (m / 2, m], and for each class documents are
cut into windows of 2 m shingles, m apart, so that an item lies whole in a window not much larger than itself. An item and a
window are a candidate pair if any of ``HASHES`` min-hashes is equal; at containment 0.8 that misses fewer than one of 10,000
(the Jaccard index is 0.19 or more). A window's minima come from minima of the finest class, so that further classes cost little.

A fixed-size bitmap of the items' min-hashes drops nearly all of the windows' hashes where they are made; those left are joined
with the items' exactly. Candidate documents are then read again and each item's exact containment is counted.

Words are lower-case runs of letters, digits and other characters that aren't ASCII punctuation; shingles are five words. An item
of fewer words has one shingle of as many words as it has.

Defined results: null and empty texts and texts without words contain nothing, and such items are in no document; equal items
are each found; a document is found once for each item; rows of an equal key are each looked at, and the key is found if one
contains the item; a null key is found as null; empty tables give no rows; other columns pass through unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import renamed, saved, slices, small, small_batches

SHINGLE = 5
CONTAINED = 0.8
HASHES = 48
#: Bits of the bitmap, as a power of two.
BITMAP = 25
#: Shingles that are hashed at once; longer documents are hashed piece by piece.
PIECE = 1 << 15

_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_rng = np.random.default_rng(7)
_A = _rng.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def shingles(found: list[bytes], n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words, in order, repeats included."""
    if len(found) < n or n < 1:
        return np.zeros(0, np.uint64)
    text, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(size + 1) - 1
    h = xxhash.xxh3_64_intdigest
    return np.array([h(text[a:b]) for a, b in zip((ends - size)[: len(found) - n + 1].tolist(), ends[n - 1 :].tolist())], np.uint64)


def item_shingles(text: str | None, n: int = SHINGLE) -> tuple[int, np.ndarray]:
    """The shingle length and the distinct shingle hashes of an item."""
    own = words(text)
    n = min(n, len(own))
    return n, np.unique(shingles(own, n))


def size_class(n: int) -> int:
    """The least power of two that is at least ``n``."""
    return 1 << max(0, int(n - 1).bit_length())


def _slot(length: int, size: int, j: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for shingle length, size class, hash function and min-hash."""
    seed = np.uint64((length << 40) + (size << 8)) + j.astype(np.uint64)
    return ((low ^ (seed * _MIX)) * _MIX).view(np.int64)


def blocked(h: np.ndarray, size: int) -> np.ndarray:
    """Minima (hash function x block) over the shingles' blocks of ``size``."""
    step = size * max(1, 4096 // size)
    parts = [np.minimum.reduceat(h[at : at + step] * _A[:, None] + _B[:, None], np.arange(0, min(step, len(h) - at), size), axis=1) for at in range(0, len(h), step)]
    return np.concatenate(parts, 1)


def item_slots(text: str | None, n: int = SHINGLE) -> np.ndarray:
    length, h = item_shingles(text, n)
    return _slot(length, size_class(len(h)), np.arange(HASHES), blocked(h, len(h))[:, 0]) if len(h) else np.zeros(0, np.int64)


def window_slots(h: np.ndarray, length: int, sizes: list[int]):
    """For each size class, the slots of all windows of 2 m shingles, m apart, of one document (or of a piece of one)."""
    low, step = blocked(h, sizes[0]), sizes[0]
    for size in sizes:
        while step < size:
            low = np.minimum(low[:, ::2], np.concatenate([low[:, 1::2], low[:, -1:]], 1) if low.shape[1] % 2 else low[:, 1::2])
            step *= 2
        both = np.minimum(low, np.concatenate([low[:, 1:], low[:, -1:]], 1))
        yield _slot(length, size, np.arange(HASHES)[:, None], both)


def _marked(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = slots.view(np.uint64) >> np.uint64(64 - BITMAP)
    return slots[(bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]


def _looked(shared):
    def run(batches):
        bitmap, sizes = shared.value
        for b in slices(batches, "text"):
            rows, found = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                own = words(text)
                hits = []
                for length, classes in sizes.items():
                    # Pieces overlap by a largest window, and start where windows of every class start.
                    piece = max(PIECE, 4 * classes[-1])
                    for at in range(0, max(1, len(own) - length + 1), piece - 2 * classes[-1]):
                        h = shingles(own[at : at + piece + length - 1], length)
                        if len(h):
                            hits += [np.unique(_marked(bitmap, x)) for x in window_slots(h, length, classes)]
                hits = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
                rows.append(np.full(len(hits), i))
                found.append(hits)
            at = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(at)), b.column("digest").take(pa.array(at)), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["key", "digest", "slot"])

    return run


def _sketched(n: int):
    def run(batches):
        for b in slices(batches, "text"):
            own = [(item_shingles(t, n), item_slots(t, n)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("item"), pa.array([x[0][0] for x in own], pa.int32()), pa.array([len(x[0][1]) for x in own], pa.int32()), pa.array([size_class(len(x[0][1])) for x in own], pa.int32()), pa.array([x[0][1].view(np.int64) for x in own], pa.list_(pa.int64())), pa.array([x[1] for x in own], pa.list_(pa.int64()))],
                ["item", "length", "n", "size", "shingles", "slots"],
            )

    return run


def _mapped(batches):
    """Each partition's slots as a bitmap, in pieces that have a bit set."""
    bits = np.zeros(1 << BITMAP >> 3, np.uint8)
    for b in batches:
        at = b.column("slot").to_numpy().view(np.uint64) >> np.uint64(64 - BITMAP)
        np.bitwise_or.at(bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    some = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].astype(np.int16))], ["at", "bits"])


def _verified(kinds: list):
    def run(batches):
        for b in batches:
            keys, ids, ns, shared = [], [], [], []
            texts, pairs = b.column("text").to_pylist(), b.column("items").to_pylist()
            for i, (text, items) in enumerate(zip(texts, pairs)):
                own, cache = words(text), {}
                for it in items:
                    if it["length"] not in cache:
                        cache[it["length"]] = np.unique(shingles(own, it["length"]))
                    keys.append(i)
                    ids.append(it["item"])
                    ns.append(it["n"])
                    shared.append(int(np.isin(np.array(it["shingles"], np.int64).view(np.uint64), cache[it["length"]], assume_unique=True).sum()))
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(keys, pa.int64())), pa.array(ids, kinds[0]), pa.array(ns, pa.int32()), pa.array(shared, pa.int32())], ["key", "item", "n", "shared"])

    return run


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", contained: float = CONTAINED, n: int = SHINGLE) -> DataFrame:
    """key, item, n_shingles, n_shared, containment: the items of which a document has the share ``contained`` or more."""
    spark = docs.sparkSession
    small_batches(spark)
    whole = {"tinyint": "int", "smallint": "int"}.get(kind := items.schema[item].dataType.simpleString(), kind)  # ids of any type are longs, ints or strings
    items = items.withColumn(item, F.col(item).cast(whole if whole in ("int", "bigint") else "string"))
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    rows = items.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    sketches = saved(rows.mapInArrow(_sketched(n), f"item {item_kind}, length int, n int, size int, shingles array<long>, slots array<long>").where("n > 0"), "leak-items")
    slots = saved(sketches.select("item", F.explode("slots").alias("slot")), "leak-slots")

    # A fixed-size bitmap and a row a size class come to the driver, however many items there are.
    bitmap = np.zeros(1 << BITMAP >> 3, np.uint8)
    for r in slots.select("slot").mapInArrow(_mapped, "at int, bits smallint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bitmap[r["at"]] = r["bits"]
    sizes: dict[int, list[int]] = {}
    for r in sketches.select("length", "size").distinct().collect():
        sizes[r["length"]] = sorted([*sizes.get(r["length"], []), r["size"]])

    shared = spark.sparkContext.broadcast((bitmap, sizes))
    looked = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    hits = saved(looked.mapInArrow(_looked(shared), f"key {kind}, digest long, slot long"), "leak-hits")
    pairs = hits.join(small(slots), "slot").select("key", "digest", "item").distinct()
    pairs = saved(pairs.join(small(sketches.drop("slots", "size")), "item").withColumn("_null", F.col("key").isNull()), "leak-pairs")

    wanted = pairs.select(F.coalesce(F.col("key").cast("string"), F.lit("")).alias("_key"), "_null", "digest", F.struct("item", "length", "n", "shingles").alias("it"))
    wanted = wanted.groupBy("_key", "_null", "digest").agg(F.collect_list("it").alias("items"))
    texts = looked.withColumns({"_key": F.coalesce(F.col("key").cast("string"), F.lit("")), "_null": F.col("key").isNull()})
    found = texts.join(small(saved(wanted, "leak-wanted"), 20_000), ["_key", "_null", "digest"]).select("key", "text", "items")
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    found = found.mapInArrow(_verified([item_type]), f"key {kind}, item {item_kind}, n int, shared int")
    found = found.where(F.col("shared") >= F.col("n") * contained).groupBy("key", "item").agg(F.max("n").alias("n_shingles"), F.max("shared").alias("n_shared"))
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "n_shingles", "n_shared", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def cleaned(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    names = docs.columns
    docs, name = renamed(docs)
    found = saved(leaks(docs, items, name[key], name[text], **how).select(F.col(name[key]).alias("_leak")).distinct(), "leak-keys")
    return docs.join(small(found), F.col(name[key]).eqNullSafe(F.col("_leak")), "left_anti").toDF(*names)
