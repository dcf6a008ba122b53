"""Near copies by the Jaccard index of their five-word shingles: SimHash by ball hashing, as in ``simhash``, finds candidates, MinHash
bands find those too far apart for it, and the shingles verify both.

Distinct texts whose shingles have a Jaccard index of at least ``LEAST`` are linked; of each connected component one row stays.
A text has ``PRINTS`` SimHash fingerprints of ``BITS`` bits, each of other bits of its shingles' hashes. Texts one of whose
fingerprints differ in two bits or fewer are candidates: at an index of 0.95 nearly all pairs, at 0.8, where 15 in 100 bits differ,
about 6 in 10. A text's MinHash has ``BANDS`` bands of ``ROWS`` values, and texts that share a band are in a bucket: at an index of 0.8 a
pair shares none with a probability of 7 in 100,000, above it with less. Every pair of a bucket counts, not only those with one
member, but pairs within what is known to be one component needn't be looked at. So there are two passes, each of which verifies
exactly, then joins components:

1. the links of the balls (those of equal fingerprints with the least text, that with those of the fingerprints around), and each
   member of a bucket with its least one, which links nearly all groups of near copies, however large;
2. in buckets that still have several components, all pairs of different components whose MinHashes agree to ``LEAST_LIKE`` at
   least (four standard errors below ``LEAST``), the likest first. They are compared in tiles of ``BLOCK`` by ``BLOCK`` members or
   ``HELD`` shingles, so that a large bucket is many tasks. A tile has its members' shingles and hands on only the links that join
   components, fewer than it has members, so that pairs are never rows.

Defined results: a null text is the empty one; texts without words have one shingle, the empty one; fewer words than a shingle
has make one shingle; words are as in ``simhash``, A-Z in lower case; the row kept is the one of least key, nulls last, of its
least text digest; of equal ones any; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import renamed, saved, slices, small, small_batches
from lociweave.llm.simhash import components, links

#: Words in a shingle.
SHINGLE = 5
#: The least Jaccard index of a link, as a fraction.
LEAST = (4, 5)
#: SimHash fingerprints of a text, and bits of each.
PRINTS, BITS = 8, 32
BANDS, ROWS = 24, 5
LEAST_LIKE = 0.65
#: Members of a bucket, and shingles of all of them, that a tile has on each side, about.
BLOCK, HELD = 1024, 4 << 20
_CHUNK = 1 << 12
_MIX = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
_XOR, _TIMES = _MIX[0], _MIX[1] | np.uint64(1)
_SEEDS = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 64, PRINTS * BITS // 64, np.uint64)
_ROUNDS = [(np.uint64(shift), np.uint64(times)) for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))]


def shingles(raw: bytes | None) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles."""
    words = (raw or b"").lower().split()
    n = max(1, min(SHINGLE, len(words)))
    text, h = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    return np.unique(np.array([h(text[a:b]) for a, b in zip(starts, ends)] or [h(b"")], np.uint64))


def minhash(found: np.ndarray) -> np.ndarray:
    """The ``BANDS`` * ``ROWS`` least values of a text's shingles."""
    return np.min([((found[at : at + _CHUNK] ^ _XOR) * _TIMES).min(1) for at in range(0, len(found), _CHUNK)], axis=0)


def fingerprints(found: np.ndarray) -> np.ndarray:
    """The ``PRINTS`` SimHash fingerprints of a text's shingles, as longs with the fingerprint's number above its bits."""
    counts = np.zeros(PRINTS * BITS, np.int64)
    for at in range(0, len(found), _CHUNK):
        mixed = found[at : at + _CHUNK, None] + _SEEDS
        for shift, times in _ROUNDS:
            mixed = (mixed ^ (mixed >> shift)) * times
        counts += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(counts * 2 > len(found), bitorder="little").view("<u4").astype(np.int64) | (np.arange(PRINTS) << BITS)


def _sketched(batches):
    h = xxhash.xxh64_intdigest
    for b in slices(batches, "raw"):
        sizes, prints, bands, sketches = [], [], [], []
        for raw in b.column("raw").to_pylist():
            found = shingles(raw)
            least = minhash(found)
            sizes.append(len(found))
            prints.append(fingerprints(found))
            bands.append(np.array([h(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64))
            sketches.append((least >> np.uint64(8)).astype("<u2").tobytes())
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], [*b.schema.names[:-1], "n", "prints", "bands", "sketch"])


def _shingled(batches):
    for b in slices(batches, "raw", 1 << 18):
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(x).view(np.int64) for x in b.column("raw").to_pylist()], pa.list_(pa.int64()))], ["id", "own"])


def shingled(ids: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """id, own: the shingles of ``ids``; saved. ``texts`` has _key, _none, id and raw, a row a document; ``reps`` names the document
    that stands for an id."""
    named = saved(reps.join(ids, "id", "left_semi"), "near-nodes")
    chosen = texts.join(small(named, 4_000_000), ["_key", "_none", "id"], "left_semi").select("id", "raw").dropDuplicates(["id"])
    return saved(chosen.mapInArrow(_shingled, "id long, own array<long>"), "near-shingles")


def verified(pairs: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Of pairs (a, b) of ids, a saved table, those whose shingles are like enough; saved."""
    sets = shingled(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), texts, reps)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("all"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return saved(both.where(F.col("shared") * LEAST[1] >= (F.col("all") - F.col("shared")) * LEAST[0]).select("a", "b"), "near-links")


def joining(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links (a, b) of members (id, root, n, sketch, shingles) of two blocks that join their components."""
    ids, roots, sizes = (np.array([r[i] for r in right]) for i in range(3))
    sketches = np.array([np.frombuffer(r[3], "<u2") for r in right])
    owns = np.array([r[1] for r in left])
    out = []
    for i, (own, _, n, sketch, mine) in enumerate(left):
        like = (sketches == np.frombuffer(sketch, "<u2")).mean(1)
        fit = (like >= LEAST_LIKE) & (roots != owns[i]) & (np.minimum(sizes, n) * LEAST[1] >= np.maximum(sizes, n) * LEAST[0])
        for j in sorted(np.flatnonzero(fit).tolist(), key=lambda j: -like[j]):
            if roots[j] == owns[i]:
                continue
            shared = len(np.intersect1d(mine, right[j][4], assume_unique=True))
            if shared * LEAST[1] >= (n + sizes[j] - shared) * LEAST[0]:
                out.append((min(own, int(ids[j])), max(own, int(ids[j]))))
                was, now = roots[j], owns[i]
                roots[roots == was] = now
                owns[owns == was] = now
    return out


def _alike(batches):
    """Rows come sorted by tile; a tile may go on in the next batch."""
    tile, rows = None, []

    def links():
        left = [r[1:] for r in rows if r[0] == tile[1]]
        right = left if tile[1] == tile[2] else [r[1:] for r in rows if r[0] == tile[2]]
        found = joining(left, right) if left and right else []
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        owns = batch.column("own")
        for i, (bucket, u, v, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "u", "v", "block", "id", "root", "n", "sketch")))):
            if (bucket, u, v) != tile:
                if tile:
                    yield links()
                tile, rows = (bucket, u, v), []
            rows.append((*row, owns[i].values.to_numpy()))
    if tile:
        yield links()


def across(members: DataFrame, roots: DataFrame, prints: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links (a, b), a < b, that join components of one bucket; saved."""
    named = saved(members.join(roots, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("root", "id").alias("root")), "near-roots")
    # A bucket of two has had its pair verified by the first pass.
    mixed = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("size > 2 AND lo < hi")
    held = saved(named.join(saved(mixed.select("bucket", "size"), "near-mixed"), "bucket").join(prints.select("id", "n", "sketch"), "id"), "near-mixed-members")
    blocks = held.groupBy("bucket").agg(F.greatest(F.ceil(F.max("size") / BLOCK), F.ceil(F.sum("n") / HELD)).cast("int").alias("blocks"))
    rows = held.join(saved(blocks, "near-blocks"), "bucket").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = rows.select("bucket", F.least("block", "other").alias("u"), F.greatest("block", "other").alias("v"), "block", "id", "root", "n", "sketch")
    tiles = tiles.join(shingled(held.select("id").distinct(), texts, reps), "id")
    return saved(tiles.repartition("bucket", "u", "v").sortWithinPartitions("bucket", "u", "v").mapInArrow(_alike, "a long, b long").distinct(), "near-links")


def likely(n: str, other: str) -> Column:
    """Whether sets of such sizes can be near copies."""
    return F.least(n, other) * LEAST[1] >= F.greatest(n, other) * LEAST[0]


def balls(prints: DataFrame) -> DataFrame:
    """Candidates (a, b), a < b: the links of fingerprints within two bits, and texts of equal fingerprints with the least of them."""
    each = prints.select("id", "n", F.explode("prints").alias("fp"))
    heads = saved(each.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")), "near-heads")
    near = saved(links(heads.select("fp"), BITS), "near-balls")
    ends = [heads.select(F.col("fp").alias(c), F.col("first.id").alias(f"{c}_id"), F.col("first.n").alias(f"{c}_n")) for c in "ab"]
    around = near.join(ends[0], "a").join(ends[1], "b").where(likely("a_n", "b_n")).select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    shared = small(saved(heads.where("first.id < last").select("fp", "first"), "near-shared"))
    equal = each.join(shared, "fp").where((F.col("id") > F.col("first.id")) & likely("n", "first.n")).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    return around.where("a < b").union(equal)


def rooted(prints: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root) of every id with a verified link. ``prints`` is saved: id, first, n, prints, bands and sketch of each distinct text."""
    each = prints.select("id", "n", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("bucket"), "id", "n")
    leaders = each.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("first"), F.max("id").alias("last")).where("first.id < last").select("bucket", "first")
    held = saved(each.join(saved(leaders, "near-buckets"), "bucket"), "near-members")
    leading = held.where((F.col("id") > F.col("first.id")) & likely("n", "first.n")).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    known = saved(balls(prints).union(leading).distinct(), "near-pairs")
    reps = prints.select("first._key", "first._none", "id")
    edges = verified(known, texts, reps)
    roots = saved(components(edges), "near-components")
    found = across(held.select("bucket", "id"), roots, prints, texts, reps)
    if found.isEmpty():
        return roots
    # Links between components join their roots.
    named = lambda d, c: d.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    joined = saved(components(named(named(found, "a"), "b").where("a <> b").distinct()), "near-joined")
    every = roots.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return saved(every.union(joined.join(roots.select("node"), "node", "left_anti")), "near-components")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies."""
    small_batches(docs.sparkSession)
    names = docs.columns
    docs, name = renamed(docs)
    key, text = name[key], name[text]
    own = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(key).isNull().alias("_none"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_digest")]
    rows = docs.select(F.col(key).alias("least"), *own, F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    first = saved(rows.groupBy(F.col("_digest").alias("id")).agg(F.min(F.struct("_none", "least", "_digest", "_key")).alias("first")), "near-firsts")
    each = rows.mapInArrow(_sketched, f"{kinds}, n int, prints array<long>, bands array<long>, sketch binary").select(F.col("_digest").alias("id"), "n", "prints", "bands", "sketch")
    sketched = each.groupBy("id").agg(*[F.any_value(c).alias(c) for c in ("n", "prints", "bands", "sketch")])
    prints = saved(sketched.join(first, "id"), "near-prints")
    roots = rooted(prints, rows.withColumnRenamed("_digest", "id"))
    named = first.join(roots, F.col("id") == F.col("node"), "left").select(F.coalesce("root", "id").alias("root"), "first")
    kept = saved(named.groupBy("root").agg(F.min("first").alias("first")).select("first._key", "first._none", "first._digest"), "near-kept")
    # Rows of one key and text, of which one stays, are rare: only they are moved to be told apart.
    same = ["_key", "_none", "_digest"]
    twice = saved(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").join(kept, same, "left_semi").select(*same), "near-twice")
    chosen = docs.select("*", *own).join(small(kept, 4_000_000), same, "left_semi")
    if not twice.isEmpty():
        chosen = chosen.join(small(twice), same, "left_anti").unionByName(chosen.join(small(twice), same, "left_semi").dropDuplicates(same))
    return chosen.select(*docs.columns).toDF(*names)
