"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most two bits share a variant that differs from each in at most one. Every
distinct fingerprint therefore emits its 65 variants; a variant's group is kept as a mask of the bits in which its members
differ from it, so it has a fixed size however many documents share a fingerprint, and never more than 65 members. Members
of a group are linked to its least one (and verified), which joins the same components as all pairs would. Components are
found by alternating large-star and small-star steps.

Defined results: null and empty texts and texts without words have fingerprint 0 and are linked like any other; fewer words
than a shingle has make one shingle; equal rows are in one component; a component's id is its least key that isn't null,
null if all are; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import forget, renamed, saved, slices, small_batches

#: Words in a shingle.
SHINGLE = 3
SEED = 42
_CHUNK = 1 << 16


def fingerprint(raw: bytes | None, n: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned SimHash of a text's UTF-8 bytes: majority bits of XXH64 over word shingles, A-Z in lower case."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    n = min(n, len(words))
    starts, ends = (ends - size)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist()
    h, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array([h(text[a:b], seed) for a, b in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def _prints(n: int, seed: int):
    def run(batches):
        for b in slices(batches, "raw"):
            prints = np.array([fingerprint(x, n, seed) for x in b.column("raw").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(prints)], [*b.schema.names[:-1], "fp"])

    return run


def fingerprints(docs: DataFrame, keep: list, text: str = "text", n: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a long."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).cast("binary").alias("raw"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_prints(n, seed), f"{kinds}, fp long")


def links(prints: DataFrame, bits: int = 64) -> DataFrame:
    """Verified links (a, b), a < b, of distinct fingerprints: every pair within two of the low ``bits`` bits is connected by them; what
    stands above these must be equal."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    balls = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("bit")).select(
        F.when(F.col("bit") < bits, F.col("fp").bitwiseXOR(one)).otherwise(F.col("fp")).alias("variant"),
        F.when(F.col("bit") < bits, one).otherwise(F.lit(0).cast("long")).alias("mask"),
        (F.col("bit") == bits).cast("int").alias("itself"),
    )
    groups = balls.groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("itself").alias("itself")).where(F.bit_count("mask") + F.col("itself") > 1)
    differing = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit("mask", i) == 1)
    members = F.concat(
        F.transform(differing, lambda i: F.col("variant").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
        F.when(F.col("itself") == 1, F.array("variant")).otherwise(F.array().cast("array<bigint>")),
    )
    return (
        groups.select(members.alias("members"))
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .distinct()
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge (a, b); root is the least node reachable.

    Large-star and small-star steps alternate until nothing changes, so the number of rounds grows with the logarithm of a
    component's diameter. Minima are partial aggregates and edges join them back, so a node may have any number of edges.
    """
    spark, now = edges.sparkSession, saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")
    before = None
    for _ in range(rounds):
        stamp = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stamp == before:
            break
        before = stamp
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).withColumn("root", F.least("node", "root"))
        large = both.where("b > a").join(least, F.col("a") == F.col("node")).select(F.col("root").alias("a"), "b")
        large = saved(large.where("a < b").distinct(), "links")
        least = large.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
        star = large.join(least, F.col("b") == F.col("node")).select(F.col("root"), F.col("a").alias("other")).where("root < other")
        new = saved(star.select(F.col("root").alias("a"), F.col("other").alias("b")).union(least.select(F.col("root").alias("a"), F.col("node").alias("b"))).distinct(), "links")
        forget(spark, now)
        forget(spark, large)
        now = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def grouped(prints: DataFrame, least: DataFrame) -> DataFrame:
    """(fp, least): for every fingerprint the least of the column ``least`` over its component. ``prints`` is saved, a row a document."""
    own = saved(prints.groupBy("fp").agg(F.min(least).alias("least")), "prints")
    roots = saved(components(links(own.select("fp"))), "roots")
    named = own.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    return named.select("fp", "root").join(named.groupBy("root").agg(F.min("least").alias("least")), "root").select("fp", "least")


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint as 16 hexadecimal digits, component_id."""
    prints = saved(fingerprints(docs, [F.col(key)], text), "simhash")
    groups = grouped(prints, F.col(key))
    return prints.join(groups, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one of least key, of its least text digest; of equal ones any."""
    rows, name = renamed(docs)
    key, text = name[key], name[text]
    own = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(key).isNull().alias("_none"), F.xxhash64(F.col(text)).alias("_digest")]
    prints = saved(fingerprints(rows, [F.col(key).alias("least"), *own], text, n), "simhash")
    kept = grouped(prints, F.struct("_none", "least", "_digest", "_key")).select("least._key", "least._none", "least._digest").distinct()
    kept = rows.select("*", *own).join(kept, ["_key", "_none", "_digest"], "left_semi").dropDuplicates(["_key", "_none", "_digest"])
    return kept.select(*rows.columns).toDF(*docs.columns)
