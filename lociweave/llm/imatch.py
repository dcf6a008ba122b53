"""I-Match document fingerprints: a document's distinct terms within a band of inverse document frequency, sorted and hashed: all of
them, and those that each of several randomised lexicon subsets keeps.

Terms are lower-case runs of letters and digits, by their 64-bit hash. Document frequencies count distinct texts, so that a large
group of copies doesn't make its terms common. A term is in the band if two distinct texts at least and ``MOST_SHARE`` of them at most
have it. The band is of any size: it is broadcast where it is small, and else joined by shuffle.

Each of ``SUBSETS`` lexicons keeps at level l a random 1 in 4^l of the band's terms, and of those 1 in 4 at the next level. A
fingerprint has the signature of all terms, and those of each lexicon at the level at which it keeps about one of the document's
terms (half a term to two) and at the next, so that a long and a short document both have signatures that a small change leaves
alone. A signature is the 64-bit hash of the terms in order of their hashes.

The likeness of two fingerprints is 1 if they are equal; else the share of the lexicons, at the levels that both have and in which
either keeps terms, whose signatures are equal. It is a mean of some 10 to 32 such outcomes. A document with no term in the band is
fingerprinted by the hash of its text, and its likeness is 1 or 0.

Documents are put in order within parts of the key range that have about ``PART_ROWS`` rows each, between approximate quantiles; the
first document of a part is also sent to the part before, as the one that follows its last.

Defined results: a null text is the empty one; equal texts have equal fingerprints, and likeness 1; keys are numbers, nulls
first, equal keys follow each other by their text's digest and share a part; equal rows are all kept; the only document is its
own next one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import saved, small

#: Lexicons, and their levels after the whole.
SUBSETS, LEVELS = 16, 7
LEAST_DOCS = 2
MOST_SHARE = 0.05
#: Band terms, and bytes of them, that are broadcast at most.
BROADCAST_TERMS, BROADCAST_BYTES = 2_000_000, 32 << 20
#: Rows that are put in order together, about, and the most parts.
PART_ROWS, MOST_PARTS = 2_000, 1_000_000
#: Separates terms.
SEPARATOR = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The distinct terms of a text, as 64-bit hashes."""
    words = F.filter(F.split(F.lower(text), SEPARATOR), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def part_of(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the key, looked up among every few of them first; 0 for a null key, others from 1."""
    kind = "array<decimal(38,10)>" if any(isinstance(b, Decimal) for b in bounds) else "array<double>" if any(isinstance(b, float) for b in bounds) else "array<bigint>"
    step = max(1, math.isqrt(len(bounds)))
    text = lambda x: json.dumps(x, default=str)
    few = F.from_json(F.lit(text(bounds[::step])), kind)
    rest = F.from_json(F.lit(text([[], *(bounds[i + 1 : i + step] for i in range(0, len(bounds), step))])), f"array<{kind}>")
    passed = F.size(F.filter(few, lambda x: x <= key))
    within = F.size(F.filter(F.element_at(rest, passed + 1), lambda x: x <= key))
    return F.when(key.isNull(), 0).otherwise(1 + F.when(passed > 0, (passed - 1) * step + 1 + within).otherwise(0))


def parted(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with ``part``, an ascending number for ranges of the key, and ``also``: the part before if the key is its part's first."""
    parts = min(MOST_PARTS, -(-docs.count() // PART_ROWS))
    bounds = []
    if parts > 1:
        shares = [i / parts for i in range(1, parts)]
        bounds = sorted(set(docs.agg(F.percentile_approx(key, shares, 20 * parts)).first()[0] or []))  # so many numbers
    rows = docs.withColumn("part", (part_of(F.col(key), bounds) if bounds else F.when(F.col(key).isNull(), 0).otherwise(1)).cast("long"))
    # A row a part; the last part comes before the first.
    firsts = rows.groupBy("part").agg(F.min(key).alias("_first"))
    befores = firsts.withColumn("_before", F.coalesce(F.lag("part").over(W.partitionBy().orderBy("part")), F.max("part").over(W.partitionBy())))
    rows = rows.join(F.broadcast(saved(befores, "imatch-parts")), "part")
    return rows.withColumn("also", F.when(F.col(key).eqNullSafe(F.col("_first")), F.col("_before"))).drop("_first", "_before")


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: part, row, key, digest, n_chars, its edited text, and the next document's key and digest; dealt by part.

    The edited text's last quarter (rounded down, in code points) is the first as many of the next document, or all it has.
    """
    rows = parted(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), "key").withColumn("digest", F.xxhash64("text"))
    places = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("copy")), F.when(F.col("also").isNotNull(), F.struct(F.col("also").alias("part"), F.lit(True).alias("copy")))))
    rows = rows.select("key", "digest", "text", F.explode(places).alias("place")).select("place.part", "place.copy", "key", "digest", "text")
    order = W.partitionBy("part").orderBy("copy", F.col("key").asc_nulls_first(), "digest")
    following = F.lead(F.struct("key", "digest", "text")).over(order)
    rows = rows.withColumn("row", F.row_number().over(order)).withColumn("next", following).where("NOT copy")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    return rows.select(
        "part", "row", "key", "digest", "text", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.text", F.lit(1), quarter)).alias("edited"),
        F.col("next.key").alias("next_key"), F.col("next.digest").alias("next_digest"),
    )


def lexicon(docs: DataFrame, text: str = "text", least: int = LEAST_DOCS, share: float = MOST_SHARE) -> DataFrame:
    """The band's terms, from the document frequencies of all distinct texts' terms; saved."""
    body = F.coalesce(F.col(text), F.lit(""))
    digests = docs.select(F.xxhash64(body).alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    n = digests.count()
    # A text of several copies counts as one, split over them.
    copied = small(saved(digests.where("copies > 1"), "imatch-copies"))
    rows = docs.select(body.alias("text"), F.xxhash64(body).alias("digest")).join(copied, "digest", "left")
    each = rows.select(F.explode_outer(terms(F.col("text"))).alias("term"), (1.0 / F.coalesce("copies", F.lit(1))).alias("weight")).where("term IS NOT NULL")
    counts = each.groupBy("term").agg(F.round(F.sum("weight")).cast("long").alias("df"))
    return saved(counts.where(F.col("df").between(least, max(least, int(n * share)))).select("term"), "imatch-band")


def level(n: Column) -> Column:
    """The level at which a lexicon keeps about one of so many terms."""
    return F.least(F.greatest(F.lit(1), F.round(F.log(4.0, F.greatest(n, F.lit(1)).cast("double")))), F.lit(LEVELS - 1)).cast("int")


def hashed(terms: str, of: int) -> Column:
    """The terms of a column with a mark and the bits of four lexicons a word."""
    return F.transform(terms, lambda x: F.struct(x.alias("term"), F.lit(of).alias("of"), *[F.xxhash64(x, F.lit(100 + i)).alias(f"h{i}") for i in range(SUBSETS // 4)]))


def kept(terms: Column, j: int, mask: Column, of: int = -1) -> Column:
    """Of hashed terms those that lexicon j keeps: those with zeros in the bits of its own that the mask has; of a mark, or of none."""
    def own(x: Column) -> Column:
        zeros = F.shiftrightunsigned(x[f"h{j // 4}"], 16 * (j % 4)).bitwiseAND(mask) == 0
        return zeros if of < 0 else zeros & x["of"].isin(0, of)

    return F.filter(terms, own)


def signature(terms: Column) -> Column:
    """The hash of a set of terms in order; 0 for none."""
    return F.when(F.size(terms) > 0, F.xxhash64(F.array_sort(terms))).otherwise(F.lit(0).cast("long"))


def signed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fp`` and ``other_fp``: level, and the signatures of all terms and of the lexicons at that level and at the next. Terms
    are in the columns both (of either text), own and other. Step by step, so that nothing is found twice."""
    sides = {"own": 1, "other": 2}
    mask = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at * 2) - 1
    rows = rows.select("*", *[level(F.size("both") + F.size(side)).alias(f"_at_{side}") for side in sides], F.concat(hashed("both", 0), hashed("own", 1), hashed("other", 2)).alias("_all"))
    rows = rows.select("*", mask(F.least("_at_own", "_at_other")).alias("_mask"), *[mask(F.col(f"_at_{side}") + step).alias(f"_mask{step}_{side}") for side in sides for step in (0, 1)])
    # What a lexicon keeps at a level has what it keeps at the next.
    rows = rows.select("*", F.array(*[kept(F.col("_all"), j, F.col("_mask")) for j in range(SUBSETS)]).alias("_least"))
    for step, before in enumerate(("_least", "_kept0")):
        of = lambda side: F.col(before if step == 0 else f"{before}_{side}")
        rows = rows.select("*", *[F.array(*[kept(of(side)[j], j, F.col(f"_mask{step}_{side}"), mark) for j in range(SUBSETS)]).alias(f"_kept{step}_{side}") for side, mark in sides.items()])

    def whole(side: str) -> Column:
        lists = F.transform(F.concat(f"_kept0_{side}", f"_kept1_{side}"), lambda x: F.transform(x, lambda y: y["term"]))
        terms = F.concat("both", side)
        some = F.struct(F.col(f"_at_{side}").alias("at"), F.concat(F.array(signature(terms)), F.transform(lists, signature)).alias("sigs"))
        return F.when(F.size(terms) > 0, some).otherwise(F.struct(F.lit(-9).alias("at"), F.array().cast("array<bigint>").alias("sigs")))

    return rows.select(*[c for c in rows.columns if not c.startswith("_")], whole("own").alias("fp"), whole("other").alias("other_fp"))


def printed(fp: Column, digest: Column) -> Column:
    """A fingerprint as a string: level and signatures, or without terms its text's digest."""
    text = F.array_join(F.transform(fp["sigs"], lambda x: F.when(x == 0, "").otherwise(F.lower(F.lpad(F.hex(x), 16, "0")))), ".")
    return F.when(fp["at"] < 0, F.concat(F.lit("t."), F.lower(F.hex(digest)))).otherwise(F.concat(F.lit("l"), fp["at"].cast("string"), F.lit("."), text))


def likeness(a: Column, b: Column, same_text: Column) -> Column:
    """1 for equal fingerprints; else the share of lexicons with equal signatures, of those that either has, at the levels both have."""
    part = lambda x, i, n: F.slice(x["sigs"], 2 + i * SUBSETS, n * SUBSETS)
    x = F.when(a["at"] < b["at"], part(a, 1, 1)).when(a["at"] > b["at"], part(a, 0, 1)).otherwise(part(a, 0, 2))
    y = F.when(a["at"] > b["at"], part(b, 1, 1)).when(a["at"] < b["at"], part(b, 0, 1)).otherwise(part(b, 0, 2))
    pairs = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: (p["x"] != 0) | (p["y"] != 0))
    same = F.size(F.filter(pairs, lambda p: p["x"] == p["y"])) / F.size(pairs)
    near = F.when((F.abs(a["at"] - b["at"]) > 1) | (F.size(pairs) <= 0), 0.0).otherwise(same)
    return F.when(F.when(a["at"] < 0, same_text).otherwise(a == b), 1.0).otherwise(near)


def banded(docs: DataFrame, band: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc, what is kept of it, and its terms in the band: in both texts, in its own, in the other, edited one.

    The texts are dealt by part for their order, and terms are gathered by part and row, so that nothing moves again where the band is
    broadcast. Explosions are outer ones, as for others Spark first finds the terms once more to see whether there are any.
    """
    rows = edited(docs, key, text).withColumns({"own": terms(F.col("text")), "other": terms(F.col("edited"))})
    facts = F.struct("key", "digest", "n_chars", "next_key", "next_digest", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_digest"))
    # A row a term of either text: in both, in the own one, in the edited one. The first of a document carries what else it has; that with
    # no term is of no text.
    mark = lambda x, of: F.transform(x, lambda t: F.struct(t.alias("term"), F.lit(of).alias("of")))
    none = F.array(F.struct(F.lit(None).cast("long").alias("term"), F.lit(-1).alias("of")))
    each = F.concat(none, mark(F.array_intersect("own", "other"), 0), mark(F.array_except("own", "other"), 1), mark(F.array_except("other", "own"), 2))
    exploded = rows.select("part", "row", facts.alias("doc"), each.alias("each")).select("part", "row", "doc", F.posexplode_outer("each").alias("place", "x"))
    exploded = exploded.select("part", "row", F.when(F.col("place") == 0, F.col("doc")).alias("doc"), F.col("x.term").alias("term"), F.col("x.of").alias("of"))
    held = exploded.join(band.select("term", F.lit(True).alias("in")), "term", "left").where("in OR of < 0")
    of = lambda *which: F.collect_list(F.when(F.col("of").isin(*which), F.col("term")))
    return held.groupBy("part", "row").agg(F.max("doc").alias("doc"), of(0).alias("both"), of(1).alias("own"), of(2).alias("other"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_DOCS, share: float = MOST_SHARE) -> DataFrame:
    """One row a document: key, n_chars, the edited text's SHA-256, both fingerprints, and the likeness of the document's to
    the edited text's and to the next document's."""
    band = small(lexicon(docs, text, least, share), BROADCAST_TERMS, BROADCAST_BYTES)
    rows = saved(signed(banded(docs, band, key, text)).select("doc.*", "fp", "other_fp"), "imatch-signatures")
    rows = rows.withColumn("no_next", F.col("next_key").isNull()).withColumn("next_key", F.coalesce("next_key", F.lit(0)))
    following = rows.select(F.coalesce("key", F.lit(0)).alias("next_key"), F.col("key").isNull().alias("no_next"), F.col("digest").alias("next_digest"), F.col("fp").alias("next_fp")).dropDuplicates(["next_key", "no_next", "next_digest"])
    return rows.join(following, ["next_key", "no_next", "next_digest"]).select(
        F.col("key").alias(key), "n_chars", "edited_sha256", printed(F.col("fp"), F.col("digest")).alias("fingerprint"), printed(F.col("other_fp"), F.col("edited_digest")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("other_fp"), F.col("digest") == F.col("edited_digest")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), F.col("digest") == F.col("next_digest")).alias("near_next"),
    )
