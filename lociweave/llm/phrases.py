"""Phrase collocations from count streams in prefix and in suffix order.

Counts. Tasks count the windows of three words that begin at each word of a piece, and send rows for each distinct word of a slice, with
the words that follow it, those that follow these, and their counts. What follows a word is cut into ``BUCKETS`` by the next word,
so that a frequent word's rows are spread; rows are dealt by word and bucket and added up, so that single words, pairs and triples
have exact counts in one shuffle. Of these, the phrases with at least ``least`` occurrences go on: the parts of such a phrase
have at least as many.

Streams. In prefix order (by first, second, third word) a word stands before the pairs that it begins, and a pair before its
triples; so one pass in lockstep gives every phrase the counts of what it begins with, and every pair its commonest extension to
the right. In suffix order (by last, last but one, ...) the same pass gives the counts of what phrases end with and the extensions
to the left. The order is cut into spans of bounded rows wherever they fall; the word and the pair that stand open at the
start of a span are put before it, one row a span. Both passes are then merge-joined by phrase.

A candidate's score is the least of floor(10^6 a^2 / (l r)) over its cuts, in exact decimals.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each time; ties are ordered by
count and then by the phrase's UTF-8 bytes; words are everything between blanks and tabs, so may hold any other character; an empty
table gives no rows; other columns are not read. A slice is at least one whole text. Counts below 10^15 are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import forget, saved, small, small_batches

#: What cuts a text into pieces, and a piece into words.
PIECES, BLANKS = r"[.,;:!?\n\v\f\r]", "[ \t]+"
#: Least occurrences, words of a phrase, phrases of a language, and the per cent of a phrase's occurrences in a longer one that drop it.
LEAST, TOP, COVERED = 10, 2000, 50
#: Bytes of text that are counted together, rows of a batch, buckets of a word's pairs, rows of a span of a stream, and parts of a
#: language that are ranked first.
COUNTED_BYTES, BATCH_ROWS, BUCKETS, SPAN_ROWS, PARTS = 4 << 20, 1 << 14, 64, 200_000, 64

COUNTS = "lang string, a string, bucket int, follow string"


def windows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of texts, and for each word occurrence its number, those of the two that follow it in its piece (0 for none;
    words count from 1) and the row it stands in."""
    pieces = pc.split_pattern_regex(pc.ascii_lower(texts), PIECES)
    row = pc.list_parent_indices(pieces).to_numpy().astype(np.int32)
    words = pc.split_pattern_regex(pc.list_flatten(pieces), BLANKS)
    piece = pc.list_parent_indices(words).to_numpy().astype(np.int32)
    flat = pc.list_flatten(words)
    held = pc.greater(pc.binary_length(flat), 0)
    piece, coded = piece[held.to_numpy(zero_copy_only=False)], flat.filter(held).dictionary_encode()
    first = coded.indices.to_numpy().astype(np.int32) + 1
    second, third = np.zeros_like(first), np.zeros_like(first)
    second[:-1] = np.where(piece[:-1] == piece[1:], first[1:], 0)
    third[:-2] = np.where(piece[:-2] == piece[2:], first[2:], 0)
    return coded.dictionary, first, second, third, row[piece]


def _lines(words: pa.Array, counts: np.ndarray) -> pa.Array:
    """A word and its count each; a count of 1 is left out."""
    counts = pa.array(counts)
    return pc.if_else(pc.equal(counts, 1), words, pc.binary_join_element_wise(words, counts.cast(pa.string()), " "))


def _joined(lines: pa.Array, owner: np.ndarray, between: str) -> pa.Array:
    """Lines joined by their owners, which ascend and are all numbers from 0."""
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner))]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts), lines), between)


def counted(langs: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows (language, word, bucket, what follows the word): a line a next word of that bucket, which has the next word with how often the
    pair occurs, and after tabs each third word with how often the triple does. Bucket -1 has how often the word itself occurs, and
    that of the empty word all words."""
    vocabulary, first, second, third, row = windows(texts)
    if not len(first):
        return
    names = langs.dictionary_encode()
    n = len(vocabulary) + 1
    words = pa.concat_arrays([pa.array([""], pa.string()), vocabulary])
    bucket = np.array([0, *(zlib.crc32(w.encode()) % BUCKETS for w in vocabulary.to_pylist())])
    lang = names.indices.to_numpy().astype(np.int64)[row]
    totals = np.bincount(lang, minlength=len(names.dictionary))
    single, of_single, n_single = np.unique(lang * n + first, return_inverse=True, return_counts=True)
    del lang, row, first
    paired = second > 0
    pair, of_pair, n_pair = np.unique(of_single[paired] * n + second[paired], return_inverse=True, return_counts=True)
    third = third[paired]
    del of_single, second, paired
    triple, n_triple = np.unique((of_pair * n + third)[third > 0], return_counts=True)
    del of_pair, third
    # Pairs by word and bucket, each with its triples after it.
    place = np.empty(len(pair), np.int64)
    order = np.argsort(pair // n * BUCKETS + bucket[pair % n], kind="stable")
    place[order] = np.arange(len(pair))
    pair, n_pair = pair[order], n_pair[order]
    owner = np.concatenate([np.arange(len(pair)), place[triple // n]])
    order = np.argsort(owner, kind="stable")
    lines = _lines(words.take(pa.array(np.concatenate([pair % n, triple % n])[order])), np.concatenate([n_pair, n_triple])[order])
    lines = _joined(lines, owner[order], "\t") if len(pair) else pa.array([], pa.string())
    group, of_group = np.unique(pair // n * BUCKETS + bucket[pair % n], return_inverse=True)
    follow = _joined(lines, of_group, "\n") if len(pair) else lines
    langs_, heads = np.flatnonzero(totals), single[group // BUCKETS]
    alone = _lines(words.take(pa.array(np.zeros(len(langs_) + len(single), np.int64))), np.concatenate([totals[langs_], n_single]))
    columns = [
        names.dictionary.take(pa.array(np.concatenate([langs_, single // n, heads // n]))),
        words.take(pa.array(np.concatenate([np.zeros(len(langs_), np.int64), single % n, heads % n]))),
        pa.array(np.concatenate([np.full(len(alone), -1), group % BUCKETS]).astype(np.int32)),
        pa.concat_arrays([alone, follow]),
    ]
    batch = pa.RecordBatch.from_arrays(columns, ["lang", "a", "bucket", "follow"])
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def _counting(batches):
    held, size = [], 0

    def flushed():
        rows = pa.Table.from_batches(held)
        held.clear()
        return counted(*(pa.concat_arrays(rows.column(c).chunks) for c in ("lang", "text")))

    for batch in batches:
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= COUNTED_BYTES:
            yield from flushed()
            size = 0
    if held:
        yield from flushed()


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> DataFrame:
    """One row for each word (b and c empty), pair (c empty) and triple with at least ``least`` occurrences in a language, and
    for all words of a language (a empty too): lang, a, b, c, n."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    dealt = rows.mapInArrow(_counting, COUNTS).repartition("lang", "a", "bucket")
    keys = ["lang", "a", "bucket"]
    pairs = dealt.select(*keys, F.explode(F.split("follow", "\n")).alias("line")).select(*keys, F.split("line", "\t").alias("entries"))
    each = pairs.select(*keys, F.substring_index(F.element_at("entries", 1), " ", 1).alias("b"), F.posexplode("entries").alias("place", "entry"))
    n = F.when(F.contains("entry", F.lit(" ")), F.substring_index("entry", " ", -1).cast("long")).otherwise(1)
    each = each.select(*keys, "b", F.when(F.col("place") == 0, "").otherwise(F.substring_index("entry", " ", 1)).alias("c"), n.alias("n"))
    return each.groupBy(*keys, "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= least).drop("bucket")


PASSED = "lang string, a string, b string, c string, one long, two long, extended long"


def _pass(span: pd.DataFrame) -> pd.DataFrame:
    """A span of a stream in order: each phrase with the counts of its first word and of its first two, and each pair with the count of
    its commonest extension as far as the span goes."""
    span = span.sort_values(["lang", "a", "b", "c"])  # code points in order are UTF-8 bytes in order
    n, level = span["n"].to_numpy(), (span["b"] != "").to_numpy().astype(int) + (span["c"] != "").to_numpy()
    at = np.arange(len(span))
    word, pair = (np.maximum.accumulate(np.where(level == k, at, 0)) for k in (0, 1))
    extended = np.zeros(len(span), np.int64)
    np.maximum.at(extended, pair[level == 2], n[level == 2])
    out = span.assign(one=n[word], two=np.where(level == 2, n[pair], 0), extended=extended)
    return out[(level > 0) & ~(span["head"].to_numpy() & (extended == 0))][["lang", "a", "b", "c", "one", "two", "extended"]]


def passed(stream: DataFrame, rows: int, span_rows: int = SPAN_ROWS) -> DataFrame:
    """One pass over a stream of (lang, a, b, c, n) in order: a row a phrase of two or three words with ``one`` (the count of a), ``two`` (of
    a b) and ``extended`` (the most of any a b x; for pairs)."""
    keys = ["lang", "a", "b", "c"]
    ordered = stream.repartitionByRange(1 + rows // span_rows, *keys).withColumn("span", F.spark_partition_id())
    spans = saved(ordered, "phrases-spans")
    # What stands open at a span's start: the last word and the last pair before it, from one row a span.
    last = lambda which: F.max_by(F.struct(*keys, "n"), F.when(which, F.struct(*keys)))
    word = F.col("b") == ""
    ends = spans.groupBy("span").agg(last(word).alias("word"), last(~word & (F.col("c") == "")).alias("pair"), F.min(F.struct(*keys)).alias("start"))
    before = W.partitionBy().orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    opened = ends.select("span", "start", F.last("word", ignorenulls=True).over(before).alias("word"), F.last("pair", ignorenulls=True).over(before).alias("pair"))
    begun = lambda c, own: F.when((F.col(f"{c}.lang") == F.col("start.lang")) & (F.col(f"{c}.a") == F.col("start.a")) & own, F.col(c))
    heads = opened.select("span", F.explode(F.array_compact(F.array(begun("word", F.lit(True)), begun("pair", F.col("pair.b") == F.col("start.b"))))).alias("x")).select("span", "x.*", F.lit(True).alias("head"))
    found = spans.withColumn("head", F.lit(False)).unionByName(heads).groupBy("span").applyInPandas(_pass, PASSED)
    # A pair's extensions may go on in the spans after its own.
    out = saved(found.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("one", "two", "extended")]), "phrases-passed")
    forget(stream.sparkSession, spans)
    return out


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (left right)) in exact decimals."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    known = saved(counts(docs, text, lang, least), "phrases-counts")
    grams = known.where(F.col("a") != "")
    rows = grams.count()
    totals = known.where(F.col("a") == "").select("lang", F.col("n").alias("total"))
    # Reversed words in order are the suffix order: c b a for triples, b a for pairs.
    three, two = F.col("c") != "", F.col("b") != ""
    turned = grams.select("lang", F.when(three, F.col("c")).when(two, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(three, F.col("b")).when(two, F.col("a")).otherwise("").alias("b"), F.when(three, F.col("a")).otherwise("").alias("c"), "n")
    prefix, suffix = passed(grams, rows), passed(turned, rows)
    back = suffix.select("lang", F.when(three, F.col("c")).otherwise(F.col("b")).alias("a"), F.when(three, F.col("b")).otherwise(F.col("a")).alias("b"), F.when(three, F.col("a")).otherwise("").alias("c"), F.col("one").alias("last_one"), F.col("two").alias("last_two"), F.col("extended").alias("extended_left"))
    keys = ["lang", "a", "b", "c"]
    each = grams.where(two).hint("merge").join(prefix.hint("merge"), keys).join(back.hint("merge"), keys)
    each = each.where(F.lit(100) * F.greatest("extended", "extended_left") < F.lit(covered) * F.col("n"))
    # Cut after the first word, and for triples after the second; the lower score counts, the first of equals.
    cut = lambda left, right: F.struct(score(F.col("n"), F.col(left), F.col(right)).alias("score"), F.col(left).alias("l"), F.col(right).alias("r"))
    early, late, pair = cut("one", "last_two"), cut("two", "last_one"), cut("one", "last_one")
    best = F.when(F.col("c") == "", pair).when(late["score"] < early["score"], late).otherwise(early)
    each = each.select("lang", F.concat_ws(" ", "a", "b", F.when(three, F.col("c"))).alias("phrase"), F.col("n").alias("a"), best.alias("best")).select("lang", "phrase", "a", "best.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's phrases are ranked within parts first, so that few rows of each meet in one task.
    parts = each.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    leading = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = leading.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = saved(ranked.join(small(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"), "phrases")
    for table in (known, prefix, suffix):
        forget(spark, table)
    return out
