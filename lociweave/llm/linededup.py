"""Line deduplication by pairwise alignment: a document and an earlier one that share a run of lines are aligned by patience diff, and
the aligned common blocks are deleted from the later one.

A run is a line and as few of the next, or of those before, as give it ``LEAST_WORDS`` words; blank lines hold no place in it and are
bridged, and blanks around lines don't count. Every block of adjacent lines with so many words is made of runs, so documents are paired by runs, which
are rarer than lines: each document that holds a run with the first that holds it. However hot a run is, it makes one pair less
than it has documents, and what two later documents share is shared with a first holder, run by run, so no block is lost: a line
goes exactly if it is part of a run that stands as adjacent lines in an earlier document. A run therefore remains in the document
that held it first. Runs are told apart by 128-bit hashes of their lines.

A pair needs only its shared runs and their places, not the texts. Patience diff: of the shared runs that occur once in both (within
the stretch looked at), the longest sequence that rises in both documents is kept; matches grow from there over neighbouring
equal runs; stretches between are looked at anew. Shared runs that this leaves stand in another order or are repeated; each is
aligned by itself, with the run's first place.

"Earlier" is by key. Blank lines within a deleted run go with it.

Defined results: a null text stays null; a document all of whose lines are deleted has the empty text; of rows with an equal key
each loses what any row of that key loses by its own place, and no row loses lines to one of its own key; rows with a null key keep
their lines and delete none; an empty table gives no rows; other columns pass through unread, and a column of the name given to
the count of lines is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import renamed, saved, slices, small_batches

LEAST_WORDS = 10
#: Places of a run in its first document that go to the documents which hold it too.
PLACES = 64
_BLANK = b" \t\r\v\f"


def runs(raw: bytes, least: int = LEAST_WORDS) -> list[tuple[bytes, int, int]]:
    """Each run's hash, and the places of its first and last line, from 0."""
    lines, places = [], []
    for at, line in enumerate(raw.split(b"\n")):
        line = line.strip(_BLANK)
        if line:
            lines.append(line)
            places.append(at)
    before = [0, *accumulate(len(x.split()) for x in lines)]
    found, end = {}, 0
    for i in range(len(lines)):  # the shortest from each line
        end = bisect_left(before, before[i] + least, max(end, i))
        if end >= len(before):
            break
        found[i, end] = None
    for z in range(1, len(lines) + 1):  # the shortest to each line
        if before[z] >= least:
            found[bisect_right(before, before[z] - least, 0, z) - 1, z] = None
    return [(xxhash.xxh3_128_digest(b"\n".join(lines[i:z]) if z > i + 1 else lines[i]), places[i], places[z - 1]) for i, z in sorted(found)]


def _split(least: int):
    def run(batches):
        for b in slices(batches, "raw"):
            rows, hashes, firsts, lasts = [], [], [], []
            for i, raw in enumerate(b.column("raw").to_pylist()):
                own: dict[bytes, tuple[list[int], list[int]]] = {}
                for h, at, to in runs(raw or b"", least):
                    a, z = own.setdefault(h, ([], []))
                    a.append(at)
                    z.append(to)
                rows += [i] * len(own)
                hashes += own.keys()
                firsts += [a for a, _ in own.values()]
                lasts += [z for _, z in own.values()]
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rows, pa.int64())), *(pa.array(both[:, k]) for k in (0, 1)), pa.array(firsts, pa.list_(pa.int32())), pa.array(lasts, pa.list_(pa.int32()))], ["key", "h", "g", "own", "ends"])

    return run


def runs_of(docs: DataFrame, key: str, text: str, least: int = LEAST_WORDS) -> DataFrame:
    """One row a distinct run of a document: key, both halves of its hash, and the places of its first and last lines."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw"))
    return rows.mapInArrow(_split(least), f"key {docs.schema[key].dataType.simpleString()}, h long, g long, own array<int>, ends array<int>")


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (a, b) in ascending a, the longest run in which b rises too (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
        back[i] = piles[at - 1] if at else -1
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: dict, b: dict) -> list[tuple]:
    """Matched places of two documents' shared runs, given as marks by place; places are numbers or tuples, in order."""
    found: list[tuple] = []
    todo = [(sorted(a), sorted(b))]
    while todo:
        left, right = todo.pop()
        # Equal runs at both ends are matched first.
        most = min(len(left), len(right))
        head = next((i for i in range(most) if a[left[i]] != b[right[i]]), most)
        found += zip(left[:head], right[:head])
        left, right, most = left[head:], right[head:], most - head
        tail = next((i for i in range(most) if a[left[-1 - i]] != b[right[-1 - i]]), most)
        found += zip(left[len(left) - tail :], right[len(right) - tail :])
        left, right = left[: len(left) - tail], right[: len(right) - tail]
        if not left or not right:
            continue
        once: dict = {}
        for side, places, own in ((0, left, a), (1, right, b)):
            for i, x in enumerate(places):
                seen = once.setdefault(own[x], [-1, -1, 0, 0])
                seen[side], seen[2 + side] = i, seen[2 + side] + 1
        anchors = rising(sorted((i, j) for i, j, m, n in once.values() if m == n == 1))
        if not anchors:
            continue
        i = j = 0
        for x, y in [*anchors, (len(left), len(right))]:
            if x > i and y > j:
                todo.append((left[i:x], right[j:y]))
            if x < len(left):
                found.append((left[x], right[y]))
            i, j = x + 1, y + 1
    return sorted(found)


def aligned(a: dict, b: dict) -> list[tuple]:
    """(place in the earlier document, place in the later one) of every shared run, given as marks by place: those that patience diff
    matches, and the others by themselves."""
    found = patience(a, b)
    done = {y for _, y in found}
    first: dict = {}
    for x in sorted(a):
        first.setdefault(a[x], x)
    return sorted([*found, *((first[h], y) for y, h in b.items() if y not in done)], key=lambda p: p[1])


def _aligned():
    """Rows come sorted by pair; a pair may go on in the next batch."""

    def run(batches):
        pair, a, b = None, {}, {}

        def out(kind, found):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((kind, kind, pa.int32(), pa.int32(), pa.int32()))], ["first", "key", "at_first", "at", "to"])

        def blocks():
            return [(*pair, x, y, z) for (x, _), (y, z) in aligned(a, b)] if pair else []

        kind = None
        for batch in batches:
            kind, found = batch.schema.field("key").type, []
            columns = [batch.column(c).to_pylist() for c in ("first", "key", "h", "g", "own", "ends", "firsts")]
            for first, key, h, g, own, ends, firsts in zip(*columns):
                firsts = [(x["own"], x["ends"]) for x in firsts]
                if (first, key) != pair:
                    found += blocks()
                    pair, a, b = (first, key), {}, {}
                for i, z in firsts:
                    a[i, z] = (h, g)
                for i, z in zip(own, ends):
                    b[i, z] = (h, g)
            yield out(kind, found)
        if pair:
            yield out(kind, blocks())

    return run


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """first, key, at_first, at, to: runs of later documents (lines ``at`` to ``to``) and where the first document has each."""
    kind = docs.schema[key].dataType.simpleString()
    each = saved(runs_of(docs.where(F.col(key).isNotNull()), key, text, least), "line-runs")
    shared = each.groupBy("h", "g").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last").select("h", "g", "first")
    # A run's places in one document are few; documents that hold it may be many, and are counted, not gathered. Rows of an
    # equal key are one document here. Both sides of each join are tables, so that Spark can split a hot run's partition.
    held = saved(each.join(saved(shared, "line-holders"), ["h", "g"]), "line-places")
    # Of a run that its first document repeats, some places are enough: it is no anchor, and what it deletes is the same at any of them.
    places = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.slice(F.arrays_zip("own", "ends"), 1, PLACES))))), 1, PLACES)
    firsts = held.where("key = first").groupBy("h", "g").agg(places.alias("firsts"))
    pairs = held.where("key > first").join(saved(firsts, "line-firsts"), ["h", "g"]).select("first", "key", "h", "g", "own", "ends", "firsts")
    ordered = pairs.repartition("first", "key").sortWithinPartitions("first", "key", "h", "g")
    return ordered.mapInArrow(_aligned(), f"first {kind}, key {kind}, at_first int, at int, to int")


def spans(found: DataFrame) -> DataFrame:
    """key, gone: the spans of lines (at, to) that go, apart from each other and in order."""
    order = W.partitionBy("key").orderBy("at", "to")
    reached = F.max("to").over(order.rowsBetween(W.unboundedPreceding, -1))
    begun = found.select("key", "at", "to").withColumn("new", F.when(F.col("at") <= reached + 1, 0).otherwise(1))
    each = begun.withColumn("span", F.sum("new").over(order)).groupBy("key", "span").agg(F.min("at").alias("at"), F.max("to").alias("to"))
    return each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "to"))).alias("gone"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, removed: str = "n_removed") -> DataFrame:
    """``docs`` without the repeated blocks in ``text``, and the number of lines removed."""
    names = [c for c in docs.columns if c != removed]
    docs, name = renamed(docs.select(*names))
    key, text = name[key], name[text]
    gone = spans(blocks(docs, key, text, least)).withColumnRenamed("key", "_line_key")
    # Texts and deletions are joined by shuffle at every size: deletions grow with the documents.
    rows = docs.join(saved(gone, "line-gone").hint("merge"), F.col(key) == F.col("_line_key"), "left").drop("_line_key")
    lines = F.split(F.col(text), "\n")
    # What stays are the slices before the first span, between spans, and after the last.
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda s: s["to"] + 1))
    stops = F.concat(F.transform("gone", lambda s: s["at"]), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(begins, stops, lambda i, j: F.slice("_lines", i + 1, F.greatest(j - i, F.lit(0)))))
    rows = rows.withColumn("_lines", F.when(F.col("gone").isNotNull(), lines)).withColumn("_kept", F.when(F.col("_lines").isNotNull(), kept))
    out = {"_removed": F.coalesce(F.size("_lines") - F.size("_kept"), F.lit(0)), text: F.when(F.col("_kept").isNull(), F.col(text)).otherwise(F.array_join("_kept", "\n"))}
    return rows.withColumns(out).select(*docs.columns, "_removed").toDF(*names, removed)
