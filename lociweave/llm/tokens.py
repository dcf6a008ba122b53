"""Token ids in compact binary files: canonical length-limited Huffman codes from global counts, in independent blocks.

A corpus is a folder of four Parquet tables that Spark's committers write, so that a lost executor leaves no half file:
``tokens`` (each document's ids, compressed; the source of the counts), ``codebook`` (id, code length), ``blocks`` (runs of
whole documents in ascending key order: their keys, token counts, Huffman bits and a bit offset for every ``STRIDE`` ids) and
``index`` (the ids before each part). Any block decodes by itself, all its strides at once by table lookup.

Words are encoded once a worker, not once an occurrence: the tokenizer drops white space and never joins over it, so a text's
ids are those of its words in turn.

Defined results: a null text is encoded as the empty one and has the end id only; keys sort ascending, nulls first, equal keys
by their text's checksum; equal rows are all written; an empty table gives an empty corpus; other columns aren't written.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lociweave.llm.common import new_path, slices, small, small_batches

#: Longest code in bits; decoding looks so many bits up at once.
LONGEST = 20
#: Ids in a block, besides a single longer document.
BLOCK = 1 << 18
#: Ids between bit-offset checkpoints.
STRIDE = 256
#: Bytes of compressed ids in a part of the key range.
PART_BYTES = 24 << 20
#: Words after which a worker starts a new generation; it remembers those of the generation before too, and what is met again
#: there moves to the new one, so that frequent words stay and rare ones go.
WORDS = 300_000
#: Bytes of text that are split to words together, besides a single longer text.
TEXT_BYTES = 2 << 20
#: A word that normalising and splitting leave as it is: lower-case letters of ASCII and Latin-1, as UTF-8.
_BARE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Punctuation that the tokenizer splits off a word that ends in a letter. Apostrophes are left out, as 's and such are one.
_ENDS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c != ord("'"))
#: Bytes as the characters that the tokenizer's model has for them: those without a printable one follow from 256.
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Generation:
    """Words and their ids, in flat arrays."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.first, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def add(self, words: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[self.used : self.used + len(ids)] = ids
        self.first[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + m] = sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m)))

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words numbered ``at``, and where each word's end."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], ends


class WordEncoder:
    """Encodes texts by their words, whose ids it remembers."""

    def __init__(self, path: str, end: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.mark = self._ids("\x01")[0]
        self.young, self.old = Generation(), Generation()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _kept(self, words: list[bytes]) -> list[bytes]:
        """Move words of the generation before to the new one; returns the others."""
        get = self.old.known.get
        at = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        had = np.flatnonzero(at >= 0)
        if len(had):
            ids, _ = self.old.ids(at[had])
            self.young.add([words[i] for i in had.tolist()], ids, self.old.size[at[had]])
        return [words[i] for i in np.flatnonzero(at < 0).tolist()]

    def learn(self, words: list[bytes]) -> None:
        """Encode distinct words that this generation doesn't know; of those that end in punctuation, the word and the punctuation."""
        ended = {}
        plain = set()
        for w in self._kept(words):
            stem = w.rstrip(_ENDS)
            if len(stem) < len(w) and stem and 97 <= stem[-1] <= 122 and b"<|" not in w:
                ended[w] = (stem, w[len(stem) :])
                plain.update(ended[w])
            else:
                plain.add(w)
        known = self.young.known
        self._learn(self._kept([w for w in plain if w not in known]))
        if ended:
            at = np.array([known[p] for pair in ended.values() for p in pair])
            ids, _ = self.young.ids(at)
            self.young.add(list(ended), ids, self.young.size[at].reshape(-1, 2).sum(1))

    def _learn(self, words: list[bytes]) -> None:
        """Bare words go to the tokenizer's model at once, others through all of it, many at a time with a mark between them,
        and the few that hold the mark one at a time."""
        bare = [w for w in words if _BARE.fullmatch(w)]
        if bare:
            tokenize = self.tokenizer.model.tokenize
            found = [[t.id for t in tokenize(w.decode() if w.isascii() else w.decode("latin-1").translate(_SHOWN))] for w in bare]
            self.young.add(bare, np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))
            words = list(set(words).difference(bare))
        odd = [w for w in words if b"\x01" in w]
        plain = [w for w in words if b"\x01" not in w] if odd else words
        for at in range(0, len(plain), 4096):
            some = plain[at : at + 4096]
            ids = np.array(self._ids(" \x01 ".join([w.decode("utf-8", "replace") for w in some]) + " \x01"), np.uint32)
            ends = np.flatnonzero(ids == self.mark)
            self.young.add(some, np.delete(ids, ends), np.diff(ends, prepend=-1) - 1)
        for w in odd:
            ids = np.array(self._ids(w.decode("utf-8", "replace")), np.uint32)
            self.young.add([w], ids, np.array([len(ids)]))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an array of bytes in turn, each text's followed by the end id, and how many each text has."""
        if len(self.young.known) > WORDS:
            self.young, self.old = Generation(), self.young
        end = b"\x01 end"  # no word: words hold no blanks
        if end not in self.young.known:
            self.young.add([end], np.array([self.end], np.uint32), np.array([1]))
        # Each distinct word is looked up once. Special tokens are told by case.
        raw = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())
        special = pc.match_substring(raw, "<|")
        lower = pc.ascii_lower(raw)
        split = pc.ascii_split_whitespace(pc.if_else(special, raw, lower) if pc.any(special).as_py() else lower)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        get = self.young.known.get
        number = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(number < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            self.learn(fresh)
            number[new] = np.fromiter(map(get, fresh), np.int64, len(fresh))
        stops = split.offsets.to_numpy().astype(np.int64)
        counts = np.diff(stops)
        at = np.insert(number[coded.indices.to_numpy()], stops[1:] - stops[0], self.young.known[end])
        if not len(at):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids, ends = self.young.ids(at)
        return ids, np.diff(ends[np.cumsum(counts + 1) - 1], prepend=0)


_encoders: dict[tuple, WordEncoder] = {}


def _encoder(path: str, end: int) -> WordEncoder:
    if (path, end) not in _encoders:
        _encoders.clear()
        _encoders[path, end] = WordEncoder(path, end)
    return _encoders[path, end]


def _encoded(path: str, end: int, n_ids: int, wide: str):
    """A row a document, and at the end of a partition one with the counts of its ids (n is -1)."""
    names = ["key", "digest", "n", "ids"]

    def run(batches):
        encoder, pack, total, kind = _encoder(path, end), zstandard.ZstdCompressor(level=1).compress, np.zeros(n_ids, np.int64), None
        for b in slices(batches, "raw", TEXT_BYTES):
            ids, counts = encoder.encode(b.column("raw"))
            total += np.bincount(ids, minlength=n_ids)
            ids, stops, kind = ids.astype(wide), np.cumsum(counts), b.schema.field("key").type
            packed = [pack(ids[z - n : z].tobytes()) for n, z in zip(counts.tolist(), stops.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("digest"), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names)
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.array([0], pa.int64()), pa.array([-1], pa.int64()), pa.array([pack(total.astype("<i8").tobytes())])], names)

    return run


def _unpacked(column, wide: str) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x), wide) for x in column.to_pylist()]


def _summed(n_ids: int):
    """Counts of several partitions, added up in each task."""

    def run(batches):
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            for counts in _unpacked(b.column("ids"), "<i8"):
                total += counts
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["id", "count"])

    return run


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal prefix-code lengths of at most ``longest`` bits (0: not used), by package-merge."""
    used = np.flatnonzero(counts)
    lengths, n = np.zeros(len(counts), np.int64), len(used)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << longest:
        raise ValueError(f"{n} ids don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves, packages, levels = counts[order].astype(np.float64), np.zeros(0), []
    for _ in range(longest):
        merged = np.concatenate([leaves, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of length, then id."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for i in sorted(np.flatnonzero(lengths).tolist(), key=lambda i: (lengths[i], i)):
        code <<= int(lengths[i]) - before
        codes[i], before = code, int(lengths[i])
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The codes of ``ids`` in turn, high bits first, and the bit offset of every ``stride``-th."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    word, shift, code = at >> 6, 64 - (at & 63) - size, codes[ids]
    over = shift < 0
    out = np.zeros((int(ends[-1]) >> 6) + 2 if len(ids) else 1, np.uint64)
    if len(ids):
        high = np.where(over, code >> np.where(over, -shift, 0).astype(np.uint64), code << np.where(over, 0, shift).astype(np.uint64))
        runs = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[runs]] = np.bitwise_or.reduceat(high, runs)
        out[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0], at[::stride]


def decode_table(lengths: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for every value of the next ``longest`` bits. Canonical codes fill the table in order."""
    order = np.array(sorted(np.flatnonzero(lengths).tolist(), key=lambda i: (lengths[i], i)), np.int64)
    span = 1 << (longest - lengths[order])
    ids, sizes = np.zeros(1 << longest, np.uint16 if len(lengths) <= 1 << 16 else np.uint32), np.ones(1 << longest, np.uint8)
    ids[: span.sum()], sizes[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, sizes


def unpack_bits(bits: bytes, n: int, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], stride: int = STRIDE, longest: int = LONGEST) -> np.ndarray:
    """The ``n`` ids; all strides are decoded side by side, one id of each at a time."""
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at, out = offsets.astype(np.int64), np.zeros((stride, len(offsets)), np.uint32)
    last = len(window) - 1
    for k in range(min(stride, n)):
        look = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - longest)
        out[k] = table[0][look]
        at += table[1][look]
    return out.T.reshape(-1)[:n]


def _blocked(lengths: np.ndarray, wide: str, block: int, stride: int):
    codes = canonical(lengths)

    def run(batches):
        keys, counts, texts, held, start, part, number, kind = [], [], [], 0, 0, 0, 0, pa.int64()

        def close():
            bits, offsets = pack_bits(np.concatenate(texts), codes, lengths, stride)
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (part, number, start, held)] + [pa.array([keys], pa.list_(kind)), pa.array([counts]), pa.array([bits]), pa.array([offsets.astype("<u4").tobytes()])],
                ["part", "number", "start", "n_ids", "keys", "counts", "bits", "offsets"],
            )

        for b in batches:
            part, kind = b.column("part")[0].as_py() if b.num_rows else part, b.schema.field("key").type
            for key, ids in zip(b.column("key").to_pylist(), _unpacked(b.column("ids"), wide)):
                if texts and held + len(ids) > block:
                    yield close()
                    start, number = start + held, number + 1
                    keys, counts, texts, held = [], [], [], 0
                keys.append(key)
                counts.append(len(ids))
                texts.append(ids)
                held += len(ids)
        if texts:
            yield close()

    return run


def write_corpus(docs: DataFrame, vocabulary: str, end: int, key: str = "doc_id", text: str = "text", path: str | None = None, block: int = BLOCK, stride: int = STRIDE) -> str:
    """Encode ``docs`` with the tokenizer file ``vocabulary`` (a path on every machine) and write a corpus; returns its folder."""
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, path or new_path(docs.sparkSession, "corpus")
    small_batches(spark)
    n_ids = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), end + 1)
    wide, kind = "<u2" if n_ids <= 1 << 16 else "<u4", docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("key"), F.crc32(body).alias("digest"), body.alias("raw"))
    rows.mapInArrow(_encoded(vocabulary, end, n_ids, wide), f"key {kind}, digest long, n long, ids binary").write.parquet(f"{path}/tokens")
    written = spark.read.parquet(f"{path}/tokens")
    tokens = written.where("n >= 0")

    # At most one row an id of the vocabulary comes to the driver.
    counts = np.zeros(n_ids, np.int64)
    for r in written.where("n < 0").select("ids").mapInArrow(_summed(n_ids), "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toLocalIterator():
        counts[r["id"]] = r["count"]
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(used.tolist(), lengths[used].tolist())), "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")

    parts = 1 + int((tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0) // PART_BYTES)
    ordered = tokens.select("key", "digest", "ids").repartitionByRange(parts, F.col("key").asc_nulls_first(), "digest").sortWithinPartitions(F.col("key").asc_nulls_first(), "digest")
    blocks = ordered.select("key", "ids", F.spark_partition_id().alias("part")).mapInArrow(
        _blocked(lengths, wide, block, stride), f"part long, number long, start long, n_ids long, keys array<{kind}>, counts array<long>, bits binary, offsets binary"
    )
    blocks.write.parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n"))
    sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before")).write.parquet(f"{path}/index")
    return path


def _decoded(lengths: np.ndarray, stride: int):
    def run(batches):
        table = decode_table(lengths)
        for b in slices(batches, "bits"):
            for r in b.to_pylist():
                ids = unpack_bits(r["bits"], r["n_ids"], np.frombuffer(r["offsets"], "<u4"), table, stride).astype("<u4")
                counts = np.array(r["counts"], np.int64)
                stops = np.cumsum(counts)
                starts = r["before"] + r["start"] + stops - counts
                for at in range(0, len(counts), 64):  # few documents at once, so that what goes to the JVM stays small
                    own = slice(at, at + 64)
                    raw = [ids[z - n : z].tobytes() for n, z in zip(counts[own].tolist(), stops[own].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(r["keys"][own], b.schema.field("keys").type.value_type), pa.array(starts[own]), pa.array(counts[own]), pa.array(raw, pa.binary())], ["key", "start", "n", "ids"])

    return run


def read_corpus(spark: SparkSession, path: str, stride: int = STRIDE) -> DataFrame:
    """key, start (ids of all documents before), n_tokens, ids (little-endian unsigned 32-bit integers), from the files."""
    small_batches(spark)
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most one row an id of the vocabulary
    lengths = np.zeros(max([0, *(r["id"] for r in book)]) + 1, np.int64)
    for r in book:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{path}/blocks").join(small(spark.read.parquet(f"{path}/index")), "part")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_decoded(lengths, stride), f"key {kind}, start long, n long, ids binary").select("key", "start", F.col("n").alias("n_tokens"), "ids")


def digests(docs: DataFrame, vocabulary: str, end: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write a corpus, read it back, and give each document's place, number of ids and their checksum."""
    path = write_corpus(docs, vocabulary, end, key, text)
    return read_corpus(docs.sparkSession, path).select(F.col("key").alias(key), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
