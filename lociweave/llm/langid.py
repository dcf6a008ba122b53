"""Language identification by nearest centroid: TF-IDF vectors of hashed character n-grams, normalised to length 1, are
compared by cosine with several centroids a language, which spherical k-means finds in labelled texts.

A text is rejected if it is too far from its nearest centroid for its length, as cosines grow with length: the limit of each
doubling of the number of n-grams is ``SLACK`` times the cosine that all but one in a hundred of the sample's texts of that
length reach, at least ``LEAST``; lengths with few texts in the sample have the limit of the next shorter ones that don't.

The classifier is fitted on at most about ``SAMPLE`` labelled rows a language, chosen by a hash of their keys; what goes to a task
are their n-gram counts, of one size whatever the texts' lengths.

Defined results: a null text and a text without letters are ``und`` with score 0 and rejected; rows without a label aren't
learned from; equal texts get equal results; with nothing to learn from, every text is ``und``; an empty table gives no rows;
other columns pass through unread. Of equally near languages, the first by code point is taken.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import hash60, record_key, renamed, saved, slices, small_batches

#: Labelled rows a language that the classifier is fitted on, about.
SAMPLE = 1500
#: Centroids a language.
CENTROIDS = 4
#: Hash buckets of n-grams.
BUCKETS = 8192
#: Cosine below which any text is rejected. Of clean texts, even single words reach 0.05; other scripts stay under 0.02.
LEAST = 0.03
#: Share of a usual text's least cosine below which a text is rejected, and texts of a length that tell what is usual.
SLACK, ENOUGH = 0.7, 40
#: Doublings of length that are told apart.
LENGTHS = 32
UNDETERMINED = "und"
#: Texts whose vectors a task holds at once.
ROWS = 256

_LETTER = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def counts(texts: list[str | None], buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each text's two- and three-byte n-grams, in lower case, by bucket."""
    out = np.zeros((len(texts), buckets), np.float32)
    for i, text in enumerate(texts):
        raw = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8).astype(np.uint32)
        two = raw[:-1] * np.uint32(257) + raw[1:]
        three = two[:-1] * np.uint32(257) + raw[2:]
        shift = np.uint32(32 - buckets.bit_length() + 1)
        for grams, seed in ((two, 2654435761), (three, 2246822519)):
            out[i] += np.bincount((grams * np.uint32(seed)) >> shift, minlength=buckets)
    return out


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0) from counts: logarithmic term frequency times inverse document frequency."""
    v = np.log1p(found) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids of length 1, and each row's centroid. Starts from rows at even steps of their cosine
    with the mean; a centroid left with less than a fiftieth of the rows goes."""
    mean = v.mean(0)
    order = np.argsort(v @ mean, kind="stable")
    centres = v[order[(np.arange(k) * 2 + 1) * len(v) // (2 * k)]].copy()
    own = np.zeros(len(v), np.int64)
    for _ in range(rounds):
        own = np.argmax(v @ centres.T, axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                centres[j] = v[own == j].mean(0)
                centres[j] /= max(float(np.linalg.norm(centres[j])), 1e-12)
    kept = np.bincount(own, minlength=len(centres)) * 50 >= len(v)
    return centres[kept], np.argmax(v @ centres[kept].T, axis=1)


def doubling(found: np.ndarray) -> np.ndarray:
    """Which doubling of the number of n-grams each row of counts is in."""
    return np.minimum(np.log2(np.maximum(found.sum(1), 1)).astype(np.int64), LENGTHS - 1)


def limits(at: np.ndarray, cosines: np.ndarray, least: float = LEAST) -> np.ndarray:
    """The cosine below which texts of each doubling of length are rejected."""
    out = np.full(LENGTHS, least)
    for k in range(LENGTHS):
        own = cosines[at == k]
        out[k] = max(least, SLACK * float(np.quantile(own, 0.01))) if len(own) >= ENOUGH else out[max(0, k - 1)]
    return out


@dataclass
class Model:
    """What goes to the executors; its size is languages x centroids x buckets."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # by doubling of length

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine (0 to 1) and whether it is rejected, for each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        found = counts(texts, len(self.idf))
        near = vectors(found, self.idf) @ self.centroids.T
        best = np.argmax(near, axis=1)
        score = np.clip(near[np.arange(len(texts)), best], 0, 1).astype(np.float64)
        none = np.array([not text or not _LETTER.search(text) for text in texts], bool)
        far = score < self.least[doubling(found)]
        return [UNDETERMINED if x else self.langs[j] for x, j in zip(none.tolist(), best.tolist())], np.where(none, 0, score), none | far


def sampled(docs: DataFrame, key: str, text: str, lang: str, learn: Column | None, most: int) -> DataFrame:
    """(lang, text) of about ``most`` labelled rows a language at most, by a hash of their keys; saved."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(learn) if learn is not None else rows
    # One row a language: far fewer than documents.
    shares = rows.groupBy(F.col(lang).alias("_of")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_least", F.least(F.lit(1.0), most / F.col("_rows")))
    picked = rows.join(F.broadcast(saved(shares, "lang-shares")), F.col(lang) == F.col("_of")).where(hash60(record_key(key, text)) < F.col("_least") * float(1 << 60))
    return saved(picked.select(F.col(lang).alias("lang"), F.col(text).alias("text")), "lang-sample")


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", learn: Column | None = None, sample: int = SAMPLE, k: int = CENTROIDS, buckets: int = BUCKETS, least: float = LEAST) -> Model:
    """Fit on rows where ``learn`` holds; a task has one language's sample."""
    small_batches(docs.sparkSession)
    rows = sampled(docs, key, text, lang, learn, sample)

    def counted(batches):
        for b in slices(batches, "text", rows=ROWS):
            found = counts(b.column("text").to_pylist(), buckets).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([x.tobytes() for x in found], pa.binary())], ["lang", "counts"])

    rows = saved(rows.mapInArrow(counted, "lang string, counts binary"), "lang-counts")

    def whole(pdf: pd.DataFrame) -> np.ndarray:
        return np.array([np.frombuffer(x, "<f4") for x in sorted(pdf["counts"])])

    def present(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(pdf)], "df": [(whole(pdf) > 0).sum(0).tolist()]})

    seen = rows.groupBy("lang").applyInPandas(present, "n long, df array<long>").collect()  # one row a language
    n, df = sum(r["n"] for r in seen), sum((np.array(r["df"]) for r in seen), np.zeros(buckets))
    idf = np.log((1 + n) / (1 + df)).astype(np.float32)

    def centres(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = whole(pdf)
        v = vectors(raw, idf)
        found, _ = clustered(v, k)
        near = (v @ found.T).max(1)
        first = [True] + [False] * (len(found) - 1)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "j": range(len(found)), "centroid": [x.tolist() for x in found.astype(np.float32)], "at": [doubling(raw).tolist() if x else [] for x in first], "cosines": [near.astype(float).tolist() if x else [] for x in first]})

    # k rows a language, the first with the sample's lengths and cosines.
    found = sorted(rows.groupBy("lang").applyInPandas(centres, "lang string, j int, centroid array<float>, at array<int>, cosines array<double>").collect(), key=lambda r: (r["lang"], r["j"]))
    at, cosines = (np.array([x for r in found for x in r[c]]) for c in ("at", "cosines"))
    return Model([r["lang"] for r in found], np.array([r["centroid"] for r in found], np.float32).reshape(-1, buckets), idf, limits(at, cosines, least))


def _predicted(model, text: str):
    def run(batches):
        for b in slices(batches, text, rows=ROWS):
            langs, score, rejected = model.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], [*b.schema.names, "_lang", "_score", "_rejected"])

    return run


def identified(docs: DataFrame, model: Model, keep: list, text: str = "text") -> DataFrame:
    """The columns ``keep`` (the text among them), _lang, _score and _rejected of every row."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_predicted(shared, text), f"{kinds}, _lang string, _score double, _rejected boolean")


def held_out(key: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == part, F.lit(False))


def predictions(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4, part: int = 2) -> DataFrame:
    """key, held_out, lang_pred, score, rejected. Rows of the held-out part aren't learned from."""
    model = fit(docs, key, text, lang, ~held_out(key, parts, part))
    rows = identified(docs, model, [F.col(key), F.col(text).alias("_text")], "_text")
    return rows.select(key, held_out(key, parts, part).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without the rows whose text has no letter or is far from every centroid."""
    rows, name = renamed(docs)
    kept = identified(rows, fit(docs, key, text, lang), rows.columns, name[text]).where("NOT _rejected")
    return kept.select(*rows.columns).toDF(*docs.columns)
