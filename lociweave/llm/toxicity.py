"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams: per-coordinate learning rates, L1
sparsity, weights that are broadcast as the few that aren't zero.

The model is fitted on at most about ``SAMPLE`` labelled rows of each label, chosen by a hash of their keys, in the order of
that hash. Where one label is far commoner, the sample evens the two out.

Defined results: null and empty texts have no terms and get the intercept's score; rows without a label aren't learned from;
a document labelled more than once counts once for each label; of
documents with an equal key one is learned from, that of the least text; equal texts get equal scores; with nothing to learn from,
every score is 0.5; an empty table gives no rows; other columns pass through unread.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.llm.common import hash60, record_key, saved, slices, small_batches
from lociweave.llm.langid import held_out

#: Rows of each label that the model is fitted on, about.
SAMPLE = 4000
#: Hash space of terms.
BITS = 20
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 1.0

#: ASCII other than digits and letters separates words.
_PLAIN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """Distinct hashes of a text's words, pairs of neighbours and pairs with one or two words between, in lower case."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()
    if not words:
        return np.zeros(0, np.int64)
    crc = zlib.crc32
    w = np.array([crc(x) for x in words], np.uint64) * _GOLD
    found = [w]
    for gap in (1, 2, 3):
        found.append((w[:-gap] ^ (w[gap:] >> np.uint64(7)) + np.uint64(gap)) * _GOLD)
    return np.unique(np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    """The terms whose weight isn't zero, ascending, their weights, and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.ids] = self.weights
        return w


def score(w: np.ndarray, bias: float, bits: int, text: str | None) -> float:
    return float(1 / (1 + np.exp(-np.clip(bias + w[terms(text, bits)].sum(dtype=np.float64), -35, 35))))


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and intercept after ``epochs`` passes over (term ids, label), one row at a time."""
    size = (1 << bits) + 1  # the last is the intercept, which L1 doesn't hold
    z, n = np.zeros(size), np.zeros(size)
    bound = np.full(size, l1)
    bound[-1] = 0

    def weights(i):
        own = z[i]
        return np.where(np.abs(own) <= bound[i], 0.0, -(own - np.sign(own) * bound[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for ids, label in rows:
            i = np.append(ids, size - 1)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    w = weights(np.arange(size))
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, sample: int = SAMPLE, bits: int = BITS) -> Model:
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.where(learn) if learn is not None else known
    known = known.select(F.col(key).alias("_of"), F.col(label).cast("int").alias("label"), hash60(F.concat_ws(":", F.col(key).cast("string"), F.col(label).cast("string"))).alias("h"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect() if r["label"] in (0, 1)}  # two rows
    if len(totals) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0, bits)
    # The bound on the sample is a bound on what is broadcast.
    picked = known.where(" OR ".join(f"(label = {y} AND h < {int(min(1, sample / n) * (1 << 60))})" for y, n in totals.items())).distinct()
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(saved(picked, "toxic-picked")), F.col(key) == F.col("_of"))
    # What goes to the one task that learns are each text's distinct terms, at most 2^bits; of equal keys, one text.
    rows = rows.groupBy("_of", "label", "h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "label", "h")

    def hashed(batches):
        for b in slices(batches, "text"):
            found = [terms(t, bits).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *b.columns[1:]], ["terms", *b.schema.names[1:]])

    rows = rows.mapInArrow(hashed, "terms binary, label int, h long")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "label", "terms"])
        w, bias = ftrl([(np.frombuffer(t, "<i4"), int(y)) for t, y in zip(pdf["terms"], pdf["label"])], bits)
        ids = np.flatnonzero(w)
        return pd.DataFrame({"id": [-1, *ids.tolist()], "weight": [bias, *w[ids].tolist()]})

    small_batches(spark)
    # One task has the whole sample, whose size is bounded; L1 bounds the rows that come back.
    found = rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(train, "id long, weight double").toPandas().sort_values("id")
    return Model(found["id"].to_numpy()[1:], found["weight"].to_numpy()[1:], float(found["weight"].iloc[0]), bits) if len(found) else Model(np.zeros(0, np.int64), np.zeros(0), 0.0, bits)


def _scored(model):
    def run(batches):
        m = model.value
        w = m.dense()
        for b in slices(batches, "_text"):
            found = pa.array([score(w, m.bias, m.bits, t) for t in b.column("_text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], found], [*b.schema.names[:-1], "score"])

    return run


def scored(docs: DataFrame, model: Model, keep: list, text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1])
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), f"{kinds}, score double")


def predictions(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", parts: int = 5, part: int = 0) -> DataFrame:
    """key, held_out, score, predicted. Labels of the held-out part aren't learned from."""
    model = fit(docs, labels, key, text, label, ~held_out(key, parts, part))
    rows = scored(docs, model, [F.col(key)], text)
    return rows.select(key, held_out(key, parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
