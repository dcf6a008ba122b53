"""The pipeline's stages one after another, each on what the one before kept, against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import pytest

from lociweave.llm import langid
from tests.llm.conftest import edge_texts, prose
from tests.llm.test_nearcopies import slow_kept

#: Names that operators use for themselves, beside those of ``documents``.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _lang string, _score string, _rejected string, _key string, _none string, _digest string, gone string, _lines string, _matches string, key string, h string, shard int, _mix_copies string"
ITEM = "which river of the seven stone bridges by the winter harbour keeps its copper lantern through the silver market letter"


def rows_of(texts):
    return [(i, t, lang, source, len(t or ""), *"abcdefghijk", 9, "m") for i, t, lang, source in texts]


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contained(text, item, n=5):
    own, its = words(text), words(item)
    n = min(n, len(its))
    grams = lambda w: {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}
    return n > 0 and len(grams(own) & grams(its)) >= 0.8 * len(grams(its))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("pipeline")
    rng = random.Random(11)
    texts = edge_texts() + [(400 + i, prose(rng, 60), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None])) for i in range(80)]
    texts += [(500 + i, prose(rng, 30) + " " + ITEM + " " + prose(rng, 30), "en", "a") for i in range(5)]
    texts += [(600, texts[-1][1] + " and", "en", "a"), (None, texts[-3][1], None, None)]
    spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "no document has these words of a benchmark at all")], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    empty = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    return str(out), str(empty)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    columns = docs.columns
    own = lambda df: sorted(map(repr, df.select(*columns).collect()))
    before = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, before, folder[0])
        assert name == "shards" or now.columns == columns
        kept[name] = spark.createDataFrame(now.collect(), now.schema)
        before = kept[name]
    # Language: the model's own choice, and nothing without a letter stays.
    model = langid.fit(docs)
    rows = docs.collect()
    _, _, rejected = model.predict([r["text"] for r in rows])
    assert own(kept["language"]) == sorted(repr(r) for r, no in zip(rows, rejected) if not no)
    assert all(any(c.isalpha() for c in r["text"]) for r in kept["language"].collect())
    # Near copies: one of each group.
    after = kept["near_duplicates"].collect()
    pairs = [(r["doc_id"], r["text"]) for r in kept["language"].collect()]
    assert Counter(r["doc_id"] for r in after) == Counter(slow_kept(pairs)) and {repr(r) for r in after} <= {repr(r) for r in kept["language"].collect()}
    # Leaks.
    assert own(kept["leaks"]) == sorted(repr(r) for r in after if not contained(r["text"], ITEM))
    assert len(kept["leaks"].collect()) < len(after)
    # Mix: whole rows, each source's words near its target.
    mixed, clean = Counter(repr(r) for r in kept["mix"].collect()), {repr(r): r for r in kept["leaks"].collect()}
    assert set(mixed) <= set(clean)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"]))
    have, taken = Counter(), Counter()
    for k, r in clean.items():
        have[r["source"]] += size(r)
        taken[r["source"]] += size(r) * mixed[k]
    order = sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, left, rest = {}, sum(have.values()), set(order)
    while rest:  # targets above three times their source stop there, the excess goes to the others by weight
        level = left / sum(weight[s] for s in rest)
        full = {s for s in rest if weight[s] * level > 3 * have[s]}
        for s in full or rest:
            target[s] = 3 * have[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        rest = rest - full if full else set()
    most = max(map(size, clean.values()))
    assert all(abs(taken[s] - target[s]) <= most for s in order)
    assert all(n <= 3 for n in mixed.values())
    # Shards: every record once, equal keys together.
    last = kept["shards"].collect()
    assert Counter(repr(r[:-2]) for r in last) == Counter(repr(r[:-2]) for r in kept["mix"].collect()) or len(last) == sum(mixed.values())
    shards = {}
    for r in last:
        assert 0 <= r["shard"] < 8
        shards.setdefault(r["doc_id"], set()).add(r["shard"])
    assert all(len(s) == 1 for k, s in shards.items() if k is not None)
    # The whole run is the stages in their order.
    assert sorted(map(repr, corpus_pipeline.run(spark, folder[0]).collect())) == sorted(map(repr, last))


def test_empty(spark, folder):
    got = corpus_pipeline.run(spark, folder[1])
    assert got.count() == 0 and set(got.columns) == set(SCHEMA.replace(",", " ").split()[::2])
