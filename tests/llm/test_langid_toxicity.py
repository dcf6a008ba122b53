from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from lociweave.llm import langid, toxicity

WORDS = {"en": "the and of that with river stone house winter light small great".split(), "fr": "le la des dans avec rivière pierre maison hiver lumière petite grande".split(), "de": "der die und das mit fluss stein haus winter licht kleine große".split()}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(8, 60))), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=400))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_language_held_out_accuracy(labelled):
    docs, rows = labelled
    got = {r["doc_id"]: r for r in langid.predictions(docs).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    held = [(got[i]["lang_pred"], lang) for i, _, lang in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and not r["rejected"] for r in got.values())


def test_language_ignores_held_out_labels(labelled, spark):
    docs, rows = labelled
    changed = spark.createDataFrame([(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows], docs.schema)
    assert {tuple(r) for r in langid.predictions(docs).collect()} == {tuple(r) for r in langid.predictions(changed).collect()}


def test_language_edge_cases(edge, empty):
    got = langid.predictions(edge).collect()
    assert len(got) == edge.count()
    assert {r["lang_pred"] for r in got} <= {"en", "fr", "de", "und"}
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (0, 1, 2, 4))
    assert langid.predictions(empty).count() == 0
    kept = langid.accepted(edge)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({0, 1, 2, 4})


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.predictions(docs).first()["lang_pred"] == "und"


def test_far_texts_are_rejected(labelled, spark):
    docs, _ = labelled
    model = langid.fit(docs)
    _, _, rejected = model.predict(["Привет как дела, это русский текст", "the river and the house", None])
    assert rejected.tolist() == [True, False, True]


def test_junk_and_unknown_languages_are_rejected(labelled):
    docs, _ = labelled
    rng = random.Random(3)
    model = langid.fit(docs)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    polish = "w i z na nie się jest że rzeka kamień dom zima światło mały wielki przez który wszystko".split()
    clean = [say(WORDS[lang], n) for lang in WORDS for n in (1, 2, 5, 20, 60, 200) for _ in range(5)]
    _, _, rejected = model.predict([say(letters, 40), say(letters, 300), say(polish, 40), say(polish, 300), *clean])
    assert rejected[:4].all() and not rejected[4:].any()


def test_nearest_centroid_matches_brute_force(labelled):
    """Vectors, cosines and the choice computed once more from n-grams counted in a dictionary."""
    docs, rows = labelled
    model = langid.fit(docs)
    for _, text, _ in rows[:40]:
        raw, tf = b" " + text.lower().encode().translate(langid._PLAIN) + b" ", {}
        for size, seed in ((2, 2654435761), (3, 2246822519)):
            for i in range(len(raw) - size + 1):
                h = 0
                for c in raw[i : i + size]:
                    h = (h * 257 + c) % (1 << 32)
                bucket = (h * seed % (1 << 32)) >> (32 - 13)
                tf[bucket] = tf.get(bucket, 0) + 1
        weights = {b: math.log1p(n) * float(model.idf[b]) for b, n in tf.items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        cosines = [sum(w * float(c[b]) for b, w in weights.items()) / norm for c in model.centroids]
        (lang,), (score,), _ = model.predict([text])
        assert abs(score - max(cosines)) < 1e-5 and lang == model.langs[max(range(len(cosines)), key=cosines.__getitem__)]


def test_ftrl_matches_brute_force():
    """Per-coordinate rates and L1 with dictionaries, a coordinate at a time."""
    rng = random.Random(5)
    rows = [(np.array(sorted(rng.sample(range(64), 6))), rng.randint(0, 1)) for _ in range(300)]
    rows = [(np.unique(np.append(ids, 3)) if y else ids[ids != 3], y) for ids, y in rows]
    w, bias = toxicity.ftrl(rows, 6, epochs=3)
    z, n = {}, {}

    def weight(i):
        bound = 0 if i == "bias" else toxicity.L1
        if abs(z.get(i, 0)) <= bound:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for ids, y in rows:
            own = {i: weight(i) for i in [*ids.tolist(), "bias"]}
            g = 1 / (1 + math.exp(-sum(own.values()))) - y
            for i, x in own.items():
                before = n.get(i, 0.0)
                n[i] = before + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(before)) / toxicity.ALPHA * x
    np.testing.assert_allclose(w, [weight(i) for i in range(64)], atol=1e-9)
    assert abs(bias - weight("bias")) < 1e-9 and w[3] > 0


def test_repeated_keys_are_learned_once(spark):
    rows = toxic_rows()
    docs, labels = [r[:2] for r in rows], [(r[0], r[2]) for r in rows]
    more = docs + [(docs[0][0], docs[0][1] + " again and again")] * 50
    a, b = (toxicity.fit(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")) for d in (docs, more))
    assert a.ids.tolist() == b.ids.tolist() and a.bias == b.bias


def toxic_rows(n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS["en"]) for _ in range(rng.randint(20, 60))]
        if i % 5 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["vile", "scum", "rotten"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.predictions(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    turned = spark.createDataFrame([(i, 1, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], labels.schema)
    assert {tuple(r) for r in toxicity.predictions(docs, turned).collect()} == {tuple(r) for r in got.values()}
    model = toxicity.fit(docs, labels)
    assert 0 < len(model.ids) < 2000


def test_toxicity_edge_cases(edge, empty, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10, 70)] + [(None, 1), (11, None), (12, 0), (12, 0)], "doc_id long, toxic int")
    got = toxicity.predictions(edge, labels).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.predictions(empty, labels).count() == 0
    none = toxicity.predictions(edge, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
