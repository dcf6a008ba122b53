from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from lociweave.llm import phrases
from tests.llm.conftest import edge_texts, prose


def slow(rows, least=10, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) by counting whole lists."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    found = []
    long = [g for g, a in counts.items() if len(g) == 4 and a >= least]
    most = Counter()
    for g in long:
        for part in (g[:3], (g[0], *g[2:])):
            most[part] = max(most[part], counts[g])
    for g, a in counts.items():
        if len(g) > 2 and a >= least and not (len(g) == 3 and 100 * most[g] >= 50 * a):
            lang, words = g[0], g[1:]
            cuts = [(10**6 * a * a // (counts[(lang, *words[:k])] * counts[(lang, *words[k:])]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            found.append((lang, -score, -a, " ".join(words).encode(), counts[(lang, *words[:k])], counts[(lang, *words[k:])]))
    out, rank = [], Counter()
    for lang, score, a, phrase, left, right in sorted(found):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return out


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus():
    rng = random.Random(2)
    rows = [(prose(rng, rng.randrange(80)), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [("x x x x x x x x x x x x x x", "aa"), ("the the the of the the the of. the of, the", "aa")] * 4
    rows += [("Æ B æ b\tz Æ  B", "zz"), (" \t. lead and  trail \t", "zz"), ("a\x00b c\x0bd a\x00b c", "zz"), ("", "zz"), (None, "zz"), ("!!!", None)] * 6
    return rows


@pytest.mark.parametrize(("span", "least", "top"), [(200_000, 10, 2000), (7, 3, 25)])
def test_phrases_match_brute_force(spark, monkeypatch, span, least, top):
    """Also where words and pairs stand open over the ends of short spans."""
    monkeypatch.setattr(phrases, "SPAN_ROWS", span)
    monkeypatch.setattr(phrases.passed, "__defaults__", (span,))
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert got(phrases.collocations(docs, least=least, top=top)) == sorted(slow(rows, least, top))


def test_slices_do_not_change_counts(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "text string, lang string").repartition(2)
    whole = sorted(map(tuple, phrases.counts(docs, least=1).collect()))
    monkeypatch.setattr(phrases, "COUNTED_BYTES", 1)
    monkeypatch.setattr(phrases, "BATCH_ROWS", 3)
    assert sorted(map(tuple, phrases.counts(docs, least=1).collect())) == whole


def test_edge_table(edge, empty):
    rows = [(t, lang) for _, t, lang, _ in edge_texts()]
    assert got(phrases.collocations(edge)) == sorted(slow(rows))
    assert phrases.collocations(empty).count() == 0


def test_hot_pair(spark):
    """A pair that is most of all words, with many words after it."""
    rows = [(f"of the w{i} of the w{i % 7}", "en") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    assert got(phrases.collocations(docs)) == sorted(slow(rows))


def test_scores_are_exact_past_64_bits(spark):
    row = spark.range(1).select(phrases.score(*[phrases.F.lit(x).cast("long") for x in (10**14 + 1, 10**14 + 3, 10**14 + 2)]).alias("s")).first()
    assert row["s"] == 10**6 * (10**14 + 1) ** 2 // ((10**14 + 3) * (10**14 + 2))
