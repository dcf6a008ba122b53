from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, h string, shard string, fp string, part string, row string, term string"


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "river", "stone", "garden", "light", "seven", "quiet", "harbour", "window", "letter", "winter", "copper", "meadow", "lantern", "bridge", "market", "silver"]
    return " ".join(rng.choice(words) + (rng.choice([",", ".", ""]) if rng.random() < 0.2 else "") for _ in range(n))


def rows_of(texts: list[tuple]) -> list[tuple]:
    """Rows with columns of names that operators use themselves."""
    return [(i, t, lang, source, len(t or ""), "k", "s", "h", "sh", "fp", "p", "r", "t") for i, t, lang, source in texts]


def edge_texts() -> list[tuple]:
    rng = random.Random(5)
    long = prose(rng, 30_000)
    out = [(0, None, "en", "a"), (1, "", "en", "a"), (2, " \t\n", "en", None), (3, "one", None, "b"), (4, "!!! ???", "en", "b"), (5, long, "en", "a"), (6, long + " end", "en", "a"), (None, "no id here at all", "en", "a"), (None, None, None, None)]
    out += [(10 + i, prose(rng, 40 + i % 7), "en", "hot" if i % 3 else f"s{i % 4}") for i in range(60)]
    same = prose(rng, 50)
    out += [(100 + i, same, "fr", "hot") for i in range(12)]
    out += [(200, same, "fr", "hot"), (200, same, "fr", "hot"), (200, "another text with the same id", "fr", "hot")]
    out += [(300, "Ärger über naïve Æsir — ½ π ≈ 1.57 wide space", "de", "z"), (301, "words\x00with\x01controls\x1c\x1d end", "de", "z")]
    return out


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(rows_of(edge_texts()), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
