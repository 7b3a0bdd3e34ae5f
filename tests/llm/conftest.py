from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, node string, doc string, spans string"


def words(rng: random.Random, n: int) -> str:
    """Prose of few words, so that shingles and lines meet again."""
    return " ".join(rng.choice(["to", "be", "or", "not", "that", "is", "the", "question", "Über", "naïve", "日本"]) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal ids."""
    rng = random.Random(7)
    base = [words(rng, 60) + "\n" + words(rng, 30) + "\n" + words(rng, 25) for _ in range(12)]
    texts = [*base, base[0], base[0] + " end", base[1].replace("to", "two", 1), "", " \n\t\x0b\x0c\r ", None, "one", "two words", " ", "123 456", words(rng, 30_000), "x" * 300_000]
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 5 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (3, "another text under an id that is taken", None, "", None), (None, base[4], None, None, None), (None, None, None, None, None)]
    return [(*r, "a", None, "b", "c", "d") for r in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
