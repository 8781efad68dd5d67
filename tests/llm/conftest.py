import random

import pytest

LONG = "palabra larga y corta " * 6000


def make(spark, rows, more=""):
    """Documents with extra columns whose names clash with what the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, start string, h string, key string, fp string, label string, words string, kept string"
    full = [(i, t, lang, src, None if t is None else len(t), "s", "h", "k", "f", "l", "w", "k") for i, t, lang, src in rows]
    return spark.createDataFrame(full, schema)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ties."""
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (None, "a null id", "en", "b"), (5, LONG, "es", "b"), (6, "same text here for all of us to read now today", "en", "a"), (6, "same text here for all of us to read now today", "en", "a"), (7, "same text here for all of us to read now today", None, None), (8, "é ñ ß 日本語 🙂", "fr", "c"), (9, "x" * 70_000, "en", "c")]
    return make(spark, rows)


@pytest.fixture
def empty(spark):
    return make(spark, [])


def words(rng: random.Random, n: int, vocab: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocab):x}z" for _ in range(n)]
