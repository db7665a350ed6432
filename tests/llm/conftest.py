from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty and long texts, repeated rows and ids."""
    long = words(1, 30_000)
    rows = [(1, "plain text of a few words", "en", "a"), (1, "plain text of a few words", "en", "a"), (2, None, None, None), (None, "no id here", "de", "b"), (None, None, None, None), (3, "", "", ""), (4, "   \n\t ", "fr", "b"), (5, long, "en", "a"), (6, "é ß 漢字 😀 " * 40, "xx", "c"), (7, words(2, 80), "en", "c")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
