"""Frames shared by the tests of the training-data operators."""

from __future__ import annotations

import pytest

WORDS = [f"w{i}x" for i in range(4000)]


def text_of(start: int, n: int) -> str:
    """``n`` words that no other start shares a 5-word run with, unless the ranges overlap."""
    return " ".join(WORDS[(start * 131 + 7 * i * (start % 5 + 1)) % 4000] + str(start) for i in range(n))


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and clashing extra columns."""
    long = text_of(3, 30000)
    rows = [
        (0, text_of(1, 80), "a", "x", 1),
        (1, text_of(1, 80), "a", None, 2),
        (2, "", None, "x", None),
        (3, None, "a", "x", 3),
        (None, text_of(4, 60), "a", "y", 4),
        (5, long, "a", "y", 5),
        (6, long, "a", "y", 6),
        (0, text_of(1, 80), "a", "x", 1),
        (7, " \n\t ", "a", "y", 7),
        (8, "one two", "a", "y", 8),
    ]
    extra = "rank int, bucket string, node string, label int, uid int, key string, h int, n int, spans int, host string, words int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    blank = (1, "b", "n", 0, 1, "k", 2, 3, 4, "h", 5)
    return spark.createDataFrame([r + blank for r in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
