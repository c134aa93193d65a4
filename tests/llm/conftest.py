"""Helpers for the corpus operators' tests."""

import pytest

EDGES = [
    (1, "Hello world, this is a small text.", "en", "a"), (1, "Hello world, this is a small text.", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"),
    (4, "   \t\n ", "fr", None), (5, "a " * 30_000, "en", "a"), (6, "x" * 50_000, None, "c"), (7, "日本語 тест ñandú 😀 <|endoftext|> a_b", "es", "b"), (None, "no id here", "de", "b"), (8, "12345 ... !!!", "en", "a"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, repeated rows, empty and very long texts, and extra columns with names that operators use themselves."""
    rows = [(*r, len(r[1] or ""), "x", 1, 2.0) for r in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, score int, row_id double")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
