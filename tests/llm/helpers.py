"""Small tables with the cases every operator has to stand."""

from __future__ import annotations

HARD_TEXTS = [None, "", " ", "\n", "a", "word " * 30_000, "zażółć 😀 ▁x\tend\r\n", "same text twice here for you", "same text twice here for you", "x" * 70_000]


def documents(spark, rows):
    """Rows (doc_id, text) with the columns of documents and some whose names clash with results."""
    filled = [(i, t, "en", None, None if t is None else len(t), 7, "x", True) for i, t in rows]
    return spark.createDataFrame(filled, "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, component_id string, kept boolean")


def hard_documents(spark):
    """Nulls in any column, empty, blank and very long texts, repeated rows and ids."""
    rows = [*enumerate(HARD_TEXTS), (3, "\n"), (1, "other text"), (None, "text without id"), (None, None)]
    return documents(spark, rows)


def no_documents(spark):
    return documents(spark, [])


def one_to_one(df, n):
    """The rows of a result that must have as many rows as its input."""
    got = df.collect()
    assert len(got) == n
    return got
