from __future__ import annotations

import pytest

#: Columns whose names the operators use inside.
CLASHING = ("key", "node", "task", "rank", "range", "last", "host", "language", "logs", "row_key", "length", "TEXT_2")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing columns."""
    long_text = " ".join(f"word{n % 977} and{n % 13}" for n in range(60_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 49),
        (2, "The quick brown fox jumps over the lazy dog again", "en", None, None),
        (3, None, "en", "b", 0),
        (4, "", None, "b", 0),
        (5, "   \n\t ", "en", "a", 6),
        (6, long_text, "en", "a", len(long_text)),
        (None, "no id at all here, mail a@b.org", "en", "a", 31),
        (None, None, None, None, None),
        (8, "two words", "en", "a", 9),
        (9, "two words", "de", "c", 9),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    for name in CLASHING:
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit("x"))
    return docs.coalesce(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
