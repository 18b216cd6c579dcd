import public_tokenizers
import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("hash", T.StringType())])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table, with two extra columns whose names clash with inner ones, from (doc_id, text[, source]) rows."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None, "x", None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, long, repeated rows and odd characters."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (5, "don't  stop x\x85y\x1cz\u3000q\U0001f389 <|endoftext|> tail"), (6, long), (6, long), (None, "no id here at all, six words"),
        (None, None), (7, "a" * 5000), (8, "ümläut ÄÖ straße " * 40), (9, "<|endoftext|>"), (10, " leading and trailing "), (10, "other text under a repeated id"),
    ]


def rows_of(df, *cols):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda t: tuple((x is not None, x) for x in t))
