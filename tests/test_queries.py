"""Every registered query outside the training-data operators runs; those with SQL give the same rows."""

import re
import unicodedata

import pytest

from ledgerloom.functions import text as T
from ledgerloom.plans import registry
from tests import oracles

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracles.connection(SF)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    cols, rows = oracles.rows_of_spark(QUERIES[name](spark, SF))
    if name in SQL:
        want_cols, want = oracles.rows_of_sql(con, SQL[name])
        assert cols == want_cols
        assert rows == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_query_terms_reads_whole_questions(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'").collect()

    def longest(text):
        plain = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower())
        return max((t for t in plain.split() if len(t) > 1 and t not in T.LATIN.stop_words), key=len)

    want = {(r["conv_id"], r["turn"]): longest(r["text"]) for r in rows}
    assert {(r["conv_id"], r["turn"]): r["longest"] for r in QUERIES["query_terms"](spark, SF).collect()} == want


def test_ordered_distinct_terms_reads_whole_texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def firsts(text):
        pieces = (re.sub(r"[ \t\n\r\f\x0b]+", " ", p).strip(" ") for p in re.split(r"[.,\n]", text))
        return "|".join(list(dict.fromkeys(p for p in pieces if p))[:3])

    assert {r["doc_id"]: r["firsts"] for r in QUERIES["ordered_distinct_terms"](spark, SF).collect()} == {r["doc_id"]: firsts(r["text"]) for r in rows}


def test_spaced_positions_look_at_every_place(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()

    def spaced(text):
        last, n, at = -600, 0, text.lower().find("the")
        while at >= 0 and n < 12:
            if at - last >= 600:
                last, n = at, n + 1
            at = text.lower().find("the", at + 3)
        return n

    assert {r["doc_id"]: r["n"] for r in QUERIES["spaced_positions"](spark, SF).collect()} == {r["doc_id"]: spaced(r["text"]) for r in rows}
