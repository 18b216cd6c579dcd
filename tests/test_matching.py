"""Containment and closeness of names against comparison of all pairs."""

import difflib

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import matching
from ledgerloom.plans import matching_queries

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("block", [8 << 20, 4])
def test_contained_equals_all_pairs(spark, block):
    texts = [(1, "abcabd"), (1, "abcabd"), (None, "xxab"), (2, None), (3, ""), (4, "é日本é"), (5, "ab" * 4000)]
    names = ["ab", "bca", "abcabd", "日本", "", None, "ab", "zz", "x"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "id long, t string, _name string")
    got = matching.contained(df, spark.createDataFrame([(n,) for n in names], "n string"), "t", "n", block_bytes=block)
    want = [(i, "clash", n) for i, t in texts for n in {x for x in names if x} if t and n in t]
    assert _rows(got) == sorted(want, key=lambda t: tuple((x is not None, x) for x in t))
    assert matching.contained(df, spark.createDataFrame([], "n string"), "t", "n").count() == 0
    assert matching.contained(df.limit(0), spark.createDataFrame([("a",)], "n string"), "t", "n").count() == 0


def test_no_nested_loop_of_rows(spark):
    for name in ("names_in_texts", "sources_either_way", "closest_words"):
        plan = matching_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_documents_of_names_puts_exact_ones_first(spark):
    docs = spark.createDataFrame([(1, "Acme"), (2, "ACME Corp"), (3, "acme"), (4, None), (5, ""), (6, "cm"), (7, "other"), (None, "acme")], "doc_id long, company string")
    asked = spark.createDataFrame([("acme",), ("ACME",), ("",), (None,), ("unknown",)], "q string")
    got = matching.documents_of_names(asked, docs, "q", "company", most=4)
    assert sorted((r.place, r.doc_id, r.kind) for r in got.collect()) == [(1, 1, "exact"), (2, 3, "exact"), (3, None, "exact"), (4, 2, "fuzzy")]


def _closest_by_all_pairs(asked, names, least, most):
    out = []
    for q in sorted(set(asked)):
        scored = []
        for n in set(names):
            ratio = 1.0 if n in q or q in n else difflib.SequenceMatcher(None, q, n).ratio()
            if ratio >= least:
                scored.append((-ratio, -len(n), n))
        out += [(q, n, round(-r, 6), k + 1) for k, (r, _, n) in enumerate(sorted(scored)[:most])]
    return sorted(out)


def test_closest_words_equal_all_pairs(spark):
    got = [tuple(r) for r in matching_queries.closest_words(spark, SF).collect()]
    asked = [r.name for r in matching_queries._long_words(spark.read.parquet(f"{SF}/benchmark.parquet"), 10).collect()]
    names = [r.name for r in matching_queries._long_words(spark.read.parquet(f"{SF}/conversations.parquet").filter("role = 'user'"), 10).collect()]
    assert len(asked) > 40 and len(names) > 60 and sorted(got) == _closest_by_all_pairs(asked, names, 0.38, 3)


@pytest.mark.parametrize("block", [8 << 20, 30])
def test_closest_names_edges(spark, block):
    asked, names = ["samsung elec", "", None, "Apple", "apple", "zzz", "ab" * 150], ["Samsung Electronics", "samsing", "apples", "Apple Inc", "", None, "p", "ab" * 149 + "x", "qqq"]
    df = lambda v: spark.createDataFrame([(x,) for x in v], "v string")
    got = matching.closest_names(df(asked), df(names), "v", "v", block_bytes=block).withColumn("ratio", F.round("ratio", 6))
    lower = lambda v: [x.lower() for x in v if x]
    assert sorted(map(tuple, got.collect())) == _closest_by_all_pairs(lower(asked), lower(names), 0.38, 3)
    assert matching.closest_names(df(asked), df([]), "v", "v").count() == 0
