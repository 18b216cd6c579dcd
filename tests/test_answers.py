"""Disclosure expressions and dialogue operators on literals: nulls, empty texts, ties, repeated rows, empty tables."""

from pyspark.sql import functions as F

from ledgerloom.functions import disclosure as D
from ledgerloom.operators import dialogue as G


def _one(spark, col, text):
    return spark.createDataFrame([(text,)], "text string").select(col(F.col("text")).alias("x")).first()["x"]


def test_executives_once_and_no_titles(spark):
    text = "President Ann Lee and Director Bo Ray. Director Bo Ray, Director President Xu"
    assert [tuple(r) for r in _one(spark, D.executives, text)] == [("President", "Ann Lee"), ("Director", "Bo Ray")]
    assert _one(spark, D.executives, "") == [] and _one(spark, D.executives, None) is None


def test_audit_info(spark):
    told = _one(spark, D.audit_info, "Audited by Gray Stone LLP.\nKey audit matters\n1. Recognition of revenue\n2. Value of stock held")
    assert (told.auditor, told.opinion, told.matters) == ("Gray Stone LLP", "unqualified", ["Recognition of revenue", "Value of stock held"])
    far = _one(spark, D.audit_info, "Audited by Gray Stone LLP." + " x" * 600 + " qualified opinion")
    assert far.opinion == "qualified"
    none = _one(spark, D.audit_info, None)
    assert none.auditor is None and none.opinion is None


def test_risks_customers_segments_of_nothing(spark):
    for of in (D.risks, D.customers, D.segments):
        assert _one(spark, of, "") == []
    assert _one(spark, D.customers, "Major customers: B, A, B, 3 more. Major customers: Co\n") == ["Co"]


def test_windows(spark):
    w = lambda n: tuple(_one(spark, lambda t: D.windows(t.cast("int")), str(n)))
    assert [w(n) for n in (9_999, 10_000, 50_000, 200_000)] == [(9_999,) * 3, (5_000, 10_000, 10_000), (3_000, 5_000, 50_000), (3_000, 5_000, 100_000)]
    assert _one(spark, lambda t: D.windows(F.length(t)), None) is None


def test_memory_looks_back_six_messages_only(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"word{i}") for i in range(8)] + [(2, 0, "user", None)]
    rows = {(r["conv_id"], r["turn"]): r for r in G.session_memory(spark.createDataFrame(turns, "conv_id long, turn int, role string, text string"), ["word0", "word2"]).collect()}
    assert rows[1, 5]["mentioned"] == ["word0", "word2"] and rows[1, 7]["mentioned"] == ["word2"]
    assert (rows[1, 7]["objective"], rows[1, 7]["resolved"]) == ("word6", "word7")
    assert rows[2, 0]["objective"] is None and rows[2, 0]["mentioned"] == []


def test_inheritance_reaches_one_turn_back(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", None), (1, 3, "user", None)]
    got = G.inherited(spark.createDataFrame(turns, "conv_id long, turn int, role string, own string"), "own").orderBy("turn").collect()
    assert [(r["context"], r["inherited"]) for r in got] == [("a", False), ("a", True), (None, False)]


def test_sources_by_priority_and_citations(spark):
    schema = "k int, value double"
    first, second = spark.createDataFrame([(1, None), (2, 5.0), (2, 4.0)], schema), spark.createDataFrame([(1, 7.0), (2, 1.0)], schema)
    assert {tuple(r) for r in G.by_source([first, second], ["k"], "value").collect()} == {(1, 2, 7.0), (2, 1, 4.0)}
    rows = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "a", 1)], "k int, s string, o int")
    assert [tuple(r) for r in G.cited_once(rows, "k", F.col("s"), [F.col("o")]).orderBy("n").collect()] == [(1, "a", 1), (1, "b", 2)]
    empty = G.cited_once(rows.filter("k = 9"), "k", F.col("s"), [F.col("o")])
    assert empty.count() == 0


def test_link_audit_of_no_rows(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert tuple(G.link_audit(none, F.col("a"), F.col("b")).first()) == (0, 0, 0, 0)
