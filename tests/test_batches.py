"""Texts are handed to Python workers a few at a time."""

from ledgerloom.operators import extraction as X


def test_a_worker_holds_few_texts(spark):
    docs = spark.createDataFrame([(k if k else None, "a | b\nc | d\ne | f" if k % 3 else None) for k in range(300)], "doc_id int, text string")
    assert "MapInArrow" in X.tables(docs)._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.place, r.table_text) for r in X.tables(docs).collect())
    assert got == [(k, 0, "| a | b |\n| --- | --- |\n| c | d |\n| e | f |") for k in range(300) if k % 3]
    assert X.tables(docs.limit(0)).count() == 0
