"""Index upkeep: broken and resumed runs equal unbroken ones."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import index

SF = "/root/testdata/sf0.001"


def _docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 60").union(spark.createDataFrame([(None, "no id"), (7, "again under seven"), (900, None), (901, "")], "doc_id long, text string"))


def _cut(text):
    return [p for p in text.split("\n") if p]


def _rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


def test_an_interrupted_run_resumes_to_the_same_index(spark, tmp_path, monkeypatch):
    docs, whole, broken = _docs(spark), f"{tmp_path}/whole", f"{tmp_path}/broken"
    counts = index.reindex(docs, _cut, whole, "r1", parts=3)
    assert counts == {"done": docs.select("doc_id").distinct().count() - 1, "failed": 1}  # the null text fails alone
    real, calls = index.commit_batch, []

    def falls_over(spark, base, batch, tables):
        calls.append(batch)
        if len(calls) == 2:  # chunks are written, the manifest and the marker are not
            tables["chunks"].write.mode("overwrite").parquet(f"{base}/chunks/batch={batch}")
            raise RuntimeError("lost")
        return real(spark, base, batch, tables)

    monkeypatch.setattr(index, "commit_batch", falls_over)
    with pytest.raises(RuntimeError):
        index.reindex(docs, _cut, broken, "r1", parts=3)
    assert len(index.committed(spark, broken)) == 1
    before = index.indexed(spark, broken).count()
    assert 0 < before < index.indexed(spark, whole).count()
    monkeypatch.setattr(index, "commit_batch", real)
    done = []
    index.reindex(docs, lambda t: done.append(1) or _cut(t), broken, "r1", parts=3)
    assert _rows(index.indexed(spark, broken)) == _rows(index.indexed(spark, whole))
    assert index.reindex(docs, _cut, broken, "r1", parts=3) == counts and len(index.committed(spark, broken)) == 3


def test_a_later_run_replaces_documents_and_failures_keep_the_old(spark, tmp_path):
    base = f"{tmp_path}/i"
    docs = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, "d")], "doc_id long, text string")
    index.reindex(docs, _cut, base, "r1", parts=2)
    changed = spark.createDataFrame([(1, "new"), (2, None)], "doc_id long, text string")
    assert index.reindex(changed, _cut, base, "r2", parts=2) == {"done": 1, "failed": 1}
    now = {(r.doc_id, r.idx, r.chunk) for r in index.indexed(spark, base).collect()}
    assert now == {(1, 0, "new"), (2, 0, "c"), (3, 0, "d")}
    mended = spark.createDataFrame([(1, "other"), (2, "mended")], "doc_id long, text string")
    assert index.reindex(mended, _cut, base, "r2", parts=2, retry_failed=True) == {"done": 2}  # only the failed one is tried
    assert {(r.doc_id, r.chunk) for r in index.indexed(spark, base).collect()} == {(1, "new"), (2, "mended"), (3, "d")}


def test_reset_counts_backs_up_and_empties(spark, tmp_path):
    base, backup = f"{tmp_path}/i", f"{tmp_path}/b"
    assert index.indexed(spark, base) is None and index.reset(spark, base) == []
    index.reindex(spark.createDataFrame([(1, "a\nb"), (2, "c")], "doc_id long, text string"), _cut, base, "r", parts=1)
    held = index.reset(spark, base)
    assert held == [("chunks", "r-000000", 3), ("manifest", "r-000000", 2)] and index.indexed(spark, base).count() == 3
    assert index.reset(spark, base, backup, dry_run=False) == held
    assert index.indexed(spark, base) is None and index.indexed(spark, backup).count() == 3


def test_five_stores_are_written_once(spark, tmp_path, monkeypatch):
    facts = "array<struct<metric:string,value:double>>"
    rows = [(1, "Acme", 2023, ["a", "b"], [("revenue", 1.0), ("revenue", 1.0)]), (2, "Acme", 2024, ["c"], [("equity", 2.0)]), (2, "Acme", 2024, ["c"], [("equity", 2.0)]), (3, None, None, [], None), (None, "", 2020, None, [])]
    df = spark.createDataFrame(rows, f"doc_id long, company string, fiscal_year int, chunks array<string>, facts {facts}")
    base, once = f"{tmp_path}/broken", f"{tmp_path}/once"
    tables = ("metadata", "chunks", "facts", "profiles", "links")
    from pyspark.sql.readwriter import DataFrameWriter

    real = DataFrameWriter.parquet
    for fail_at in tables:

        def falls_over(self, path, *a, fail_at=fail_at, **k):
            if f"/{fail_at}/" in path:
                raise RuntimeError("lost")
            return real(self, path, *a, **k)

        monkeypatch.setattr(DataFrameWriter, "parquet", falls_over)
        with pytest.raises(RuntimeError):
            index.store_knowledge(spark, base, "b1", df)
        assert all(index.read_batches(spark, base, t) is None for t in tables)
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    assert index.store_knowledge(spark, base, "b1", df) and index.store_knowledge(spark, once, "b1", df)
    assert not index.store_knowledge(spark, base, "b1", df)
    for t in tables:
        assert _rows(index.read_batches(spark, base, t)) == _rows(index.read_batches(spark, once, t))
    got = {t: index.read_batches(spark, base, t) for t in tables}
    assert {t: got[t].count() for t in tables} == {"metadata": 4, "chunks": 3, "facts": 2, "profiles": 1, "links": 2}
    assert got["profiles"].select("fiscal_year", "latest_doc").head()[0:2] == (2024, 2)
    assert got["facts"].filter(F.col("fact_uid").isNull()).count() == 0
