"""Upkeep of an index of chunks: batches under commit markers, a manifest of runs, replacement by document, resumption.

A batch writes its tables under ``<base>/<table>/batch=<name>`` and its marker last; readers see marked batches alone. So a
batch that fell over between two writes adds nothing, and writing it again leaves what one unbroken writing leaves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_MARKS = "_commits"


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _place(spark, path)
    return fs.exists(where)


def committed(spark: SparkSession, base: str) -> list[str]:
    """Names of the batches whose marker stands, in order."""
    fs, where = _place(spark, f"{base}/{_MARKS}")
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def commit_batch(spark: SparkSession, base: str, batch: str, tables: Mapping[str, DataFrame]) -> bool:
    """Write a batch's tables and then its marker; False, and nothing is done, if the marker stands already.

    What an earlier try has left of the batch is overwritten. ``batch`` must be the same whenever the same work is done
    again, and be used by one writer at a time.
    """
    if batch in committed(spark, base):
        return False
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
    fs, where = _place(spark, f"{base}/{_MARKS}/{batch}")
    fs.create(where, True).close()
    return True


def read_batches(spark: SparkSession, base: str, table: str) -> DataFrame | None:
    """Rows of a table in committed batches, with ``batch``; None before the first that wrote it."""
    paths = [p for b in committed(spark, base) if exists(spark, p := f"{base}/{table}/batch={b}")]
    return spark.read.option("basePath", f"{base}/{table}").parquet(*paths).withColumn("batch", F.col("batch").cast("string")) if paths else None


def indexed(spark: SparkSession, base: str, table: str = "chunks", key: str = "doc_id") -> DataFrame | None:
    """The index as it counts: of each document the rows of the last batch that indexed it, by the manifests.

    A document that was indexed anew has no rows of before, and one whose indexing failed keeps them.
    """
    rows, runs = read_batches(spark, base, table), read_batches(spark, base, "manifest")
    if rows is None or runs is None:
        return None
    last = runs.filter("status = 'done'").groupBy(F.col(key).alias("_key")).agg(F.max("batch").alias("_last"))
    return rows.join(last, F.col(key).eqNullSafe(F.col("_key")) & (F.col("batch") == F.col("_last")), "left_semi")


def isolated(docs: DataFrame, cut: Callable[[str], list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, status, error, chunks: each text cut by ``cut``; one that raises is failed with its message and harms no other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"], strict=True):
                try:
                    rows.append((key, "done", None, list(cut(text))))
                except Exception as e:  # whatever a text does to the cutter is that text's failure
                    rows.append((key, "failed", f"{type(e).__name__}: {e}"[:500], []))
            yield pd.DataFrame(rows, columns=["id", "status", "error", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, status string, error string, chunks array<string>").withColumnRenamed("id", id_col)


def reindex(docs: DataFrame, cut: Callable[[str], list[str]], base: str, run: str, parts: int = 4, retry_failed: bool = False, id_col: str = "doc_id", text_col: str = "text") -> dict[str, int]:
    """Index documents in ``parts`` batches of a run; resumes where an earlier try of the same run stopped.

    Documents are dealt to parts by a hash of their id, so a part is the same whenever it is tried. A committed part is
    passed over; with ``retry_failed`` its failed documents are tried again in a batch of their own. Returns documents by
    status in this run. Null ids are one document, as are rows of one id: each of its rows is cut, and it is failed if any is.
    """
    spark = docs.sparkSession
    dealt = docs.withColumn("_part", F.pmod(F.xxhash64(id_col), F.lit(parts)))
    for k in range(parts):
        _index_part(dealt.filter(F.col("_part") == k).drop("_part"), cut, base, f"{run}-{k:06d}", id_col, text_col)
    runs = read_batches(spark, base, "manifest")
    own = runs.filter(F.col("batch").startswith(f"{run}-"))
    if retry_failed:
        tries = len({b for b in committed(spark, base) if b.startswith(f"{run}-retry")})
        failed = _latest(own, id_col).filter("status = 'failed'").select(F.col(id_col).alias("_key"))
        again = docs.join(failed, F.col(id_col).eqNullSafe(F.col("_key")), "left_semi")
        if again.head(1):
            _index_part(again, cut, base, f"{run}-retry{tries:06d}", id_col, text_col)
            own = read_batches(spark, base, "manifest").filter(F.col("batch").startswith(f"{run}-"))
    return {r["status"]: r["n"] for r in _latest(own, id_col).groupBy("status").agg(F.count("*").alias("n")).collect()}


def _latest(manifest: DataFrame, key: str) -> DataFrame:
    return manifest.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("batch").desc()))).filter("_n = 1").drop("_n")


def _index_part(docs: DataFrame, cut: Callable, base: str, batch: str, id_col: str, text_col: str) -> None:
    spark = docs.sparkSession
    if batch in committed(spark, base):
        return
    where = f"{base}/_work/batch={batch}"  # cut once, read for both tables
    isolated(docs, cut, id_col, text_col).write.mode("overwrite").parquet(where)
    found = spark.read.parquet(where)
    statuses = found.groupBy(id_col).agg(F.max("status").alias("status"), F.max("error").alias("error"), F.sum(F.size("chunks")).alias("n_chunks"))  # 'failed' comes after 'done'
    bad = statuses.filter("status = 'failed'").select(F.col(id_col).alias("_key"))
    good = found.join(bad, F.col(id_col).eqNullSafe(F.col("_key")), "left_anti")
    chunks = good.select(id_col, F.posexplode("chunks").alias("idx", "chunk"))
    commit_batch(spark, base, batch, {"chunks": chunks, "manifest": statuses})
    fs, path = _place(spark, where)
    fs.delete(path, True)


def inventory(spark: SparkSession, base: str, tables: tuple[str, ...] = ("chunks", "manifest")) -> DataFrame:
    """table, batch, n: rows by committed batch."""
    counts = [t.groupBy("batch").agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "batch", "n") for name in tables if (t := read_batches(spark, base, name)) is not None]
    out = spark.createDataFrame([], "table string, batch string, n long")
    for c in counts:
        out = out.unionByName(c)
    return out


def reset(spark: SparkSession, base: str, backup: str | None = None, dry_run: bool = True, tables: tuple[str, ...] = ("chunks", "manifest")) -> list[tuple[str, str, int]]:
    """What an index holds by table and batch; unless ``dry_run``, that is copied to ``backup`` and the index emptied.

    Nothing is removed before the copy's rows have been counted and agree; afterwards the index must be empty.
    """
    held = [tuple(r) for r in inventory(spark, base, tables).orderBy("table", "batch").collect()]
    if dry_run:
        return held
    if backup:
        for batch in committed(spark, base):
            commit_batch(spark, backup, batch, {name: rows.filter(F.col("batch") == batch).drop("batch") for name in tables if (rows := read_batches(spark, base, name)) is not None})
        kept = {tuple(r) for r in inventory(spark, backup, tables).collect()}
        if not set(held) <= kept:
            raise ValueError("the backup does not hold what the index holds; nothing was removed")
    fs, where = _place(spark, f"{base}/{_MARKS}")
    fs.delete(where, True)  # without markers nothing counts, whatever is interrupted after this
    for name in (*tables, "_work"):
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}"), True)
    if inventory(spark, base, tables).count():
        raise ValueError("the index is not empty")
    return held


def store_knowledge(spark: SparkSession, base: str, batch: str, analyses: DataFrame, id_col: str = "doc_id") -> bool:
    """One batch of what analyses hold into five stores: metadata, chunks, facts, profiles and links. True if it was written now.

    ``analyses`` has the id, company, fiscal_year (int), chunks (array of string) and facts (array of struct of metric and
    value). Of a document's repeated rows the first by content counts. Facts and chunks bear ids made of what they say, so
    the same analysis makes the same rows; of a company the profile is its document of the latest year, then the greatest id.
    """
    once = analyses.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy("fiscal_year", "company", F.to_json(F.struct("chunks", "facts"))))).filter("_n = 1").drop("_n")
    uid = lambda *parts: F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)
    doc = F.col(id_col)
    each_fact = once.select(id_col, "company", "fiscal_year", F.explode("facts").alias("f")).select(id_col, "company", "fiscal_year", "f.metric", "f.value")
    each_chunk = once.select(id_col, F.posexplode("chunks").alias("idx", "chunk"))
    named = once.filter(F.coalesce("company", F.lit("")) != "")
    return commit_batch(
        spark,
        base,
        batch,
        {
            "metadata": once.select(id_col, "company", "fiscal_year", F.size("chunks").alias("n_chunks"), F.size("facts").alias("n_facts")),
            "chunks": each_chunk.withColumn("chunk_uid", uid(doc, F.col("idx"), F.col("chunk"))),
            "facts": each_fact.withColumn("fact_uid", uid(doc, F.col("company"), F.col("fiscal_year"), F.col("metric"), F.col("value"))).dropDuplicates(["fact_uid"]),
            "profiles": named.groupBy("company").agg(F.max(F.struct("fiscal_year", id_col)).alias("l")).select("company", "l.fiscal_year", F.col(f"l.{id_col}").alias("latest_doc")),
            "links": named.select(id_col, "company").distinct(),
        },
    )
