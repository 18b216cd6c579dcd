"""Chunk and vector stores kept as Parquet or JSON lines: readers that count bad rows, writers that may run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, chunk_idx int, rcept_no string, company_name string, fiscal_year string, report_type string, chunk_type string, statement_scope string, text string, char_count int, _corrupt string"


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected lines) of JSON lines; a line that is no record of the schema is rejected, never dropped silently."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    missing = F.col("_corrupt").isNotNull() | F.col("chunk_id").isNull()
    return rows.filter(~missing).drop("_corrupt"), rows.filter(missing).select(F.col("_corrupt").alias("line"))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training records of text lines: file, line and the parsed variant, null where it is no JSON."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"), F.try_parse_json("value").alias("record"))


def completed(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys a store already holds, or None where there is no store yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(path).select(key).distinct()


def append_new(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Append the rows whose key the store doesn't hold; of repeated keys the least row. Running it again adds nothing.

    A null key counts as a key like others.
    """
    have = completed(rows.sparkSession, path, key)
    ranked = rows.withColumn("_row", F.row_number().over(Window.partitionBy(key).orderBy(*(F.col(f"`{c}`") for c in rows.columns))))
    new = ranked.filter("_row = 1").drop("_row")
    if have is not None:
        have = have.withColumnRenamed(key, "_have")
        new = new.join(have, F.col(key).eqNullSafe(F.col("_have")), "left_anti")
    new.write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """Write rows by partition; partitions that come again are replaced whole, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows but those that come anew, and the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def upserted_vectors(old: DataFrame, new: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """As upserted(); new vectors of another size than ``dim`` are passed over."""
    return upserted(old, new.filter(F.size(vector) == dim).dropDuplicates([key]), key)


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, null fields left out, other characters than ASCII kept."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def with_defaults(rows: DataFrame) -> DataFrame:
    """Nulls by type: empty text, zero, false; other kinds stay."""
    kinds = {"string": "", "int": 0, "bigint": 0, "double": 0.0, "float": 0.0, "boolean": False}
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit(kinds[t]).cast(t)).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in rows.dtypes))


def indexed_now(index: DataFrame, done: DataFrame, key: str, stamp: str, at) -> DataFrame:
    """The index with a time on rows that were done, others' times kept."""
    marks = done.select(key).distinct().withColumn("_done", F.lit(True))
    return index.join(marks, key, "left").withColumn(stamp, F.when(F.col("_done"), F.lit(at)).otherwise(F.col(stamp))).drop("_done")


def reclassified(analyses: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(analyses with each document's latest category replaced, audit rows of previous and new category).

    Of several changes of a document the last by category and reason is taken.
    """
    changes = changes.groupBy("document_id").agg(F.max(F.struct("new_category", "reason")).alias("c")).select("document_id", "c.new_category", "c.reason")
    last = analyses.groupBy("document_id").agg(F.max("id").alias("id"))
    hit = changes.join(last, "document_id")
    audit = hit.join(analyses, ["document_id", "id"]).select("document_id", F.col("category").alias("previous_category"), "new_category", "reason")
    out = analyses.join(hit.select("id", "new_category"), "id", "left").withColumn("category", F.coalesce("new_category", "category")).drop("new_category")
    return out, audit
