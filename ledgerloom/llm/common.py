"""Shared plumbing: Arrow-mapped functions, shared-folder tables, column hygiene."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def arrow_map(df: DataFrame, target: str, schema: str, **options) -> DataFrame:
    """mapInArrow with ``module:function`` called as function(batches, **options) in the worker.

    The function is looked up in the worker, so its module-level caches live as long as the worker does.
    """
    module, _, name = target.partition(":")
    root = ROOT

    def run(batches):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(batches, **options)

    return df.mapInArrow(run, schema)


def arrow_groups(grouped, target: str, schema: str, **options) -> DataFrame:
    """applyInArrow with ``module:function`` called as function(table, **options) in the worker on each group's table."""
    module, _, name = target.partition(":")
    root = ROOT

    def run(table):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(table, **options)

    return grouped.applyInArrow(run, schema)


def arrow_cogroups(left, right, target: str, schema: str, **options) -> DataFrame:
    """applyInArrow on two tables grouped alike, ``module:function`` called as function(left, right, **options) in the worker."""
    module, _, name = target.partition(":")
    root = ROOT

    def run(a, b):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(a, b, **options)

    return left.cogroup(right).applyInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor reaches: spark.checkpoint.dir. Only a session on this machine alone may leave it unset and gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_own_dirs: set[str] = set()


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir/ledgerloom/<application>, which is removed when the driver's Python ends."""
    own = f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}"
    if own not in _own_dirs:
        if not _own_dirs:
            atexit.register(_remove_own)
        _own_dirs.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _remove(path: str) -> None:
    jvm = SparkContext._gateway.jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    active = SparkContext._active_spark_context
    conf = active._jsc.hadoopConfiguration() if active else jvm.org.apache.hadoop.conf.Configuration()
    where.getFileSystem(conf).delete(where, True)


def _remove_own() -> None:
    for path in _own_dirs:
        with contextlib.suppress(Exception):  # the JVM may have ended before, and then nothing can be removed from here
            _remove(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Remove what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_ledgerloom_path", None)
    if path:
        _remove(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just id and text under fixed names, so extra columns can't clash; null texts become empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def tasks(df: DataFrame) -> int:
    """Number of shuffle partitions of the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


_stores: dict = {}


def claim(name: str, clear) -> None:
    """Make this operator the one that keeps a store in this worker; other operators' stores are let go.

    Workers outlive a query's stages, and what an earlier operator has kept would otherwise add up.
    """
    _stores[name] = clear
    others = [k for k in _stores if k != name]
    for other in others:
        _stores.pop(other)()
    if others:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: what Arrow's pool keeps for later, and what the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """(ids, texts) of a batch in slices of about ``most`` characters, so work arrays stay small."""
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        s = t.as_py() or ""
        if ids and size + len(s) > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(i)
        texts.append(s)
        size += len(s)
    if ids:
        yield ids, texts


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 (fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
