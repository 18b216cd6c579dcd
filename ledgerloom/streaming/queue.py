"""A task queue as a stream: tasks are dispatched into numbered segments, which a Python data source reads by offset.

A segment is a file of JSON lines, moved into place whole, so a reader never sees half of one. The offset is the number of
segments read; Spark keeps it in the checkpoint, and a query that starts again goes on from there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable, Iterator, Mapping
from urllib.parse import urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_NAME = "segment-{:012d}.jsonl"


def _open(path: str):
    return pafs.FileSystem.from_uri(path if urlparse(path).scheme else "file://" + os.path.abspath(path))


def _count(path: str) -> int:
    """Segments from the first on without a gap."""
    fs, where = _open(path)
    found = {f.base_name for f in fs.get_file_info(pafs.FileSelector(where, allow_not_found=True)) if f.is_file}
    n = 0
    while _NAME.format(n) in found:
        n += 1
    return n


def dispatch(path: str, tasks: Iterable[tuple[str, Mapping]]) -> list[str]:
    """Put (task name, arguments) on the queue as one segment; the tasks' ids. For one writer at a time; no tasks, no segment."""
    rows = [{"task_id": uuid.uuid4().hex, "task": name, "args": json.dumps(args, ensure_ascii=False, sort_keys=True)} for name, args in tasks]
    if rows:
        fs, where = _open(path)
        fs.create_dir(where, recursive=True)
        part = f"{where}/.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode())
        fs.move(part, f"{where}/{_NAME.format(_count(path))}")
    return [r["task_id"] for r in rows]


class QueueSource(DataSource):
    """``spark.readStream.format("task_queue").option("path", ...)``; a batch takes all segments there are, a task each."""

    @classmethod
    def name(cls) -> str:
        return "task_queue"

    def schema(self) -> str:
        return "task_id string, task string, args string, segment long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QueueReader(self.options["path"])


class Segment(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"segments": 0}

    def latestOffset(self) -> dict:
        return {"segments": _count(self.path)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Segment(k) for k in range(start["segments"], end["segments"])]

    def read(self, partition: Segment) -> Iterator[tuple]:
        fs, where = _open(self.path)
        with fs.open_input_stream(f"{where}/{_NAME.format(partition.value)}") as f:
            for line in f.read().decode().splitlines():
                r = json.loads(line)
                yield r["task_id"], r["task"], r["args"], partition.value

    def commit(self, end: dict) -> None:
        """Segments stay, so that results can be traced to them."""


def queued(spark: SparkSession, path: str) -> DataFrame:
    """The queue as a stream of task_id, task, args (JSON) and segment."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("task_queue").option("path", path).load()


def results(stream: DataFrame, target: str, checkpoint: str, work, failed: str):
    """Run ``work`` (a DataFrame of tasks to task_id, result, error) on arriving tasks; results and dead letters to their stores.

    A batch that comes again adds nothing. Tasks with an error go to ``failed`` with what it was.
    """
    from ledgerloom.sources import stores

    def write(batch: DataFrame, _number: int) -> None:
        done = work(batch)
        stores.append_new(done.filter("error IS NULL").select("task_id", "result"), target, "task_id")
        stores.append_new(done.filter("error IS NOT NULL").select("task_id", "error"), failed, "task_id")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome(spark: SparkSession, target: str, task_id: str):
    """A task's stored result, or None."""
    found = spark.read.parquet(target).filter(F.col("task_id") == task_id).head(1)
    return found[0]["result"] if found else None
