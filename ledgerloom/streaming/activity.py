"""Streams of events and arriving documents: windows, sessions, rates, expiring state, incremental ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, size: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts and sums by window; events later than the watermark are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, closed after a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def over_capacity(events: DataFrame, capacity: int, size: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Keys with more events in a window than their capacity, and the seconds to wait: 30 * 2 ** (overrun - 1), at most 300."""
    counts = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", size)).agg(F.count("*").alias("n"))
    wait = F.least(F.lit(300.0), 30.0 * F.pow(F.lit(2.0), F.col("n") - capacity - 1))
    return counts.filter(F.col("n") > capacity).select("user_id", F.col("window.start").alias("start"), "n", wait.alias("wait_s"))


def deduplicated(rows: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _touched(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        n, last = state.get
        state.remove()
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ts": [pd.Timestamp(last, unit="us")], "expired": [True]})
        return
    n, last = state.get if state.exists else (0, 0)
    for b in batches:
        n += len(b)
        last = max(last, int(b["ts"].max().value // 1000))
    state.update((n, last))
    state.setTimeoutTimestamp(max(last // 1000 + ttl_ms, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "last_ts": [pd.Timestamp(last, unit="us")], "expired": [False]})


def expiring_sessions(events: DataFrame, ttl_ms: int = 1_800_000, late: str = "10 minutes") -> DataFrame:
    """Running count of each user's events; state that has not been touched for the time to live goes, with a last row."""

    def update(key, batches, state):
        yield from _touched(key, batches, state, ttl_ms)

    return events.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, last_ts timestamp, expired boolean", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_once(stream: DataFrame, target: str, checkpoint: str, key: str):
    """Arriving rows to a Parquet store: the checkpoint resumes after a stop, and a repeated batch adds nothing."""
    from ledgerloom.sources import stores

    def write(batch: DataFrame, _number: int) -> None:
        stores.append_new(batch, target, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dead_letters(failures: DataFrame, key: str, most: int = 3) -> DataFrame:
    """Keys that failed in at least ``most`` runs."""
    return failures.groupBy(key).agg(F.countDistinct("run").alias("runs")).filter(F.col("runs") >= most)
