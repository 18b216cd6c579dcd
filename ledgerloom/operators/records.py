"""Counting, grouping, windowing and joining of records: dashboards, integrity checks, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(rows: DataFrame, status: Column, done: str, failed: str) -> DataFrame:
    """One row: total, done, failed, pending, distinct owners."""
    known = status.isin(done, failed)
    return rows.agg(F.count("*").alias("total"), F.count_if(status == done).alias("done"), F.count_if(status == failed).alias("failed"), F.count_if(~F.coalesce(known, F.lit(False))).alias("pending"))


def failure_level(rows: DataFrame, keys: Sequence[str], failed: Column, warn: float = 0.1, stop: float = 0.3) -> DataFrame:
    """Failure ratio of each group and its level: ok, warning above ``warn``, critical above ``stop``."""
    ratio = F.try_divide(F.count_if(failed), F.count("*"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(failed).alias("n_failed"), ratio.alias("ratio"))
    return out.withColumn("level", F.when(F.col("ratio") > stop, "critical").when(F.col("ratio") > warn, "warning").otherwise("ok"))


def top_groups(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values but null; ties by value."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), key).limit(n)


def duplicate_groups(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Groups of more than one row with an equal key: key, size, least and greatest id."""
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).filter("n > 1")


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Of each key the columns at the greatest order value, in one aggregate."""
    return rows.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("m")).select(key, *(F.col(f"m.{c}").alias(c) for c in (order, *columns)))


def missing(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows without a partner."""
    return left.join(right.select(F.col(right_key).alias("_k")).distinct(), F.col(left_key) == F.col("_k"), "left_anti")


def flagged(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str) -> DataFrame:
    """Left rows with whether they have a partner; none is doubled."""
    keys = right.select(F.col(right_key).alias("_k")).distinct()
    return left.join(keys, F.col(left_key) == F.col("_k"), "left").withColumn(name, F.col("_k").isNotNull()).drop("_k")


def batch_status(ids: DataFrame, rows: DataFrame, key: str, done: Column) -> DataFrame:
    """Whether all asked ids are done; unknown ids are not."""
    found = rows.groupBy(key).agg(F.max(done.cast("int")).alias("done"))
    joined = ids.join(found, key, "left")
    return joined.agg(F.count("*").alias("total"), F.count_if(F.col("done") == 1).alias("completed"), F.bool_and(F.coalesce(F.col("done") == 1, F.lit(False))).alias("all_done"))


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of rows in a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def islands(rows: DataFrame, keys: Sequence[str], order: str, kind: Column) -> DataFrame:
    """Runs of consecutive rows of equal kind: number within the keys, kind, length, first and last place."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_kind", kind).withColumn("_new", (F.coalesce(F.lag("_kind").over(w) != F.col("_kind"), F.lit(True))).cast("int"))
    numbered = marked.withColumn("island", F.sum("_new").over(w))
    return numbered.groupBy(*keys, "island").agg(F.first("_kind").alias("kind"), F.count("*").alias("n"), F.min(order).alias("first_at"), F.max(order).alias("last_at"))


def carried_forward(rows: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, within: int | None = None) -> DataFrame:
    """The last known value at or before each row, or strictly before it within a number of rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    w = w.rowsBetween(Window.unboundedPreceding, 0) if within is None else w.rowsBetween(-within, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def running_penalty(rows: DataFrame, key: str, order: Sequence[Column], score: str, free: int = 2, step: float = 0.15) -> DataFrame:
    """Score less ``step`` from the row after the ``free`` first of a key on."""
    seen = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("seen", seen).withColumn("adjusted", F.when(F.col("seen") > free, F.col(score) - step).otherwise(F.col(score)))


def trimmed_history(turns: DataFrame, key: str, order: str, tokens: Column, trigger: int, keep: int) -> DataFrame:
    """Turns of a conversation; only the last ``keep`` where its tokens exceed the trigger."""
    w = Window.partitionBy(key)
    sized = turns.withColumn("_all", F.sum(tokens).over(w)).withColumn("_back", F.row_number().over(w.orderBy(F.col(order).desc())))
    return sized.filter((F.col("_all") <= trigger) | (F.col("_back") <= keep)).drop("_all", "_back")


def most_frequent(rows: DataFrame, keys: Sequence[str], value: str, first: str) -> DataFrame:
    """The value a group has most often; of equals the one seen first."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    return keep_first(counts, keys, [F.col("n").desc(), F.col("_first"), F.col(value)]).select(*keys, value, "n")


def gradient_cutoff(rows: DataFrame, keys: Sequence[str], score: str, tie: str, factor: float = 2.0, least: float = 0.05) -> DataFrame:
    """Scored rows of each group up to the first drop larger than max(factor * mean drop, least); the first row always stays."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), tie)
    steps = rows.withColumn("place", F.row_number().over(w)).withColumn("_drop", F.lag(score).over(w) - F.col(score))
    sized = steps.withColumn("_mean", F.avg("_drop").over(Window.partitionBy(*keys)))
    cut = sized.withColumn("_cut", F.min(F.when((F.col("place") > 1) & (F.col("_drop") > F.greatest(F.col("_mean") * factor, F.lit(least))), F.col("place"))).over(Window.partitionBy(*keys)))
    return cut.filter("_cut is null or place < _cut").drop("_drop", "_mean", "_cut")


def name_matches(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Registered names against query texts, scored by how they match, the best per query.

    Equal 100, name in query 90, query in name 80 plus ten times the share of the name covered; ties by
    shorter name, then name. What is contained begins with a part of up to three characters that what contains it
    holds somewhere, so both directions are joins on that part.
    """
    q, n = F.lower(F.trim("query")), F.lower(F.trim("name"))
    queries, names = queries.filter(F.length(q) > 1), names.filter(F.length(n) > 0)

    def parts(text):
        places = F.sequence(F.lit(1), F.length(text))
        return F.explode(F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*(F.substr(text, i, F.lit(k)) for k in (1, 2, 3)))))))

    in_query = queries.withColumn("_part", parts(q)).join(names.withColumn("_part", F.substring(n, 1, 3)), "_part").filter(F.contains(q, n))
    in_name = names.withColumn("_part", parts(n)).join(queries.withColumn("_part", F.substring(q, 1, 3)), "_part").filter(F.contains(n, q))
    score = F.when(q == n, 100.0).when(F.contains(q, n), 90.0).otherwise(80.0 + 10.0 * F.length(q) / F.length(n))
    found = in_query.unionByName(in_name).drop("_part").withColumn("score", score)
    return keep_first(found, ["query"], [F.col("score").desc(), F.length("name"), F.col("name")])
