"""Filters and links between documents, their metadata and an index; each is a plan, nothing is collected but one row where said."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def of_category(rows: DataFrame, col: str, wanted: str | None, every: str = "all") -> DataFrame:
    """Rows of a category; all of them without one or with the word for all."""
    return rows if wanted in (None, "", every) else rows.filter(F.col(col) == wanted)


def matching(rows: DataFrame, wanted: Mapping[str, object]) -> DataFrame:
    """Rows equal in every column for which a value is given; it stands before scoring, so it reaches the scan."""
    given = {c: v for c, v in wanted.items() if v not in (None, "")}
    return functools.reduce(lambda df, c: df.filter(F.col(c) == F.lit(given[c])), given, rows)


def of_company(rows: DataFrame, variants: Sequence[str], columns: Sequence[str], text: str, head: int = 1500) -> DataFrame:
    """Rows that name a variant in a column or in the text's head; all rows where none does."""
    places = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns] + [F.lower(F.coalesce(F.substring(text, 1, head), F.lit("")))]
    named = functools.reduce(Column.__or__, (p.contains(v.lower()) for p in places for v in variants), F.lit(False))
    some = rows.agg(F.max(named).alias("_any"))  # one row
    return rows.withColumn("_named", named).join(F.broadcast(some), F.lit(True)).filter(F.col("_named") | ~F.coalesce("_any", F.lit(False))).drop("_named", "_any")


def already_there(uploads: DataFrame, stored: DataFrame, keys: Sequence[str], done: Column) -> DataFrame:
    """Uploads with ``duplicate``: whether the store holds a finished row of the same keys."""
    have = stored.filter(done).select(*keys).distinct().withColumn("_there", F.lit(True))
    return uploads.join(have, list(keys), "left").withColumn("duplicate", F.coalesce("_there", F.lit(False))).drop("_there")


def without_sources(index: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    return index.join(failed.select(key).distinct(), key, "left_anti")


def binding_company(binding: Column, company: Column) -> Column:
    """The company as a filter, where its binding is authoritative or confirmed."""
    return F.when(binding.isin("authoritative", "confirmed"), company).otherwise("")


def first_of(payload: Column, paths: Sequence[str]) -> Column:
    """The first path of a JSON text that holds a filled value."""
    return F.coalesce(*(F.nullif(F.get_json_object(payload, p), F.lit("")) for p in paths))


def enriched(rows: DataFrame, cache: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows whose blank columns are filled from a cache; of a key's rows there the least by all of its columns, in their order."""
    least = cache.groupBy(key).agg(F.min(F.struct(*columns)).alias("_least"))
    own = least.select(key, *(F.col(f"_least.{c}").alias(f"_{c}") for c in columns))
    joined = rows.join(own, key, "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in rows.columns))


def scope_preferred(rows: DataFrame, score: str, scope: str, separate_only: bool = False, boost: float = 0.05) -> DataFrame:
    """Consolidated rows get a little more; where separate figures are asked for, only these stay."""
    rows = rows.filter(F.col(scope) == "separate") if separate_only else rows
    return rows.withColumn(score, F.col(score) + F.when(F.col(scope) == "consolidated", boost).otherwise(0.0))


def prefiltered(chunks: DataFrame, text: str, company: str, asked: str | None, least: int = 30, foreign: float = 0.1, pattern: str = r"\p{IsHan}") -> DataFrame:
    """Chunks without those too short, of foreign script, or of another company than the one asked for."""
    shown = F.regexp_replace(text, r"\s+", "")
    keep = (F.length(text) >= least) & (F.coalesce(F.try_divide(F.regexp_count(shown, F.lit(pattern)), F.length(shown)), F.lit(0.0)) <= foreign)
    return chunks.filter(keep & (F.coalesce(F.col(company), F.lit("")).isin("", asked)) if asked else keep)


def first_seen(hits: DataFrame, value: str, order: Sequence[Column], most: int = 6) -> DataFrame:
    """Distinct filled values of the best ``most`` hits, with the place at which each comes first."""
    top = hits.orderBy(*order).limit(most).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # at most ``most`` rows
    return top.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(value).agg(F.min("_n").alias("place"))


def newest_per(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order: newest fiscal year first, then least id, for facts of earlier documents."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chat_score(vector: Column, keyword: Column, company: Column, year: Column, period: Column, scope: Column, report: Column) -> Column:
    """0.40 vector, 0.25 keywords and 0.35 metadata: 0.45 company, 0.25 year, 0.15 period and scope each, 0.1 report, at most 1."""
    meta = sum((F.when(F.coalesce(flag, F.lit(False)), w).otherwise(0.0) for flag, w in ((company, 0.45), (year, 0.25), (period, 0.15), (scope, 0.15), (report, 0.1))), F.lit(0.0))
    return F.round(0.40 * vector + 0.25 * keyword + 0.35 * F.least(meta, F.lit(1.0)), 4)


def longest_label(rows: DataFrame, labels: Mapping[str, str], text: str, none: str = "none") -> Column:
    """The event of the longest label that a text holds."""
    return functools.reduce(lambda chain, k: chain.when(F.lower(F.col(text)).contains(k), labels[k]), sorted(labels, key=lambda k: (-len(k), k)), F.when(F.lit(False), "")).otherwise(none)


def model_report(rows: DataFrame, model: str, severity: str, key: str) -> DataFrame:
    """Per model: rows, critical and warning ones, and the ids of critical ones in order."""
    critical = F.col(severity) == "critical"
    return rows.groupBy(model).agg(F.count("*").alias("n"), F.count_if(critical).alias("critical"), F.count_if(F.col(severity) == "warning").alias("warnings"), F.array_join(F.sort_array(F.collect_list(F.when(critical, F.col(key)))), ",").alias("ids"))


def gate(checks: Mapping[str, DataFrame]) -> DataFrame:
    """(check, n, passed) of tables of which none may have a row."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n", (F.col("n") == 0).alias("passed")) for name, df in checks.items()]
    return functools.reduce(DataFrame.union, parts)
