"""Selecting, ranking, comparing and deriving financial facts.

Facts are long rows (fact_id, company, fiscal_year, metric, value, period_type, report_type). Ties are always
broken by fact_id, so results do not depend on the order of input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_RANK = {"annual": 0, "semiannual": 1, "quarterly": 2, "event": 3}
REPORT_RANK = {"1-URGENT": 0, "2-HIGH": 0, "3-MEDIUM": 1, "4-NOT SPECIFIED": 2}


def rank_of(value: Column, ranks: Mapping[str, int], other: int) -> Column:
    """Place of a value in a fixed order; ``other`` for values that aren't in it and for null."""
    table = F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))
    return F.coalesce(F.try_element_at(table, value), F.lit(other))


def without_reports(facts: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Facts but for some report types; a null type stays."""
    return facts.filter(~F.coalesce("report_type", F.lit("")).isin(*excluded))


def best_per_cell(facts: DataFrame) -> DataFrame:
    """The best fact of each (metric, company, year): by report rank, period rank, then newest id; null values never win."""
    order = [rank_of(F.col("report_type"), REPORT_RANK, 5), rank_of(F.col("period_type"), PERIOD_RANK, 4), F.col("fact_id").desc()]
    w = Window.partitionBy("metric", "company", "fiscal_year").orderBy(*order)
    return facts.filter("value is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_per_company(facts: DataFrame, metric: str) -> DataFrame:
    """Each company's newest fact of a metric: latest year, then newest id."""
    w = Window.partitionBy("company").orderBy(F.col("fiscal_year").desc(), F.col("fact_id").desc())
    return facts.filter((F.col("metric") == metric) & F.col("value").isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ranked(rows: DataFrame, by: str = "value", ascending: bool = False, limit: int | None = None) -> DataFrame:
    """Rows numbered 1..n by a column, ties by company; with a limit the top rows alone are numbered."""
    order = [F.col(by).asc() if ascending else F.col(by).desc(), F.col("company")]
    top = rows.orderBy(*order).limit(limit) if limit is not None else rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def trend(facts: DataFrame, metric: str, oldest_wins: bool = True) -> DataFrame:
    """One value per company and year; of several facts the smallest id wins (the largest, if not oldest_wins)."""
    w = Window.partitionBy("company", "fiscal_year").orderBy(F.col("fact_id").asc() if oldest_wins else F.col("fact_id").desc())
    found = facts.filter((F.col("metric") == metric) & F.col("value").isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return found.select("company", "fiscal_year", "value", "fact_id")


def series(points: DataFrame) -> DataFrame:
    """Trend points of a company as one ordered array of (fiscal_year, value)."""
    return points.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("fiscal_year", "value"))).alias("points"))


def year_over_year(cells: DataFrame) -> DataFrame:
    """Growth in per cent against the year before, which must be there; by the absolute value of the base, null for base 0."""
    w = Window.partitionBy("metric", "company").orderBy("fiscal_year")
    before = cells.withColumn("prev_year", F.lag("fiscal_year").over(w)).withColumn("prev_value", F.lag("value").over(w))
    growth = F.try_divide(F.col("value") - F.col("prev_value"), F.nullif(F.abs("prev_value"), F.lit(0.0))) * 100
    return before.filter("prev_year = fiscal_year - 1").select("metric", "company", "fiscal_year", "value", "prev_value", growth.alias("yoy_pct"))


def wide(cells: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per company and year with a column for each metric."""
    pick = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]
    return cells.groupBy("company", "fiscal_year").agg(*pick)


def percent(part: Column, whole: Column) -> Column:
    """part / whole in per cent; null when either is null or the whole is 0."""
    return F.try_divide(part, F.nullif(whole, F.lit(0.0))) * 100


def ratios(cells: DataFrame) -> DataFrame:
    """Operating margin, net margin and debt ratio of each company and year, from cells of annual facts alone."""
    table = wide(cells.filter("period_type = 'annual'"), ("revenue", "operating_profit", "net_income", "liabilities", "equity"))
    return table.select(
        "company",
        "fiscal_year",
        percent(F.col("operating_profit"), F.col("revenue")).alias("operating_margin"),
        percent(F.col("net_income"), F.col("revenue")).alias("net_margin"),
        percent(F.col("liabilities"), F.col("equity")).alias("debt_ratio"),
    )


def coverage_grid(facts: DataFrame, metrics: Sequence[str], years: Sequence[int]) -> DataFrame:
    """OK, NON_ANNUAL or MISSING for each company, metric and year; the dimensions are small and crossed as arrays."""
    cells = facts.select("company").distinct().select("company", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    cells = cells.select("company", "metric", F.explode(F.array(*map(F.lit, years))).alias("fiscal_year"))
    have = facts.filter("value is not null").groupBy("company", "metric", "fiscal_year").agg(F.count_if(F.col("period_type") == "annual").alias("annual"), F.count("*").alias("n"))
    verdict = F.when(F.col("annual") > 0, "OK").when(F.col("n") > 0, "NON_ANNUAL").otherwise("MISSING")
    return cells.join(have, ["company", "metric", "fiscal_year"], "left").select("company", "metric", "fiscal_year", verdict.alias("verdict"))


def within_ranges(facts: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Facts whose absolute value lies in their metric's range; metrics without a range stay."""
    bounds = {m: F.abs("value").between(lo, hi) for m, (lo, hi) in ranges.items()}
    test = F.lit(True)
    for m, inside in bounds.items():
        test = test & ((F.col("metric") != m) | inside)
    return facts.filter(F.col("value").isNotNull() & test)


def latest_year(facts: DataFrame, otherwise: int) -> DataFrame:
    """The latest fiscal year of each company, ``otherwise`` where none is known."""
    return facts.groupBy("company").agg(F.coalesce(F.max("fiscal_year"), F.lit(otherwise)).alias("latest_year"))


def companies_with(facts: DataFrame, metric: str, excluded: Sequence[str]) -> DataFrame:
    """Companies that have a metric, numbered in the order their first fact was seen."""
    first = without_reports(facts, excluded).filter(F.col("metric") == metric).groupBy("company").agg(F.min("fact_id").alias("first_seen"))
    return first.select("company", F.row_number().over(Window.orderBy("first_seen")).alias("seen_order"))


def profiles(facts: DataFrame) -> DataFrame:
    """Each company's latest annual fact: year and id, a later id winning within a year."""
    return facts.filter("period_type = 'annual'").groupBy("company").agg(F.max(F.struct("fiscal_year", "fact_id")).alias("m")).select("company", F.col("m.fiscal_year").alias("fiscal_year"), F.col("m.fact_id").alias("fact_id"))


def unknown_passes(rows: DataFrame, column: str, wanted) -> DataFrame:
    """Rows that have the wanted value or none at all."""
    return rows.filter(F.col(column).isNull() | (F.col(column) == F.lit(wanted)))
