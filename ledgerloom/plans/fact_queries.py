"""Queries over facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import facts as ops
from ledgerloom.sources.tables import EVENT_REPORT, FACTS_SQL, METRICS, facts

_KEPT = f"kept AS (SELECT * FROM facts WHERE coalesce(report_type, '') <> '{EVENT_REPORT}' AND value IS NOT NULL)"
_BEST = """best AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY metric, company, fiscal_year ORDER BY
      CASE report_type WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 5 END,
      CASE period_type WHEN 'annual' THEN 0 WHEN 'semiannual' THEN 1 WHEN 'quarterly' THEN 2 WHEN 'event' THEN 3 ELSE 4 END,
      fact_id DESC) AS n
    FROM kept) WHERE n = 1)"""
_WITH = f"WITH {FACTS_SQL}, {_KEPT}, {_BEST}"


def _kept(spark, d):
    return ops.without_reports(facts(spark, d), [EVENT_REPORT])


def _best(spark, d):
    return ops.best_per_cell(_kept(spark, d))


def fact_best_per_cell(spark, d):
    return _best(spark, d).select("metric", "company", "fiscal_year", "value", "period_type", "report_type", "fact_id")


def fact_ranking_latest(spark, d):
    top = ops.ranked(ops.latest_per_company(_kept(spark, d), "revenue"), limit=10)
    return top.select("rank", "company", "fiscal_year", "value", "fact_id")


def fact_ranking_lowest(spark, d):
    cells = _best(spark, d).filter("metric = 'net_income' and fiscal_year = 1998")
    return ops.ranked(cells, ascending=True, limit=5).select("rank", "company", "value")


def fact_trend_oldest_wins(spark, d):
    return ops.trend(facts(spark, d), "revenue")


def fact_trend_series(spark, d):
    s = ops.series(ops.trend(facts(spark, d), "equity", oldest_wins=False))
    return s.select("company", F.size("points").cast("long").alias("n_points"), F.col("points")[0]["fiscal_year"].alias("first_year"), F.element_at("points", -1)["value"].alias("last_value"))


def fact_yoy(spark, d):
    out = ops.year_over_year(_best(spark, d).filter("period_type = 'annual'"))
    return out.withColumn("yoy_pct", F.round("yoy_pct", 4))


def fact_ratios(spark, d):
    out = ops.ratios(_best(spark, d))
    return out.select("company", "fiscal_year", *(F.round(c, 4).alias(c) for c in ("operating_margin", "net_margin", "debt_ratio")))


def fact_compare_latest(spark, d):
    """Derived metrics of the latest year alone, all companies side by side."""
    table = ops.ratios(_best(spark, d))
    last = table.groupBy("company").agg(F.max("fiscal_year").alias("fiscal_year"))
    return table.join(last, ["company", "fiscal_year"]).select("company", "fiscal_year", F.round("operating_margin", 4).alias("operating_margin"), F.round("debt_ratio", 4).alias("debt_ratio"))


def fact_coverage_grid(spark, d):
    return ops.coverage_grid(facts(spark, d), METRICS, tuple(range(1995, 2003)))


def fact_within_ranges(spark, d):
    out = ops.within_ranges(facts(spark, d), {"revenue": (50_000.0, 300_000.0), "equity": (10_000.0, 200_000.0)})
    return out.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def fact_latest_year(spark, d):
    return ops.latest_year(facts(spark, d).filter("metric = 'revenue'"), 2001)


def fact_companies_with_metric(spark, d):
    return ops.companies_with(facts(spark, d), "liabilities", [EVENT_REPORT])


def fact_profiles(spark, d):
    return ops.profiles(facts(spark, d))


def fact_single_answer(spark, d):
    """The one fact that answers a question on a company's metric: latest year, newest id."""
    return ops.latest_per_company(_kept(spark, d).filter("company = 'NATION_6'"), "revenue").select("company", "fiscal_year", "value", "fact_id")


def fact_cell_telemetry(spark, d):
    return _best(spark, d).groupBy("metric").agg(F.count_if(F.col("period_type") == "annual").alias("annual_cells"), F.count_if(F.col("period_type") != "annual").alias("other_cells"))


def fact_metric_companies(spark, d):
    return facts(spark, d).groupBy("metric").agg(F.countDistinct("company").alias("companies"), F.countDistinct("fiscal_year").alias("years"))


def fact_unknown_period_passes(spark, d):
    rows = facts(spark, d).withColumn("period_type", F.when(F.col("period_type") != "semiannual", F.col("period_type")))
    return ops.unknown_passes(rows, "period_type", "annual").groupBy("company").agg(F.count("*").alias("n"))


def fact_requested_order(spark, d):
    """Named companies' values in the order they were asked for."""
    asked = ["NATION_12", "NATION_6", "NATION_2"]
    cells = _best(spark, d).filter((F.col("metric") == "revenue") & (F.col("fiscal_year") == 1997) & F.col("company").isin(asked))
    return cells.select(F.array_position(F.array(*map(F.lit, asked)), F.col("company")).cast("long").alias("place"), "company", "value")


def fact_matrix_pivot(spark, d):
    return ops.wide(_best(spark, d), METRICS)


def fact_report_mix_rollup(spark, d):
    return facts(spark, d).rollup("report_type", "period_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 2).alias("mean_value"))


QUERIES = {
    f.__name__: f
    for f in (
        fact_best_per_cell, fact_ranking_latest, fact_ranking_lowest, fact_trend_oldest_wins, fact_trend_series, fact_yoy, fact_ratios,
        fact_compare_latest, fact_coverage_grid, fact_within_ranges, fact_latest_year, fact_companies_with_metric, fact_profiles,
        fact_single_answer, fact_cell_telemetry, fact_metric_companies, fact_unknown_period_passes, fact_requested_order, fact_matrix_pivot,
        fact_report_mix_rollup,
    )
}

_ANNUAL = """w AS (
  SELECT company, fiscal_year,
    max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'operating_profit' THEN value END) AS operating_profit,
    max(CASE WHEN metric = 'net_income' THEN value END) AS net_income, max(CASE WHEN metric = 'liabilities' THEN value END) AS liabilities,
    max(CASE WHEN metric = 'equity' THEN value END) AS equity
  FROM best WHERE period_type = 'annual' GROUP BY ALL)"""

ORACLES = {
    "fact_best_per_cell": f"{_WITH} SELECT metric, company, fiscal_year, value, period_type, report_type, fact_id FROM best",
    "fact_ranking_latest": f"""{_WITH}, l AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY fiscal_year DESC, fact_id DESC) AS n FROM kept WHERE metric = 'revenue'),
        r AS (SELECT CAST(row_number() OVER (ORDER BY value DESC, company) AS INTEGER) AS rank, company, fiscal_year, value, fact_id FROM l WHERE n = 1)
        SELECT * FROM r WHERE rank <= 10""",
    "fact_ranking_lowest": f"""{_WITH}, r AS (SELECT CAST(row_number() OVER (ORDER BY value, company) AS INTEGER) AS rank, company, value FROM best WHERE metric = 'net_income' AND fiscal_year = 1998)
        SELECT * FROM r WHERE rank <= 5""",
    "fact_trend_oldest_wins": f"""WITH {FACTS_SQL} SELECT company, fiscal_year, value, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY company, fiscal_year ORDER BY fact_id) AS n
        FROM facts WHERE metric = 'revenue' AND value IS NOT NULL) WHERE n = 1""",
    "fact_trend_series": f"""WITH {FACTS_SQL}, t AS (SELECT company, fiscal_year, value FROM (SELECT *, row_number() OVER (PARTITION BY company, fiscal_year ORDER BY fact_id DESC) AS n
        FROM facts WHERE metric = 'equity' AND value IS NOT NULL) WHERE n = 1)
        SELECT company, count(*) AS n_points, min(fiscal_year) AS first_year, max_by(value, fiscal_year) AS last_value FROM t GROUP BY company""",
    "fact_yoy": f"""{_WITH}, a AS (SELECT * FROM best WHERE period_type = 'annual')
        SELECT c.metric, c.company, c.fiscal_year, c.value, p.value AS prev_value, round((c.value - p.value) / nullif(abs(p.value), 0) * 100, 4) AS yoy_pct
        FROM a c JOIN a p ON p.metric = c.metric AND p.company = c.company AND p.fiscal_year = c.fiscal_year - 1""",
    "fact_ratios": f"""{_WITH}, {_ANNUAL} SELECT company, fiscal_year, round(operating_profit / nullif(revenue, 0) * 100, 4) AS operating_margin,
        round(net_income / nullif(revenue, 0) * 100, 4) AS net_margin, round(liabilities / nullif(equity, 0) * 100, 4) AS debt_ratio FROM w""",
    "fact_compare_latest": f"""{_WITH}, {_ANNUAL}, m AS (SELECT *, max(fiscal_year) OVER (PARTITION BY company) AS last_year FROM w)
        SELECT company, fiscal_year, round(operating_profit / nullif(revenue, 0) * 100, 4) AS operating_margin, round(liabilities / nullif(equity, 0) * 100, 4) AS debt_ratio
        FROM m WHERE fiscal_year = last_year""",
    "fact_coverage_grid": f"""WITH {FACTS_SQL}, c AS (SELECT DISTINCT company FROM facts), m AS (SELECT unnest(['revenue', 'operating_profit', 'net_income', 'liabilities', 'equity']) AS metric),
        y AS (SELECT CAST(unnest(range(1995, 2003)) AS INTEGER) AS fiscal_year)
        SELECT c.company, m.metric, y.fiscal_year, CASE WHEN count(*) FILTER (WHERE f.period_type = 'annual') > 0 THEN 'OK' WHEN count(f.fact_id) > 0 THEN 'NON_ANNUAL' ELSE 'MISSING' END AS verdict
        FROM c CROSS JOIN m CROSS JOIN y LEFT JOIN facts f ON f.company = c.company AND f.metric = m.metric AND f.fiscal_year = y.fiscal_year AND f.value IS NOT NULL
        GROUP BY ALL""",
    "fact_within_ranges": f"""WITH {FACTS_SQL} SELECT metric, count(*) AS n, round(sum(value), 2) AS total FROM facts
        WHERE value IS NOT NULL AND (metric <> 'revenue' OR abs(value) BETWEEN 50000 AND 300000) AND (metric <> 'equity' OR abs(value) BETWEEN 10000 AND 200000) GROUP BY metric""",
    "fact_latest_year": f"WITH {FACTS_SQL} SELECT company, coalesce(max(fiscal_year), 2001) AS latest_year FROM facts WHERE metric = 'revenue' GROUP BY company",
    "fact_companies_with_metric": f"""{_WITH}, s AS (SELECT company, min(fact_id) AS f FROM facts WHERE metric = 'liabilities' AND coalesce(report_type, '') <> '{EVENT_REPORT}' GROUP BY company)
        SELECT company, CAST(row_number() OVER (ORDER BY f) AS INTEGER) AS seen_order FROM s""",
    "fact_profiles": f"""WITH {FACTS_SQL} SELECT company, fiscal_year, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY fiscal_year DESC, fact_id DESC) AS n
        FROM facts WHERE period_type = 'annual') WHERE n = 1""",
    "fact_single_answer": f"{_WITH} SELECT company, fiscal_year, value, fact_id FROM kept WHERE company = 'NATION_6' AND metric = 'revenue' ORDER BY fiscal_year DESC, fact_id DESC LIMIT 1",
    "fact_cell_telemetry": f"{_WITH} SELECT metric, count(*) FILTER (WHERE period_type = 'annual') AS annual_cells, count(*) FILTER (WHERE period_type <> 'annual') AS other_cells FROM best GROUP BY metric",
    "fact_metric_companies": f"WITH {FACTS_SQL} SELECT metric, count(DISTINCT company) AS companies, count(DISTINCT fiscal_year) AS years FROM facts GROUP BY metric",
    "fact_unknown_period_passes": f"WITH {FACTS_SQL} SELECT company, count(*) AS n FROM facts WHERE period_type IN ('semiannual', 'annual') GROUP BY company",
    "fact_requested_order": f"""{_WITH} SELECT CAST(list_position(['NATION_12', 'NATION_6', 'NATION_2'], company) AS BIGINT) AS place, company, value FROM best
        WHERE metric = 'revenue' AND fiscal_year = 1997 AND company IN ('NATION_12', 'NATION_6', 'NATION_2')""",
    "fact_matrix_pivot": f"{_WITH}, {_ANNUAL.replace(chr(34), '').replace(' WHERE period_type = ' + chr(39) + 'annual' + chr(39), '')} SELECT company, fiscal_year, revenue, operating_profit, net_income, liabilities, equity FROM w",
    "fact_report_mix_rollup": f"WITH {FACTS_SQL} SELECT report_type, period_type, count(*) AS n, round(avg(value), 2) AS mean_value FROM facts GROUP BY ROLLUP (report_type, period_type)",
}
