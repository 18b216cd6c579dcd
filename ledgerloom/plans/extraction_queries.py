"""Queries of extraction, naming and planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import extraction as X
from ledgerloom.operators import facts as ops
from ledgerloom.plans import planner
from ledgerloom.sources.tables import EVENT_REPORT, FACTS_SQL, facts, load


def _ratios(spark, d):
    return ops.ratios(ops.best_per_cell(ops.without_reports(facts(spark, d), [EVENT_REPORT])))


def document_classes(spark, d):
    return load(spark, d, "documents").select("doc_id", X.classified(F.col("text")).alias("class"))


def document_events(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", X.event_type(F.substring("text", 1, 40), F.col("text")).alias("event"))


def ratio_insights(spark, d):
    return X.insights(_ratios(spark, d))


def financial_one_liner(spark, d):
    cells = ops.best_per_cell(ops.without_reports(facts(spark, d), [EVENT_REPORT]))
    wide = ops.wide(cells.filter("period_type = 'annual'"), ("revenue",)).join(_ratios(spark, d), ["company", "fiscal_year"])
    return wide.select("company", "fiscal_year", X.one_liner(F.col("company"), F.col("fiscal_year"), F.col("revenue"), F.round("operating_margin", 1)).alias("line"))


def company_guess(spark, d):
    c = load(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).when(F.col("c_custkey") % 3 == 1, F.lit("12,345")).otherwise(F.concat(F.lit("Firm "), F.col("c_mktsegment")))
    out = X.first_known([(name, 0.98), (F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")), 0.93), (F.lit("report.pdf"), 0.62)])
    return c.select("c_custkey", out["name"].alias("name"), out["confidence"].alias("confidence"))


def metric_pairs(spark, d):
    o = load(spark, d, "orders")
    raw = F.concat(F.lit("Revenue: "), F.format_number(F.col("o_orderkey") * 7, 0), F.lit(" | note: none | Equity: ("), F.col("o_orderkey").cast("string"), F.lit(")"))
    pairs = o.select("o_orderkey", F.explode(X.metric_pairs(raw)).alias("p"))
    return pairs.select("o_orderkey", "p.metric", "p.value")


def labelled_dates(spark, d):
    o = load(spark, d, "orders")
    text = F.concat(F.lit("Filed on: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("; decision none"))
    m = X.labelled_dates(text, {"filing": "filed", "decision": "decision"})
    return o.select("o_orderkey", F.try_element_at(m, F.lit("filing")).alias("filed"), F.cardinality(m).cast("int").alias("n"))


def name_suggestions(spark, d):
    queries = spark.createDataFrame([("natoin_1",), ("region2",), ("NATION_22x",)], "query string")
    names = load(spark, d, "nation").select(F.col("n_name").alias("name"))
    return X.suggestions(queries, names).select("query", "name", "ratio", "place")


def canonical_names(spark, d):
    aliases = spark.createDataFrame([("auto mobile", "Automobile Inc."), ("Building Co", "Building Group")], "alias string, canonical string")
    c = load(spark, d, "customer").select(F.concat(F.initcap("c_mktsegment"), F.lit(" Co.")).alias("name"))
    return X.canonical_names(c, "name", aliases).groupBy("canonical").agg(F.count("*").alias("n"))


def name_mismatches(spark, d):
    s = load(spark, d, "customer")
    inferred = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.col("c_name"), F.lit(" Ltd"))).when(F.col("c_custkey") % 5 == 1, F.lit("Other Firm"))
    return X.name_mismatches(s, "c_name", inferred).select("c_custkey", "inferred")


def year_of_text(spark, d):
    return X.year_of_text(load(spark, d, "documents"), "doc_id", "text", F.lit(2009))


def corrected_numbers(spark, d):
    p = load(spark, d, "part")
    shown = F.col("p_retailprice") * F.when(F.col("p_partkey") % 2 == 0, 1000).otherwise(1)
    text = F.concat(F.lit("price "), F.format_string("%.0f", shown))
    return p.select("p_partkey", X.corrected_numbers(text, F.col("p_retailprice"), shown).alias("text"))


def summaries(spark, d):
    out = X.summaries(load(spark, d, "documents"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


def evidence_quotes(spark, d):
    return X.evidence(load(spark, d, "documents"))


def markdown_tables(spark, d):
    out = X.tables(load(spark, d, "documents"))
    return out.select("doc_id", "place", F.length("table_text").alias("n"))


def line_facts(spark, d):
    return X.line_facts(load(spark, d, "documents"), {"secret": ("token", "password"), "license": ("version",)})


def question_ranking(spark, d):
    """A question in words, planned and answered."""
    names = [f"NATION_{i}" for i in range(25)]
    p = planner.plan("Top 7 companies by revenue in 1999", names, 2001)
    return planner.execute(p, ops.without_reports(facts(spark, d), [EVENT_REPORT]))


QUERIES = {
    f.__name__: f
    for f in (
        document_classes, document_events, ratio_insights, financial_one_liner, company_guess, metric_pairs, labelled_dates, name_suggestions,
        canonical_names, name_mismatches, year_of_text, corrected_numbers, summaries, evidence_quotes, markdown_tables, line_facts,
        question_ranking,
    )
}

_BEST = f"""{FACTS_SQL}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, company, fiscal_year ORDER BY
  CASE report_type WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 5 END, CASE period_type WHEN 'annual' THEN 0 WHEN 'semiannual' THEN 1 WHEN 'quarterly' THEN 2 ELSE 4 END, fact_id DESC) AS n
  FROM facts WHERE coalesce(report_type, '') <> '{EVENT_REPORT}' AND value IS NOT NULL) WHERE n = 1),
  w AS (SELECT company, fiscal_year, max(CASE WHEN metric = 'revenue' THEN value END) AS revenue, max(CASE WHEN metric = 'operating_profit' THEN value END) AS op,
    max(CASE WHEN metric = 'liabilities' THEN value END) AS li, max(CASE WHEN metric = 'equity' THEN value END) AS eq FROM best WHERE period_type = 'annual' GROUP BY ALL),
  r AS (SELECT company, fiscal_year, revenue, op / nullif(revenue, 0) * 100 AS m, li / nullif(eq, 0) * 100 AS d FROM w)"""
_HIT = "3 * len(regexp_extract_all(lower(substr(text, 1, 300)), '{0}')) + len(regexp_extract_all(lower(substr(text, 301)), '{0}'))"
_C = list(X.CLASSES.items())
_EV = " ".join(f"WHEN regexp_matches({src}, '{p}') THEN '{n}'" for src in ("lower(substr(text, 1, 40))", "lower(substr(text, 1, 500))") for n, p in X.EVENTS.items())

ORACLES = {
    "corrected_numbers": "SELECT p_partkey, 'price ' || floor(p_retailprice + 0.5)::BIGINT AS text FROM part",
    "document_classes": f"""WITH s AS (SELECT doc_id, {", ".join(f"{_HIT.format(p)} AS s{i}" for i, (_, p) in enumerate(_C))} FROM documents)
        SELECT doc_id, CASE WHEN greatest(s0, s1, s2, s3) = 0 THEN 'other' {" ".join(f"WHEN s{i} = greatest(s0, s1, s2, s3) THEN '{c}'" for i, (c, _) in enumerate(_C))} END AS class FROM s""",
    "document_events": f"SELECT doc_id, CASE {_EV} END AS event FROM documents",
    "ratio_insights": f"""WITH {_BEST} SELECT company, fiscal_year, CASE WHEN d IS NULL THEN NULL WHEN d <= 50 THEN 'low' WHEN d <= 100 THEN 'moderate' WHEN d <= 200 THEN 'high' ELSE 'critical' END AS debt_level,
        CASE WHEN m IS NULL THEN NULL WHEN m < 0 THEN 'loss' WHEN m <= 5 THEN 'thin' WHEN m <= 15 THEN 'fair' ELSE 'strong' END AS margin_level FROM r""",
    "company_guess": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'Firm ' || c_mktsegment WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS name,
        CASE WHEN c_custkey % 3 = 2 THEN 0.98 WHEN c_custkey % 2 = 0 THEN 0.93 ELSE 0.0 END::DOUBLE AS confidence FROM customer""",
    "metric_pairs": "SELECT o_orderkey, 'revenue' AS metric, (o_orderkey * 7)::DOUBLE AS value FROM orders UNION ALL SELECT o_orderkey, 'equity', -o_orderkey::DOUBLE FROM orders",
    "labelled_dates": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS filed, 1 AS n FROM orders",
    "name_suggestions": """WITH q(query) AS (VALUES ('natoin_1'), ('region2'), ('NATION_22x')), m AS (SELECT query, n_name AS name, round(1 - levenshtein(lower(query), lower(n_name))::DOUBLE / greatest(length(query), length(n_name)), 6) AS ratio FROM q, nation),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY ratio DESC, name) AS INTEGER) AS place FROM m WHERE ratio >= 0.38) SELECT * FROM r WHERE place <= 3""",
    "canonical_names": """SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automobile Inc.' WHEN 'BUILDING' THEN 'Building Group' ELSE upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Co.' END AS canonical, count(*) AS n FROM customer GROUP BY 1""",
    "name_mismatches": "SELECT c_custkey, 'Other Firm' AS inferred FROM customer WHERE c_custkey % 5 = 1",
    "year_of_text": r"""WITH y AS (SELECT doc_id, unnest(ys) AS y, unnest(range(len(ys))) AS k FROM (SELECT doc_id, regexp_extract_all(substr(text, 1, 5000), '(?:^|[^0-9])(20[0-9]{2})(?:$|[^0-9])', 1) AS ys FROM documents)),
        c AS (SELECT doc_id, y, count(*) AS n, min(k) AS f FROM y WHERE y BETWEEN '2010' AND '2030' GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, y) AS r FROM c)
        SELECT d.doc_id, coalesce(CAST(b.y AS INTEGER), 2009) AS fiscal_year FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id AND b.r = 1""",
    "question_ranking": f"""WITH {_BEST}, c AS (SELECT company, fiscal_year, metric, value FROM best WHERE metric = 'revenue' AND fiscal_year = 1999), k AS (SELECT CAST(row_number() OVER (ORDER BY value DESC, company) AS INTEGER) AS rank, * FROM c) SELECT * FROM k WHERE rank <= 7""",
}
