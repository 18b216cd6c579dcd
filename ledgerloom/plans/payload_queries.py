"""Queries of nested payloads, made of the given tables' own columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import labels as L
from ledgerloom.operators import payloads
from ledgerloom.sources.tables import load


def _event_payloads(spark, d):
    """An event as JSON, with its props nested three deep; every seventh is JSON inside a JSON string, some are none."""
    e = load(spark, d, "events")
    nested = F.concat(
        F.lit('{"category":"'), "event_type", F.lit('","who":{"id":'), F.col("user_id").cast("string"), F.lit(',"seen":{"props":'), "props", F.lit(',"none":null,"empty":{}}},"metrics":[{"unit":"usd"},{"amount":{"text":"'),
        F.col("user_id").cast("string"), F.lit(' million"}},['), F.col("event_id").cast("string"), F.lit("]]}"),
    )
    quoted = F.concat(F.lit('"'), F.replace(nested, F.lit('"'), F.lit('\\"')), F.lit('"'))
    payload = F.when(F.col("event_id") % 7 == 0, quoted).when(F.col("event_id") % 50 == 1, F.lit("{not json")).when(F.col("event_id") % 50 == 2, F.lit(None)).otherwise(nested)
    return e.select("event_id", payload.alias("payload"))


def payload_leaves(spark, d):
    return payloads.leaves(_event_payloads(spark, d), "payload", "event_id")


def payload_amounts(spark, d):
    e = _event_payloads(spark, d).withColumn("metrics", F.regexp_extract("payload", r'"metrics\\?":(.*)\}', 1))
    unescaped = F.nullif(F.replace("metrics", F.lit('\\"'), F.lit('"')), F.lit(""))
    return payloads.metric_value(e.select("event_id", unescaped.alias("metrics")), "metrics").select("event_id", "amount", "unit")


def foreign_text_fields(spark, d):
    """Letters of other alphabets in the text leaves of a turn's payload."""
    turns = load(spark, d, "conversations")
    lines = F.slice(F.split("text", "\n"), 1, 100_000)
    payload = F.to_json(F.struct(F.struct(F.col("role").alias("by"), lines.alias("lines")).alias("turn"), F.lit(1).alias("version")))
    found = payloads.foreign_fields(turns.select("conv_id", "turn", payload.alias("p")), "p", "conv_id", "turn", pattern="[ß-ÿ]")
    return found.select("conv_id", "turn", "field", "n")


def _analyses(spark, d):
    """A document's analysis as JSON: the source as company, its language as category, its conversation's first turn as summary."""
    docs = load(spark, d, "documents")
    first = load(spark, d, "conversations").filter("turn = 0").groupBy("conv_id").agg(F.min("text").alias("said"))
    company = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("No "), F.col("n_chars"), F.lit(" & Co #1"))).when(F.col("doc_id") % 13 == 0, F.lit(" ")).otherwise(F.initcap("source"))
    payload = F.to_json(F.struct(company.alias("company_name"), F.when(F.col("lang") == "fr", "other").otherwise(F.col("lang")).alias("category"), F.substring("said", 1, 120).alias("summary"), F.array("source").alias("key_points")))
    joined = docs.join(first, F.col("doc_id") == F.col("conv_id"), "left")
    return joined.select("doc_id", F.when(F.col("doc_id") % 17 != 0, payload).alias("payload"), (F.col("doc_id") % 34 != 0).alias("analysed"), (F.col("doc_id") % 3 != 0).alias("report"))


def quality_run(spark, d):
    found = payloads.quality_run(_analyses(spark, d), "payload", F.col("analysed"), F.col("report"), "doc_id", L.name_issues, pattern="[ß-ÿ]")
    return found.select("doc_id", F.array_join("issues", "|").alias("issues"), "severity")


def quality_run_counts(spark, d):
    return payloads.quality_counts(payloads.quality_run(_analyses(spark, d), "payload", F.col("analysed"), F.col("report"), "doc_id", L.name_issues, pattern="[ß-ÿ]"))


QUERIES = {f.__name__: f for f in (payload_leaves, payload_amounts, foreign_text_fields, quality_run, quality_run_counts)}

_RUN = r"""first AS (SELECT conv_id, min(text) AS said FROM conversations WHERE turn = 0 GROUP BY 1
), a AS (
  SELECT doc_id, doc_id % 17 <> 0 AS there, doc_id % 34 <> 0 AS analysed, doc_id % 3 <> 0 AS report, coalesce(substr(said, 1, 120), '') AS summary, CASE lang WHEN 'fr' THEN 'other' ELSE lang END AS category,
    trim(CASE WHEN doc_id % 11 = 0 THEN 'No ' || n_chars || ' & Co #1' WHEN doc_id % 13 = 0 THEN ' ' ELSE upper(source[1]) || source[2:] END) AS name
  FROM documents LEFT JOIN first ON doc_id = conv_id
), i AS (
  SELECT doc_id, CASE WHEN NOT there THEN CASE WHEN analysed THEN ['NO_ANALYSIS'] ELSE [] END ELSE list_filter([
    CASE WHEN regexp_matches(summary || name || category, '[ß-ÿ]') THEN 'FOREIGN' END, CASE WHEN name = '' THEN 'COMPANY_EMPTY' END, CASE WHEN length(name) > 30 THEN 'COMPANY_TOO_LONG' END,
    CASE WHEN regexp_matches(name, '[0-9]{4,}') THEN 'COMPANY_DIGITS' END, CASE WHEN regexp_matches(name, '[#$%&*@]') THEN 'COMPANY_SYMBOLS' END, CASE WHEN name <> '' AND name = upper(name) AND regexp_matches(name, '\p{L}') THEN 'COMPANY_SHOUTING' END,
    CASE WHEN summary = '' THEN 'EMPTY_SUMMARY' END, CASE WHEN length(summary) BETWEEN 1 AND 49 THEN 'SHORT_SUMMARY' END, CASE WHEN lower(category) IN ('', 'other') THEN 'WEAK_CATEGORY' END, CASE WHEN NOT report THEN 'NO_REPORT' END], lambda x: x IS NOT NULL) END AS issues FROM a
)"""

ORACLES = {
    "payload_leaves": r"""WITH p AS (SELECT event_id, ('{"category":"' || event_type || '","who":{"id":' || user_id || ',"seen":{"props":' || props || ',"none":null,"empty":{}}},"metrics":[{"unit":"usd"},{"amount":{"text":"' || user_id || ' million"}},[' || event_id || ']]}')::JSON AS payload
          FROM events WHERE event_id % 7 = 0 OR event_id % 50 NOT IN (1, 2))
        SELECT event_id, substr(fullkey, 3) AS path, CASE type WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' WHEN 'OBJECT' THEN type WHEN 'ARRAY' THEN type ELSE 'BIGINT' END AS kind, CASE WHEN type = 'OBJECT' THEN '{}' ELSE p.payload ->> fullkey END AS value
        FROM p, json_tree(p.payload) t WHERE atom IS NOT NULL OR (type = 'OBJECT' AND value::VARCHAR = '{}') OR type = 'NULL'""",
    "payload_amounts": "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 50 NOT IN (1, 2) THEN user_id * 1e6 END AS amount, CASE WHEN event_id % 7 = 0 OR event_id % 50 NOT IN (1, 2) THEN 'currency' END AS unit FROM events",
    "foreign_text_fields": """WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM conversations)
        SELECT conv_id, turn, 'turn.lines[' || k || ']' AS field, len(regexp_extract_all(line, '[ß-ÿ]'))::INT AS n FROM l WHERE regexp_matches(line, '[ß-ÿ]')""",
    "quality_run": f"""WITH {_RUN} SELECT doc_id, array_to_string(issues, '|') AS issues, CASE WHEN list_contains(issues, 'FOREIGN') THEN 'CRITICAL' WHEN len(list_filter(issues, lambda x: starts_with(x, 'COMPANY_'))) > 0 THEN 'HIGH'
          WHEN len(list_filter(issues, lambda x: ends_with(x, '_SUMMARY'))) > 0 THEN 'MEDIUM' WHEN len(issues) > 0 THEN 'LOW' ELSE 'none' END AS severity FROM i""",
    "quality_run_counts": f"WITH {_RUN} SELECT issue, count(*) AS n FROM (SELECT unnest(CASE WHEN len(issues) > 0 THEN issues ELSE ['(clean)'] END) AS issue FROM i) GROUP BY 1",
}
