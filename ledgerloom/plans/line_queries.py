"""Queries over filings: the given documents, each with the cells and item lines of the order of its number."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import cells, lines, window_facts
from ledgerloom.sources.tables import load


def filings(spark, d):
    """doc_id, text: a document's text, then cells with a unit, labels and amounts of its order, then its items a line each."""
    price = F.floor("o_totalprice").cast("long")
    unit = F.when(F.col("o_orderkey") % 3 == 0, "(unit: thousand)").when(F.col("o_orderkey") % 3 == 1, "(Unit : million)").otherwise("no declaration")
    lost = F.concat(F.lit("("), F.floor(price / 4).cast("string"), F.lit(")"))
    assets = F.format_number(F.when(F.col("o_orderkey") % 5 == 0, price).otherwise(price * 2), 0)
    cell_lines = F.concat_ws("\n", F.lit("1. Amounts"), unit, F.lit("I. Revenue"), F.format_number(price, 0), F.lit("77"), F.lit("Operating profit (note 3)"), F.lit(""), lost, F.lit("Equity\nnone\nTotal assets"), assets)
    orders = load(spark, d, "orders").select("o_orderkey", cell_lines.alias("cells"))
    line = F.concat_ws("  ", "l_linenumber", F.floor("l_quantity"), F.floor("l_extendedprice"), "l_returnflag")
    items = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))).alias("rows"))
    items = items.select("l_orderkey", F.concat_ws("\n", F.lit("\n2. Items\nNumber and quantity\n"), F.array_join("rows.line", "\n"), F.lit("All items")).alias("items"))
    joined = load(spark, d, "documents").join(orders, F.col("doc_id") == F.col("o_orderkey"), "left").join(items, F.col("doc_id") == F.col("l_orderkey"), "left")
    return joined.select("doc_id", F.concat_ws("\n", "text", "cells", "items").alias("text"))


FILINGS_SQL = """o AS (
  SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS p, CASE o_orderkey % 3 WHEN 0 THEN '(unit: thousand)' WHEN 1 THEN '(Unit : million)' ELSE 'no declaration' END AS unit FROM orders
), c AS (
  SELECT k, concat_ws(chr(10), '1. Amounts', unit, 'I. Revenue', format('{:,}', p), '77', 'Operating profit (note 3)', '', '(' || floor(p / 4)::BIGINT || ')', 'Equity', 'none', 'Total assets', format('{:,}', CASE WHEN k % 5 = 0 THEN p ELSE 2 * p END)) AS cells FROM o
), i AS (
  SELECT l_orderkey AS k, concat_ws(chr(10), '', '2. Items', 'Number and quantity', '', string_agg(line, chr(10) ORDER BY l_linenumber, line), 'All items') AS items
  FROM (SELECT l_orderkey, l_linenumber, concat_ws('  ', l_linenumber, floor(l_quantity)::BIGINT, floor(l_extendedprice)::BIGINT, l_returnflag) AS line FROM lineitem) GROUP BY 1
), filings AS (
  SELECT doc_id, concat_ws(chr(10), text, cells, items) AS text FROM documents LEFT JOIN c ON doc_id = c.k LEFT JOIN i ON doc_id = i.k
), l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM filings
), s AS (
  SELECT doc_id, pos, trim(raw, concat(' ', chr(9), chr(13), chr(12), chr(11))) AS s FROM l
)"""


def filing_cell_facts(spark, d):
    return cells.cell_facts(filings(spark, d))


def tagged_lines(spark, d):
    return lines.tagged_lines(filings(spark, d), lines.LATIN, "doc_id").select("doc_id", "letters", F.length(F.regexp_replace("letters", "[^M]", "")).alias("absorbed"))


def line_chunks(spark, d):
    return lines.line_chunks(filings(spark, d)).select("doc_id", "idx", "section", "kind", F.md5(F.col("chunk").cast("binary")).alias("h"))


def every_fact(spark, d):
    return window_facts.every_fact(filings(spark, d))


def _sentences(spark, d):
    """An order's amounts as sentences in one line, in which the first unit word counts for an amount without its own."""
    o = load(spark, d, "orders")
    price = F.floor("o_totalprice").cast("string")
    said = F.concat(F.lit("In short, revenue of "), price, F.lit(" thousand and net loss was -"), F.floor(F.col("o_totalprice") / 9).cast("string"), F.lit(" million; equity: "), F.col("o_custkey").cast("string"), F.lit(", sales 1 billion."))
    return o.select("o_orderkey", said.alias("text"))


def inline_facts(spark, d):
    return window_facts.inline_facts(_sentences(spark, d), id_col="o_orderkey")


QUERIES = {f.__name__: f for f in (every_fact, inline_facts, filing_cell_facts, tagged_lines, line_chunks)}

_LABELS = ", ".join(f"('{k}', '{v}')" for k, v in cells.LATIN_LABELS.items())
_UNITS = ", ".join(f"('{k}', {v!r})" for k, v in cells.LATIN_UNITS.items())
_RANGES = ", ".join(f"('{k}', {a!r}, {b!r})" for k, (a, b) in cells.RANGES.items())

ORACLES = {
    "inline_facts": """SELECT o_orderkey, 'revenue' AS metric, (floor(o_totalprice)::BIGINT * 1e3)::DOUBLE AS value FROM orders WHERE floor(o_totalprice)::BIGINT * 1e3 >= 10000
        UNION ALL SELECT o_orderkey, 'revenue', 1e9 FROM orders WHERE floor(o_totalprice)::BIGINT * 1e3 < 10000
        UNION ALL SELECT o_orderkey, 'net_income', -(floor(o_totalprice / 9)::BIGINT * 1e6)::DOUBLE FROM orders WHERE floor(o_totalprice / 9) > 0
        UNION ALL SELECT o_orderkey, 'equity', o_custkey * 1e3 FROM orders WHERE o_custkey * 1e3 >= 10000""",
    "filing_cell_facts": rf"""
WITH {FILINGS_SQL}, labels(cell, metric) AS (VALUES {_LABELS}), units(word, factor) AS (VALUES {_UNITS}), ranges(metric, low, high) AS (VALUES {_RANGES})
, declared AS (
  SELECT s.*, factor FROM s LEFT JOIN units ON word = lower(regexp_extract(s, '(?i)unit[ \t]*[:：][ \t]*(billion|thousand|million)', 1))
), sighted AS (
  SELECT *, last_value(factor IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING) AS unit FROM declared
), filled AS (
  SELECT doc_id, pos, unit, lower(trim(regexp_replace(s, '^(?:[IVXivx]+\.|[0-9]+[.)]|[가-힣]\.)[ \t]*', ''))) AS name, regexp_replace(s, '(?i)[ \t]*\((?:주|note|n)\.?[ \t]*[0-9]*\)$|[ \t]*\*[0-9]+$', '') AS plain FROM sighted WHERE s <> ''
), bare AS (
  SELECT *, replace(replace(regexp_replace(regexp_replace(plain, '^[-△▲][ \t]*', ''), '^\((.+)\)$', '\1'), ',', ''), ' ', '') AS digits, regexp_matches(plain, '^[-△▲]') OR regexp_matches(plain, '^[-△▲]?[ \t]*\(.+\)$') AS below FROM filled
), numbered AS (
  SELECT *, CASE WHEN regexp_matches(digits, '^[0-9]+(\.[0-9]+)?$') THEN digits::DOUBLE * CASE WHEN below THEN -1 ELSE 1 END END AS number FROM bare
), beside AS (
  SELECT n.doc_id, n.pos, n.unit, coalesce(a.metric, b.metric) AS metric, lead(n.number) OVER w AS number, lead(n.pos) OVER w - n.pos AS far
  FROM numbered n LEFT JOIN labels a ON a.cell = n.name LEFT JOIN labels b ON b.cell = trim(regexp_replace(n.name, '[ \t]*\([^)]*\)$', ''))
  WINDOW w AS (PARTITION BY n.doc_id ORDER BY n.pos)
), sane AS (
  SELECT doc_id, pos, metric, number * coalesce(unit, 1.0) AS value FROM beside JOIN ranges USING (metric) WHERE number IS NOT NULL AND far <= 9 AND abs(number * coalesce(unit, 1.0)) BETWEEN low AND high
), first AS (
  SELECT doc_id, metric, arg_min(value, pos) AS value FROM sane GROUP BY 1, 2
)
SELECT doc_id, metric, value FROM first QUALIFY count(*) OVER (PARTITION BY doc_id, round(abs(value))) = 1
""",
    "tagged_lines": rf"""
WITH {FILINGS_SQL}, counted AS (
  SELECT *, length(s) - length(regexp_replace(s, '\p{{Nd}}', '', 'g')) AS d, len(regexp_extract_all(s, '\p{{Nd}}+(?:[.,]\p{{Nd}}+)*%?')) AS n, len(regexp_extract_all(s, '  +')) AS gaps FROM s
), k AS (
  SELECT doc_id, pos, CASE WHEN s = '' THEN 'B' WHEN length(s) < 60 AND regexp_matches(s, '^(?:[IVX]+\.|[0-9]+\.)\s*.{{2,40}}$|^#{{1,3}} .{{2,40}}$') THEN 'S'
    WHEN length(s) > 8 AND n >= 2 AND (d / length(s) > 0.3 OR gaps >= 2) THEN 'N' WHEN length(s) <= 30 AND d <= 3 THEN 'L' ELSE 'X' END AS c FROM counted
), beside AS (
  SELECT *, lag(pos) OVER w AS before, lead(pos) OVER w AS after, lead(c) OVER w AS next FROM k WHERE c <> 'B' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), decided AS (
  SELECT doc_id, pos, c, CASE WHEN c = 'N' OR (c = 'L' AND next = 'N' AND after - pos <= 3) THEN 1 WHEN c IN ('X', 'S') OR before IS NULL OR pos - before > 3 THEN 0 END AS sure FROM beside
), spread AS (
  SELECT *, last_value(sure IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS numeric FROM decided
), letters AS (
  SELECT doc_id, pos, CASE WHEN c = 'L' AND numeric = 1 THEN 'M' ELSE c END AS c FROM spread UNION ALL SELECT doc_id, pos, c FROM k WHERE c = 'B'
)
SELECT doc_id, string_agg(c, '' ORDER BY pos) AS letters, (count(*) FILTER (c = 'M'))::INT AS absorbed FROM letters GROUP BY 1
""",
}
