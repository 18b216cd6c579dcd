"""Queries of annotated numbers, budgeted assembly, token windows and tables with spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import assembly
from ledgerloom.plans.line_queries import FILINGS_SQL, filings
from ledgerloom.sources import html
from ledgerloom.sources.tables import load


def annotated_numbers(spark, d):
    unit = F.element_at(F.array(F.lit("million"), F.lit("thousand"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    noted = V.annotated_numbers(F.col("text"), unit)
    return filings(spark, d).select("doc_id", F.regexp_count(noted, F.lit(r"\[=")).alias("n"), F.md5(noted.cast("binary")).alias("h"))


def assembled_texts(spark, d):
    found = assembly.assembled(filings(spark, d), 2500)
    return found.select("doc_id", "n_taken", "n_paragraphs", F.md5(F.col("assembled").cast("binary")).alias("h"))


def token_windows(spark, d):
    found = assembly.token_windows(load(spark, d, "documents"), 128, 24)
    return found.select("doc_id", "idx", "first_token", "n_tokens", "shared_tokens", F.md5(F.col("chunk").cast("binary")).alias("h"))


def page_tables(spark, d):
    """An order's items as a page: a title over all columns, the order's number down all its rows."""
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"))
    row = F.concat(*(cell(F.floor(c)) for c in ("l_quantity", "l_extendedprice")), cell(F.col("l_returnflag")))
    items = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rows"))
    first = F.concat(F.lit("<td rowspan='"), F.size("rows").cast("string"), F.lit("'>No "), F.col("l_orderkey").cast("string"))
    page = F.concat(F.lit("<p>x<table><tr><th colspan=4>Items &amp; more</th></tr><tr><th></th></tr><tr>"), first, F.array_join("rows.r", "</tr><tr>"), F.lit("</table>"))
    return html.page_tables(items.select("l_orderkey", page.alias("html")), "l_orderkey")


QUERIES = {f.__name__: f for f in (annotated_numbers, assembled_texts, token_windows, page_tables)}

_NUMBER = r"\([0-9,]+(?:\.[0-9]+)?\)|[0-9,]+(?:\.[0-9]+)?"

ORACLES = {
    "annotated_numbers": rf"""WITH {FILINGS_SQL}, u AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 END AS k FROM filings
        ), parts AS (SELECT doc_id, k, regexp_split_to_array(text, '{_NUMBER}') AS b, regexp_extract_all(text, '{_NUMBER}') AS m FROM u
        ), valued AS (SELECT doc_id, k, b, list_transform(m, lambda x: {{'raw': x, 'v': TRY_CAST(regexp_replace(x, '[,()]', '', 'g') AS DOUBLE) * k * CASE WHEN x LIKE '(%' THEN -1 ELSE 1 END}}) AS m FROM parts
        ), noted AS (SELECT doc_id, k, b, list_transform(m, lambda x: x.raw || coalesce('[=' || CASE WHEN abs(x.v) >= 1e9 THEN format('{{:,.1f}}', x.v / 1e9) || ' billion' WHEN abs(x.v) >= 1e6 THEN format('{{:,.1f}}', x.v / 1e6) || ' million' ELSE format('{{:,.0f}}', x.v) END || ']', '')) AS m FROM valued
        ), t AS (SELECT n.doc_id, CASE WHEN n.k IS NULL THEN f.text ELSE list_reduce(list_transform(list_zip(b, m), lambda p: coalesce(p[1], '') || coalesce(p[2], '')), lambda x, y: x || y) END AS noted FROM noted n JOIN filings f USING (doc_id))
        SELECT doc_id, len(regexp_extract_all(noted, '\[='))::INT AS n, md5(noted) AS h FROM t""",
    "page_tables": r"""WITH r AS (SELECT l_orderkey, l_linenumber, concat_ws(' | ', floor(l_quantity)::BIGINT, floor(l_extendedprice)::BIGINT, l_returnflag) AS cells, '<td>' || concat_ws('<td>', floor(l_quantity)::BIGINT, floor(l_extendedprice)::BIGINT, l_returnflag) AS html FROM lineitem)
        SELECT l_orderkey, 0 AS idx, (count(*) + 2)::INT AS n_rows, 4 AS n_columns,
          '| ' || concat_ws(' | ', 'Items & more', 'Items & more', 'Items & more', 'Items & more') || ' |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || string_agg('| No ' || l_orderkey || ' | ' || cells || ' |', chr(10) ORDER BY l_linenumber, html) AS markdown FROM r GROUP BY 1""",
}
