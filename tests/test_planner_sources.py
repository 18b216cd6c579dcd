"""Planner, archives, stores and streams on small inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import planner
from ledgerloom.sources import archives, html, stores
from ledgerloom.streaming import activity

KNOWN = ("Alpha", "Alpha Beta", "Gamma")


@pytest.mark.parametrize(
    ("question", "route", "companies"),
    [
        ("?", "trivial", ()), ("top 10 companies by revenue", "ranking", ()), ("Compare Gamma and Alpha Beta margin", "compare", ("Gamma", "Alpha Beta")), ("revenue trend of Alpha, last 3 years", "trend", ("Alpha",)),
        ("what is the debt ratio of Gamma in 2020", "value", ("Gamma",)), ("tell me about Alpha", "summary", ("Alpha",)), ("why these filing events", "events", ()), ("hello there", "search", ()),
    ],
)
def test_routes(question, route, companies):
    p = planner.plan(question, KNOWN, 2024)
    assert (p.route, p.companies) == (route, companies)


def test_parsing():
    assert planner.limit_in("top 10") == 10 and planner.limit_in("top 99") == 20 and planner.limit_in("ranking") == 5
    assert planner.span_in("last 3 years") == 3 and planner.span_in("past 1 year") == 2
    assert planner.years_in("2020 and 2018", 2024) == (2018, 2020) and planner.years_in("last 3 years", 2024) == (2022, 2023, 2024)
    assert planner.years_in("last year", 2024) == (2023,) and planner.plan("highest", KNOWN, 2024).missing == "metric"
    assert planner.plan("lowest equity, 3 companies", KNOWN, 2024).ascending


def _facts(spark, rows):
    return spark.createDataFrame(rows, "fact_id long, company string, fiscal_year int, metric string, value double, period_type string, report_type string")


def test_best_fact_and_execution(spark):
    facts = _facts(
        spark,
        [
            (999, "Alpha", 2023, "revenue", 46.0, "quarterly", None), (100, "Alpha", 2023, "revenue", 66.0, "annual", None), (5, "Gamma", 2023, "revenue", 32.7, "semiannual", None), (6, "Gamma", 2023, "revenue", None, "annual", None),
            (7, "Alpha", 2023, "operating_profit", 23.4, "annual", None), (8, "Alpha", 2022, "revenue", 32.7, "annual", None),
        ],
    )
    rank = planner.execute(planner.plan("top 3 companies by revenue in 2023", KNOWN, 2024), facts).collect()
    assert [(r["rank"], r["company"], r["value"]) for r in rank] == [(1, "Alpha", 66.0), (2, "Gamma", 32.7)]
    margin = planner.execute(planner.plan("operating margin of Alpha in 2023", KNOWN, 2024), facts).collect()
    assert round(margin[0]["value"], 1) == 35.5
    assert planner.execute(planner.plan("revenue", KNOWN, 2024), facts).collect()[0]["missing"] == "company"
    from ledgerloom.operators import facts as ops

    yoy = ops.year_over_year(ops.best_per_cell(facts).filter("period_type = 'annual'")).collect()
    assert [(r["company"], round(r["yoy_pct"], 1)) for r in yoy] == [("Alpha", 101.8)]


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    body = "<DOC><SECTION><TITLE>Business</TITLE><P>" + "Makes paper and sells it abroad. " * 20 + "</P><P>short</P><P>short</P><TABLE><TR><TD>Sales</TD><TD>1,234</TD></TR></TABLE></SECTION></DOC>"
    (tmp_path / "Alpha_20240101000001.zip").write_bytes(_zip({"20240101000001.xml": body, "audit_00760.xml": body.replace("Business", "Audit"), "tiny.xml": "<a/>"}))
    (tmp_path / "Alpha_20240101000001.zip.pdf").write_bytes(b"other copy")
    (tmp_path / "Beta_20240101000002.zip").write_bytes(b"no zip")
    files = archives.one_per_receipt(archives.archives(spark, str(tmp_path), with_content=True))
    assert sorted((r["receipt"], r["kind"], r["company"]) for r in files.drop("content").collect()) == [("20240101000001", "zip", "Alpha"), ("20240101000002", "zip", "Beta")]
    rows = archives.archive_texts(files).collect()
    assert sorted((r["role"] or "", r["problem"] or "") for r in rows) == [("", "bad_zip"), ("audit", ""), ("main", "")]
    text = next(r["text"] for r in rows if r["role"] == "main")
    assert text.startswith("## Business") and "[TABLE]\nSales  1,234\n[/TABLE]" in text and text.count("short") == 1


def test_xbrl(spark):
    instance = b"""<xbrl xmlns:k="u"><context id="c1"><period><startDate>2023-01-01</startDate><endDate>2023-12-31</endDate></period><scenario><explicitMember>k:ConsolidatedMember</explicitMember></scenario></context>
        <k:Revenue contextRef="c1" unitRef="KRW">100</k:Revenue><k:Other contextRef="c9">5</k:Other></xbrl>"""
    labels = b"""<linkbase xmlns:xlink="http://www.w3.org/1999/xlink"><loc xlink:href="a.xsd#k_Revenue" xlink:label="l1"/><labelArc xlink:from="l1" xlink:to="t1"/><label xlink:label="t1">Sales</label></linkbase>"""
    contexts, facts = archives.xbrl_rows(instance)
    out = archives.labelled_facts(
        spark.createDataFrame(facts, "element string, context string, unit string, value string"),
        spark.createDataFrame(contexts, "context string, period string, scope string"),
        spark.createDataFrame(archives.label_rows(labels), "element string, label string"),
    )
    assert sorted(map(tuple, out.select("label", "period", "scope", "value").collect()), key=str) == [("Other", None, None, "5"), ("Sales", "2023-01-01/2023-12-31", "consolidated", "100")]


def test_html_lines():
    assert html.visible_lines("<title>T &amp; x</title><p>a<b>b</b><script>no()</script><p>c<br>d") == ["T & x", "ab", "c", "d"] and html.visible_lines(None) == []


def test_stores(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"chunk_id": "a", "chunk_idx": 1}\nnot json\n{"chunk_idx": 2}\n')
    good, bad = stores.read_chunks(spark, str(tmp_path / "c.jsonl"))
    assert [r["chunk_id"] for r in good.collect()] == ["a"] and bad.count() == 2
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    path = str(tmp_path / "store")
    assert stores.append_new(rows, path, "k").count() == 2 and stores.append_new(rows, path, "k").count() == 2
    assert {tuple(r) for r in stores.upserted(rows, spark.createDataFrame([(1, "z")], "k long, v string"), "k").collect()} == {(1, "z"), (2, "y")}
    assert stores.with_defaults(spark.createDataFrame([(None, None)], "a string, b long")).collect()[0] == ("", 0)
    analyses = spark.createDataFrame([(1, 7, "a"), (2, 7, "b")], "id long, document_id long, category string")
    out, audit = stores.reclassified(analyses, spark.createDataFrame([(7, "c", "why")], "document_id long, new_category string, reason string"))
    assert {(r["id"], r["category"]) for r in out.collect()} == {(1, "a"), (2, "c")} and audit.collect()[0]["previous_category"] == "b"


def _run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    _run(activity.windowed(stream), "win", "complete")
    want = {tuple(r) for r in activity.windowed(events).select("start", "n").collect()}
    assert {tuple(r) for r in spark.table("win").select("start", "n").collect()} == want
    _run(activity.sessions(stream), "ses", "complete")
    assert {tuple(r) for r in spark.table("ses").select("user_id", "start", "n").collect()} == {tuple(r) for r in activity.sessions(events).select("user_id", "start", "n").collect()}
    _run(activity.expiring_sessions(stream), "exp", "append")
    total = spark.table("exp").filter("not expired").groupBy("user_id").agg(F.max("n").alias("n")).agg(F.sum("n")).collect()[0][0]
    assert total == events.count()
    q = activity.ingest_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "event_id")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_paragraphs_keep_what_stands_in_inline_marks():
    raw = "<DOC><BODY><P>Sales rose <B>5%</B> YoY to <B>1,234</B> won</P><SECTION><P>See <SPAN>note 3</SPAN>.</P></SECTION></BODY></DOC>".encode()
    assert archives.filing_text(raw) == "Sales rose 5% YoY to 1,234 won\nSee note 3."


def test_append_takes_a_null_key_once(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a"), (None, "b"), ("k", "c"), ("k", "b")], "key string, v string")
    for _ in range(2):
        got = stores.append_new(rows, f"{tmp_path}/s", "key")
    assert sorted((r["key"] or "", r["v"]) for r in got.collect()) == [("", "a"), ("k", "b")]


def test_two_changes_of_a_document_leave_one_row(spark):
    analyses = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "z")], "id int, document_id int, category string")
    changes = spark.createDataFrame([(1, "n", "r"), (1, "m", "s")], "document_id int, new_category string, reason string")
    out, audit = stores.reclassified(analyses, changes)
    assert sorted(map(tuple, out.select("id", "category").collect())) == [(1, "x"), (2, "n"), (3, "z")] and audit.count() == 1
