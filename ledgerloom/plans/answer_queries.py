"""Queries of what filings disclose, of questions in their conversation, and of answers put together from facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import disclosure as D
from ledgerloom.operators import dialogue as G
from ledgerloom.plans.fact_queries import _WITH, _best
from ledgerloom.sources.tables import FACTS_SQL, facts, load

def _key():
    return F.col("o_orderkey")


def _word(key):
    """A capitalised word of four letters or more for a number."""
    return F.initcap(F.translate((1000 + key % 1000).cast("string"), "0123456789", "abcdefghij"))


# A filing of each order, with people, an auditor, risks, customers and a segment table.
def _filings(spark, d):
    rest = _key() % 3
    lines = (
        F.when(_key() % 2 == 0, F.concat(F.lit("Report on material facts (Capital increase "), (_key() % 10).cast("string"), F.lit(")"))).otherwise("Annual Report of the year"),
        F.concat(F.lit("Chief Executive Ann "), _word(_key()), F.lit(", Director Bob "), _word(_key() + 1)),
        F.concat(F.lit("Director Bob "), _word(_key() + 1)),
        F.lit("Director Director Zed"),
        F.when(rest == 0, "Audited by Alpha Beta LLP. Adverse opinion.").when(rest == 1, "Audited by Alpha Beta LLP.").otherwise("No audit took place."),
        F.concat(F.lit("Credit risk: depends on "), (_key() % 100).cast("string"), F.lit(" large buyers in two regions.\nMarket risk: low.")),
        F.concat(F.lit("Major customers: Zeta "), (_key() % 10).cast("string"), F.lit(", Alpha, 12 others, 5% share, Alpha.")),
        F.concat(F.lit("Cloud business | product | export | "), F.format_number(_key() * 1000, 0), F.lit(" | 51.8%")),
        F.lit("Total | 2,345 | 100%"),
        F.when(_key() % 4 == 0, F.concat(F.lit("Payment date: 2024-01-0"), (_key() % 9 + 1).cast("string"))),
    )
    return load(spark, d, "orders").select("o_orderkey", F.concat_ws("\n", *lines).alias("text"))


def executives(spark, d):
    return _filings(spark, d).select("o_orderkey", F.inline(D.executives(F.col("text"))))


def segment_revenue(spark, d):
    return _filings(spark, d).select("o_orderkey", F.inline(D.segments(F.col("text"))))


def audit_infos(spark, d):
    a = _filings(spark, d).select("o_orderkey", D.audit_info(F.col("text")).alias("a"))
    return a.select("o_orderkey", "a.auditor", "a.opinion", F.size("a.matters").alias("n_matters"))


def risks_and_customers(spark, d):
    t = F.col("text")
    return _filings(spark, d).select("o_orderkey", F.array_join(D.risks(t), ";").alias("risks"), F.array_join(D.customers(t), ";").alias("customers"))


def filing_titles(spark, d):
    terms = D.event_terms(F.col("text"), {"paid": r"Payment date: ([0-9-]+)", "opened": r"Opening date: ([0-9-]+)"})
    return _filings(spark, d).select("o_orderkey", D.title(F.col("text")).alias("title"), F.size(terms).cast("int").alias("n_terms"), F.try_element_at(terms, F.lit("paid")).alias("paid"))


def text_windows(spark, d):
    return load(spark, d, "documents").select("doc_id", D.windows(F.length("text")).alias("w")).select("doc_id", "w.event", "w.terms", "w.overview")


_SUMMARIES = (
    None, "", "Short.", "A summary of some forty characters in all.", "The company the company has reported its figures for the whole year once more.",
    "Profit rose and the board has resolved and disclosed the plan to buy back shares.", "The spin-off was registered and its payment date was set for the first of June.",
    "After the dissolution a listing date was named in the filing of the second quarter.", "Marks were left ( ) in the text of this summary and nobody has taken them out.",
    "Revenue of 1,200 trillion was reported for the fiscal year, more than all others.", "The debt ratio of -12.5% was reported for the fiscal year, less than all others.",
    "The debt ratio of 5100% was reported for the fiscal year and more than all others.",
)
_FAULTS = (("empty",), ("empty",), ("too_short_30",), ("too_short_60",), ("twice_named",), ("kind_and_event",), ("split_with_payment",), ("negative_with_date",), ("stray_marks",), ("revenue_too_large",), ("negative_debt_ratio",), ("extreme_debt_ratio",))


def narrative_faults(spark, d):
    said = F.element_at(F.array(*map(F.lit, _SUMMARIES)), (F.col("p_partkey") % 12 + 1).cast("int"))
    kind = F.when(F.col("p_partkey") % 24 < 12, "annual").otherwise("event")
    found = load(spark, d, "part").select(F.explode(D.narrative_faults(said, kind)).alias("code"))
    return found.groupBy("code").agg(F.count("*").alias("n"))


def stored_names(spark, d):
    c = load(spark, d, "customer")
    file = F.when(F.col("c_custkey") % 4 == 0, F.lit(None).cast("string")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("0a1b_DART_P1_"), F.col("c_name"), F.lit("_20240102030405.zip"))).otherwise(F.concat(F.col("c_name"), F.lit(".pdf")))
    return c.select("c_custkey", D.stored_name(file, F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))).alias("shown"))


_QUESTIONS = (
    "Top 5 by revenue", "Which event and why, compare it with others", "tell me", "Recommend a good company to buy now please",
    "Find those with a high revenue in the last years", "What is the outlook for the next two quarters", "Revenue history over the years please",
    "An overview of the business in plain words", "Explain the risk of the main business lines", None,
)


def question_routes(spark, d):
    asked = F.element_at(F.array(*map(F.lit, _QUESTIONS)), (_key() % 10 + 1).cast("int"))
    tens = F.floor(_key() / 10)
    has, bound = tens % 2 == 0, tens % 4 == 0
    r = load(spark, d, "orders").select((_key() % 10).alias("form"), has.alias("has"), bound.alias("bound"), G.route(asked, has, F.contains(F.lower(asked), F.lit("revenue")), bound, F.lit(None).cast("boolean")).alias("r"))
    return r.groupBy("form", "has", "bound", "r.route", "r.density", "r.missing").agg(F.count("*").alias("n"))


def question_tests(spark, d):
    form = F.col("c_custkey") % 5
    asked = F.when(form == 0, "Hello there").when(form == 1, "What can you do for me?").when(form == 2, "So, who are you?").when(form == 3, F.concat(F.col("c_name"), F.lit("?!"))).otherwise(F.concat(F.col("c_name"), F.lit(" revenue")))
    return load(spark, d, "customer").select("c_custkey", G.meta_reply(asked).alias("meta"), G.name_only(asked, F.array("c_name")).alias("only_name"))


def inherited_context(spark, d):
    low = F.lower("text")
    own = F.when(F.contains(low, F.lit("ment")), "ment").when(F.contains(low, F.lit("ung")), "ung").when(F.contains(low, F.lit("tion")), "tion")
    rows = G.inherited(load(spark, d, "conversations").withColumn("own", own), "own")
    return rows.select("conv_id", "turn", "context", "inherited")


def session_memory(spark, d):
    rows = G.session_memory(load(spark, d, "conversations"), ("the", "der", "ment", "tion"))
    return rows.select("conv_id", "turn", "objective", "resolved", F.array_join("mentioned", ",").alias("mentioned"))


def answer_gates(spark, d):
    c = load(spark, d, "conversations").filter("role = 'assistant'")
    share, covered = (F.length("text") % 100) / 100, (F.col("conv_id") % 5).cast("int")
    return c.groupBy(G.confidence(share, F.nullif(F.col("conv_id") % 4, F.lit(0))).alias("confidence"), G.outlook(covered).alias("outlook")).agg(F.count("*").alias("n"))


def answers_with_fallback(spark, d):
    o = load(spark, d, "orders")
    one = lambda rows, agg: rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(agg("o_orderkey").cast("string").alias("answer"))
    asked = load(spark, d, "customer").select("c_custkey")
    return G.with_fallback(asked, one(o.filter("o_orderpriority = '1-URGENT'"), F.max), one(o.filter("o_orderstatus = 'O'"), F.min), "c_custkey")


def values_by_source(spark, d):
    f = facts(spark, d)
    return G.by_source([f.filter(F.col("period_type") == p) for p in ("annual", "semiannual", "quarterly")], ["metric", "company", "fiscal_year"], "value")


def comparison_lines(spark, d):
    return G.comparison_text(_best(spark, d), ("FRANCE", "GERMANY", "NOWHERE"), (1996, 1997, 1998), "revenue")


def citations(spark, d):
    f = facts(spark, d)
    label = G.citation(F.col("company"), F.when(F.col("fiscal_year") > 1993, F.col("fiscal_year")), F.col("report_type"), F.lit(None).cast("long"))
    return G.cited_once(f, "company", label, [F.col("fact_id")])


def link_audit(spark, d):
    key, name = F.col("c_custkey"), F.col("c_name")
    inferred = F.when(key % 3 == 0, "").when(key % 7 == 0, "other").otherwise(name)
    return G.link_audit(load(spark, d, "customer"), F.when(key % 5 != 0, name), inferred)


QUERIES = {
    f.__name__: f
    for f in (
        executives, segment_revenue, audit_infos, risks_and_customers, filing_titles, text_windows, narrative_faults, stored_names, question_routes,
        question_tests, inherited_context, session_memory, answer_gates, answers_with_fallback, values_by_source, comparison_lines, citations, link_audit,
    )
}

_W = lambda key: f"translate(CAST(1000 + ({key}) % 1000 AS VARCHAR), '0123456789', 'abcdefghij')"
_CAP = lambda key: f"upper({_W(key)}[1]) || {_W(key)}[2:]"
_ROUTES = """CASE form WHEN 0 THEN ['ranking', 'R1', ''] WHEN 1 THEN CASE WHEN has THEN ['qa', 'R2', ''] ELSE ['qa', 'R0', 'company'] END
    WHEN 2 THEN CASE WHEN bound THEN ['summary', 'R1', ''] ELSE ['qa', 'R1', ''] END WHEN 3 THEN CASE WHEN has THEN ['qa', 'R2', ''] ELSE ['qa', 'R0', 'priority_axis'] END
    WHEN 4 THEN CASE WHEN has THEN ['qa', 'R2', ''] ELSE ['ranking', 'R1', ''] END WHEN 5 THEN CASE WHEN has THEN ['outlook', 'R2', ''] ELSE ['outlook', 'R0', 'company'] END
    WHEN 6 THEN ['trend', 'R1', ''] WHEN 7 THEN CASE WHEN has THEN ['summary', 'R1', ''] ELSE ['qa', 'R2', ''] END
    WHEN 8 THEN CASE WHEN has THEN ['qa', 'R2', ''] ELSE ['qa', 'R0', 'company'] END ELSE CASE WHEN bound THEN ['summary', 'R1', ''] ELSE ['qa', 'R1', ''] END END"""

ORACLES = {
    "executives": f"""SELECT o_orderkey, 'Chief Executive' AS title, 'Ann ' || {_CAP("o_orderkey")} AS name FROM orders
        UNION ALL SELECT o_orderkey, 'Director', 'Bob ' || {_CAP("o_orderkey + 1")} FROM orders""",
    "segment_revenue": """SELECT o_orderkey, 'Cloud business' AS segment, 'product' AS kind, 'export' AS channel, format('{:,}', o_orderkey * 1000) AS amount, '51.8%' AS share FROM orders
        UNION ALL SELECT o_orderkey, 'Total', '-', '-', '2,345', '100%' FROM orders""",
    "audit_infos": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'Alpha Beta LLP' END AS auditor,
        CASE o_orderkey % 3 WHEN 0 THEN 'adverse' WHEN 1 THEN 'unqualified' END AS opinion, 0 AS n_matters FROM orders""",
    "risks_and_customers": """SELECT o_orderkey, 'Credit risk: depends on ' || (o_orderkey % 100) || ' large buyers in two regions' AS risks,
        'Alpha;Zeta ' || (o_orderkey % 10) AS customers FROM orders""",
    "filing_titles": """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Capital increase ' || (o_orderkey % 10) ELSE 'Annual Report' END AS title,
        CAST(o_orderkey % 4 = 0 AS INTEGER) AS n_terms, CASE WHEN o_orderkey % 4 = 0 THEN '2024-01-0' || (o_orderkey % 9 + 1) END AS paid FROM orders""",
    "text_windows": """WITH n AS (SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents)
        SELECT doc_id, CASE WHEN n < 10000 THEN n WHEN n < 50000 THEN 5000 WHEN n >= 50000 THEN 3000 END AS event,
        CASE WHEN n < 10000 THEN n WHEN n < 50000 THEN 10000 WHEN n >= 50000 THEN 5000 END AS terms,
        CASE WHEN n < 50000 THEN n WHEN n < 200000 THEN 50000 WHEN n >= 200000 THEN 100000 END AS overview FROM n""",
    "narrative_faults": f"""WITH k AS (SELECT unnest(CASE p_partkey % 12 {" ".join(f"WHEN {i} THEN {list(c)}" for i, c in enumerate(_FAULTS))} END) AS code, p_partkey FROM part)
        SELECT code, count(*) AS n FROM k WHERE code <> 'kind_and_event' OR p_partkey % 24 < 12 GROUP BY code""",
    "stored_names": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_name || '_' || CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'unclassified' END
        ELSE c_name || '.pdf' END AS shown FROM customer""",
    "question_routes": f"""WITH q AS (SELECT o_orderkey % 10 AS form, (o_orderkey // 10) % 2 = 0 AS has, (o_orderkey // 10) % 4 = 0 AS bound FROM orders), r AS (SELECT *, {_ROUTES} AS r FROM q)
        SELECT form, has, bound, r[1] AS route, r[2] AS density, r[3] AS missing, count(*) AS n FROM r GROUP BY ALL""",
    "question_tests": "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'greeting' WHEN 1 THEN 'capability' WHEN 2 THEN 'identity' END AS meta, c_custkey % 5 = 3 AS only_name FROM customer",
    "inherited_context": """WITH u AS (SELECT conv_id, turn, CASE WHEN contains(lower(text), 'ment') THEN 'ment' WHEN contains(lower(text), 'ung') THEN 'ung' WHEN contains(lower(text), 'tion') THEN 'tion' END AS own
        FROM conversations WHERE role = 'user'), b AS (SELECT *, lag(own) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM u)
        SELECT conv_id, turn, coalesce(own, prev) AS context, own IS NULL AND prev IS NOT NULL AS inherited FROM b""",
    "session_memory": """SELECT a.conv_id, a.turn, substring(trim(arg_max(b.text, b.turn) FILTER (b.role = 'user')), 1, 100) AS objective,
        substring(replace(trim(arg_max(b.text, b.turn) FILTER (b.role = 'assistant')), chr(10), ' '), 1, 100) AS resolved,
        concat_ws(',', CASE WHEN bool_or(b.role = 'user' AND contains(lower(b.text), 'der')) THEN 'der' END, CASE WHEN bool_or(b.role = 'user' AND contains(lower(b.text), 'ment')) THEN 'ment' END,
        CASE WHEN bool_or(b.role = 'user' AND contains(lower(b.text), 'the')) THEN 'the' END, CASE WHEN bool_or(b.role = 'user' AND contains(lower(b.text), 'tion')) THEN 'tion' END) AS mentioned
        FROM conversations a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) b ON a.conv_id = b.conv_id
        JOIN (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) n ON n.conv_id = a.conv_id AND n.turn = a.turn AND b.i BETWEEN n.i - 5 AND n.i
        GROUP BY a.conv_id, a.turn""",
    "answer_gates": """SELECT CASE WHEN conv_id % 4 = 0 THEN 0.3 WHEN length(text) % 100 >= 60 THEN 0.85 WHEN length(text) % 100 >= 30 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence,
        CASE WHEN conv_id % 5 = 4 THEN 'inference_full' WHEN conv_id % 5 = 3 THEN 'inference_part' ELSE 'shortage' END AS outlook, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2""",
    "answers_with_fallback": """WITH s AS (SELECT o_custkey, CAST(max(o_orderkey) AS VARCHAR) AS a FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
        r AS (SELECT o_custkey, CAST(min(o_orderkey) AS VARCHAR) AS a FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
        SELECT c_custkey, coalesce(s.a, r.a) AS answer, CASE WHEN s.a IS NOT NULL THEN 'structured' WHEN r.a IS NOT NULL THEN 'retrieved' ELSE 'none' END AS via
        FROM customer LEFT JOIN s ON s.o_custkey = c_custkey LEFT JOIN r ON r.o_custkey = c_custkey""",
    "values_by_source": f"""WITH {FACTS_SQL}, k AS (SELECT *, CASE period_type WHEN 'annual' THEN 1 WHEN 'semiannual' THEN 2 ELSE 3 END AS source FROM facts WHERE value IS NOT NULL)
        SELECT metric, company, fiscal_year, min(source) AS source, arg_min(value, (source, value)) AS value FROM k GROUP BY 1, 2, 3""",
    "comparison_lines": f"""{_WITH}, g AS (SELECT unnest(['FRANCE', 'GERMANY', 'NOWHERE']) AS company), y AS (SELECT company, unnest([1996, 1997, 1998]) AS fiscal_year FROM g)
        SELECT y.company, string_agg(y.fiscal_year || ': ' || coalesce(CAST(round(value, 0) AS BIGINT) || ' (' || period_type || ')', 'missing'), '; ' ORDER BY y.fiscal_year) AS line,
        count(*) FILTER (value IS NULL) AS missing FROM y LEFT JOIN best ON best.company = y.company AND best.fiscal_year = y.fiscal_year AND metric = 'revenue' GROUP BY 1""",
    "citations": f"""WITH {FACTS_SQL}, l AS (SELECT company, concat_ws(' / ', company, CASE WHEN fiscal_year > 1993 THEN fiscal_year END, report_type) AS label, min(fact_id) AS o FROM facts GROUP BY 1, 2)
        SELECT * FROM (SELECT company, label, CAST(row_number() OVER (PARTITION BY company ORDER BY o, label) AS INTEGER) AS n FROM l) WHERE n <= 5""",
    "link_audit": """SELECT count(*) AS total, count(*) FILTER (c_custkey % 5 <> 0) AS linked, count(*) FILTER (c_custkey % 5 = 0) AS missing,
        count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 7 = 0) AS mismatch FROM customer""",
}
