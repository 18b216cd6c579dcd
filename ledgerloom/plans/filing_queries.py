"""Queries of table cells, budgeted chunks, cleaning rules, filters and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import cleaning as K
from ledgerloom.functions import text as T
from ledgerloom.operators import budgets, cells, filters, quality, search
from ledgerloom.sources.tables import FACTS_SQL, facts, load


def _docs(spark, d):
    return load(spark, d, "documents")


# Tables of an order as filings hold them, a cell a line.
def _cell_table(spark, d):
    o = load(spark, d, "orders")
    price = F.floor("o_totalprice").cast("long")
    unit = F.when(F.col("o_orderkey") % 3 == 0, "(unit: thousand)").when(F.col("o_orderkey") % 3 == 1, "(Unit: million)").otherwise("no declaration")
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    rows = (unit, "1. Revenue", F.format_number(price, 0), "77", "Operating profit (note 3)", "", F.concat(F.lit("("), (price / 4).cast("long").cast("string"), F.lit(")")), "Equity", "none", "Total assets", F.when(F.col("o_orderkey") % 5 == 0, F.format_number(price, 0)).otherwise(F.format_number(price * 2, 0)))
    return o.select("o_orderkey", F.concat_ws("\n", *map(lit, rows)).alias("text"))


def cell_facts(spark, d):
    return cells.cell_facts(_cell_table(spark, d), id_col="o_orderkey").select("o_orderkey", "metric", "value")


def suspicious_values(spark, d):
    f = facts(spark, d)
    flag = cells.suspicious(F.col("metric"), F.when(F.col("fact_id") % 7 != 0, F.col("value") * 10), F.col("fact_id") % 2 == 0, F.lit(None).cast("string"))
    return f.groupBy("metric", flag.alias("suspicious")).agg(F.count("*").alias("n"))


def budgeted_chunks(spark, d):
    return budgets.budgeted_chunks(_docs(spark, d), "source").select("doc_id", "idx", "kind", F.md5(F.col("chunk").cast("binary")).alias("h"))


def long_splits(spark, d):
    return budgets.long_splits(_docs(spark, d), 2000).select("doc_id", F.col("part").cast("int").alias("part"), F.length("piece").alias("n"))


def numeric_tables(spark, d):
    share = K.numeric_share(F.col("text"))
    return _docs(spark, d).select("doc_id", F.round(share, 6).alias("share"), (share >= 0.5).alias("numeric"))


def noise_lines(spark, d):
    lines = _docs(spark, d).select("doc_id", F.explode(K.filled_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(K.noise_text(F.col("line"))).alias("noise"), F.count_if(K.noise_sentence(F.col("line"))).alias("thin"))


def respaced_lines(spark, d):
    p = load(spark, d, "part")
    apart = F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("p_name", "(.)", "$1 ")).otherwise(F.col("p_name"))
    return p.select("p_partkey", K.respaced(apart).alias("line"))


def official_names(spark, d):
    n = load(spark, d, "nation")
    text = F.concat(F.lit("sales of "), "n_name", F.lit(" and NATION_1, again NATION_11?"))
    names = {"NATION_1": "First", "NATION_11": "Eleventh", "NATION_2": "Second"}
    return n.select("n_nationkey", K.replaced(text, names).alias("named"), K.without_names(text, list(names)).alias("bare"), K.compact(F.col("n_name"), {"nation": "en", "_": ""}).alias("compact"))


def search_variants(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", F.array_join(K.search_variants(F.concat("c_name", F.lit(" Inc.")), F.array("c_mktsegment")), "|").alias("variants"))


def field_faults(spark, d):
    return load(spark, d, "conversations").select("conv_id", "turn", F.array_join(K.field_faults(F.col("text")), ",").alias("faults"), K.corrupted(F.col("text")).alias("corrupted"), K.cut_off(F.col("text")).alias("cut"))


def word_snippets(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(K.snippets(F.col("text"), "licen[cs]e"), "|").alias("snippets"))


def made_up_numbers(spark, d):
    return _docs(spark, d).select("doc_id", K.made_up_numbers(F.col("text"), 1, 0.2).alias("made_up"), K.no_evidence(F.nullif(F.col("lang"), F.lit("fr"))).alias("none"))


def question_horizon(spark, d):
    turns = load(spark, d, "conversations")
    return turns.select("conv_id", "turn", K.time_horizon(F.concat_ws(" ", "text", F.when(F.col("turn") % 3 == 0, "next year"), F.when(F.col("turn") % 3 == 1, "long-term"))).alias("horizon"))


def report_kinds(spark, d):
    return _docs(spark, d).groupBy(K.report_kind(F.substring("text", 1, 500)).alias("kind"), K.opinion(F.col("text")).alias("opinion"), K.sub_type(F.col("lang"), F.col("source"), F.col("text")).alias("sub")).agg(F.count("*").alias("n"))


def typed_values(spark, d):
    o = load(spark, d, "orders")
    key = F.element_at(F.array(*map(F.lit, ("revenue", "net_margin", "shares_issued", "share_price"))), (F.col("o_orderkey") % 4).cast("int") + 1)
    value = F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 8 == 0, 100_000).otherwise(1)
    amount = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(""), F.floor("o_totalprice").cast("string"))
    return o.select("o_orderkey", K.typed_value(key, value).alias("shown"), K.positive_amount(amount).alias("amount"), K.plausible_amount(key, value / 10_000).alias("plausible"))


def section_spans(spark, d):
    spans = K.section_spans(F.col("text"), {"license": "[Ll]icense", "mail": "[a-z]+@[a-z]+", "figures": "[0-9]{4}"})
    return _docs(spark, d).select("doc_id", F.explode(spans).alias("s")).select("doc_id", "s.name", "s.start", "s.stop")


def amount_after_label(spark, d):
    text = F.concat_ws("\n", F.lit("Revenue:"), F.when(F.col("o_orderkey") % 2 == 0, F.format_number(F.floor("o_totalprice"), 0)).otherwise("about 5"))
    return load(spark, d, "orders").select("o_orderkey", K.followed_by_amount(text, "Revenue").alias("follows"), K.position_uid(F.col("o_orderkey"), F.col("o_custkey")).alias("uid"), K.unit_annotation(F.concat(F.lit("x (unit: "), "o_orderstatus", F.lit(" thousands)"))).alias("unit"))


def filtered_documents(spark, d):
    docs = filters.of_category(filters.matching(_docs(spark, d), {"lang": "en", "source": None}), "source", "all")
    return docs.select("doc_id", "source")


def company_or_all(spark, d):
    docs = _docs(spark, d)
    some = filters.of_company(docs, ["src3", "SRC7"], ["source"], "text").select("doc_id", F.lit("some").alias("which"))
    none = filters.of_company(docs.filter("lang = 'de'"), ["no such name"], ["source"], "text").select("doc_id", F.lit("all").alias("which"))
    return some.union(none)


def duplicate_uploads(spark, d):
    o = load(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    uploads = load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    return filters.already_there(uploads, o, ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F").select("o_custkey", "duplicate")


def purged_index(spark, d):
    failed = _docs(spark, d).filter("n_chars < 100").select("source")
    return filters.without_sources(_docs(spark, d), failed, "source").select("doc_id")


def payload_names(spark, d):
    e = load(spark, d, "events")
    return e.select("event_id", filters.first_of(F.col("props"), ["$.safe.name", "$.k"]).alias("name"), filters.binding_company(F.col("event_type"), F.col("event_type")).alias("company"))


def enriched_rows(spark, d):
    rows = load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") % 2 == 0, "").otherwise("own").alias("lang"), F.lit(None).cast("string").alias("source"))
    return filters.enriched(rows, _docs(spark, d).select("doc_id", "lang", "source"), "doc_id", ["lang", "source"])


def scope_preferred(spark, d):
    v = load(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 3 == 0, "consolidated").when(F.col("label") % 3 == 1, "separate").otherwise("unknown").alias("scope"), (F.col("label") / 10.0).alias("score"))
    out = filters.scope_preferred(v, "score", "scope").union(filters.scope_preferred(v, "score", "scope", separate_only=True))
    return out.groupBy("scope").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def prefiltered_chunks(spark, d):
    return filters.prefiltered(_docs(spark, d), "text", "source", "src5").select("doc_id")


def first_seen_sources(spark, d):
    return filters.first_seen(_docs(spark, d), "source", [F.col("n_chars").desc(), F.col("doc_id")], 12)


def earlier_facts(spark, d):
    rows = filters.newest_per(facts(spark, d), ["company", "metric"], [F.col("fiscal_year").desc(), F.col("fact_id")])
    return rows.select("company", "metric", "fiscal_year", "fact_id")


def chat_scores(spark, d):
    docs = _docs(spark, d)
    score = filters.chat_score(F.lit(0.5), F.least(F.col("n_chars") / 7919.0, F.lit(1.0)), F.col("source") == "src1", F.col("lang") == "en", F.col("n_chars") > 1000, F.col("n_chars") > 3000, F.col("source").contains("1"))
    return docs.select("doc_id", score.alias("score")).filter("score >= 0.15")


def event_labels(spark, d):
    docs = _docs(spark, d)
    return docs.groupBy(filters.longest_label(docs, {"license": "licence", "licensed under": "grant", "token": "secret"}, "text").alias("event")).agg(F.count("*").alias("n"))


def model_report(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_totalprice") > 400_000, "critical").when(F.col("o_totalprice") > 300_000, "warning").otherwise("fine").alias("severity"))
    return filters.model_report(o, "o_orderpriority", "severity", "o_orderkey")


def phase_gate(spark, d):
    docs, labels = _docs(spark, d), load(spark, d, "labels")
    return filters.gate({
        "labels without document": labels.join(docs, "doc_id", "left_anti"),
        "documents without label": docs.join(labels, "doc_id", "left_anti"),
        "tiny texts": docs.filter("n_chars < 20"),
        "repeated ids": docs.groupBy("doc_id").count().filter("count > 1"),
    })


def union_sources(spark, d):
    docs = _docs(spark, d)
    summary = docs.select("doc_id", F.lit("summary").alias("kind"), T.cut_at_sentence(F.col("text"), 200).alias("text")).filter("text <> ''")
    pages = docs.select("doc_id", F.lit("page").alias("kind"), "text").filter("text <> ''")
    return summary.unionByName(pages).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# The vector searched for, and what else the search of a passage asks.
_VECTOR_ID = 7
_ASKED = {"terms": ["license", "password", "the"], "company": "src1", "variants": ["src1"], "category": "en", "years": ["2024"], "domain": ["license", "token", "error"], "k": 10}


def staged_search(spark, d):
    v = load(spark, d, "embeddings")
    vector = v.filter(F.col("vec_id") == _VECTOR_ID).select("embedding").head()[0]
    chunks = _docs(spark, d).join(v.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select("doc_id", "text", F.col("source").alias("company"), F.col("lang").alias("category"), "embedding")
    return search.staged_search(chunks, search.Request(vector=vector, **_ASKED), F.when(F.col("category") == "en", 0.3).otherwise(0.0))


def question_rewrites(spark, d):
    turns = load(spark, d, "conversations").filter("role = 'user'")
    intent = F.element_at(F.array(*map(F.lit, ("ranking", "trend", "outlook", "qa"))), (F.col("conv_id") % 4).cast("int") + 1)
    company = F.when(F.col("turn") % 3 == 0, "").otherwise("Acme")
    return turns.select("conv_id", "turn", F.md5(F.array_join(search.rewrites(F.col("text"), company, intent), "|").cast("binary")).alias("h"))


def context_scores(spark, d):
    turns = load(spark, d, "conversations")
    question, answer, confidence = F.concat(F.lit("license of 2024 "), F.col("role")), F.col("text"), F.when(F.col("turn") % 2 == 0, "inference").otherwise("axiom")
    scores = {
        "precision": quality.context_precision(question, answer, F.when(F.col("turn") % 3 == 0, "token"), F.lit(0)),
        "recall": quality.context_recall(question, answer, F.array(F.lit("license"), F.lit("password")), "license"),
        "faithfulness": quality.faithfulness(answer, confidence),
    }
    return turns.select("conv_id", "turn", *(F.round(c, 6).alias(k) for k, c in scores.items()))


QUERIES = {
    f.__name__: f
    for f in (
        cell_facts, suspicious_values, budgeted_chunks, long_splits, numeric_tables, noise_lines, respaced_lines, official_names, search_variants,
        field_faults, word_snippets, made_up_numbers, question_horizon, report_kinds, typed_values, section_spans, amount_after_label,
        filtered_documents, company_or_all, duplicate_uploads, purged_index, payload_names, enriched_rows, scope_preferred, prefiltered_chunks,
        first_seen_sources, earlier_facts, chat_scores, event_labels, model_report, phase_gate, union_sources, staged_search, question_rewrites,
        context_scores,
    )
}

_SHARE = r"coalesce(len(list_filter(c, lambda x: regexp_matches(trim(x, ' '), '^[(△▲-]?[0-9][0-9,.]*[)%]?$')))::DOUBLE / nullif(len(c), 0), 0.0)"
_WS = r"[ \t\n\r\f\v]+"
_TOKENS = "list_filter(regexp_extract_all(lower(text), '[A-Za-zÀ-ɏ]{2,}'), lambda t: t NOT IN ('the','and','of','is','to','in','it','die','der','und','de','la','que','los') AND length(t) > 1)"
_BM25 = "least(list_sum(list_transform(['license', 'password', 'the'], lambda q: len(list_filter(tk, lambda x: x = q))::DOUBLE * 2.5 / (len(list_filter(tk, lambda x: x = q))::DOUBLE + 1.5 * (0.25 + 0.75 * len(tk) / 200.0)))) / 4.5, 1.0)"
_AMOUNT = r"[0-9][0-9,.]*\s*(?:%|bn|million|billion|thousand)|[0-9]{1,3}(?:,[0-9]{3})+"
_SOURCES = " + ".join(f"contains(a, '{w}')::INT" for w in quality.SOURCES)
_HITS = "len(regexp_extract_all({0}, '{1}'))"

ORACLES = {
    "union_sources": """WITH c AS (SELECT text, regexp_extract(substr(text, 1, 200), '(?s)^(.*[.!?])', 1) AS c FROM documents), s AS (SELECT CASE WHEN length(text) <= 200 THEN text WHEN length(c) >= 20 THEN c ELSE '' END AS s FROM c),
        u AS (SELECT 'summary' AS kind, s AS text FROM s WHERE s <> '' UNION ALL SELECT 'page', text FROM documents WHERE text <> '') SELECT kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM u GROUP BY 1""",
    "cell_facts": """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1.0 END AS u, floor(o_totalprice)::BIGINT AS p FROM orders),
        v AS (SELECT k, 'revenue' AS metric, p * u AS value FROM t UNION ALL SELECT k, 'operating_profit', -(trunc(p / 4.0)::BIGINT * u) FROM t
            UNION ALL SELECT k, 'total_assets', CASE WHEN k % 5 = 0 THEN p * u ELSE 2 * p * u END FROM t),
        s AS (SELECT * FROM v WHERE abs(value) BETWEEN CASE metric WHEN 'operating_profit' THEN 1e7 ELSE 1e8 END AND CASE metric WHEN 'revenue' THEN 5e14 WHEN 'operating_profit' THEN 6e13 ELSE 1e15 END),
        n AS (SELECT *, count(*) OVER (PARTITION BY k, round(abs(value))) AS c FROM s) SELECT k AS o_orderkey, metric, value::DOUBLE AS value FROM n WHERE c = 1""",
    "suspicious_values": f"WITH {FACTS_SQL} SELECT metric, (fact_id % 7 = 0) OR (metric <> 'liabilities' AND fact_id % 2 = 0 AND abs(value * 10) < 1000000) AS suspicious, count(*) AS n FROM facts GROUP BY 1, 2",
    "numeric_tables": rf"""WITH c AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' | '), ' | '), lambda x: trim(x, ' ') <> '') AS c FROM documents) SELECT doc_id, round({_SHARE}, 6) AS share, {_SHARE} >= 0.5 AS numeric FROM c""",
    "noise_lines": rf"""WITH l AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'), lambda x: trim(regexp_replace(x, '{_WS}', ' ', 'g'))), lambda x: x <> '')) AS line FROM documents),
        v AS (SELECT doc_id, line, regexp_replace(line, '{_WS}', '', 'g') AS s FROM l)
        SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(s, '[0-9]') AND (regexp_matches(s, '\p{{Han}}') OR len(list_distinct(regexp_extract_all(s, '(?s).'))) <= 2 OR regexp_matches(s, '^[A-Z_]+="?'))) AS noise,
            count(*) FILTER (WHERE len(regexp_extract_all(line, '\p{{L}}')) < 5 OR regexp_matches(line, '^[^\p{{L}}]*$') OR regexp_matches(line, '(?i)^(page|see|table) [0-9]+')) AS thin FROM v GROUP BY 1""",
    "respaced_lines": r"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(regexp_replace(replace(p_name, ' ', ''), '(\p{L})([0-9])', '\1 \2', 'g'), '([0-9])(\p{L})', '\1 \2', 'g') ELSE p_name END AS line FROM part",
    "official_names": r"""WITH t AS (SELECT n_nationkey, n_name, 'sales of ' || n_name || ' and NATION_1, again NATION_11?' AS s FROM nation)
        SELECT n_nationkey, replace(replace(replace(s, 'NATION_11', 'Eleventh'), 'NATION_1', 'First'), 'NATION_2', 'Second') AS named,
            regexp_replace(trim(regexp_replace(replace(replace(replace(s, 'NATION_11', ' '), 'NATION_1', ' '), 'NATION_2', ' '), ' +', ' ', 'g')), '^[ .,:;?!]+|[ .,:;?!]+$', '', 'g') AS bare,
            regexp_replace(replace(replace(lower(n_name), 'nation', 'en'), '_', ''), '[^\p{L}\p{N}]', '', 'g') AS compact FROM t""",
    "search_variants": "SELECT c_custkey, c_name || ' Inc.|' || c_mktsegment || '|' || upper(c_name || ' Inc.') || '|' || c_name AS variants FROM customer",
    "field_faults": r"""SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(text, '\p{Han}') THEN 'foreign' END, CASE WHEN regexp_matches(text, '[ぁ-ヿ]') THEN 'kana' END, CASE WHEN regexp_matches(text, '[、。「」『』]') THEN 'punctuation' END,
        CASE WHEN regexp_matches(text, '[^ \n] {2,}[^ \n]') THEN 'spacing' END, CASE WHEN regexp_matches(text, '[ㄱ-ㆎ]') THEN 'jamo' END, CASE WHEN regexp_matches(text, '(?i)as an (ai|assistant)|output (only )?json|system prompt') THEN 'instruction' END], lambda x: x IS NOT NULL), ',') AS faults,
        regexp_matches(text, 'Ã[\x{80}-¿]|Â[\x{80}-¿]|â€|ï¿½|�') AS corrupted, trim(text, ' ') <> '' AND NOT regexp_matches(rtrim(text, ' '), '[.!?]["'')\]]*$') AS cut FROM conversations""",
    "word_snippets": r"SELECT doc_id, array_to_string(regexp_extract_all(text, '(?s).{0,15}licen[cs]e.{0,15}')[1:3], '|') AS snippets FROM documents",
    "made_up_numbers": r"""WITH n AS (SELECT doc_id, lang, list_filter(list_transform(regexp_extract_all(text, '[0-9][0-9,]{2,}'), lambda x: replace(x, ',', '')), lambda x: length(x) >= 3) AS n FROM documents)
        SELECT doc_id, len(n) >= 1 AND len(list_filter(n, lambda x: ends_with(x, '00'))) > 0.2 * len(n) AS made_up, lang = 'fr' AS none FROM n""",
    "question_horizon": r"""WITH q AS (SELECT conv_id, turn, lower(text || CASE turn % 3 WHEN 0 THEN ' next year' WHEN 1 THEN ' long-term' ELSE '' END) AS q FROM conversations)
        SELECT conv_id, turn, CASE WHEN regexp_matches(q, 'long.term|years ahead|장기') THEN 'long' WHEN regexp_matches(q, 'next year|mid.term|중기|내년') THEN 'mid' WHEN regexp_matches(q, 'this quarter|next quarter|short.term|단기|분기') THEN 'short' ELSE 'unspecified' END AS horizon FROM q""",
    "typed_values": """WITH t AS (SELECT o_orderkey AS k, o_orderkey % 4 AS q, floor(o_totalprice)::BIGINT AS p, floor(o_totalprice)::BIGINT * CASE WHEN o_orderkey % 8 = 0 THEN 100000 ELSE 1 END AS v FROM orders)
        SELECT k AS o_orderkey, CASE q WHEN 1 THEN format('{:,.1f}%', v::DOUBLE) WHEN 2 THEN format('{:,}', v) WHEN 3 THEN format('{:,.2f}', v::DOUBLE)
            ELSE CASE WHEN v >= 1e9 THEN format('{:,.1f} bn', v / 1e9) WHEN v >= 1e6 THEN format('{:,.1f} m', v / 1e6) ELSE format('{:,}', v) END END AS shown,
            CASE WHEN k % 3 <> 0 AND p > 0 THEN format('{:,}', p) END AS amount, NOT (q = 0 AND v / 10000.0 < 100) AS plausible FROM t""",
    "report_kinds": """WITH t AS (SELECT text, lower(substr(text, 1, 500)) AS h, lower(text) AS w, lang, lower(lang || ' ' || source || ' ' || substr(text, 1, 2000)) AS f FROM documents)
        SELECT CASE WHEN regexp_matches(h, 'annual report|사업보고서') THEN 'annual' WHEN regexp_matches(h, 'half.year|semiannual|반기보고서') THEN 'semiannual' WHEN regexp_matches(h, 'quarter|분기보고서') THEN 'quarterly' WHEN regexp_matches(h, 'audit|감사보고서') THEN 'audit' ELSE 'other' END AS kind,
            CASE WHEN regexp_matches(w, 'disclaimer of opinion|opinion: *disclaimer|의견거절') THEN 'disclaimer' WHEN regexp_matches(w, 'adverse opinion|opinion: *adverse|부적정의견') THEN 'adverse' WHEN regexp_matches(replace(w, 'unqualified opinion', ''), 'qualified opinion|opinion: *qualified|한정의견') THEN 'qualified' WHEN regexp_matches(w, 'unqualified|fairly|적정의견|공정하게') THEN 'unqualified' END AS opinion,
            CASE WHEN regexp_matches(f, 'audit|감사') THEN 'audit' WHEN regexp_matches(f, 'governance|지배구조') THEN 'governance' WHEN regexp_matches(f, 'funding|증자|사채') THEN 'event_funding' WHEN regexp_matches(f, 'merger|event|주요사항') THEN 'event' WHEN regexp_matches(f, 'financial|재무') THEN 'financial' ELSE lang END AS sub,
            count(*) AS n FROM t GROUP BY 1, 2, 3""",
    "staged_search": rf"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {_VECTOR_ID}),
        c AS (SELECT d.doc_id, d.text, d.source AS company, d.lang, round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q), 0), 6) AS v FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id, q),
        l AS (SELECT * FROM (SELECT doc_id, 0 AS no FROM c WHERE lang = 'en' AND contains(company, 'src1') ORDER BY v DESC, doc_id LIMIT 30) UNION ALL SELECT * FROM (SELECT doc_id, 1 FROM c WHERE lang = 'en' ORDER BY v DESC, doc_id LIMIT 30)
            UNION ALL SELECT * FROM (SELECT doc_id, 2 FROM c WHERE contains(text, '2024') AND (contains(lower(text), 'license') OR contains(lower(text), 'password') OR contains(lower(text), 'the')) ORDER BY contains(lower(text), 'license')::INT + contains(lower(text), 'password')::INT + contains(lower(text), 'the')::INT DESC, doc_id LIMIT 40)),
        m AS (SELECT doc_id, min(no) AS no FROM l GROUP BY 1),
        t AS (SELECT c.*, m.no, {_TOKENS} AS tk, lower(text) AS w, contains(lower(text), 'license')::INT + contains(lower(text), 'token')::INT + contains(lower(text), 'error')::INT AS n FROM c JOIN m USING (doc_id) WHERE length(trim(text, ' ')) >= 20),
        b AS (SELECT *, ((0.40::DOUBLE * v + 0.25::DOUBLE * {_BM25} + 0.35::DOUBLE * CASE WHEN lang = 'en' THEN 0.3::DOUBLE ELSE 0 END) * CASE WHEN contains(text, '2024') THEN 1.08::DOUBLE ELSE 1 END * CASE WHEN n >= 3 THEN 1.2::DOUBLE WHEN n >= 1 THEN 1.12::DOUBLE ELSE 1 END
            + least(0.15::DOUBLE, 0.05::DOUBLE * {_HITS.format('text', '[0-9]{3,}')} / greatest(length(text) / 100.0::DOUBLE, 1.0))) * CASE WHEN contains(substr(w, 1, 3000), 'src1') THEN 1.35::DOUBLE ELSE 1 END
            * CASE WHEN company = 'src1' THEN 1.6::DOUBLE WHEN contains(company, 'src1') OR contains('src1', company) THEN 1.3::DOUBLE ELSE 1 END AS base,
            CASE WHEN {_HITS.format("substr(text, 1, 500)", chr(92) + 'p{Han}')} > 3 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN {_HITS.format("substr(text, 1, 500)", '[ぁ-ヿ]')} > 2 THEN 0.1::DOUBLE ELSE 0 END
            + CASE WHEN {_HITS.format("substr(text, 1, 300)", chr(92) + '{"')} + {_HITS.format("substr(text, 1, 300)", '":')} >= 3 THEN 0.12::DOUBLE ELSE 0 END AS p FROM t),
        s AS (SELECT *, round(CASE WHEN p > 0 THEN greatest(0.01::DOUBLE, base - p) ELSE base END, 4) AS score, contains(company, 'src1') OR contains(substr(w, 1, 1500), 'src1') AS named FROM b)
        SELECT doc_id, company, no AS source_no, score FROM s WHERE score >= 0.08 AND (named OR NOT (SELECT bool_or(named) FROM s)) ORDER BY score DESC, doc_id LIMIT 30""",
    "question_rewrites": """WITH q AS (SELECT conv_id, turn, text, conv_id % 4 AS i, CASE WHEN turn % 3 = 0 THEN '' ELSE 'Acme' END AS c FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, md5(text || CASE WHEN c <> '' THEN '|Acme ' || text ELSE '' END || CASE i WHEN 0 THEN '|largest ' || coalesce(nullif(c, ''), text) || '|ranking of ' || coalesce(nullif(c, ''), text)
            WHEN 1 THEN '|change over years of ' || coalesce(nullif(c, ''), text) || '|growth of ' || coalesce(nullif(c, ''), text) WHEN 2 THEN '|outlook of ' || coalesce(nullif(c, ''), text) || '|risks of ' || coalesce(nullif(c, ''), text) ELSE '' END) AS h FROM q""",
    "context_scores": rf"""WITH t AS (SELECT conv_id, turn, text, lower(text) AS a, CASE WHEN turn % 2 = 0 THEN 0.12::DOUBLE ELSE 0.15::DOUBLE END AS sure, regexp_extract_all(text, '20[0-9]{{2}}') AS y FROM conversations),
        u AS (SELECT *, ({_SOURCES} + least({_HITS.format('text', 'https?://' + chr(92) + 'S+')}, 3)) * 0.065::DOUBLE AS shown, {_HITS.format('text', _AMOUNT)} AS amounts,
            contains(a, 'is expected to')::INT + contains(a, 'will likely')::INT + contains(a, 'is forecast')::INT AS g FROM t)
        SELECT conv_id, turn, round(CASE WHEN length(text) < 30 THEN 0.1::DOUBLE ELSE least(CASE WHEN turn % 3 <> 0 THEN 0.28::DOUBLE WHEN contains(a, 'token') THEN 0.35::DOUBLE ELSE 0 END + least(shown, 0.28::DOUBLE)
            + CASE WHEN amounts > 0 THEN 0.25::DOUBLE WHEN regexp_matches(text, 'https?://') THEN 0.23::DOUBLE WHEN regexp_matches(text, '[0-9]{{3,}}') THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN list_contains(y, '2024') THEN 0.15::DOUBLE WHEN len(y) > 0 THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE) END, 6) AS precision,
            round(CASE WHEN text = '' THEN 0 ELSE least((CASE WHEN contains(a, 'license') THEN 1.0::DOUBLE WHEN contains(a, 'lic') THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN contains(a, 'password') THEN 1.0::DOUBLE WHEN contains(a, 'pas') THEN 0.8::DOUBLE ELSE 0 END) / 2
            + CASE WHEN amounts >= 3 THEN 0.25::DOUBLE WHEN regexp_matches(text, '[0-9]{{2,}}') THEN 0.22::DOUBLE WHEN regexp_matches(text, 'https?://') THEN 0.2::DOUBLE ELSE 0 END, 1.0::DOUBLE) END, 6) AS recall,
            round(CASE WHEN text = '' THEN 0 ELSE least(least(shown, 0.35::DOUBLE) + least(CASE WHEN contains(a, 'conclusion') THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN contains(a, 'evidence') THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN contains(a, 'risk') THEN 0.06::DOUBLE ELSE 0 END + CASE WHEN contains(a, 'confidence') THEN 0.06::DOUBLE ELSE 0 END
            + CASE WHEN {_HITS.format('text', '(?m)^' + chr(92) + '*' + chr(92) + '*[^*]+' + chr(92) + '*' + chr(92) + '*|^###?' + chr(92) + 's')} >= 2 THEN 0.05::DOUBLE ELSE 0 END, 0.32::DOUBLE)
            + CASE WHEN amounts > 0 THEN 0.2::DOUBLE WHEN regexp_matches(text, '[0-9]{{3,}}') THEN 0.16::DOUBLE WHEN regexp_matches(text, 'https?://') OR {_HITS.format('text', '(?m)^' + chr(92) + 's*[0-9]+[.)]' + chr(92) + 's')} >= 2 THEN 0.15::DOUBLE ELSE 0 END
            + sure + greatest(0.12::DOUBLE - 0.02::DOUBLE * CASE WHEN regexp_matches(a, 'speculation|exploration') THEN 0 ELSE g END, 0), 1.0::DOUBLE) END, 6) AS faithfulness FROM u""",
    "section_spans": r"""WITH p AS (SELECT doc_id, length(text) + 1 AS e, name, CASE WHEN regexp_matches(text, pat) THEN length(regexp_extract(text, '(?s)^(.*?)(?:' || pat || ')', 1)) + 1 ELSE 0 END AS start
        FROM documents, (VALUES ('license', '[Ll]icense'), ('mail', '[a-z]+@[a-z]+'), ('figures', '[0-9]{4}')) AS h(name, pat))
        SELECT doc_id, name, start::INTEGER AS start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start, name), e)::INTEGER AS stop FROM p WHERE start > 0""",
    "amount_after_label": """SELECT o_orderkey, o_orderkey % 2 = 0 AND o_totalprice >= 1000 AS follows, substr(sha256(o_orderkey || ':pos:' || o_custkey), 1, 32) AS uid, 'unit: ' || o_orderstatus || ' thousands' AS unit FROM orders""",
    "filtered_documents": "SELECT doc_id, source FROM documents WHERE lang = 'en'",
    "company_or_all": "SELECT doc_id, 'some' AS which FROM documents WHERE regexp_matches(lower(source), 'src3|src7') OR regexp_matches(lower(substr(text, 1, 1500)), 'src3|src7') UNION ALL SELECT doc_id, 'all' FROM documents WHERE lang = 'de'",
    "duplicate_uploads": "SELECT c_custkey AS o_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS duplicate FROM customer",
    "purged_index": "SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE n_chars < 100)",
    "payload_names": "SELECT event_id, json_extract_string(props, '$.k') AS name, '' AS company FROM events",
    "enriched_rows": "SELECT vec_id AS doc_id, CASE WHEN label % 2 = 0 THEN d.lang ELSE 'own' END AS lang, d.source FROM embeddings LEFT JOIN documents d ON vec_id = d.doc_id",
    "scope_preferred": "WITH v AS (SELECT CASE label % 3 WHEN 0 THEN 'consolidated' WHEN 1 THEN 'separate' ELSE 'unknown' END AS scope, label / 10.0::DOUBLE AS score FROM embeddings), o AS (SELECT scope, score + CASE scope WHEN 'consolidated' THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS score FROM v UNION ALL SELECT scope, score FROM v WHERE scope = 'separate') SELECT scope, count(*) AS n, round(sum(score), 6) AS score FROM o GROUP BY 1",
    "prefiltered_chunks": rf"SELECT doc_id FROM documents WHERE length(text) >= 30 AND source = 'src5' AND coalesce(len(regexp_extract_all(text, '\p{{Han}}'))::DOUBLE / nullif(length(regexp_replace(text, '\s+', '', 'g')), 0), 0) <= 0.1",
    "first_seen_sources": "WITH t AS (SELECT source, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents QUALIFY n <= 12) SELECT source, min(n)::INTEGER AS place FROM t GROUP BY 1",
    "earlier_facts": f"WITH {FACTS_SQL} SELECT company, metric, fiscal_year, fact_id FROM facts QUALIFY row_number() OVER (PARTITION BY company, metric ORDER BY fiscal_year DESC, fact_id) = 1",
    "chat_scores": """SELECT doc_id, round(0.40::DOUBLE * 0.5::DOUBLE + 0.25::DOUBLE * least(n_chars / 7919.0::DOUBLE, 1.0::DOUBLE) + 0.35::DOUBLE * least(0.0::DOUBLE + CASE WHEN source = 'src1' THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN lang = 'en' THEN 0.25::DOUBLE ELSE 0 END
        + CASE WHEN n_chars > 1000 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN n_chars > 3000 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN contains(source, '1') THEN 0.1::DOUBLE ELSE 0 END, 1.0::DOUBLE), 4) AS score FROM documents""",
    "event_labels": "SELECT CASE WHEN contains(lower(text), 'licensed under') THEN 'grant' WHEN contains(lower(text), 'license') THEN 'licence' WHEN contains(lower(text), 'token') THEN 'secret' ELSE 'none' END AS event, count(*) AS n FROM documents GROUP BY 1",
    "model_report": "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 400000) AS critical, count(*) FILTER (WHERE o_totalprice > 300000 AND o_totalprice <= 400000) AS warnings, coalesce(string_agg(CASE WHEN o_totalprice > 400000 THEN o_orderkey END, ',' ORDER BY o_orderkey), '') AS ids FROM orders GROUP BY 1",
    "phase_gate": """WITH c AS (SELECT 'labels without document' AS c, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'documents without label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
        UNION ALL SELECT 'tiny texts', count(*) FROM documents WHERE n_chars < 20 UNION ALL SELECT 'repeated ids', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) SELECT c AS "check", n, n = 0 AS passed FROM c""",
}
