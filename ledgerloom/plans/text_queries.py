"""Queries of text functions, chunks, scores and rankings over documents, pages, conversations and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import values as V
from ledgerloom.operators import chunking as C
from ledgerloom.operators import retrieval as R
from ledgerloom.operators import records as ops
from ledgerloom.sources import html
from ledgerloom.sources.tables import load

LEXICON = {"legal": "license|apache", "code": "token|password|secret", "mail": "@[a-z]+", "figures": "[0-9]{4,}"}
TERMS = ["the", "thation", "ation", "und", "hea"]
QUERY_VECTOR_ID = 7


def _docs(spark, d):
    return load(spark, d, "documents")


def clean_text(spark, d):
    out = T.clean_lines(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(out.cast("binary")).alias("h"), F.length(out).alias("n"))


def squeezed_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.squeezed(F.col("text")).cast("binary")).alias("h"), T.shortened(F.col("text"), 40).alias("head"))


def lines_once(spark, d):
    out = T.lines_once(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(out).alias("n"), F.md5(out.cast("binary")).alias("h"))


def script_ratio(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.script_ratio(F.col("text")), 6).alias("letters"), F.round(T.script_ratio(F.col("text"), spaces=True), 6).alias("letters_all"), T.has_foreign(F.col("text")).alias("foreign"))


def text_quality(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.readability(F.col("text")), 4).alias("score"))


def quality_tags(spark, d):
    confidence = F.when(F.col("doc_id") % 3 == 0, 0.2).otherwise(0.9)
    return _docs(spark, d).groupBy("lang", T.quality_tag(F.col("text"), confidence).alias("tag")).agg(F.count("*").alias("n"))


def token_counts_simple(spark, d):
    return _docs(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_distinct"))


def query_terms(spark, d):
    turns = load(spark, d, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", F.try_element_at(T.query_terms(F.col("text")), F.lit(1)).alias("longest"))


def sentence_cut(spark, d):
    out = T.cut_at_sentence(F.col("text"), 300)
    return _docs(spark, d).select("doc_id", F.length(out).alias("n"))


def company_keys(spark, d):
    s = load(spark, d, "customer")
    return s.select("c_custkey", T.company_key(F.col("c_name")).alias("k"), T.plausible_company(F.col("c_name")).isNotNull().alias("plausible"))


def number_parsing(spark, d):
    raws = [("1,234",), ("(5,600.5)",), ("△ 12",), ("-",), ("n/a",), ("7 [3]",), ("",), ("-0.5",), ("12a",)]
    return spark.createDataFrame(raws, "raw string").select("raw", V.parsed_number(F.col("raw")).alias("value"))


def unit_values(spark, d):
    p = load(spark, d, "part")
    unit = F.element_at(F.array(F.lit("thousand"), F.lit("MILLION"), F.lit(None), F.lit("dozen")), (F.col("p_partkey") % 4).cast("int") + 1)
    return p.select("p_partkey", V.with_unit(F.col("p_retailprice"), unit).alias("value"))


def amount_phrases(spark, d):
    c = load(spark, d, "customer")
    phrase = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("about "), F.col("c_custkey").cast("string"), F.lit(" million of sales"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("up "), F.col("c_custkey").cast("string"), F.lit(".5% and 3 billion"))).when(F.col("c_custkey") % 4 == 2, F.lit("paid 1,250 dollars")).otherwise("none")
    out = V.amount_phrase(phrase)
    return c.select("c_custkey", out["value"].alias("value"), out["unit"].alias("unit"))


def years_in_text(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(F.transform(V.years_in(F.col("text")), lambda y: y.cast("string")), ",").alias("years"))


def fiscal_years(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy(V.fiscal_year(F.col("o_orderdate"), F.col("o_orderstatus") == "F").alias("fiscal_year")).agg(F.count("*").alias("n"))


def dates_normalised(spark, d):
    o = load(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy.MM.dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.groupBy(F.year(V.any_date(raw)).alias("y"), F.month(V.any_date(raw)).alias("m")).agg(F.count("*").alias("n"))


def token_estimates(spark, d):
    return _docs(spark, d).select("doc_id", V.token_estimate(F.col("text"), per_token=4).alias("by_four"), V.token_estimate(F.col("text"), per_token=3).alias("by_three"), F.round(V.digit_ratio(F.col("text")), 6).alias("digits"))


def uid_hashes(spark, d):
    docs = _docs(spark, d)
    name = F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", V.document_uid(name).alias("doc_uid"), V.chunk_uid(F.col("doc_id"), F.lit(0), F.sha2(F.col("text").cast("binary"), 256)).alias("chunk_uid"), F.sha1(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.substring("text", 1, 160)).cast("binary")).alias("page_uid"), V.receipt_number(name).alias("receipt"), V.chunk_id(F.col("source"), F.lit("main"), F.col("doc_id")).alias("chunk_id"))


def readable_amounts(spark, d):
    c = load(spark, d, "customer").withColumn("v", F.floor(F.abs("c_acctbal")) * F.when(F.col("c_custkey") % 2 == 0, 1000000).otherwise(1))
    return c.groupBy(F.when(V.readable_amount(F.col("v").cast("double")).endswith("billion"), "billion").when(V.readable_amount(F.col("v").cast("double")).endswith("million"), "million").otherwise("plain").alias("size")).agg(F.count("*").alias("n"))


def double_encoded_json(spark, d):
    e = load(spark, d, "events")
    quoted = F.concat(F.lit('"'), F.replace(F.col("props"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    raw = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(quoted)
    return e.groupBy("event_type").agg(F.sum(F.try_variant_get(V.loaded_json(raw), "$.k", "long")).alias("sum_k"))


def salvaged_json(spark, d):
    e = load(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("answer "), F.col("props"), F.lit(" end"))).otherwise(F.col("props"))
    return e.groupBy("event_type").agg(F.sum(F.try_variant_get(V.salvaged_json(raw), "$.k", "long")).alias("sum_k"))


def paragraph_chunks(spark, d):
    out = C.paragraph_chunks(_docs(spark, d).select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text")), size=400)
    return out.select("doc_id", "para", "part", F.length("chunk").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("h"))


def section_chunks(spark, d):
    return C.section_chunks(_docs(spark, d)).select("doc_id", "idx", "kind", F.length("chunk").alias("n"))


def chunk_types(spark, d):
    docs = _docs(spark, d)
    return docs.groupBy(C.chunk_type(F.substring("text", 1, 200)).alias("type"), C.statement_scope(F.col("text")).alias("scope")).agg(F.count("*").alias("n"))


def embedding_texts(spark, d):
    out = C.embedding_text({"source": F.col("source"), "language": F.when(F.col("lang") != "en", F.col("lang"))}, F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(out.cast("binary")).alias("h"), C.breadcrumb(F.col("source"), F.lit(""), F.col("lang")).alias("crumb"))


def topic_tags(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(C.topic_tags(F.col("text"), LEXICON, 2), ",").alias("tags"))


def keyword_windows(spark, d):
    return C.keyword_windows(_docs(spark, d), "(?i)license").select("doc_id", "start", F.length("chunk").alias("n"))


def cosine_topk(spark, d):
    v = load(spark, d, "embeddings")
    query = v.filter(F.col("vec_id") == QUERY_VECTOR_ID).select("embedding").head()[0]
    return R.nearest(v, query, 10)


def cosine_topk_each(spark, d):
    v = load(spark, d, "embeddings")
    return R.nearest_each(v.filter("vec_id % 100 = 0"), v, 5).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


def bm25_tf(spark, d):
    score = R.bm25_tf(TERMS, T.tokens(F.col("text")))
    return _docs(spark, d).select("doc_id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(50)


def keyword_overlap(spark, d):
    terms = F.array(*map(F.lit, TERMS))
    return _docs(spark, d).select("doc_id", F.round(R.keyword_overlap(terms, T.tokens(F.col("text"))), 6).alias("share"))


def hybrid_composite(spark, d):
    v = load(spark, d, "embeddings")
    query = v.filter(F.col("vec_id") == QUERY_VECTOR_ID).select("embedding").head()[0]
    q = F.array(*(F.lit(float(x)) for x in query))
    joined = v.join(_docs(spark, d), F.col("vec_id") == F.col("doc_id"))
    meta = F.when(F.col("lang") == "en", 0.3).otherwise(0.0) + F.when(F.col("source").isin("src1", "src2"), 0.2).otherwise(0.0)
    vec = F.round(F.greatest(R.cosine(F.col("embedding"), q), F.lit(0.0)), 6)
    lex = F.round(R.bm25_tf(TERMS, T.tokens(F.col("text"))), 6)
    scored = joined.select("doc_id", "lang", R.composite(vec, lex, meta).alias("score"), F.round(R.density_bonus(F.col("text")), 6).alias("bonus"))
    return scored.filter("score >= 0.15").orderBy(F.col("score").desc(), "doc_id").limit(40)


def candidate_merge(spark, d):
    docs = _docs(spark, d)
    a = docs.filter("lang = 'en'").orderBy(F.col("n_chars").desc(), "doc_id").limit(40)
    b = docs.filter(F.contains(F.lower("text"), F.lit("license"))).orderBy("doc_id").limit(40)
    return R.merged([a, b], "doc_id", ["n_chars"])


def diverse_choice(spark, d):
    docs = _docs(spark, d).withColumn("score", F.col("n_chars") % 1000)
    return R.diverse(docs, "doc_id", "score", "text", 20)


def compressed_passages(spark, d):
    return _docs(spark, d).select("doc_id", F.length(R.compressed(F.col("text"), ["license", "token"])).alias("n"))


def grounding_ratio(spark, d):
    turns = load(spark, d, "conversations")
    texts = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda s: s["text"]), " ").alias("evidence"))
    joined = turns.filter("role = 'assistant'").join(texts, "conv_id")
    return joined.select("conv_id", "turn", F.round(R.grounding(F.col("text"), F.col("evidence")), 6).alias("ratio"))


def judged_chunks(spark, d):
    docs = _docs(spark, d).withColumn("score", F.col("n_chars") % 500)
    return R.judged(docs, "doc_id", "text", "score").select("doc_id", "score")


def benchmark_overlap(spark, d):
    return R.passage_pairs(_docs(spark, d), load(spark, d, "benchmark"), "doc_id", "item_id", "text", 0.8)


def html_titles(spark, d):
    return load(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"), html.count_tags(F.col("html"), "p").alias("n_p"), html.count_tags(F.col("html"), "li").alias("n_li"))


def html_text(spark, d):
    out = html.page_text(load(spark, d, "pages"))
    return out.select("page_id", F.length("text").alias("n"), F.substring("text", 1, 60).alias("head"))


def role_checks(spark, d):
    turns = load(spark, d, "conversations")
    by = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"), F.count_if(F.trim("text") == "").alias("n_empty"), F.max(F.struct("turn", "role"))["role"].alias("last_role"))
    bad = F.array_compact(F.array(F.when(F.col("n_user") == 0, "no_user"), F.when(F.col("n_empty") > 0, "empty"), F.when(F.col("last_role") != "assistant", "open_end")))
    return by.select("conv_id", "n", F.array_join(bad, ",").alias("issues"))


def han_purge(spark, d):
    return _docs(spark, d).groupBy(F.col("text").rlike(r"\p{IsHan}").alias("has_han")).agg(F.count("*").alias("n"))


def chunk_validation(spark, d):
    chunks = C.paragraph_chunks(_docs(spark, d), size=600)
    text = F.col("chunk")
    rules = {"short": F.length(text) < 60, "numeric": V.digit_ratio(text) > 0.3, "symbols": text.rlike("[#$%&*]{3}"), "no_stop": ~text.rlike(r"[.!?]")}
    found = chunks.select(F.explode(F.array_compact(F.array(*(F.when(t, n) for n, t in rules.items())))).alias("rule"))
    return found.groupBy("rule").agg(F.count("*").alias("failed"))


def keep_first_of_chunks(spark, d):
    chunks = C.paragraph_chunks(_docs(spark, d), size=600).join(_docs(spark, d).select("doc_id", "source"), "doc_id").withColumn("k", F.md5(F.substring("chunk", 1, 200).cast("binary")))
    return ops.keep_first(chunks, ["source", "k"], [F.col("doc_id"), F.col("para"), F.col("part")]).groupBy("source").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, squeezed_text, lines_once, script_ratio, text_quality, quality_tags, token_counts_simple, query_terms, sentence_cut,
        company_keys, number_parsing, unit_values, amount_phrases, years_in_text, fiscal_years, dates_normalised, token_estimates, uid_hashes,
        readable_amounts, double_encoded_json, salvaged_json, paragraph_chunks, section_chunks, chunk_types, embedding_texts, topic_tags,
        keyword_windows, cosine_topk, cosine_topk_each, bm25_tf, keyword_overlap, hybrid_composite, candidate_merge, diverse_choice,
        compressed_passages, grounding_ratio, judged_chunks, benchmark_overlap, html_titles, html_text, role_checks, han_purge,
        chunk_validation, keep_first_of_chunks,
    )
}

_SQZ = r"trim(regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g'))"
_TOK = r"list_filter(regexp_extract_all(lower({0}), '[A-Za-zÀ-ɏ]{{2,}}'), lambda t: t NOT IN ('the','and','of','is','to','in','it','die','der','und','de','la','que','los') AND length(t) > 1)"
_NOSP = r"length(regexp_replace({0}, '[ \t\n\r\f\v]+', '', 'g'))"
_CNT = r"len(regexp_extract_all({0}, '{1}'))"
_TERMS = "['the','thation','ation','und','hea']"
_BM = f"least(list_sum(list_transform({_TERMS}, lambda q: len(list_filter(tk, lambda x: x = q))::DOUBLE * 2.5 / (len(list_filter(tk, lambda x: x = q))::DOUBLE + 1.5 * (0.25 + 0.75 * len(tk) / 200.0)))) / 7.5, 1.0)"
_READ = f"""CASE WHEN length(text) < 10 THEN 0.0 ELSE least(1.0, coalesce(0.5 * coalesce({_CNT.format('text', r'\p{L}')}::DOUBLE / nullif({_NOSP.format('text')}, 0), 0)
  + 0.15 * (1 - {_CNT.format('text', r'[#$%&*@^~|<>\\]')}::DOUBLE / nullif({_NOSP.format('text')}, 0)) + 0.15 * (1 - {_CNT.format('text', '�')}::DOUBLE / nullif({_NOSP.format('text')}, 0))
  + 0.2 * len(list_filter(ln, lambda x: length(x) >= 5))::DOUBLE / nullif(len(ln), 0), 0.0)) END"""
_LN = f"SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_SQZ.format('x')}), lambda x: x <> '') AS ln FROM documents"
_PARA = r"""p AS (SELECT doc_id, unnest(ps) AS p, unnest(range(len(ps))) AS para FROM (SELECT doc_id, regexp_split_to_array({src}, '\n[ \t]*\n?') AS ps FROM documents)),
  s AS (SELECT doc_id, para, p, unnest(range(0, (length(p) - 1) // {size} + 1)) AS part FROM p WHERE length(p) > 0),
  c AS (SELECT doc_id, CAST(para AS INTEGER) AS para, CAST(part AS INTEGER) AS part, trim(regexp_replace(substr(p, part * {size} + 1, {size}), '[ \t\n\r\f\v]+', ' ', 'g')) AS chunk FROM s)"""

ORACLES = {
    "lines_once": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), k AS (SELECT doc_id, l, list_transform(l, lambda x: substr(x, 1, 80)) AS k FROM l),
        o AS (SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(k, substr(x, 1, 80)) = i), chr(10)) AS o FROM k) SELECT doc_id, length(o) AS n, md5(o) AS h FROM o""",
    "query_terms": r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) >= 2 AND x NOT IN ('the','and','of','is','to','in','it','die','der','und','de','la','que','los')) AS t FROM conversations WHERE role = 'user')
        SELECT conv_id, turn, list_filter(t, lambda x: length(x) = list_max(list_transform(t, lambda y: length(y))))[1] AS longest FROM t""",
    "sentence_cut": """WITH c AS (SELECT doc_id, text, length(regexp_extract(substr(text, 1, 300), '(?s)^(.*[.!?])', 1)) AS c FROM documents)
        SELECT doc_id, CASE WHEN length(text) <= 300 THEN length(text) WHEN c >= 20 THEN c ELSE 0 END AS n FROM c""",
    "squeezed_text": f"SELECT doc_id, md5({_SQZ.format('text')}) AS h, substr({_SQZ.format('text')}, 1, 40) AS head FROM documents",
    "script_ratio": f"""SELECT doc_id, round(coalesce({_CNT.format('text', r'\p{L}')}::DOUBLE / nullif({_NOSP.format('text')}, 0), 0), 6) AS letters, round(coalesce({_CNT.format('text', r'\p{L}')}::DOUBLE / nullif(length(text), 0), 0), 6) AS letters_all,
        coalesce({_CNT.format('text', r'\p{Han}')}::DOUBLE / nullif({_NOSP.format('text')}, 0), 0) > 0.02 AS "foreign" FROM documents""",
    "text_quality": f"WITH l AS ({_LN}) SELECT doc_id, round({_READ}, 4) AS score FROM l",
    "quality_tags": f"""WITH l AS ({_LN}), c AS (SELECT lang, text, 0.6 * ({_READ}) + 0.4 * CASE WHEN doc_id % 3 = 0 THEN 0.2 ELSE 0.9 END AS c FROM l)
        SELECT lang, CASE WHEN trim(text) = '' THEN 'empty' WHEN c < 0.3 THEN 'very_low' WHEN c < 0.6 THEN 'low' ELSE 'good' END AS tag, count(*) AS n FROM c GROUP BY 1, 2""",
    "token_counts_simple": f"SELECT doc_id, CAST(len({_TOK.format('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({_TOK.format('text')})) AS INTEGER) AS n_distinct FROM documents",
    "company_keys": r"SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '\b(inc|corp|co|ltd|llc|plc|gmbh|ag|sa|kg)\b\.?', '', 'g'), '[^\p{L}\p{N}]', '', 'g') AS k, len(regexp_extract_all(c_name, '[0-9]')) * 2 <= length(c_name) AS plausible FROM customer",
    "number_parsing": "SELECT * FROM (VALUES ('1,234', 1234.0::DOUBLE), ('(5,600.5)', -5600.5), ('△ 12', -12.0), ('-', NULL), ('n/a', NULL), ('7 [3]', 7.0), ('', NULL), ('-0.5', -0.5), ('12a', NULL)) t(raw, value)",
    "unit_values": "SELECT p_partkey, p_retailprice * CASE p_partkey % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 ELSE 1.0 END AS value FROM part",
    "amount_phrases": "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey * 1e6 WHEN 1 THEN c_custkey + 0.5 WHEN 2 THEN 1250.0 END AS value, CASE c_custkey % 4 WHEN 0 THEN 'currency' WHEN 1 THEN '%' WHEN 2 THEN 'currency' END AS unit FROM customer",
    "years_in_text": r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?:^|[^0-9])(20[0-9]{2})(?:$|[^0-9])', 1))), ',') AS years FROM documents",
    "fiscal_years": "SELECT CAST(year(o_orderdate) - CASE WHEN o_orderstatus = 'F' AND month(o_orderdate) <= 6 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, count(*) AS n FROM orders GROUP BY 1",
    "dates_normalised": "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    "token_estimates": f"SELECT doc_id, greatest(length(text) // 4, 1) AS by_four, greatest(length(text) // 3, 1) AS by_three, round(coalesce({_CNT.format('text', '[0-9]')}::DOUBLE / nullif(length(text), 0), 0), 6) AS digits FROM documents",
    "uid_hashes": """SELECT doc_id, substr(sha256(source || '-' || doc_id || '.txt'), 1, 16) AS doc_uid, substr(sha256(doc_id || ':0:' || sha256(text)), 1, 32) AS chunk_uid, sha1(doc_id || ':' || substr(text, 1, 160)) AS page_uid,
        substr(md5(source || '-' || doc_id || '.txt'), 1, 14) AS receipt, source || '-main-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS chunk_id FROM documents""",
    "readable_amounts": "WITH v AS (SELECT floor(abs(c_acctbal)) * CASE WHEN c_custkey % 2 = 0 THEN 1000000 ELSE 1 END AS v FROM customer) SELECT CASE WHEN v >= 1e9 THEN 'billion' WHEN v >= 1e6 THEN 'million' ELSE 'plain' END AS size, count(*) AS n FROM v GROUP BY 1",
    "double_encoded_json": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1",
    "salvaged_json": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY 1",
    "paragraph_chunks": f"WITH {_PARA.format(src='replace(text, chr(10), chr(10) || chr(10))', size=400)} SELECT doc_id, para, part, CAST(length(chunk) AS INTEGER) AS n, md5(chunk) AS h FROM c WHERE length(chunk) >= 20",
    "chunk_types": """SELECT CASE WHEN regexp_matches(h, 'audit|opinion') THEN 'audit' WHEN regexp_matches(h, 'summary|fact') THEN 'fact' WHEN regexp_matches(h, 'note [0-9]|footnote') THEN 'note' WHEN regexp_matches(h, 'balance|income|cash flow') THEN 'financial' ELSE 'narrative' END AS type,
        CASE WHEN contains(s, 'consolidated') THEN 'consolidated' WHEN contains(s, 'separate') THEN 'separate' ELSE 'unknown' END AS scope, count(*) AS n
        FROM (SELECT lower(substr(text, 1, 200)) AS h, lower(replace(substr(text, 1, 500), ' ', '')) AS s FROM documents) GROUP BY 1, 2""",
    "embedding_texts": "SELECT doc_id, md5('source: ' || source || chr(10) || CASE WHEN lang <> 'en' THEN 'language: ' || lang || chr(10) ELSE '' END || text) AS h, source || ' > ' || lang AS crumb FROM documents",
    "topic_tags": """WITH h AS (SELECT doc_id, lower(substr(text, 1, 4000)) AS h FROM documents) SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(h, 'license|apache') THEN 'legal' END, CASE WHEN regexp_matches(h, 'token|password|secret') THEN 'code' END,
        CASE WHEN regexp_matches(h, '@[a-z]+') THEN 'mail' END, CASE WHEN regexp_matches(h, '[0-9]{4,}') THEN 'figures' END], lambda x: x IS NOT NULL)[1:2], ',') AS tags FROM h""",
    "cosine_topk": f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID}) SELECT vec_id, round(greatest(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 0), 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 10""",
    "cosine_topk_each": """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(greatest(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 0), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS k FROM s) SELECT query_id, id, round(similarity, 4) AS similarity FROM r WHERE k <= 5""",
    "bm25_tf": f"WITH t AS (SELECT doc_id, {_TOK.format('text')} AS tk FROM documents) SELECT doc_id, round({_BM}, 6) AS score FROM t ORDER BY score DESC, doc_id LIMIT 50",
    "keyword_overlap": f"WITH t AS (SELECT doc_id, {_TOK.format('text')} AS tk FROM documents) SELECT doc_id, round(len(list_filter({_TERMS}, lambda q: list_contains(tk, q))) / 5.0::DOUBLE, 6) AS share FROM t",
    "hybrid_composite": f"""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = {QUERY_VECTOR_ID}), t AS (SELECT d.doc_id, d.lang, d.source, d.text, {_TOK.format('d.text')} AS tk, round(greatest(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q), 0), 6) AS vec
          FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id, q),
        s AS (SELECT doc_id, lang, round(0.40::DOUBLE * vec + 0.25::DOUBLE * round({_BM}, 6) + 0.35::DOUBLE * (CASE WHEN lang = 'en' THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN source IN ('src1', 'src2') THEN 0.2::DOUBLE ELSE 0 END), 4) AS score,
          round(least(0.15, 0.05 * {_CNT.format('text', '[0-9]{3,}')} / greatest(length(text) / 100.0, 1.0))::DOUBLE, 6) AS bonus FROM t)
        SELECT * FROM s WHERE score >= 0.15 ORDER BY score DESC, doc_id LIMIT 40""",
    "candidate_merge": """WITH a AS (SELECT doc_id, n_chars, 0 AS s FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 40), b AS (SELECT doc_id, n_chars, 1 AS s FROM documents WHERE contains(lower(text), 'license') ORDER BY doc_id LIMIT 40)
        SELECT doc_id, any_value(n_chars) AS n_chars, min(s) AS source_no FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""",
    "grounding_ratio": """WITH e AS (SELECT conv_id, coalesce(string_agg(CASE WHEN role = 'user' THEN text END, ' ' ORDER BY turn), '') AS ev FROM conversations GROUP BY 1),
        n AS (SELECT c.conv_id, c.turn, list_distinct(regexp_extract_all(replace(text, ',', ''), '[0-9]{3,}')) AS ns, replace(ev, ',', '') AS ev FROM conversations c JOIN e USING (conv_id) WHERE role = 'assistant')
        SELECT conv_id, turn, round(coalesce(len(list_filter(ns, lambda x: contains(ev, x)))::DOUBLE / nullif(len(ns), 0), 0.8), 6) AS ratio FROM n""",
    "judged_chunks": f"""WITH k AS (SELECT doc_id, n_chars % 500 AS score, row_number() OVER (PARTITION BY substr(lower({_SQZ.format('text')}), 1, 140) ORDER BY n_chars % 500 DESC, doc_id) AS n FROM documents
        WHERE length(text) >= 40 AND {_CNT.format('text', '[#$%&*]')} < 0.05 * length(text)) SELECT doc_id, score FROM k WHERE n = 1""",
    "benchmark_overlap": f"""WITH l AS (SELECT doc_id, list_distinct({_TOK.format('text')}) AS lt FROM documents), r AS (SELECT item_id, list_distinct({_TOK.format('text')}) AS rt FROM benchmark)
        SELECT doc_id, item_id, round(len(list_intersect(lt, rt))::DOUBLE / len(rt), 6) AS share FROM l, r WHERE len(rt) > 0 AND round(len(list_intersect(lt, rt))::DOUBLE / len(rt), 6) >= 0.8""",
    "html_titles": "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<p[ >]')) AS INTEGER) AS n_p, CAST(len(regexp_extract_all(html, '<li[ >]')) AS INTEGER) AS n_li FROM pages",
    "role_checks": """WITH b AS (SELECT conv_id, count(*) AS n, count(*) FILTER (WHERE role = 'user') AS nu, count(*) FILTER (WHERE trim(text) = '') AS ne, max_by(role, turn) AS lr FROM conversations GROUP BY 1)
        SELECT conv_id, n, array_to_string(list_filter([CASE WHEN nu = 0 THEN 'no_user' END, CASE WHEN ne > 0 THEN 'empty' END, CASE WHEN lr <> 'assistant' THEN 'open_end' END], lambda x: x IS NOT NULL), ',') AS issues FROM b""",
    "han_purge": r"SELECT regexp_matches(text, '\p{Han}') AS has_han, count(*) AS n FROM documents GROUP BY 1",
    "chunk_validation": f"""WITH {_PARA.format(src='text', size=600)}, k AS (SELECT chunk FROM c WHERE length(chunk) >= 20), i AS (SELECT 'short' AS rule FROM k WHERE length(chunk) < 60 UNION ALL SELECT 'numeric' FROM k WHERE {_CNT.format('chunk', '[0-9]')}::DOUBLE / length(chunk) > 0.3
        UNION ALL SELECT 'symbols' FROM k WHERE regexp_matches(chunk, '[#$%&*]{{3}}') UNION ALL SELECT 'no_stop' FROM k WHERE NOT regexp_matches(chunk, '[.!?]')) SELECT rule, count(*) AS failed FROM i GROUP BY rule""",
    "keep_first_of_chunks": f"""WITH {_PARA.format(src='text', size=600)} SELECT source, count(DISTINCT md5(substr(chunk, 1, 200))) AS n FROM c JOIN documents USING (doc_id) WHERE length(chunk) >= 20 GROUP BY source""",
}
