"""Queries of file names, labels, lookups, candidate merging and coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import labels as L
from ledgerloom.functions import text as T
from ledgerloom.functions import values as V
from ledgerloom.operators import matching
from ledgerloom.operators import records as ops
from ledgerloom.sources import archives
from ledgerloom.sources.tables import load

SLOTS = {"who": "loweich|idiot|user", "what": "license|token", "when": "20[0-9]{2}", "how": "version|password"}


def _names(spark, d):
    kind = F.element_at(F.array(*map(F.lit, (".zip", ".zip.pdf", ".PDF", ".html", ".xls", ".txt"))), (F.col("o_orderkey") % 6).cast("int") + 1)
    name = F.concat(F.lit("firm_"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 14, "2"), kind)
    return load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("plain"), kind)).otherwise(name).alias("name"))


def file_kinds(spark, d):
    return _names(spark, d).groupBy(archives.file_type(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))


def archive_choice(spark, d):
    parts = archives.name_parts(F.col("name"))
    files = _names(spark, d).select(F.col("name").alias("path"), archives.file_type(F.col("name")).alias("kind"), parts["receipt"].alias("receipt"), parts["company"].alias("company"), F.col("o_orderkey").alias("length"))
    files = ops.keep_first(files.filter(F.col("kind").isin("zip", "zip.pdf")), ["path"], [F.col("length")])
    return archives.one_per_receipt(files).select("receipt", "kind", "company", "path")


def receipt_numbers(spark, d):
    return _names(spark, d).select("o_orderkey", V.receipt_number(F.col("name")).alias("receipt"))


def status_filters(spark, d):
    return load(spark, d, "events").filter(F.col("event_type").isin("error", "signup") & (F.col("user_id") == 7)).select("event_id", "event_type")


def trivial_inputs(spark, d):
    msgs = load(spark, d, "conversations").select("conv_id", "turn", F.substr("text", F.lit(1), (F.col("turn") % 4).cast("int")).alias("m"))
    return msgs.select("conv_id", "turn", L.trivial(F.col("m")).alias("trivial"))


def documents_with_latest(spark, d):
    """Documents with their conversation's latest turn as analysis; none is doubled."""
    docs = load(spark, d, "documents").select("doc_id", "source")
    last = ops.latest(load(spark, d, "conversations"), "conv_id", "turn", ["role"])
    return docs.join(last, docs.doc_id == last.conv_id, "left").select("doc_id", "source", F.col("turn").alias("last_turn"), F.coalesce("role", F.lit("none")).alias("last_role"))


def alias_matches(spark, d):
    aliases = spark.createDataFrame([("lic", "license"), ("apache", "Apache"), ("tok", "token =")], "alias string, term string")
    keyed = aliases.select("alias", F.lower("term").alias("name"))
    docs = load(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    return matching.contained(docs, keyed, "t", "name").join(keyed, "name").select("doc_id", "alias")


def merged_candidates(spark, d):
    """Best score of each normalised name, longer names first among equals."""
    c = load(spark, d, "customer").select(T.company_key(F.col("c_mktsegment")).alias("k"), F.col("c_mktsegment").alias("name"), F.round(F.col("c_acctbal") / 10000, 6).alias("score"))
    best = c.groupBy("k").agg(F.max(F.struct("score", "name")).alias("m"))
    order = Window.orderBy(F.col("m.score").desc(), F.length("m.name").desc(), "k")
    return best.select("k", F.col("m.score").alias("score"), F.row_number().over(order).alias("place"))


def autocomplete(spark, d):
    return load(spark, d, "part").select("p_name").distinct().filter(F.contains("p_name", F.lit("ring"))).orderBy(F.length("p_name"), "p_name").limit(10)


def overfetched_search(spark, d):
    """First twelve documents of the newest 48 that have a line break early on."""
    docs = load(spark, d, "documents").filter("n_chars > 0").orderBy(F.col("doc_id").desc()).limit(48)
    return docs.filter(F.contains(F.substring("text", 1, 120), F.lit("\n"))).orderBy(F.col("doc_id").desc()).limit(12).select("doc_id")


def multi_query_merge(spark, d):
    docs, out = load(spark, d, "documents"), None
    for i, word in enumerate(("license", "token", "thation")):
        hits = docs.filter(F.contains(F.lower("text"), F.lit(word))).select("doc_id", F.lit(i).alias("q"), F.round(1.0 / (1 + F.instr(F.lower("text"), word)), 6).alias("score"))
        out = hits if out is None else out.unionByName(hits)
    first = ops.keep_first(out, ["doc_id"], [F.col("q")])
    return first.orderBy(F.col("score").desc(), "doc_id").limit(30)


def slot_coverage(spark, d):
    docs = load(spark, d, "documents").select("source", F.explode(L.slots(F.col("text"), SLOTS)).alias("slot"))
    by = docs.groupBy("source").agg(F.countDistinct("slot").alias("n_slots"), F.count("*").alias("n"))
    return by.select("source", "n_slots", "n", (F.col("n_slots") >= 3).alias("enough"))


def domain_labels(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", L.best_domain(F.col("text")).alias("domain"), L.domain_boost(F.col("text"), L.DOMAINS["law"]).alias("boost"))


def period_labels(spark, d):
    title = F.concat(F.element_at(F.array(*map(F.lit, ("Annual report", "Q3 figures", "Half-year report", "Material fact", "Notice"))), (F.col("o_orderkey") % 5).cast("int") + 1), F.lit(" "), F.year("o_orderdate").cast("string"))
    return load(spark, d, "orders").groupBy(L.period_type(title).alias("period")).agg(F.count("*").alias("n"))


def table_types(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("Total assets 5", "Revenue 3", "Cash flow 1", "Changes in equity", "Retained earnings", "Other"))), (F.col("p_partkey") % 6).cast("int") + 1)
    return load(spark, d, "part").groupBy(L.table_type(head).alias("type")).agg(F.count("*").alias("n"))


def company_name_issues(spark, d):
    c = load(spark, d, "customer")
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.lit("Good Name"))
    return c.select(F.explode(L.name_issues(name)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def metadata_scores(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.round(L.metadata_score(F.col("source"), "src1", F.col("lang"), "fr", F.col("doc_id") % 2 == 0), 4).alias("score"))


def duplicate_members(spark, d):
    docs = load(spark, d, "documents").select(F.md5(F.lower(F.trim("text")).cast("binary")).alias("k"), "doc_id")
    groups = docs.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")
    return docs.join(groups, "k").select("doc_id", "first_id", "n")


def modal_columns(spark, d):
    """Most common number of bar-separated cells in a document's lines; of equals the first seen."""
    lines = load(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).withColumn("cells", F.size(F.split("line", r" \| ")))
    return ops.most_frequent(lines, ["doc_id"], "cells", "place").select("doc_id", "cells")


def spaced_positions(spark, d):
    """Places of a word at least 600 characters apart, at most 12: a fold over the sorted places."""
    before = F.slice(F.split(F.lower("text"), "the"), 1, F.size(F.split(F.lower("text"), "the")) - 1)
    start = F.struct(F.lit(0).alias("at"), F.lit(-600).alias("last"), F.lit(0).alias("n"))

    def step(s, w):
        place = s["at"] + F.length(w)
        taken = (place - s["last"] >= 600) & (s["n"] < 12)
        return F.struct((place + 3).alias("at"), F.when(taken, place).otherwise(s["last"]).alias("last"), (s["n"] + taken.cast("int")).alias("n"))

    return load(spark, d, "documents").select("doc_id", F.aggregate(before, start, step, lambda s: s["n"]).alias("n"))


def similarity_sanity(spark, d):
    """Mean similarity between vectors of different labels, by label, over the sums of the unit vectors: no pairs are made."""
    v = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    per = v.groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    total = v.groupBy("i").agg(F.sum(F.col("x").cast("double")).alias("t"))
    n = load(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    every = load(spark, d, "embeddings").count()
    dots = per.join(total, "i").groupBy("label").agg(F.sum(F.col("s") * (F.col("t") - F.col("s"))).alias("dot"))
    return dots.join(n, "label").select("label", F.round(F.col("dot") / (F.col("n") * (F.lit(every) - F.col("n"))), 4).alias("mean_similarity"))


def index_statistics(spark, d):
    v = load(spark, d, "embeddings")
    return v.agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("most_dim"))


def year_filters(spark, d):
    """Years a text asks for: the span of "last N years" before 2024, else years named."""
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("last "), (F.col("turn") + 1).cast("string"), F.lit(" years of 2019")).alias("q"))
    n = F.least(F.regexp_extract("q", "last ([0-9]+) years", 1).cast("int"), F.lit(5))
    return turns.select("conv_id", "turn", F.array_join(F.transform(F.sequence(2024 - n + 1, F.lit(2024)), lambda y: y.cast("string")), ",").alias("years"))


def ordered_distinct_terms(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.array_join(F.slice(T.ordered_distinct(F.split("text", r"[.,\n]")), 1, 3), "|").alias("firsts"))


QUERIES = {
    f.__name__: f
    for f in (
        file_kinds, archive_choice, receipt_numbers, status_filters, trivial_inputs, documents_with_latest, alias_matches, merged_candidates,
        autocomplete, overfetched_search, multi_query_merge, slot_coverage, domain_labels, period_labels, table_types, company_name_issues,
        metadata_scores, duplicate_members, modal_columns, spaced_positions, similarity_sanity, index_statistics, year_filters,
        ordered_distinct_terms,
    )
}

_N = """names AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'plain' ELSE 'firm_' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 14, '2') END || (['.zip', '.zip.pdf', '.PDF', '.html', '.xls', '.txt'])[(o_orderkey % 6) + 1] AS name FROM orders)"""
_KIND = "CASE WHEN lower(name) LIKE '%.zip.pdf' THEN 'zip.pdf' WHEN lower(name) LIKE '%.zip' THEN 'zip' WHEN lower(name) LIKE '%.pdf' THEN 'pdf' WHEN lower(name) LIKE '%.html' THEN 'html' WHEN lower(name) LIKE '%.xls' THEN 'sheet' END"
_HITS = lambda words: " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in words)

ORACLES = {
    "ordered_distinct_terms": r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.,\n]'), lambda x: trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')), lambda x: x <> '') AS t FROM documents)
        SELECT doc_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:3], '|') AS firsts FROM t""",
    "file_kinds": f"WITH {_N} SELECT {_KIND} AS kind, count(*) AS n FROM names GROUP BY 1",
    "archive_choice": f"""WITH {_N}, f AS (SELECT DISTINCT name AS path, {_KIND} AS kind, regexp_extract(name, '([0-9]{{14}})', 1) AS receipt FROM names), r AS (SELECT *, row_number() OVER (PARTITION BY receipt ORDER BY CASE kind WHEN 'zip' THEN 0 ELSE 1 END, path) AS k
        FROM f WHERE kind IN ('zip', 'zip.pdf') AND receipt <> '') SELECT receipt, kind, 'firm' AS company, path FROM r WHERE k = 1""",
    "receipt_numbers": f"WITH {_N} SELECT o_orderkey, CASE WHEN regexp_extract(name, '([0-9]{{14}})', 1) <> '' THEN regexp_extract(name, '([0-9]{{14}})', 1) ELSE substr(md5(name), 1, 14) END AS receipt FROM names",
    "status_filters": "SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'signup') AND user_id = 7",
    "trivial_inputs": r"SELECT conv_id, turn, length(regexp_replace(substr(text, 1, turn % 4), '[^\p{L}\p{N}]', '', 'g')) < 2 AS trivial FROM conversations",
    "documents_with_latest": """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1)
        SELECT doc_id, source, turn AS last_turn, coalesce(role, 'none') AS last_role FROM documents LEFT JOIN l ON doc_id = conv_id""",
    "alias_matches": "WITH a(alias, term) AS (VALUES ('lic', 'license'), ('apache', 'Apache'), ('tok', 'token =')) SELECT doc_id, alias FROM documents JOIN a ON contains(lower(text), lower(term))",
    "merged_candidates": """WITH c AS (SELECT lower(c_mktsegment) AS k, c_mktsegment AS name, round(c_acctbal / 10000, 6) AS score FROM customer), b AS (SELECT k, max(score) AS score, any_value(name) AS name FROM c GROUP BY k)
        SELECT k, score, CAST(row_number() OVER (ORDER BY score DESC, length(name) DESC, k) AS INTEGER) AS place FROM b""",
    "autocomplete": "SELECT p_name FROM (SELECT DISTINCT p_name FROM part) WHERE contains(p_name, 'ring') ORDER BY length(p_name), p_name LIMIT 10",
    "overfetched_search": "WITH n AS (SELECT * FROM documents WHERE n_chars > 0 ORDER BY doc_id DESC LIMIT 48) SELECT doc_id FROM n WHERE contains(substr(text, 1, 120), chr(10)) ORDER BY doc_id DESC LIMIT 12",
    "multi_query_merge": """WITH h AS (SELECT doc_id, q, round(1.0::DOUBLE / (1 + strpos(lower(text), w)), 6) AS score FROM documents, (VALUES (0, 'license'), (1, 'token'), (2, 'thation')) t(q, w) WHERE contains(lower(text), w)),
        f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY q) AS k FROM h) SELECT doc_id, q, score FROM f WHERE k = 1 ORDER BY score DESC, doc_id LIMIT 30""",
    "slot_coverage": f"""WITH s AS ({" UNION ALL ".join(f"SELECT source, '{s}' AS slot FROM documents WHERE regexp_matches(lower(text), '{p}')" for s, p in SLOTS.items())})
        SELECT source, count(DISTINCT slot) AS n_slots, count(*) AS n, count(DISTINCT slot) >= 3 AS enough FROM s GROUP BY source""",
    "domain_labels": f"""WITH h AS (SELECT doc_id, {", ".join(f"{_HITS(w)} AS d{i}" for i, w in enumerate(L.DOMAINS.values()))} FROM documents)
        SELECT doc_id, CASE WHEN greatest(d0, d1, d2) = 0 THEN NULL {" ".join(f"WHEN d{i} = greatest(d0, d1, d2) THEN '{n}'" for i, n in enumerate(L.DOMAINS))} END AS domain, CASE WHEN d0 >= 3 THEN 1.20 WHEN d0 >= 1 THEN 1.12 ELSE 1.0 END::DOUBLE AS boost FROM h""",
    "period_labels": "SELECT (['annual', 'quarterly', 'semiannual', 'event', 'unknown'])[(o_orderkey % 5) + 1] AS period, count(*) AS n FROM orders GROUP BY 1",
    "table_types": "SELECT (['balance', 'income', 'cash', 'equity', 'retained', 'normal'])[(p_partkey % 6) + 1] AS type, count(*) AS n FROM part GROUP BY 1",
    "company_name_issues": "SELECT CASE c_custkey % 3 WHEN 0 THEN 'shouting' ELSE 'digits' END AS issue, count(*) AS n FROM customer WHERE c_custkey % 3 < 2 GROUP BY 1 UNION ALL SELECT 'symbols', count(*) FROM customer WHERE c_custkey % 3 = 1",
    "metadata_scores": "SELECT doc_id, round(least(1.0, CASE WHEN source = 'src1' THEN 0.6 WHEN contains(source, 'src1') THEN 0.4 ELSE 0.0 END + CASE WHEN lang = 'fr' THEN 0.3 ELSE 0.0 END + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0.0 END)::DOUBLE, 4) AS score FROM documents",
    "duplicate_members": "WITH k AS (SELECT doc_id, md5(lower(trim(text))) AS k FROM documents), g AS (SELECT k, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY k HAVING count(*) > 1) SELECT doc_id, first_id, n FROM k JOIN g USING (k)",
    "modal_columns": """WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)), c AS (SELECT doc_id, CAST(len(string_split(line, ' | ')) AS INTEGER) AS cells, count(*) AS n, min(place) AS f FROM l GROUP BY 1, 2),
        b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f, cells) AS k FROM c) SELECT doc_id, cells FROM b WHERE k = 1""",
    "index_statistics": "SELECT count(*) AS n, count(DISTINCT label) AS labels, CAST(min(len(embedding)) AS INTEGER) AS least_dim, CAST(max(len(embedding)) AS INTEGER) AS most_dim FROM embeddings",
    "similarity_sanity": """SELECT a.label, round(avg(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 4) AS mean_similarity FROM embeddings a JOIN embeddings b ON a.label <> b.label GROUP BY 1""",
    "year_filters": "SELECT conv_id, turn, array_to_string(range(2024 - least(turn + 1, 5) + 1, 2025), ',') AS years FROM conversations",
}
