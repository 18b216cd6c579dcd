"""Queries over documents, events, conversations, orders: counts, windows, integrity, histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import records as ops
from ledgerloom.sources.tables import load


def status_dashboard(spark, d):
    return ops.status_counts(load(spark, d, "events"), F.col("event_type"), "purchase", "error")


def category_distribution(spark, d):
    docs = load(spark, d, "documents").withColumn("lang", F.when(F.col("lang") != "es", F.col("lang")))
    return docs.groupBy(F.coalesce("lang", F.lit("unclassified")).alias("category")).agg(F.count("*").alias("n"))


def top3_categories(spark, d):
    return ops.top_groups(load(spark, d, "events"), "event_type", 3)


def failure_level(spark, d):
    out = ops.failure_level(load(spark, d, "events"), ["user_id"], F.col("event_type") == "error")
    return out.withColumn("ratio", F.round("ratio", 6))


def owner_statistics(spark, d):
    docs = load(spark, d, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("lang").alias("display"), F.sum("n_chars").alias("chars"))


def duplicate_groups(spark, d):
    return ops.duplicate_groups(load(spark, d, "documents"), F.md5(F.lower(F.trim("text")).cast("binary")), "doc_id")


def having_duplicates(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


def distinct_counts(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.to_date("o_orderdate")).alias("days"))


def latest_turn(spark, d):
    return ops.latest(load(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])


def last_user_message(spark, d):
    return ops.latest(load(spark, d, "conversations").filter("role = 'user'"), "conv_id", "turn", ["text"])


def batch_status(spark, d):
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels")
    return ops.batch_status(docs.select("doc_id"), labels, "doc_id", F.col("quality") == 1)


def length_buckets(spark, d):
    docs = load(spark, d, "documents")
    return docs.groupBy((F.floor(F.col("doc_id") / 200) * 200).alias("from_id")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


def length_histogram(spark, d):
    n = F.col("n_chars")
    bucket = F.when(n == 0, "0").when(n < 200, "<200").when(n < 500, "<500").when(n < 1000, "<1000").otherwise(">=1000")
    return load(spark, d, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def integrity_rollup(spark, d):
    """Flags by file with a grand total, and duplicates as total less distinct hashes."""
    rows = load(spark, d, "documents").select("source", F.md5(F.col("text").cast("binary")).alias("h"), (F.length("text") < 200).alias("short"))
    return rows.rollup("source").agg(F.count("*").alias("n"), F.count_if("short").alias("n_short"), F.countDistinct("h").alias("n_distinct"), (F.count("*") - F.countDistinct("h")).alias("n_duplicate"))


def evaluation_averages(spark, d):
    rows = load(spark, d, "labels").join(load(spark, d, "documents"), "doc_id")
    return rows.cube("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))


def anti_join_integrity(spark, d):
    docs = load(spark, d, "documents")
    checks = [("labels", "doc_id"), ("embeddings", "vec_id")]
    parts = [ops.missing(docs, load(spark, d, t), "doc_id", k).agg(F.count("*").alias("n")).select(F.lit(f"without_{t}").alias("check_name"), "n") for t, k in checks]
    out = parts[0].unionByName(parts[1])
    return out.withColumn("status", F.when(F.col("n") == 0, "ok").otherwise("missing"))


def semi_join_ids(spark, d):
    docs = load(spark, d, "documents")
    return docs.join(load(spark, d, "labels").filter("toxic = 1"), "doc_id", "left_semi").select("doc_id", "lang", "n_chars")


def insight_flag(spark, d):
    return ops.flagged(load(spark, d, "documents").select("doc_id", "source"), load(spark, d, "labels").filter("quality = 1"), "doc_id", "doc_id", "has_insight")


def pending_work(spark, d):
    docs = load(spark, d, "documents").filter("lang in ('en', 'fr') and doc_id >= 10")
    return ops.missing(docs, load(spark, d, "labels"), "doc_id", "doc_id").orderBy("doc_id").limit(25).select("doc_id", "lang")


def pagination(spark, d):
    return ops.page(load(spark, d, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 3, 20).select("o_orderkey", "o_totalprice")


def newest_first(spark, d):
    return load(spark, d, "events").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(15).select("event_id", "event_type", F.when(F.col("event_type") == "error", "failed").otherwise("done").alias("label"))


def set_difference(spark, d):
    return load(spark, d, "documents").select(F.col("doc_id").alias("id")).exceptAll(load(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


def scalar_subquery_largest(spark, d):
    """The customer of largest total, nulls last."""
    totals = load(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    joined = load(spark, d, "customer").join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.orderBy(F.col("total").desc_nulls_last(), "c_custkey").limit(1).select("c_custkey", "c_name", "total")


def keyword_and_or(spark, d):
    """Documents that have every keyword; if none has, those with any, most keywords first."""
    words = ["license", "ation", "the"]
    docs = load(spark, d, "documents")
    n = sum(F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words)
    scored = docs.select("doc_id", n.alias("n_hit")).filter("n_hit > 0")
    best = scored.agg(F.max("n_hit").alias("best"))
    return scored.crossJoin(best).filter(f"best < {len(words)} or n_hit = {len(words)}").select("doc_id", "n_hit")


def contains_any(spark, d):
    docs = load(spark, d, "documents")
    return docs.filter(F.col("text").ilike("%license%") | F.col("source").ilike("%src1%")).select("doc_id", "source")


def event_islands(spark, d):
    return ops.islands(load(spark, d, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "error", "bad").otherwise("good"))


def section_forward_fill(spark, d):
    rows = ops.carried_forward(load(spark, d, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "since")
    return rows.select("event_id", "user_id", "since")


def nearest_unit_before(spark, d):
    rows = ops.carried_forward(load(spark, d, "events"), ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", F.col("value")), "unit", within=20)
    return rows.select("event_id", "unit")


def diversity_penalty(spark, d):
    docs = load(spark, d, "documents").withColumn("score", F.round(1000.0 / (F.col("n_chars") + 1000), 6))
    out = ops.running_penalty(docs, "source", [F.col("score").desc(), F.col("doc_id")], "score")
    return out.select("doc_id", "seen", F.round("adjusted", 6).alias("adjusted"))


def history_trim(spark, d):
    turns = load(spark, d, "conversations")
    tokens = F.greatest(F.floor(F.length("text") / 3), F.lit(1))
    return ops.trimmed_history(turns, "conv_id", "turn", tokens, 600, 3).select("conv_id", "turn", "role")


def most_frequent_type(spark, d):
    return ops.most_frequent(load(spark, d, "events"), ["user_id"], "event_type", "event_id")


def gradient_cutoff(spark, d):
    events = load(spark, d, "events").withColumn("score", F.round(F.col("value") / 100, 4))
    return ops.gradient_cutoff(events, ["user_id"], "score", "event_id").select("user_id", "event_id", "score", "place")


def keep_first_by_prefix(spark, d):
    rows = load(spark, d, "documents").withColumn("k", F.md5(F.substring("text", 1, 200).cast("binary")))
    return ops.keep_first(rows, ["source", "k"], [F.col("doc_id")]).select("doc_id", "source")


def registry_match(spark, d):
    queries = spark.createDataFrame([("orders of nation_1 last year",), ("region_2",), ("ion_17",), ("NATION_3",)], "query string")
    names = load(spark, d, "nation").select(F.col("n_name").alias("name"))
    return ops.name_matches(queries, names).select("query", "name", F.round("score", 4).alias("score"))


def contamination_rate(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.stack(F.lit(2), F.lit("text"), F.col("text"), F.lit("source"), F.col("source")).alias("field", "content"))
    bad = F.col("content").rlike("[#$%&*]{3}")
    return docs.groupBy("field").agg(F.count("*").alias("n"), F.count_if(bad).alias("n_bad"), F.round(F.count_if(bad) / F.count("*"), 6).alias("rate"))


def field_issue_crosstab(spark, d):
    docs = load(spark, d, "documents")
    issues = F.array_compact(F.array(F.when(F.length("text") < 200, "short"), F.when(F.col("text").rlike("[#$%&*]{3}"), "symbols"), F.when(F.col("text") == F.upper("text"), "shouting")))
    return docs.select("lang", F.explode(issues).alias("issue")).groupBy("lang").pivot("issue", ["short", "symbols", "shouting"]).count().na.fill(0)


def violation_counts(spark, d):
    docs = load(spark, d, "documents")
    issues = F.array_compact(F.array(F.when(F.length("text") < 200, "FR-02"), F.when(F.col("text").rlike("[0-9]{6}"), "FR-01"), F.when(~F.col("text").contains("\n"), "FR-07")))
    return docs.select(F.explode(issues).alias("rule")).groupBy("rule").agg(F.count("*").alias("failed"))


def event_window_counts(spark, d):
    w = F.window("ts", "1 hour")
    return load(spark, d, "events").groupBy(w).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


def rate_windows(spark, d):
    """Requests of a key a minute over its capacity."""
    w = F.window("ts", "60 seconds")
    return load(spark, d, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).filter("n > 1").select("user_id", F.col("window.start").alias("start"), "n")


def user_sessions(spark, d):
    w = F.session_window("ts", "30 minutes")
    return load(spark, d, "events").groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def json_props(spark, d):
    doc = F.try_parse_json("props")
    k = F.try_variant_get(doc, "$.k", "long")
    return load(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count_if(k.isNull()).alias("n_null"))


def go_no_go(spark, d):
    docs = load(spark, d, "documents")
    rates = docs.agg(F.round(F.count_if(F.length("text") < 200) / F.count("*"), 6).alias("short_rate"), F.round(F.count_if(F.col("text").rlike("[#$%&*]{3}")) / F.count("*"), 6).alias("symbol_rate"))
    gate = lambda c, warn, stop: F.when(F.col(c) > stop, "STOP").when(F.col(c) > warn, "WARN").otherwise("GO")
    return rates.select("short_rate", gate("short_rate", 0.05, 0.2).alias("short_gate"), "symbol_rate", gate("symbol_rate", 0.05, 0.2).alias("symbol_gate"))


QUERIES = {
    f.__name__: f
    for f in (
        status_dashboard, category_distribution, top3_categories, failure_level, owner_statistics, duplicate_groups, having_duplicates,
        distinct_counts, latest_turn, last_user_message, batch_status, length_buckets, length_histogram, integrity_rollup, evaluation_averages,
        anti_join_integrity, semi_join_ids, insight_flag, pending_work, pagination, newest_first, set_difference, scalar_subquery_largest,
        keyword_and_or, contains_any, event_islands, section_forward_fill, nearest_unit_before, diversity_penalty, history_trim,
        most_frequent_type, gradient_cutoff, keep_first_by_prefix, registry_match, contamination_rate, field_issue_crosstab, violation_counts,
        event_window_counts, rate_windows, user_sessions, json_props, go_no_go,
    )
}

_SYM = r"regexp_matches({0}, '[#$%&*]{{3}}')"
ORACLES = {
    "status_dashboard": "SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE coalesce(event_type, '') NOT IN ('purchase', 'error')) AS pending FROM events",
    "category_distribution": "SELECT CASE WHEN lang <> 'es' THEN lang ELSE 'unclassified' END AS category, count(*) AS n FROM documents GROUP BY 1",
    "top3_categories": "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3",
    "failure_level": """WITH g AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM events GROUP BY 1)
        SELECT user_id, total, n_failed, round(n_failed / total, 6) AS ratio, CASE WHEN n_failed / total > 0.3 THEN 'critical' WHEN n_failed / total > 0.1 THEN 'warning' ELSE 'ok' END AS level FROM g""",
    "owner_statistics": "SELECT source, count(*) AS n_docs, max(lang) AS display, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1",
    "duplicate_groups": "SELECT md5(lower(trim(text, ' '))) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "having_duplicates": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15",
    "distinct_counts": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1",
    "latest_turn": "SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n = 1",
    "last_user_message": "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user') WHERE n = 1",
    "batch_status": """WITH f AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS done FROM labels GROUP BY 1)
        SELECT count(*) AS total, count(*) FILTER (WHERE done = 1) AS completed, bool_and(coalesce(done = 1, false)) AS all_done FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
    "length_buckets": "SELECT CAST(floor(doc_id / 200) * 200 AS BIGINT) AS from_id, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY 1",
    "length_histogram": "SELECT CASE WHEN n_chars = 0 THEN '0' WHEN n_chars < 200 THEN '<200' WHEN n_chars < 500 THEN '<500' WHEN n_chars < 1000 THEN '<1000' ELSE '>=1000' END AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "integrity_rollup": "SELECT source, count(*) AS n, count(*) FILTER (WHERE length(text) < 200) AS n_short, count(DISTINCT md5(text)) AS n_distinct, count(*) - count(DISTINCT md5(text)) AS n_duplicate FROM documents GROUP BY ROLLUP (source)",
    "evaluation_averages": "SELECT lang, source, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM labels JOIN documents USING (doc_id) GROUP BY CUBE (lang, source)",
    "anti_join_integrity": """WITH c AS (SELECT 'without_labels' AS check_name, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
        UNION ALL SELECT 'without_embeddings', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id))
        SELECT check_name, n, CASE WHEN n = 0 THEN 'ok' ELSE 'missing' END AS status FROM c""",
    "semi_join_ids": "SELECT doc_id, lang, n_chars FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)",
    "insight_flag": "SELECT doc_id, source, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS has_insight FROM documents d",
    "pending_work": "SELECT doc_id, lang FROM documents d WHERE lang IN ('en', 'fr') AND doc_id >= 10 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) ORDER BY doc_id LIMIT 25",
    "pagination": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "newest_first": "SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS label FROM events ORDER BY ts DESC, event_id DESC LIMIT 15",
    "set_difference": "SELECT doc_id AS id FROM documents EXCEPT ALL SELECT vec_id FROM embeddings",
    "scalar_subquery_largest": "SELECT c_custkey, c_name, (SELECT round(sum(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS total FROM customer ORDER BY total DESC NULLS LAST, c_custkey LIMIT 1",
    "keyword_and_or": """WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'ation') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER) AS n_hit FROM documents)
        SELECT doc_id, n_hit FROM s WHERE n_hit > 0 AND ((SELECT max(n_hit) FROM s) < 3 OR n_hit = 3)""",
    "contains_any": "SELECT doc_id, source FROM documents WHERE text ILIKE '%license%' OR source ILIKE '%src1%'",
    "event_islands": """WITH k AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS kind FROM events),
        m AS (SELECT *, CAST(coalesce(lag(kind) OVER (PARTITION BY user_id ORDER BY event_id) <> kind, true) AS INTEGER) AS fresh FROM k),
        i AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS island FROM m)
        SELECT user_id, island, any_value(kind) AS kind, count(*) AS n, min(event_id) AS first_at, max(event_id) AS last_at FROM i GROUP BY user_id, island""",
    "section_forward_fill": "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS since FROM events",
    "nearest_unit_before": "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS unit FROM events",
    "diversity_penalty": """WITH s AS (SELECT doc_id, source, round(1000.0::DOUBLE / (n_chars + 1000), 6) AS score FROM documents), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS INTEGER) AS seen FROM s)
        SELECT doc_id, seen, round(CASE WHEN seen > 2 THEN score - 0.15::DOUBLE ELSE score END, 6) AS adjusted FROM r""",
    "history_trim": """WITH t AS (SELECT conv_id, turn, role, sum(greatest(length(text) // 3, 1)) OVER (PARTITION BY conv_id) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM conversations)
        SELECT conv_id, turn, role FROM t WHERE s <= 600 OR b <= 3""",
    "most_frequent_type": """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS k FROM c)
        SELECT user_id, event_type, n FROM r WHERE k = 1""",
    "gradient_cutoff": """WITH s AS (SELECT user_id, event_id, round(value / 100, 4) AS score FROM events),
        p AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS place, lag(score) OVER w - score AS fall FROM s WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, event_id)),
        m AS (SELECT *, avg(fall) OVER (PARTITION BY user_id) AS mean_fall FROM p),
        c AS (SELECT *, min(CASE WHEN place > 1 AND fall > greatest(mean_fall * 2, 0.05) THEN place END) OVER (PARTITION BY user_id) AS cut FROM m)
        SELECT user_id, event_id, score, place FROM c WHERE cut IS NULL OR place < cut""",
    "keep_first_by_prefix": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, md5(substr(text, 1, 200)) ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "registry_match": """WITH q(query) AS (VALUES ('orders of nation_1 last year'), ('region_2'), ('ion_17'), ('NATION_3')),
        m AS (SELECT query, n_name AS name, CASE WHEN lower(query) = lower(n_name) THEN 100.0 WHEN contains(lower(query), lower(n_name)) THEN 90.0 ELSE 80.0 + 10.0 * length(query) / length(n_name) END AS score
              FROM q JOIN nation ON contains(lower(query), lower(n_name)) OR contains(lower(n_name), lower(query)))
        SELECT query, name, round(CAST(score AS DOUBLE), 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, length(name), name) AS k FROM m) WHERE k = 1""",
    "contamination_rate": f"""WITH f AS (SELECT 'text' AS field, text AS content FROM documents UNION ALL SELECT 'source', source FROM documents)
        SELECT field, count(*) AS n, count(*) FILTER (WHERE {_SYM.format('content')}) AS n_bad, round(count(*) FILTER (WHERE {_SYM.format('content')}) / count(*), 6) AS rate FROM f GROUP BY field""",
    "field_issue_crosstab": f"""WITH i AS (SELECT lang, length(text) < 200 AS a, {_SYM.format('text')} AS b, text = upper(text) AS c FROM documents)
        SELECT lang, count(*) FILTER (WHERE a) AS short, count(*) FILTER (WHERE b) AS symbols, count(*) FILTER (WHERE c) AS shouting FROM i WHERE a OR b OR c GROUP BY lang""",
    "violation_counts": r"""WITH i AS (SELECT 'FR-02' AS rule FROM documents WHERE length(text) < 200 UNION ALL SELECT 'FR-01' FROM documents WHERE regexp_matches(text, '[0-9]{6}') UNION ALL SELECT 'FR-07' FROM documents WHERE NOT contains(text, chr(10)))
        SELECT rule, count(*) AS failed FROM i GROUP BY rule""",
    "event_window_counts": "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
    "rate_windows": "SELECT user_id, date_trunc('minute', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CAST(coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS INTEGER) AS fresh, event_id FROM events),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS n_null FROM events GROUP BY 1",
    "go_no_go": f"""WITH r AS (SELECT round(count(*) FILTER (WHERE length(text) < 200) / count(*), 6) AS short_rate, round(count(*) FILTER (WHERE {_SYM.format('text')}) / count(*), 6) AS symbol_rate FROM documents)
        SELECT short_rate, CASE WHEN short_rate > 0.2 THEN 'STOP' WHEN short_rate > 0.05 THEN 'WARN' ELSE 'GO' END AS short_gate, symbol_rate, CASE WHEN symbol_rate > 0.2 THEN 'STOP' WHEN symbol_rate > 0.05 THEN 'WARN' ELSE 'GO' END AS symbol_gate FROM r""",
}
