"""Queries of evaluation scores and validation reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import quality as Q
from ledgerloom.operators import retrieval as R
from ledgerloom.sources.tables import load


def _pairs(spark, d):
    """Assistant turns with the user turn before them."""
    turns = load(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("question", F.lag("text").over(w)).withColumn("asker", F.lag("role").over(w)).filter("role = 'assistant' and asker = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def answer_relevancy(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(Q.relevancy(F.col("question"), F.col("answer")), 6).alias("relevancy"))


def language_quality(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(Q.language_quality(F.col("answer")), 4).alias("quality"))


def answer_correctness(spark, d):
    keys = F.slice(F.array_distinct(T.tokens(F.col("question"))), 1, 5)
    return _pairs(spark, d).select("conv_id", "turn", F.round(Q.correctness(keys, F.col("answer"), F.col("conv_id") % 10 == 0), 6).alias("score"))


def evaluation_overall(spark, d):
    parts = {"relevancy": Q.relevancy(F.col("question"), F.col("answer")), "grounding": R.grounding(F.col("answer"), F.col("question")), "language": Q.language_quality(F.col("answer"))}
    scored = _pairs(spark, d).withColumn("score", Q.overall(parts))
    return scored.groupBy((F.col("turn") % 4).alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"))


def validation_report(spark, d):
    return Q.rule_report(load(spark, d, "documents"), "text")


def validated_chunks(spark, d):
    out = Q.validated(load(spark, d, "documents"), "text")
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.size("violations")).alias("soft"))


def summary_duplicates(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", Q.same_as_evidence(F.substring("text", 1, 150), F.col("text")).alias("same"))


def training_record_flags(spark, d):
    turns = load(spark, d, "conversations")
    rec = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content"))).alias("messages"))
    return rec.select("conv_id", F.size("messages").alias("n"), F.array_join(Q.record_flags(F.col("messages")), ",").alias("flags"))


QUERIES = {f.__name__: f for f in (answer_relevancy, language_quality, answer_correctness, evaluation_overall, validation_report, validated_chunks, summary_duplicates, training_record_flags)}

_TOK = r"list_filter(regexp_extract_all(lower({0}), '[A-Za-zÀ-ɏ]{{2,}}'), lambda t: t NOT IN ('the','and','of','is','to','in','it','die','der','und','de','la','que','los') AND length(t) > 1)"
_P = """p AS (SELECT * FROM (SELECT conv_id, turn, role, text AS answer, lag(text) OVER w AS question, lag(role) OVER w AS asker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND asker = 'user')"""
_REL = f"coalesce(len(list_intersect(list_distinct({_TOK.format('question')}), list_distinct({_TOK.format('answer')})))::DOUBLE / nullif(len(list_distinct({_TOK.format('question')})), 0), 0.0)"
_NOSP = r"length(regexp_replace(answer, '[ \t\n\r\f\v]+', '', 'g'))"
_LQ = rf"greatest(0.0, 1.0 - (CASE WHEN coalesce(len(regexp_extract_all(answer, '\p{{Han}}'))::DOUBLE / nullif({_NOSP}, 0), 0) > 0.02 THEN 0.4 ELSE 0.0 END + CASE WHEN regexp_matches(answer, '[#$%&*]{{3}}') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches(answer, '[{{}}]') THEN 0.2 ELSE 0.0 END + CASE WHEN length(answer) < 20 THEN 0.3 ELSE 0.0 END))::DOUBLE"
_GR = "coalesce(len(list_filter(list_distinct(regexp_extract_all(replace(answer, ',', ''), '[0-9]{3,}')), lambda x: contains(replace(question, ',', ''), x)))::DOUBLE / nullif(len(list_distinct(regexp_extract_all(replace(answer, ',', ''), '[0-9]{3,}'))), 0), 0.8)"
_RULES = """v AS (SELECT lang, list_filter([CASE WHEN coalesce(len(regexp_extract_all(text, '[0-9]'))::DOUBLE / nullif(length(text), 0), 0) > 0.8 THEN 'FR-01' END,
  CASE WHEN contains(lower(substr(text, 1, 300)), 'consolidated') AND contains(lower(substr(text, 1, 300)), 'separate') THEN 'FR-03' END, CASE WHEN NOT contains(substr(text, 1, 60), ' ') THEN 'FR-07' END,
  CASE WHEN regexp_matches(text, '(?i)^[ \t\n\r\f\v]*total[ \t\n\r\f\v]+[0-9,.]+[ \t\n\r\f\v]*$') THEN 'FR-12' END, CASE WHEN coalesce(trim(text), '') = '' THEN 'FR-08' END, CASE WHEN length(text) / 4 > 6000 THEN 'FR-11' END], lambda x: x IS NOT NULL) AS v FROM documents)"""

ORACLES = {
    "answer_relevancy": f"WITH {_P} SELECT conv_id, turn, round({_REL}, 6) AS relevancy FROM p",
    "language_quality": f"WITH {_P} SELECT conv_id, turn, round({_LQ}, 4) AS quality FROM p",
    "answer_correctness": f"""WITH {_P}, k AS (SELECT conv_id, turn, question, lower(answer) AS a, answer FROM p), t AS (SELECT conv_id, turn, a, answer, {_TOK.format('question')} AS tk FROM k),
        o AS (SELECT conv_id, turn, a, answer, list_filter(tk, lambda x, i: list_position(tk, x) = i)[1:5] AS ks FROM t)
        SELECT conv_id, turn, round(CASE WHEN conv_id % 10 = 0 THEN CASE WHEN regexp_matches(answer, '(?i)not (?:available|disclosed|found)|no data|unclear|cannot') THEN 1.0 ELSE 0.2 END
          ELSE coalesce(list_sum(list_transform(ks, lambda x: CASE WHEN contains(a, x) THEN 1.0::DOUBLE WHEN length(x) > 3 AND contains(a, substr(x, 1, 3)) THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END)) / nullif(len(ks), 0), 0.0) END, 6) AS score FROM o""",
    "evaluation_overall": f"WITH {_P}, s AS (SELECT turn % 4 AS category, 0.4::DOUBLE * {_REL} + 0.35::DOUBLE * {_GR} + 0.25::DOUBLE * {_LQ} AS score FROM p) SELECT category, count(*) AS n, round(avg(score), 4) AS mean_score FROM s GROUP BY 1",
    "validation_report": f"WITH {_RULES} SELECT rule, count(*) AS failed, round(count(*) / (SELECT count(*) FROM documents), 6) AS rate FROM (SELECT unnest(v) AS rule FROM v) GROUP BY rule",
    "validated_chunks": f"WITH {_RULES} SELECT lang, count(*) AS n, CAST(sum(len(v)) AS BIGINT) AS soft FROM v WHERE NOT list_has_any(v, ['FR-08', 'FR-11']) GROUP BY lang",
    "training_record_flags": """WITH b AS (SELECT conv_id, count(*) AS n, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a, bool_or(trim(text) = '') AS e FROM conversations GROUP BY 1)
        SELECT conv_id, CAST(n AS INTEGER) AS n, array_to_string(list_filter([CASE WHEN NOT u THEN 'no_user' END, CASE WHEN NOT a THEN 'no_assistant' END, CASE WHEN e THEN 'blank_content' END], lambda x: x IS NOT NULL), ',') AS flags FROM b""",
}
