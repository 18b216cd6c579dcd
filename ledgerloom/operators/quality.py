"""Scoring of answers, checks of chunks and records, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import values as V

HEDGES = r"(?i)not (?:available|disclosed|found)|no data|unclear|cannot"


def keyword_score(keyword: Column, answer: Column) -> Column:
    """1 when the answer holds the keyword, 0.8 when it holds its first three characters, else 0."""
    k, a = F.lower(keyword), F.lower(answer)
    return F.when(F.contains(a, k), 1.0).when((F.length(k) > 3) & F.contains(a, F.substring(k, 1, 3)), 0.8).otherwise(0.0)


def correctness(keywords: Column, answer: Column, expects_none: Column) -> Column:
    """Mean keyword score; for questions that have no answer, 1 for a hedged reply and 0.2 for any other."""
    total = F.aggregate(F.transform(keywords, lambda k: keyword_score(k, answer)), F.lit(0.0), lambda s, x: s + x)
    mean = F.coalesce(F.try_divide(total, F.size(keywords)), F.lit(0.0))
    return F.when(expects_none, F.when(answer.rlike(HEDGES), 1.0).otherwise(0.2)).otherwise(mean)


def language_quality(answer: Column, profile: T.LanguageProfile = T.LATIN) -> Column:
    """1 less penalties: foreign script 0.4, symbol runs 0.2, JSON remains 0.2, under 20 characters 0.3; never below 0."""
    a = answer
    penalty = F.when(T.has_foreign(a, profile=profile), 0.4).otherwise(0.0) + F.when(a.rlike(r"[#$%&*]{3}"), 0.2).otherwise(0.0) + F.when(a.rlike(r"[{}]"), 0.2).otherwise(0.0) + F.when(F.length(a) < 20, 0.3).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1.0 - penalty)


def relevancy(question: Column, answer: Column) -> Column:
    """Share of the question's distinct tokens in the answer."""
    q, a = F.array_distinct(T.tokens(question)), T.tokens(answer)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, a)), F.size(q)), F.lit(0.0))


WEIGHTS = {"relevancy": 0.4, "grounding": 0.35, "language": 0.25}


def overall(parts: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * parts[name]
    return total


RULES = {
    "FR-01": lambda t: V.digit_ratio(t) > 0.8,
    "FR-03": lambda t: F.lower(F.substring(t, 1, 300)).contains("consolidated") & F.lower(F.substring(t, 1, 300)).contains("separate"),
    "FR-07": lambda t: ~F.contains(F.substring(t, 1, 60), F.lit(" ")),
    "FR-12": lambda t: t.rlike(r"(?i)^\s*total\s+[0-9,.]+\s*$"),
}
HARD = {
    "FR-08": lambda t: F.coalesce(F.trim(t), F.lit("")) == "",
    "FR-11": lambda t: F.length(t) / 4 > 6000,
}


def violations(text: Column) -> Column:
    """Codes of every rule a chunk breaks."""
    return F.array_compact(F.array(*(F.when(test(text), code) for code, test in (RULES | HARD).items())))


def validated(chunks: DataFrame, text: str) -> DataFrame:
    """Chunks that break no hard rule, with all their violations."""
    marked = chunks.withColumn("violations", violations(F.col(text)))
    return marked.filter(~F.arrays_overlap("violations", F.array(*map(F.lit, HARD))))


def rule_report(chunks: DataFrame, text: str) -> DataFrame:
    """Violations by rule and their rate; a chunk counts once for every rule it breaks."""
    marked = chunks.select(violations(F.col(text)).alias("v"))
    total = marked.agg(F.count("*").alias("total"))
    failed = marked.select(F.explode("v").alias("rule")).groupBy("rule").agg(F.count("*").alias("failed"))
    return failed.crossJoin(F.broadcast(total)).select("rule", "failed", F.round(F.col("failed") / F.col("total"), 6).alias("rate"))  # one row


def same_as_evidence(summary: Column, evidence: Column) -> Column:
    """Equal, one holds the other (over 50 characters), or sentences overlap by more than 0.6."""
    s, e = T.squeezed(summary), T.squeezed(evidence)
    held = (F.length(s) > 50) & F.contains(e, s) | (F.length(e) > 50) & F.contains(s, e)
    parts = lambda x: F.array_distinct(F.filter(F.transform(F.split(x, r"[.!?]"), T.squeezed), lambda p: p != ""))
    return (s == e) | held | (T.jaccard(parts(s), parts(e)) > 0.6)


def record_flags(messages: Column) -> Column:
    """Flags of a training record's messages array of (role, content)."""
    roles = F.transform(messages, lambda m: m["role"])
    return F.array_compact(
        F.array(
            F.when(F.size(messages) == 0, "empty"),
            F.when(~F.array_contains(roles, "user"), "no_user"),
            F.when(~F.array_contains(roles, "assistant"), "no_assistant"),
            F.when(F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "blank_content"),
        )
    )


SOURCES = ("report", "filing", "statement", "according to", "source", "based on", ".pdf", ".zip")
SHAPES = {"conclusion": 0.10, "evidence": 0.08, "risk": 0.06, "confidence": 0.06}
_AMOUNT = r"[0-9][0-9,.]*\s*(?:%|bn|million|billion|thousand)|[0-9]{1,3}(?:,[0-9]{3})+"


def _held(text: Column, words) -> Column:
    total = F.lit(0)
    for w in words:
        total = total + F.contains(F.lower(text), F.lit(w)).cast("int")
    return total


def _shown(answer: Column, most: float) -> Column:
    """Credit for sources named, links among them up to three."""
    return F.least((_held(answer, SOURCES) + F.least(T.count_of(answer, r"https?://\S+"), F.lit(3))) * 0.065, F.lit(most))


def context_precision(question: Column, answer: Column, company: Column, evidence: Column) -> Column:
    """Whether the right data was used: company 0.35, sources 0.28, evidence or figures 0.25, the question's year 0.15; short answers 0.1."""
    c = F.lower(F.coalesce(company, F.lit("")))
    about = F.when(c == "", 0.28).when(F.contains(F.lower(answer), c), 0.35).otherwise(0.0)
    figures = F.when((evidence >= 1) | answer.rlike(_AMOUNT), 0.25).when(answer.rlike("https?://"), 0.23).when(answer.rlike("[0-9]{3,}"), 0.20).otherwise(0.0)
    asked, told = (F.regexp_extract_all(x, F.lit("20[0-9]{2}"), F.lit(0)) for x in (question, answer))
    year = F.when(F.size(asked) == 0, 0.12).when(F.arrays_overlap(asked, told), 0.15).when(F.size(told) > 0, 0.10).otherwise(0.0)
    return F.when(F.coalesce(F.length(answer), F.lit(0)) < 30, 0.1).otherwise(F.least(about + _shown(answer, 0.28) + figures + year, F.lit(1.0)))


def context_recall(question: Column, answer: Column, keywords: Column, content: str) -> Column:
    """Mean keyword score and a bonus for figures where the question is about ``content``; no keywords 0.8, no answer 0."""
    mean = F.coalesce(F.try_divide(F.aggregate(F.transform(keywords, lambda k: keyword_score(k, answer)), F.lit(0.0), lambda s, x: s + x), F.size(keywords)), F.lit(0.0))
    on_topic = F.lower(question).rlike(content)
    bonus = F.when(on_topic & (T.count_of(answer, _AMOUNT) >= 3), 0.25).when(on_topic & answer.rlike("[0-9]{2,}"), 0.22).when(on_topic & answer.rlike("https?://"), 0.20).otherwise(0.0)
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).when(F.size(keywords) == 0, 0.8).otherwise(F.least(mean + bonus, F.lit(1.0)))


def faithfulness(answer: Column, confidence: Column) -> Column:
    """Whether an answer keeps to its data: sources 0.35, shape 0.32, figures 0.20, stated confidence 0.15, and 0.12 less 0.02 for each forecast that is not marked as such."""
    shape = F.lit(0.0)
    for word, weight in SHAPES.items():
        shape = shape + F.when(F.contains(F.lower(answer), F.lit(word)), weight).otherwise(0.0)
    shape = F.least(shape + F.when(T.count_of(answer, r"(?m)^\*\*[^*]+\*\*|^###?\s") >= 2, 0.05).otherwise(0.0), F.lit(0.32))
    figures = F.when(answer.rlike(_AMOUNT), 0.20).when(answer.rlike("[0-9]{3,}"), 0.16).when(answer.rlike("https?://") | (T.count_of(answer, r"(?m)^\s*[0-9]+[.)]\s") >= 2), 0.15).otherwise(0.0)
    sure = F.when(confidence.isin("consensus", "axiom"), 0.15).when(confidence.isin("speculation", "exploration"), 0.14).when(confidence == "inference", 0.12).otherwise(0.0)
    guesses = F.when(F.lower(answer).rlike("speculation|exploration"), 0).otherwise(_held(answer, ("is expected to", "will likely", "is forecast")))
    return F.when(F.coalesce(answer, F.lit("")) == "", 0.0).otherwise(F.least(_shown(answer, 0.35) + shape + figures + sure + F.greatest(0.12 - 0.02 * guesses, F.lit(0.0)), F.lit(1.0)))
