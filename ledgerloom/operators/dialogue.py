"""Questions in their conversation, and answers put together from facts: routes, inherited context, memory, gates, texts.

Turns are rows of (conversation, turn, role, text). Windows run within a conversation, so its turns share a task; their
frames are bounded by the number of turns looked back or by running values, never by a collected conversation.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Words:
    """Regular expressions of the words that decide a question's route, on its lower-cased text."""

    ranking: str = "top |rank|largest|highest|lowest|compare|versus"
    listing: str = "(event|announcement).*(why|reason|cause)"
    recommend: str = "recommend|suggest"
    scan: str = "find|which companies|screen"
    outlook: str = "outlook|forecast|share price"
    trend: str = "trend|history|last [0-9]+ years"
    summary: str = "summar|overview|about"
    document: str = "why|how|explain|risk|opinion"


def route(question: Column, company: Column, metric: Column, bound: Column, several: Column, words: Words = Words()) -> Column:
    """(route, density, missing) of a question by ordered rules.

    Ranking and comparison come before everything unless events are asked for; short questions (25 characters and three
    words at most) are summaries of a bound company, else plain questions. Null flags count as false, a null question as empty.
    """
    low = F.lower(F.coalesce(question, F.lit("")))
    has, measured, tied, many = (F.coalesce(c, F.lit(False)) for c in (company, metric, bound, several))
    listing = low.rlike(words.listing)
    short = (F.length(low) <= 25) & (F.size(F.filter(F.split(low, r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)) <= 3)

    def to(name: str, density: str | Column, missing: str | Column = "") -> Column:
        lit = lambda v: F.lit(v) if isinstance(v, str) else v
        return F.struct(F.lit(name).alias("route"), lit(density).alias("density"), lit(missing).alias("missing"))

    return (
        F.when((low.rlike(words.ranking) | many) & ~listing, to("ranking", "R1"))
        .when(short, F.when(tied, to("summary", "R1")).otherwise(to("qa", "R1")))
        .when(low.rlike(words.recommend) & ~has, to("qa", "R0", "priority_axis"))
        .when(~has & measured & low.rlike(words.scan), to("ranking", "R1"))
        .when(low.rlike(words.outlook), to("outlook", F.when(has, "R2").otherwise("R0"), F.when(has, "").otherwise("company")))
        .when(low.rlike(words.trend) & (has | measured), to("trend", "R1"))
        .when(has & low.rlike(words.summary), to("summary", "R1"))
        .when(~has & (measured | low.rlike(words.document)), to("qa", "R0", "company"))
        .otherwise(to("qa", "R2"))
    )


def meta_reply(question: Column) -> Column:
    """greeting, identity or capability for questions about the assistant itself, else null."""
    low = F.trim(F.lower(question))
    return F.when(low.rlike(r"^(hello|hi|hey|good (morning|evening))\b.{0,10}$"), "greeting").when(low.rlike("who are you|your name"), "identity").when(low.rlike("what can you do|how do i use"), "capability")


def name_only(question: Column, names: Column) -> Column:
    """Whether nothing but names and marks is left of a question; one without any name is not."""
    left = F.aggregate(names, F.lower(question), lambda acc, n: F.replace(acc, F.lower(n), F.lit(" ")))
    return F.coalesce((left != F.lower(question)) & ~left.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def inherited(turns: DataFrame, own: str, key: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """User turns with ``context``: their own value, else the user turn's before; ``inherited`` tells which. Further back is not looked."""
    w = Window.partitionBy(key).orderBy(order)
    asked = turns.filter(F.col(role) == "user").withColumn("_before", F.lag(own).over(w))
    return asked.withColumn("context", F.coalesce(own, "_before")).withColumn("inherited", F.col(own).isNull() & F.col("_before").isNotNull()).drop("_before")


def session_memory(turns: DataFrame, words: Sequence[str], most: int = 6, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Slots of the last ``most`` messages up to each turn: objective (last user text), resolved (last answer), mentioned words, sorted."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1 - most, 0)
    by = lambda who: F.last(F.when(F.col(role) == who, F.trim(text)), ignorenulls=True).over(w)
    low = F.lower(text)
    held = [F.max(F.when((F.col(role) == "user") & F.contains(low, F.lit(x)), F.lit(x))).over(w) for x in sorted(words)]
    return turns.select("*", F.substring(by("user"), 1, 100).alias("objective"), F.substring(F.regexp_replace(by("assistant"), "\n", " "), 1, 100).alias("resolved"), F.array_compact(F.array(*held)).alias("mentioned"))


def confidence(grounding: Column, evidence: Column) -> Column:
    """Confidence of an answer by how much of it its evidence holds: 0.85 from 0.6 on, 0.7 from 0.3, else 0.5; 0.3 without evidence."""
    return F.when(F.coalesce(evidence, F.lit(0)) == 0, 0.3).when(grounding >= 0.6, 0.85).when(grounding >= 0.3, 0.7).otherwise(0.5)


def outlook(covered: Column, least: int = 3, slots: int = 4) -> Column:
    """How an outlook may be answered: full or part of the slots, or that evidence is short."""
    return F.when(covered >= slots, "inference_full").when(covered >= least, "inference_part").otherwise("shortage")


def with_fallback(asked: DataFrame, structured: DataFrame, retrieved: DataFrame, key: str) -> DataFrame:
    """Each question with its structured answer, else the retrieved one, else none; ``via`` tells which. One row a key in both is expected."""
    joined = asked.join(structured.select(key, F.col("answer").alias("_s")), key, "left").join(retrieved.select(key, F.col("answer").alias("_r")), key, "left")
    via = F.when(F.col("_s").isNotNull(), "structured").when(F.col("_r").isNotNull(), "retrieved").otherwise("none")
    return joined.withColumn("answer", F.coalesce("_s", "_r")).withColumn("via", via).drop("_s", "_r")


def by_source(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """The value of each key from the first source that has one; ``source`` counts from 1. Partial aggregates, no window."""
    parts = [s.filter(F.col(value).isNotNull()).select(*keys, F.struct(F.lit(i).alias("source"), F.col(value).alias(value)).alias("_v")) for i, s in enumerate(sources, 1)]
    all_rows = parts[0]
    for p in parts[1:]:
        all_rows = all_rows.unionByName(p)
    return all_rows.groupBy(*keys).agg(F.min("_v").alias("_v")).select(*keys, F.col("_v.source").alias("source"), F.col(f"_v.{value}").alias(value))


def comparison_text(cells: DataFrame, companies: Sequence[str], years: Sequence[int], metric: str) -> DataFrame:
    """One line a company over the years asked for: value and period of each cell, missing ones named."""
    grid = cells.sparkSession.createDataFrame([(c, y) for c in companies for y in years], "company string, fiscal_year int")
    rows = grid.join(cells.filter(F.col("metric") == metric), ["company", "fiscal_year"], "left")
    said = F.concat(F.col("fiscal_year").cast("string"), F.lit(": "), F.coalesce(F.concat(F.round("value", 0).cast("long").cast("string"), F.lit(" ("), F.col("period_type"), F.lit(")")), F.lit("missing")))
    lines = rows.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("fiscal_year", said.alias("said")))).alias("_l"), F.count_if(F.col("value").isNull()).alias("missing"))
    return lines.select("company", F.array_join(F.transform("_l", lambda x: x["said"]), "; ").alias("line"), "missing")


def citation(company: Column, year: Column, report: Column, source: Column) -> Column:
    """How a fact or chunk is cited; unknown parts are left out."""
    return F.concat_ws(" / ", company, year.cast("string"), report, F.concat(F.lit("#"), source.cast("string")))


def cited_once(rows: DataFrame, key: str, label: Column, order: Sequence[Column], most: int = 5) -> DataFrame:
    """The first ``most`` different labels of each key, numbered in order of first appearance."""
    firsts = rows.withColumn("label", label).groupBy(key, "label").agg(F.min(F.struct(*order)).alias("_o"))
    w = Window.partitionBy(key).orderBy("_o", "label")
    return firsts.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).select(key, "label", "n")


def link_audit(rows: DataFrame, stored: Column, inferred: Column) -> DataFrame:
    """Totals of documents with a company, without one, and with another than their name tells."""
    linked = F.coalesce(F.trim(stored) != "", F.lit(False))
    return rows.agg(F.count("*").alias("total"), F.count_if(linked).alias("linked"), F.count_if(~linked).alias("missing"), F.count_if(linked & (inferred != "") & (stored != inferred)).alias("mismatch"))
