"""Nested JSON payloads as VARIANT: leaves by path, values looked up by priority, and checks of what analyses hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import values as V

HAN = r"[\x{4E00}-\x{9FFF}]"
# Where an amount may stand in an object, first found counts (fixed values).
AMOUNT_KEYS = ("value", "amount", "metric_value", "number", "text")


def parsed(payload: Column) -> Column:
    """The payload as VARIANT; an object or array that stands inside a JSON string is read once more; no JSON gives null."""
    once = F.try_parse_json(payload)
    inner = F.try_variant_get(once, "$", "string")
    return F.when((F.schema_of_variant(once) == "STRING") & inner.rlike(r"^\s*[\[{]"), F.coalesce(F.try_parse_json(inner), once)).otherwise(once)


def leaves(df: DataFrame, payload: str, *keep: str, depth: int = 6) -> DataFrame:
    """keep, path, kind, value: a row for each leaf of a payload, however it is nested, down to ``depth`` levels.

    A path is keys joined by dots with places in brackets, ``a.b[0].c``; of a payload that is a scalar itself it is empty.
    kind is the leaf's type; objects and arrays that are empty, or lie deeper than ``depth``, are leaves of their own, as
    JSON. A payload that is null or no JSON has no leaves. Each row of ``df`` is a payload, whatever its other columns hold.
    """
    spark = df.sparkSession
    at = df.select(*keep, parsed(F.col(payload)).alias("_v"), F.lit("").alias("_path")).filter("_v IS NOT NULL")
    for _ in range(depth):
        names = ", ".join(f"t.`{c}`" for c in keep)
        step = "CASE WHEN e.key IS NOT NULL THEN concat(t._path, CASE WHEN t._path = '' THEN '' ELSE '.' END, e.key) WHEN e.pos IS NOT NULL THEN concat(t._path, '[', e.pos, ']') ELSE t._path END"
        at = spark.sql(f"SELECT {names}{', ' if names else ''}CASE WHEN e.pos IS NULL THEN t._v ELSE e.value END AS _v, {step} AS _path FROM {{t}} AS t, LATERAL variant_explode_outer(t._v) AS e", t=at)
    kind = F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0)
    value = F.when(kind.isin("OBJECT", "ARRAY"), F.to_json("_v")).otherwise(F.try_variant_get(F.col("_v"), "$", "string"))
    return at.select(*keep, F.col("_path").alias("path"), kind.alias("kind"), value.alias("value"))


def text_fields(df: DataFrame, payload: str, *keep: str, depth: int = 6) -> DataFrame:
    """keep, field, text: the leaves that are filled strings."""
    return leaves(df, payload, *keep, depth=depth).filter((F.col("kind") == "STRING") & (F.col("value") != "")).select(*keep, F.col("path").alias("field"), F.col("value").alias("text"))


def metric_value(df: DataFrame, payload: str, keys: Sequence[str] = AMOUNT_KEYS, depth: int = 3) -> DataFrame:
    """``df`` with amount and unit of its payload: a number as it stands, a phrase read as one, an object by its
    first of ``keys``, an array by its first item with an amount, an object or array inside these alike down to ``depth``.

    Null where there is none. Row by row: what a value may hold is laid out a level at a time, in order, so the first scalar
    with an amount is the one asked for, and the expression grows with ``depth`` as a chain, not as a tree.
    """
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    inner = lambda v: F.coalesce(*(F.try_variant_get(v, f"$.{k}", "variant") for k in keys))
    held = lambda v: F.when(kind(v) == "OBJECT", F.array(inner(v))).when(kind(v) == "ARRAY", F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))).otherwise(F.array(v))
    scalars = F.array("_v")
    for _ in range(depth):
        scalars = F.flatten(F.transform(scalars, held))

    def read(v: Column) -> Column:
        number = F.struct(F.try_variant_get(v, "$", "double").alias("value"), F.lit("number").alias("unit"))
        return F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), number).when(kind(v) == "STRING", V.amount_phrase(F.try_variant_get(v, "$", "string")))

    first = F.try_element_at(F.filter(F.transform(scalars, read), lambda m: m["value"].isNotNull()), F.lit(1))
    rows = df.withColumn("_v", parsed(F.col(payload))).withColumn("_m", first)
    return rows.select(*df.columns, F.col("_m.value").alias("amount"), F.col("_m.unit").alias("unit"))


def foreign_fields(df: DataFrame, payload: str, *keep: str, pattern: str = HAN, around: int = 15, most: int = 3, depth: int = 6) -> DataFrame:
    """keep, field, n, snippets: text leaves with characters of ``pattern``, how many, and the first ``most`` different surroundings.

    A payload that is no JSON is one field, ``raw_text``.
    """
    raw = df.filter(F.col(payload).isNotNull() & F.try_parse_json(F.col(payload)).isNull()).select(*keep, F.lit("raw_text").alias("field"), F.col(payload).cast("string").alias("text"))
    every = text_fields(df, payload, *keep, depth=depth).unionByName(raw).withColumn("n", F.regexp_count("text", F.lit(pattern))).filter("n > 0")
    near = F.regexp_extract_all("text", F.lit(f"(?s).{{0,{around}}}{pattern}+.{{0,{around}}}"), F.lit(0))
    return every.select(*keep, "field", "n", F.slice(F.array_distinct(F.transform(near, lambda s: F.trim(F.regexp_replace(s, "\n", " ")))), 1, most).alias("snippets"))


def quality_run(rows: DataFrame, payload: str, analysed: Column, report: Column, id_col: str, name_issues, weak: Sequence[str] = ("", "other"), short: int = 50, pattern: str = HAN) -> DataFrame:
    """id, issues, severity: of each row what is wrong with its analysis, in a fixed order, and the worst of it.

    NO_ANALYSIS where an analysed row has no payload (nothing else is asked of it then); FOREIGN where text leaves hold
    characters of ``pattern``; the issues of the company's name, which ``name_issues`` gives as an array of strings;
    EMPTY_SUMMARY or SHORT_SUMMARY under ``short`` characters; WEAK_CATEGORY; NO_REPORT. Severity is CRITICAL for FOREIGN,
    HIGH for names, MEDIUM for summaries, else LOW; rows without issues are none. Rows are judged one by one, whatever their ids.
    """
    v = parsed(F.col(payload))
    get = lambda k: F.coalesce(F.try_variant_get(F.col("_v"), f"$.{k}", "string"), F.lit(""))
    seen = rows.withColumn("_v", v).withColumn("_summary", get("summary")).withColumn("_company", get("company_name")).withColumn("_category", get("category"))
    strings = F.regexp_count(F.coalesce(F.to_json("_v"), F.col(payload).cast("string"), F.lit("")), F.lit(pattern))  # keys of payloads are ASCII
    mark = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    length = F.length("_summary")
    issues = F.concat(
        mark(strings > 0, "FOREIGN"), F.transform(name_issues(F.col("_company")), lambda x: F.concat(F.lit("COMPANY_"), F.upper(x))), mark(length == 0, "EMPTY_SUMMARY"), mark((length > 0) & (length < short), "SHORT_SUMMARY"),
        mark(F.lower("_category").isin(*weak), "WEAK_CATEGORY"), mark(~F.coalesce(report, F.lit(False)), "NO_REPORT"),
    )
    found = F.when(F.col(payload).isNotNull(), issues).otherwise(mark(F.coalesce(analysed, F.lit(False)), "NO_ANALYSIS"))
    named = F.exists("issues", lambda x: x.startswith("COMPANY_"))
    severity = F.when(F.array_contains("issues", "FOREIGN"), "CRITICAL").when(named, "HIGH").when(F.exists("issues", lambda x: x.endswith("_SUMMARY")), "MEDIUM").when(F.size("issues") > 0, "LOW").otherwise("none")
    return seen.select(id_col, found.alias("issues")).withColumn("severity", severity)


def quality_counts(found: DataFrame) -> DataFrame:
    """issue, n: rows of quality_run() by issue, with ``(clean)`` for rows without any."""
    each = F.explode(F.when(F.size("issues") > 0, F.col("issues")).otherwise(F.array(F.lit("(clean)"))))
    return found.select(each.alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
