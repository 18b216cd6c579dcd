"""From a question's text to a plan over facts, without any model: words, companies, metric, years, limit, route."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import facts as ops

METRIC_WORDS = {
    "operating_margin": ("operating margin", "margin"),
    "debt_ratio": ("debt ratio", "leverage"),
    "operating_profit": ("operating profit", "operating income"),
    "net_income": ("net income", "net profit", "earnings"),
    "liabilities": ("liabilities", "debt"),
    "equity": ("equity", "net assets"),
    "revenue": ("revenue", "sales", "turnover"),
}
RATIOS = ("operating_margin", "net_margin", "debt_ratio")
_RANK = re.compile(r"\b(top|rank(?:ing)?|largest|highest|lowest|smallest|best|worst|most)\b")
_LOW = re.compile(r"\b(lowest|smallest|worst|least)\b")
_TREND = re.compile(r"\b(trend|history|over time|last \d+ years|recent years|since)\b")
_COMPARE = re.compile(r"\b(compare|versus|vs\.?|between|against)\b")
_EVENTS = re.compile(r"\b(event|announcement|filing)s?\b")
_REASON = re.compile(r"\b(why|reason|cause|top|rank)\b")


@dataclass(frozen=True)
class Plan:
    """What a question asks for; ``missing`` names what must be asked back."""

    route: str
    metric: str | None = None
    companies: tuple[str, ...] = ()
    years: tuple[int, ...] = ()
    limit: int = 5
    ascending: bool = False
    missing: str | None = None
    notes: dict = field(default_factory=dict)


def limit_in(question: str, otherwise: int = 5) -> int:
    """N of "top N", between 1 and 20."""
    found = re.search(r"\b(?:top|best|first)\s*(\d{1,3})\b|\b(\d{1,3})\s+(?:largest|highest|lowest|smallest|companies)\b", question.lower())
    return max(1, min(20, int(found[1] or found[2]))) if found else otherwise


def span_in(question: str, otherwise: int = 3) -> int:
    """Years of "last N years", between 2 and 10."""
    found = re.search(r"\b(?:last|past|recent)\s+(\d{1,2})\s+years?\b", question.lower())
    return max(2, min(10, int(found[1]))) if found else otherwise


def years_in(question: str, as_of: int) -> tuple[int, ...]:
    """Asked-for years, ascending: a span of the last years, else years named, else last or this year."""
    q = question.lower()
    if re.search(r"\b(?:last|past|recent)\s+\d{1,2}\s+years?\b", q):
        n = min(5, span_in(q))
        return tuple(range(as_of - n + 1, as_of + 1))
    named = sorted({int(y) for y in re.findall(r"\b((?:19|20)\d{2})\b", q)})
    if named:
        return tuple(named)
    return (as_of - 1,) if "last year" in q else (as_of,) if "this year" in q else ()


def metric_in(question: str) -> str | None:
    q = question.lower()
    return next((m for m, words in METRIC_WORDS.items() if any(w in q for w in words)), None)


def companies_in(question: str, known: Sequence[str]) -> tuple[str, ...]:
    """Known names in the text, in the order they stand there; longer names hide the shorter ones inside them."""
    text, found = question.lower(), []
    for name in sorted(known, key=lambda n: (-len(n), n)):
        for m in re.finditer(rf"(?<!\w){re.escape(name.lower())}(?!\w)", text):
            found.append((m.start(), name))
            text = text[: m.start()] + "\0" * len(name) + text[m.end() :]
    return tuple(dict.fromkeys(n for _, n in sorted(found)))


def plan(question: str, known: Sequence[str], as_of: int) -> Plan:
    """Route of a question, by ordered rules: trivial, listing of events, comparison, ranking, trend, single value, summary."""
    q = question.strip().lower()
    if len(re.sub(r"\W", "", q)) < 2:
        return Plan("trivial")
    metric, companies, years = metric_in(q), companies_in(q, known), years_in(q, as_of)
    if _EVENTS.search(q) and _REASON.search(q):
        return Plan("events", metric, companies, years)
    if _COMPARE.search(q) and len(companies) > 1 or len(companies) > 1 and not _TREND.search(q):
        return Plan("compare", metric or "revenue", companies, years or (as_of,))
    if _RANK.search(q):
        return Plan("ranking", metric, companies, years, limit_in(q), bool(_LOW.search(q)) or metric == "debt_ratio", None if metric else "metric")
    if _TREND.search(q):
        return Plan("trend", metric or "revenue", companies, years or tuple(range(as_of - span_in(q) + 1, as_of + 1)), missing=None if companies else "company")
    if metric:
        return Plan("value", metric, companies, years, missing=None if companies else "company")
    return Plan("summary", None, companies, years) if companies else Plan("search")


def execute(p: Plan, facts: DataFrame) -> DataFrame:
    """The plan's rows: company, fiscal_year, metric, value and, for rankings, rank."""
    if p.missing or p.route in ("trivial", "events", "search"):
        return facts.sparkSession.createDataFrame([(p.route, p.missing)], "route string, missing string")
    rows = facts
    if p.companies:
        rows = rows.filter(F.col("company").isin(*p.companies))
    if p.years:
        rows = rows.filter(F.col("fiscal_year").isin(*p.years))
    cells = ops.best_per_cell(rows)
    if p.metric in RATIOS:
        wide = ops.ratios(cells)
        cells = wide.select("company", "fiscal_year", F.lit(p.metric).alias("metric"), F.col(p.metric).alias("value")).filter("value is not null")
        cells = cells.withColumn("fact_id", F.lit(0))
    elif p.metric:
        cells = cells.filter(F.col("metric") == p.metric)
    if p.route == "ranking":
        return ops.ranked(ops.latest_per_company(cells, p.metric), ascending=p.ascending, limit=p.limit).select("rank", "company", "fiscal_year", "metric", "value")
    return cells.select("company", "fiscal_year", "metric", "value")
