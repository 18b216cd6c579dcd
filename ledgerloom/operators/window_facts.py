"""Facts out of running text and flat tables: amounts right after a label, the largest of the columns after one, and the union with cells.

What a label's amount means goes by where the label stands: a unit in its own line first, else the last one declared
before it. Three readers stand beside each other here: cells.cell_facts() for a cell a line, table_facts() for columns
that follow a label, inline_facts() for sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache, partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import cells


@dataclass(frozen=True)
class WindowRules:
    """Label patterns in order of preference with their metrics, magnitudes inside an amount, and units of a table."""

    table_labels: Sequence[tuple[str, str]]
    inline_labels: Sequence[tuple[str, str]]
    magnitudes: Mapping[str, float]  # longest first where one is part of another
    currency: str
    units: Mapping[str, float]
    unit_word: str
    row_units: Sequence[str]  # such as stand alone in a row, before a column's end
    about: str = ""
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=lambda: cells.RANGES)
    begins: Mapping[str, Sequence[str]] = field(default_factory=dict)  # of a metric the lower-case words one of which each of its labels begins with, if known

    @property
    def amount(self) -> str:
        return rf"[-△▲]?\s*[\d,]+(?:\.\d+)?(?:\s*(?:{'|'.join(self.magnitudes)})?(?:{self.currency})?)?"

    @property
    def unit(self) -> str:
        return "|".join(sorted(self.units, key=len, reverse=True))


LATIN = WindowRules(
    table_labels=((r"(?i)\b(?:revenue|sales)\b", "revenue"), (r"(?i)\boperating (?:profit|loss)\b", "operating_profit"), (r"(?i)\bnet (?:income|loss)\b", "net_income"), (r"(?i)\btotal assets\b", "total_assets"), (r"(?i)\btotal liabilities\b", "total_liabilities"), (r"(?i)\b(?:total )?equity\b", "equity")),
    inline_labels=((r"(?i)\b(?:revenue|sales)", "revenue"), (r"(?i)\boperating (?:profit|loss)", "operating_profit"), (r"(?i)\bnet (?:income|loss)", "net_income"), (r"(?i)\btotal assets", "total_assets"), (r"(?i)\btotal liabilities", "total_liabilities"), (r"(?i)\bequity", "equity")),
    magnitudes={"billion": 1e9, "million": 1e6, "thousand": 1e3},
    currency=r"\s*(?:usd|eur|won)",
    units={"billion": 1e9, "million": 1e6, "thousand": 1e3},
    unit_word="[Uu]nit",
    row_units=("billion", "million", "thousand"),
    about=r"(?:of|was|about)?",
    begins={"revenue": ("revenue", "sales"), "operating_profit": ("operating profit", "operating loss"), "net_income": ("net income", "net loss"), "total_assets": ("total assets",), "total_liabilities": ("total liabilities",), "equity": ("total equity", "equity")},
)
# Labels in tables and in sentences of filings in Hangul, magnitudes and units.
HANGUL = WindowRules(
    table_labels=(
        (r"수익\s*\(\s*매출액\s*\)", "revenue"), (r"(?<![가-힣])매출액(?![가-힣])", "revenue"), (r"(?<![가-힣])영업수익(?![가-힣])", "revenue"), (r"영업이익(?:\s*\([^)]*\))?(?!률)", "operating_profit"),
        (r"영업손실(?:\s*\([^)]*\))?", "operating_profit"), (r"당기순이익(?:\s*\([^)]*\))?", "net_income"), (r"당기순손실(?:\s*\([^)]*\))?", "net_income"), (r"(?<![가-힣])순이익(?![가-힣률])", "net_income"),
        (r"(?:자산총계|총자산)(?:\s*\([^)]*\))?", "total_assets"), (r"(?:부채총계|총부채)(?:\s*\([^)]*\))?", "total_liabilities"), (r"(?:자본총계|총자본)(?:\s*\([^)]*\))?", "equity"),
    ),
    inline_labels=tuple((w, m) for w, m in (
        ("매출액", "revenue"), ("영업수익", "revenue"), ("영업이익", "operating_profit"), ("영업손실", "operating_profit"), ("당기순이익", "net_income"), ("당기순손실", "net_income"), ("순이익", "net_income"),
        ("자산총계", "total_assets"), ("총자산", "total_assets"), ("부채총계", "total_liabilities"), ("총부채", "total_liabilities"), ("자본총계", "equity"), ("총자본", "equity"),
    )),
    magnitudes={"조": 1e12, "억": 1e8, "백만": 1e6, "만": 1e4, "천": 1e3},
    currency="원",
    units=cells.HANGUL_UNITS,
    unit_word="단위",
    row_units=("백만원", "천원", "억원", "조원"),
    about="약?",
    begins={"revenue": ("수익", "매출액", "영업수익"), "operating_profit": ("영업이익", "영업손실"), "net_income": ("당기순이익", "당기순손실", "순이익"), "total_assets": ("자산총계", "총자산"), "total_liabilities": ("부채총계", "총부채"), "equity": ("자본총계", "총자본")},
)


def amount(raw: str, rules: WindowRules) -> float | None:
    """What an amount says: sign, digits and the first magnitude it holds; nothing and zero are no amounts."""
    plain = re.sub(r"[,\s]", "", raw)
    times = next((k for word, k in rules.magnitudes.items() if word in plain.lower()), 1.0)
    digits = re.search(r"\d+(?:\.\d+)?|\.\d+", plain)
    value = float(digits.group()) * times if digits else 0.0
    return (-value if plain.startswith(("-", "△", "▲")) else value) or None


def unit_at(text: str, at: int, rules: WindowRules, before: int = 800) -> float:
    """The factor for a label at ``at``: by its own line, at most 200 characters back and 250 on, else the last declaration before."""
    start = max(text.rfind("\n", max(0, at - 200), at) + 1, at - 200, 0)
    end = text.find("\n", at, at + 250)
    row = text[start : end if end >= 0 else at + 250]
    own = re.search(rf"(?:\(|│|\s)\s*{rules.unit_word}\s*[:：]?\s*({rules.unit})|({'|'.join(rules.row_units)})(?=[│\s),])", row)
    if own:
        return rules.units[own.group(1) or own.group(2)]
    said = [m.group(1) for m in re.finditer(rf"\(?\s*{rules.unit_word}\s*[:：]\s*({rules.unit})\s*\)?", text[max(0, at - before) : at])]
    return rules.units[said[-1]] if said else 1.0


def _scaled(raw: str, unit: Callable[[], float], rules: WindowRules) -> float | None:
    """An amount by its own magnitude, else by the unit of its label's place."""
    value = amount(raw, rules)
    own = any(word in raw.lower() for word in rules.magnitudes)
    return value if value is None or own else value * unit()


def _folded(text: str) -> str:
    """The text in lower case, character for character, with the letters that patterns without case take for i and s."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")


def _labels(pattern: str, metric: str, text: str, folded: str, rules: WindowRules) -> Iterator[re.Match]:
    """``re.finditer``, but tried only where one of the metric's words begins: a search for words costs far less than one for patterns."""
    words = rules.begins.get(metric)
    if not words:
        yield from re.finditer(pattern, text)
        return
    places = set()
    for word in words:
        at = folded.find(word)
        while at >= 0:
            places.add(at)
            at = folded.find(word, at + 1)
    read, end = re.compile(pattern), 0
    for at in sorted(places):
        if at >= end and (found := read.match(text, at)):
            yield found
            end = found.end()


def table_facts_of(text: str, rules: WindowRules, reach: int = 200, columns: int = 5, least: float = 1e8) -> dict[str, float]:
    """Of each metric the largest of up to five numbers after its first label whose largest is in the metric's range."""
    column = re.compile(rf"[│|\s)]+({rules.amount})")
    found: dict[str, float] = {}
    folded = _folded(text)
    for pattern, metric in rules.table_labels:
        for label in _labels(pattern, metric, text, folded, rules) if metric not in found else ():
            raws = [m.group(1).strip() for _, m in zip(range(columns), column.finditer(text[label.end() : label.end() + reach]), strict=False)]
            unit = cache(partial(unit_at, text, label.start(), rules))  # one for all of a label's columns
            values = [v for r in raws if (v := _scaled(r, unit, rules)) is not None and abs(v) >= least]
            low, high = rules.ranges.get(metric, (1e8, 1e15))
            if values and low <= abs(best := max(values, key=abs)) <= high:
                found[metric] = best
                break
    return _plausible(found)


def _plausible(found: dict[str, float]) -> dict[str, float]:
    """Without amounts that two metrics share and profits too large for the revenue; small ones brought to the revenue's scale."""
    shared = Counter(round(abs(v)) for v in found.values())
    revenue = abs(found.get("revenue", 0.0))
    large = {m for m, share in (("operating_profit", 0.6), ("net_income", 1.0)) if revenue and abs(found.get(m, 0.0)) > revenue * share}
    kept = {m: v for m, v in found.items() if shared[round(abs(v))] == 1 and m not in large}
    anchor = abs(kept.get("revenue", 0.0))
    if 1e12 <= anchor <= 5e14:
        for m, v in kept.items():
            if m != "revenue" and 1e5 <= anchor / abs(v) <= 1e7 and 1e8 <= abs(v) * 1e6 <= 1e15 and anchor / 100 <= abs(v) * 1e6 <= anchor * 100:
                kept[m] = v * 1e6
    return kept


def inline_facts_of(text: str, rules: WindowRules, least: float = 10_000) -> dict[str, float]:
    """Of each metric the first amount right after its label in a sentence, if it is not too small to mean anything."""
    found: dict[str, float] = {}
    folded = _folded(text)
    for pattern, metric in rules.inline_labels:
        said = rf"{pattern}\s*[:：]?\s*{rules.about}\s*([-△▲]?\s*[\d,.]+\s*(?:{'|'.join(rules.magnitudes)})?(?:{rules.currency})?)"
        for m in _labels(said, metric, text, folded, rules) if metric not in found else ():
            value = _scaled(m.group(1), partial(unit_at, text, m.start(), rules), rules)
            if value is not None and abs(value) >= least:
                found[metric] = value
                break
    return found


_FACTS = "array<struct<metric:string,value:double>>"


def _reader(read, rules: WindowRules):
    """A column of the facts that ``read`` finds in a column of texts."""

    @F.pandas_udf(_FACTS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"metric": m, "value": v} for m, v in read(t, rules).items()] if t else [] for t in texts], dtype=object)

    return found


def _facts(docs: DataFrame, read, rules: WindowRules, id_col: str, text_col: str) -> DataFrame:
    found = docs.select(F.col(id_col), _reader(read, rules)(F.col(text_col)).alias("_facts"))
    return found.select(id_col, F.explode_outer("_facts").alias("_f")).filter("_f IS NOT NULL").select(id_col, "_f.metric", "_f.value")


def table_facts(docs: DataFrame, rules: WindowRules = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, metric, value: facts of columns after labels, a row's own whatever its id; null texts have none. No shuffle."""
    return _facts(docs, table_facts_of, rules, id_col, text_col)


def inline_facts(docs: DataFrame, rules: WindowRules = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, metric, value: facts of sentences, a row's own whatever its id; null texts have none. No shuffle."""
    return _facts(docs, inline_facts_of, rules, id_col, text_col)


def every_fact(docs: DataFrame, cell_rules: cells.CellRules = cells.LATIN, rules: WindowRules = LATIN, id_col: str = "doc_id", text_col: str = "text", clean_col: str | None = None) -> DataFrame:
    """id, metric, value, reader: facts of cells, of columns where cells have none of the metric, and of sentences where both have none at all.

    Sentences are read in ``clean_col`` if it is given. All three are read beside each other in a row, whatever its id;
    nothing is shuffled.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_raw"), F.col(clean_col or text_col).alias("_clean"))
    celled = cells.cell_fact_arrays(texts, cell_rules, "_id", "_raw", "_clean", text_col="_raw")
    read = celled.withColumn("_columns", _reader(table_facts_of, rules)(F.col("_raw"))).withColumn("_sentences", _reader(inline_facts_of, rules)(F.col("_clean")))
    told = lambda facts, reader: F.transform(facts, lambda f: F.struct(f["metric"].alias("metric"), f["value"].alias("value"), F.lit(reader).alias("reader")))
    more = F.filter("_columns", lambda f: ~F.exists("facts", lambda c: c["metric"] == f["metric"]))
    sure = F.concat(told(F.col("facts"), "cells"), told(more, "columns"))
    chosen = F.explode_outer(F.when(F.size(sure) > 0, sure).otherwise(told(F.col("_sentences"), "sentences")))
    return read.select("_id", chosen.alias("_f")).filter("_f IS NOT NULL").select(F.col("_id").alias(id_col), "_f.metric", "_f.value", "_f.reader")
