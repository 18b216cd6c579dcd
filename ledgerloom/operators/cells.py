"""Facts out of table cells that stand a line each: label cells, the number after them, the unit declared before."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Label cells and the metric each names, units and their factors, and the range a metric's amount may have.
HANGUL_LABELS = {
    "매출액": "revenue", "매출": "revenue", "영업수익": "revenue", "영업수익(매출액)": "revenue", "수익(매출액)": "revenue", "(매출액)": "revenue",
    "영업이익": "operating_profit", "영업이익(손실)": "operating_profit", "영업손실": "operating_profit", "영업손실(이익)": "operating_profit",
    "당기순이익": "net_income", "당기순손실": "net_income", "연결총당기순이익": "net_income", "총당기순이익": "net_income", "당기순이익(손실)": "net_income", "당기순손실(이익)": "net_income",
    "자산총계": "total_assets", "부채총계": "total_liabilities", "자본총계": "equity", "지배기업소유주지분": "equity",
}
HANGUL_UNITS = {"조원": 1e12, "조": 1e12, "억원": 1e8, "억": 1e8, "백만원": 1e6, "백만": 1e6, "천원": 1e3, "천": 1e3, "원": 1.0}
LATIN_LABELS = {"revenue": "revenue", "sales": "revenue", "operating profit": "operating_profit", "net income": "net_income", "total assets": "total_assets", "total liabilities": "total_liabilities", "equity": "equity"}
LATIN_UNITS = {"billion": 1e9, "million": 1e6, "thousand": 1e3}
RANGES = {"revenue": (1e8, 5e14), "operating_profit": (1e7, 6e13), "net_income": (1e7, 6e13), "total_assets": (1e8, 1e15), "total_liabilities": (1e8, 1e15), "equity": (1e8, 1e15)}


@dataclass(frozen=True)
class CellRules:
    labels: Mapping[str, str] = field(default_factory=lambda: LATIN_LABELS)
    units: Mapping[str, float] = field(default_factory=lambda: LATIN_UNITS)
    unit_word: str = "unit"
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=lambda: RANGES)


LATIN = CellRules()
HANGUL = CellRules(HANGUL_LABELS, HANGUL_UNITS, "단위")


# What may stand before a label and after a number.
_LABEL_NUMBER = r"^(?:[IVXivx]+\.|[0-9]+[.)]|[가-힣]\.)[ \t]*"
_NUMBER_NOTE = r"(?i)[ \t]*\((?:주|note|n)\.?[ \t]*[0-9]*\)$|[ \t]*\*[0-9]+$"


def label_metric(cell: Column, labels: Mapping[str, str]) -> Column:
    """The metric a whole cell names: as it stands without a leading number, or without a trailing bracket too; else null."""
    plain = F.lower(F.trim(F.regexp_replace(F.trim(cell), _LABEL_NUMBER, "")))
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), F.try_element_at(known, F.trim(F.regexp_replace(plain, r"[ \t]*\([^)]*\)$", ""))))


def cell_number(cell: Column) -> Column:
    """The number a whole cell is: thousands' commas, a sign or brackets for negative ones, a trailing note left off; else null."""
    plain = F.regexp_replace(F.trim(cell), _NUMBER_NOTE, "")
    bare = F.regexp_replace(F.regexp_replace(plain, r"^[-△▲][ \t]*", ""), r"^\((.+)\)$", "$1")
    number = F.regexp_replace(bare, "[, ]", "")
    value = F.when(number.rlike(r"^[0-9]+(\.[0-9]+)?$"), number).try_cast("double")
    return F.when(plain.rlike(r"^[-△▲]") | plain.rlike(r"^[-△▲]?[ \t]*\(.+\)$"), -value).otherwise(value)


def unit_factor(cell: Column, rules: CellRules) -> Column:
    """The factor of a unit declaration in a cell, else null."""
    names = "|".join(sorted(rules.units, key=len, reverse=True))
    found = F.lower(F.regexp_extract(cell, rf"(?i){rules.unit_word}[ \t]*[:：][ \t]*({names})", 1))
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in rules.units.items() for x in pair)), found)


def cell_facts(docs: DataFrame, rules: CellRules = LATIN, ahead: int = 9, back: int = 300, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, metric, value: of each label cell the number in the next filled line, at most ``ahead`` lines on, times the unit declared last within ``back`` lines before.

    Values out of a metric's range are no facts; of each metric the first fact of a text counts; amounts that two
    metrics of a text share are none. Every row is a text of its own, whatever its id: null and repeated ids give their
    own facts. Null texts give none. All happens within a row, so nothing is shuffled.
    """
    found = cell_fact_arrays(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), rules, "_id", ahead=ahead, back=back, text_col="_text")
    # explode() would have its emptiness tested by a filter below everything, which would work all this out again
    return found.select("_id", F.explode_outer("facts").alias("f")).filter("f IS NOT NULL").select(F.col("_id").alias(id_col), "f.metric", "f.value")


def cell_fact_arrays(docs: DataFrame, rules: CellRules, *keep: str, ahead: int = 9, back: int = 300, text_col: str = "text") -> DataFrame:
    """keep, facts: cell_facts() of each row as an array of metric and value, empty where there are none."""
    struct = F.struct
    cells = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda cell, at: struct(at.alias("at"), F.btrim(cell, F.lit(" \t\r\f\v")).alias("cell")))
    filled = docs.select(*keep, F.filter(cells, lambda c: c["cell"] != "").alias("_filled"))
    read = lambda c: struct(c["at"].alias("at"), label_metric(c["cell"], rules.labels).alias("metric"), cell_number(c["cell"]).alias("number"), unit_factor(c["cell"], rules).alias("factor"))
    known = filled.select(*keep, F.transform("_filled", read).alias("_known"))
    units = F.filter("_known", lambda c: c["factor"].isNotNull())
    pairs = F.zip_with("_known", F.slice("_known", 2, F.size("_known")), lambda c, n: struct(c["at"].alias("at"), c["metric"].alias("metric"), F.when(n["at"] - c["at"] <= ahead, n["number"]).alias("number")))
    asked = known.select(*keep, units.alias("_units"), F.filter(pairs, lambda p: p["metric"].isNotNull() & p["number"].isNotNull()).alias("_pairs"))
    declared = lambda p: F.try_element_at(F.filter("_units", lambda u: (u["at"] < p["at"]) & (p["at"] - u["at"] <= back)), F.lit(-1))["factor"]
    valued = asked.select(*keep, F.transform("_pairs", lambda p: struct(p["metric"].alias("metric"), (p["number"] * F.coalesce(declared(p), F.lit(1.0))).alias("value"))).alias("_facts"))
    first = lambda metric, low, high: F.try_element_at(F.filter("_facts", lambda f: (f["metric"] == metric) & F.abs(f["value"]).between(float(low), float(high))), F.lit(1))
    one_each = valued.select(*keep, F.array_compact(F.array(*(first(m, *r) for m, r in rules.ranges.items()))).alias("_facts"))
    amount = lambda f: F.round(F.abs(f["value"]))
    return one_each.select(*keep, F.filter("_facts", lambda f: F.size(F.filter("_facts", lambda g: amount(g) == amount(f))) == 1).alias("facts"))


def suspicious(metric: Column, value: Column, won: Column, text: Column) -> Column:
    """Amounts not to be trusted: none, under a million won for amounts of a whole company, or prices of one share."""
    small = won & (F.abs(value) < 1_000_000)
    per_share = F.lower(F.coalesce(text, F.lit(""))).rlike("주당|액면가|per share|share price|단가|발행가")
    whole = metric.isin("revenue", "operating_profit", "net_income", "total_assets", "total_liabilities", "equity", "capex", "dividend_amount")
    return F.coalesce(value.isNull() | (metric.isin("treasury_stock_amount", "capital_raise_amount") & (per_share | small)) | (whole & small), F.lit(True))
