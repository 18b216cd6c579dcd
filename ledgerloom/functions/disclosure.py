"""What a filing discloses, read from its text as column expressions: people, segments, auditors, risks, customers, events.

Every pattern set is a parameter with a Latin default. Null text gives null arrays or null fields; nothing found gives
empty arrays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import cleaning as K
from ledgerloom.functions import text as T

TITLES = ("Chief Executive", "Chairman", "President", "Director", "Auditor")
FIRMS = (r"[A-Z][A-Za-z&]+(?: [A-Z][A-Za-z&]+)* LLP",)
RISKS = ("Market risk", "Credit risk", "Liquidity risk", "Currency risk", "Interest risk", "Operational risk", "Regulatory risk", "Technology risk", "Competition risk")

# Text length below which a window size holds, and the sizes of the event and term windows there.
_WINDOWS = ((10_000, None, None, None), (50_000, 5_000, 10_000, None), (200_000, 3_000, 5_000, 50_000))
_LARGEST = (3_000, 5_000, 100_000)


def executives(text: Column, titles: Sequence[str] = TITLES, name: str = r"[A-Z][a-z]+ [A-Z][a-z]+", most: int = 20) -> Column:
    """Distinct (title, name) in the order of the titles, at most ``most`` a title; a name that begins like a title is none."""

    def of(title: str) -> Column:
        names = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"{title}[ \t]+({name})"), F.lit(1)))
        real = F.filter(names, lambda n: ~n.rlike("^(" + "|".join(t.split()[0] for t in titles) + r")\b"))
        return F.transform(F.slice(real, 1, most), lambda n: F.struct(F.lit(title).alias("title"), n.alias("name")))

    return F.flatten(F.array(*map(of, titles)))


def segments(text: Column, separator: str = r"[ \t]*\|[ \t]*", most: int = 20) -> Column:
    """Rows name | kind | channel | amount | share of a segment table as structs; a total row comes last."""
    row = r"(?m)^[^|\n]*business[ \t]*\|[^|\n]*\|[^|\n]*\|[ \t]*\(?[0-9][0-9,]*\)?[ \t]*\|[ \t]*[0-9.]+[ \t]*%"
    total = r"(?m)^Total[ \t]*\|[ \t]*([0-9][0-9,]*)[ \t]*\|[ \t]*100[ \t]*%"

    def fields(line: Column) -> Column:
        part = F.split(F.trim(line), separator)
        return F.struct(*(F.get(part, i).alias(n) for i, n in enumerate(("segment", "kind", "channel", "amount", "share"))))

    sums = F.transform(
        F.slice(F.regexp_extract_all(text, F.lit(total), F.lit(1)), 1, 1),
        lambda a: F.struct(F.lit("Total").alias("segment"), F.lit("-").alias("kind"), F.lit("-").alias("channel"), a.alias("amount"), F.lit("100%").alias("share")),
    )
    return F.concat(F.transform(F.slice(F.regexp_extract_all(text, F.lit(row), F.lit(0)), 1, most), fields), sums)


def audit_info(text: Column, firms: Sequence[str] = FIRMS, window: int = 800, most: int = 5) -> Column:
    """(auditor, opinion, matters): the first firm; the opinion beside it, else anywhere, else unqualified where a firm is named."""
    pattern = "|".join(firms)
    firm = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    beside = F.substr(text, F.regexp_instr(text, F.lit(pattern)), F.lit(window))
    found = F.coalesce(F.when(firm.isNotNull(), K.opinion(beside)), K.opinion(text), F.when(firm.isNotNull(), F.lit("unqualified")))
    after = F.regexp_extract(text, r"(?is)key audit matters(.{0,2000})", 1)
    matters = F.slice(F.regexp_extract_all(after, F.lit(r"\n[ \t]*[1-9]\.[ \t]*([^\n]{10,150})"), F.lit(1)), 1, most)
    return F.struct(firm.alias("auditor"), found.alias("opinion"), matters.alias("matters"))


def risks(text: Column, labels: Sequence[str] = RISKS, most: int = 8) -> Column:
    """"label: sentence" for each kind of risk whose label is followed by a sentence of over 15 characters."""

    def of(label: str) -> Column:
        told = T.squeezed(F.regexp_extract(text, rf"{label}[ \t]*:?[ \t]*(\p{{L}}[^.\n]{{10,200}})", 1))
        return F.when(F.length(told) > 15, F.concat(F.lit(f"{label}: "), told))

    return F.slice(F.array_compact(F.array(*map(of, labels))), 1, most)


def customers(text: Column, label: str = r"[Mm]ajor customers", most: int = 10) -> Column:
    """Names listed after the label, sorted; those that begin with a digit, hold a per cent sign or are of odd length are left out."""
    blocks = F.regexp_extract_all(text, F.lit(rf"{label}[ \t]*:?[ \t]*([^.\n]+)"), F.lit(1))
    names = F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "[,/、]"))), T.squeezed)
    kept = F.filter(names, lambda n: F.length(n).between(2, 30) & ~n.rlike("^[0-9]|%"))
    return F.slice(F.array_sort(F.array_distinct(kept)), 1, most)


def windows(length: Column) -> Column:
    """(event, terms, overview) window sizes by a text's length; null stands for the whole text and becomes the length."""

    def sized(sizes: Sequence[int | None]) -> Column:
        return F.struct(*((length if s is None else F.lit(s)).cast("int").alias(n) for n, s in zip(("event", "terms", "overview"), sizes)))

    chain = F
    for below, *sizes in _WINDOWS:
        chain = chain.when(length < below, sized(sizes))
    return F.when(length.isNotNull(), chain.otherwise(sized(_LARGEST)))


def event_terms(text: Column, patterns: Mapping[str, str]) -> Column:
    """Map of each named term's first value within the term window of the text's length; terms not found are left out."""
    head = F.substr(text, F.lit(1), windows(F.length(text))["terms"])
    found = F.array(*(F.struct(F.lit(k).alias("key"), F.trim(F.regexp_extract(head, p, 1)).alias("value")) for k, p in patterns.items()))
    return F.map_from_entries(F.filter(found, lambda e: e["value"] != ""))


def title(text: Column, patterns: Sequence[str] = (r"(?i)report on (?:material facts|major events)[ \t]*\(([^()\n]{2,60})\)", r"(?i)correction[^.\n]{0,80}?report[ \t]*\(?([^()\n]{4,60})\)?", r"^[ \t]*([A-Z][A-Za-z ]{3,40} Report)\b")) -> Column:
    """The title that the first fitting pattern finds within a text's first 1,000 characters, else null."""
    head = F.substring(text, 1, 1000)
    return F.coalesce(*(F.nullif(T.squeezed(F.regexp_extract(head, p, 1)), F.lit("")) for p in patterns))


def stored_name(filename: Column, category: Column, none: str = "unclassified") -> Column:
    """company_category of a stored file's name; any other name as it is, null as empty."""
    company = F.regexp_extract(filename, r"^[a-f0-9]+_[A-Z]+_P[0-9]+_(.+?)_[0-9]{13,14}", 1)
    return F.coalesce(F.when(company != "", F.concat_ws("_", company, F.coalesce(F.nullif(category, F.lit("")), F.lit(none)))).otherwise(filename), F.lit(""))


def narrative_faults(summary: Column, kind: Column, revenue_most: float = 1000.0, debt_most: float = 5000.0) -> Column:
    """Codes of what is wrong with a summary, in fixed order; an empty or null one has the code empty alone."""
    low, size = F.lower(summary), F.length(summary)
    revenue = F.regexp_replace(F.regexp_extract(low, r"revenue[ \t]+(?:of[ \t]+)?([0-9][0-9,.]*)[ \t]*trillion", 1), ",", "").try_cast("double")
    debt = F.regexp_extract(low, r"debt ratio[ \t]+(?:of[ \t]+)?(-?[0-9][0-9.]*)[ \t]*%", 1).try_cast("double")
    rules = {
        "too_short_30": size < 30,
        "too_short_60": size.between(30, 59),
        "placeholder": summary.rlike(r"\([sn]\)|은\(는\)|이\(가\)|을\(를\)|와\(과\)"),
        "twice_named": low.rlike("the company the company"),
        "kind_and_event": kind.isin("annual", "quarterly", "semiannual", "audit") & low.contains("resolved and disclosed"),
        "split_with_payment": low.contains("spin-off") & low.contains("payment date"),
        "negative_with_date": low.rlike("rehabilitation|dissolution") & low.rlike("payment date|listing date"),
        "stray_marks": summary.rlike(r"\([ \t]*\)|[ \t]\.[ \t]\."),
        "revenue_too_large": revenue > revenue_most,
        "negative_debt_ratio": debt < 0,
        "extreme_debt_ratio": debt > debt_most,
    }
    found = F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in rules.items())))
    return F.when(F.coalesce(size, F.lit(0)) == 0, F.array(F.lit("empty"))).otherwise(found)
