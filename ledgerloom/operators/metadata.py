"""Who a document is about and what it says of itself: candidates scored by label and by line, fields anchored in a page."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


@dataclass(frozen=True)
class NameRules:
    """Patterns of labels with their points, of names in a line, and words that speak for or against a name."""

    labels: Sequence[tuple[str, int]]
    names: Sequence[str]
    marks: Sequence[str]
    against: Sequence[str] = ()
    section: str = r"^(?:[IVX]+\.|[0-9]+\.)\s*\S"
    letters: str = r"\p{L}"


LATIN = NameRules(
    labels=tuple((rf"(?i){label}\s*[:：]\s*(.+?)(?:\s{{2,}}|\n|$)", n) for label, n in (("company name", 10), ("company", 9), ("issuer", 8), ("filer", 8), ("submitted by", 7))),
    names=(r"[A-Z][\w&.\-]*(?: [A-Z&][\w&.\-]*)* (?:Inc|Ltd|Corp|GmbH|Co|SA|AG)\b\.?",),
    marks=("Inc", "Ltd", "Corp", "GmbH", " Co", " SA", " AG"),
    against=("total", "balance sheet", "notes to"),
)
# Labels of filings in Hangul with their points, shapes of company names, and their marks.
HANGUL = NameRules(
    labels=tuple((rf"{label}\s*[:：]\s*(.+?)(?:\s{{2,}}|\n|$)", n) for label, n in (("회사명", 10), ("법인명", 10), ("상호", 9), ("상호명", 9), ("발행회사", 8), ("제출인", 8), ("신고인", 7), ("발행인", 7), (r"회사의\s*명칭", 9))),
    names=(r"주식회사\s+[가-힣A-Za-z0-9&().\-\s]+", r"[가-힣A-Za-z0-9&().\-\s]+\s*주식회사", r"\(주\)\s*[가-힣A-Za-z0-9&().\-\s]+", r"[가-힣A-Za-z0-9&().\-\s]+㈜"),
    marks=("주식회사", "(주)", "㈜"),
    against=("재무상태표", "손익계산서", "감사보고서"),
    letters="[가-힣]",
)


def _has(text: Column, words: Sequence[str]) -> Column:
    return F.greatest(F.lit(False), F.lit(False), *(F.contains(text, F.lit(w)) for w in words))


def label_candidate(head: Column, rules: NameRules) -> Column:
    """struct(score, name) of the best label whose value may be a name, five points over the label's own; the first of equals."""
    found = []
    for k, (pattern, points) in enumerate(rules.labels):
        raw = F.trim(F.substring(F.trim(F.regexp_extract(head, pattern, 1)), 1, 50))
        fits = (raw != "") & ~raw.rlike(r"^\p{Nd}+$") & ~raw.rlike(rules.section) & ~_has(raw, rules.against) & raw.rlike(rules.letters)
        found.append(F.when(fits, F.struct(F.lit(points + 5).alias("score"), F.lit(-k).alias("order"), raw.alias("name"))))
    return F.array_max(F.array_compact(F.array(*found)))


def line_score(line: Column, at: Column, rules: NameRules) -> Column:
    """Points of a line: 5 for a mark of a company, 3 among the first eighty, 2 for a fair length, less 2 if long, 8 for words against it, 4 for a number in front, 10 for a section's title."""
    when = lambda cond, n: F.when(cond, n).otherwise(0)
    long = F.length(line)
    return when(_has(line, rules.marks), 5) + when(at < 80, 3) + when(long.between(3, 40), 2) - when(long > 80, 2) - when(line.rlike(rules.section), 10) - when(_has(line, rules.against), 8) - when(line.rlike(r"^\p{Nd}+\.\s*"), 4)


def line_candidate(head: Column, rules: NameRules, least: int = 3) -> Column:
    """struct(score, order, name) of the best line that holds a name; the first of equals; null under ``least`` points."""
    lines = F.filter(F.transform(F.split(head, r"\r?\n"), T.squeezed), lambda x: x != "")

    def name(line: Column) -> Column:
        picked = [F.trim(F.regexp_extract(line, p, 0)) for p in rules.names]
        return F.coalesce(*(F.when(F.length(x).between(2, 50), x) for x in picked))

    scored = F.transform(lines, lambda x, k: F.when(~x.rlike(rules.section) & ~_has(x, rules.against) & name(x).isNotNull(), F.struct(line_score(x, k, rules).alias("score"), (-k).alias("order"), name(x).alias("name"))))
    best = F.array_max(F.array_compact(scored))
    return F.when(best["score"] >= least, best)


def document_names(docs: DataFrame, rules: NameRules = LATIN, label_head: int = 5000, line_head: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, name, kind, score, line, confidence: who a document is about.

    A label's value comes first (0.9), then the best line by points (0.7 from 5 points, else 0.5). Names stand at the head
    of a filing, so labels are sought in its first ``label_head`` characters and lines in ``line_head``. Documents without
    a candidate, null and empty texts have null in all but the id. Every row is judged for itself; no shuffle.
    """
    found = docs.select(F.col(id_col), label_candidate(F.substring(text_col, 1, label_head), rules).alias("label"), line_candidate(F.substring(text_col, 1, line_head), rules).alias("line"))
    by_label = F.col("label").isNotNull()
    kind = F.when(by_label, "label").when(F.col("line").isNotNull(), "line")
    sure = F.when(by_label, 0.9).when(F.col("line.score") >= 5, 0.7).when(F.col("line").isNotNull(), 0.5)
    at = F.when(~by_label, -F.col("line.order"))
    return found.select(id_col, F.coalesce("label.name", "line.name").alias("name"), kind.alias("kind"), F.coalesce("label.score", "line.score").alias("score"), at.alias("line"), sure.alias("confidence"))


def anchored_fields(docs: DataFrame, fields: Mapping[str, Sequence[tuple[str, float]]], valid: Mapping[str, Callable[[Column], Column]] | None = None, head: int = 3000, page_break: str = "\f", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, field, value, source_text, source_page, confidence: of each field the surest pattern that is found and valid.

    Of equal confidence the first pattern counts. The page is the first that holds the beginning of the source text, 1
    if none does. A field that is not found has a null value and confidence 0. Row by row; no shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    top, pages = F.substring(text, 1, head), F.split(text, page_break)
    checks, structs = valid or {}, []
    for name, patterns in fields.items():
        candidates = []
        for k, (pattern, confidence) in enumerate(patterns):
            value, source = F.substring(F.trim(F.regexp_extract(top, pattern, 1)), 1, 100), F.substring(F.trim(F.regexp_extract(top, pattern, 0)), 1, 200)
            value = checks[name](value) if name in checks else value
            candidates.append(F.when((source != "") & (value != ""), F.struct(F.lit(float(confidence)).alias("confidence"), F.lit(-k).alias("order"), value.alias("value"), source.alias("source"))))
        structs.append(F.struct(F.lit(name).alias("field"), F.array_max(F.array_compact(F.array(*candidates))).alias("best")))
    each = docs.select(F.col(id_col), pages.alias("_pages"), F.explode(F.array(*structs)).alias("_f"))
    start = F.substring("_f.best.source", 1, 50)
    page = F.array_position(F.transform("_pages", lambda p: F.contains(p, start)), F.lit(True))
    return each.select(id_col, F.col("_f.field").alias("field"), F.col("_f.best.value").alias("value"), F.col("_f.best.source").alias("source_text"), F.when(F.col("_f.best").isNotNull(), F.greatest(page, F.lit(1).cast("long"))).alias("source_page"), F.coalesce("_f.best.confidence", F.lit(0.0)).alias("confidence"))
