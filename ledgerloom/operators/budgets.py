"""Chunks within budgets by kind: tables that repeat their header, narrative with an overlap, long documents by paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    target: int
    cap: int
    overlap: int = 0


# Target, cap and overlap in characters by kind of chunk; the least chunk.
BUDGETS = {
    "narrative": Budget(800, 1200, 100), "financial_table": Budget(1800, 2800), "note_table": Budget(500, 700),
    "note_narrative": Budget(500, 700, 80), "audit_opinion": Budget(1800, 3500), "fact_summary": Budget(300, 400),
}
LEAST = 150
_TOTAL = re.compile(r"합계|소계|계\b|\btotal\b|\bsum\b", re.IGNORECASE)


def table_parts(rows: list[str], budget: Budget) -> list[list[str]]:
    """Rows of a table in parts, each with the header first; a total row stays with the rows before it, even past the cap."""
    if len(rows) < 2:
        return []
    header, *data = rows
    parts, size = [[]], len(header)
    for row in data:
        if parts[-1] and size + len(row) + 1 > budget.cap and not _TOTAL.search(row):
            parts.append([])
            size = len(header)
        parts[-1].append(row)
        size += len(row) + 1
    return [[header, *p] for p in parts]


def _within(paragraph: str, cap: int) -> Iterator[str]:
    """A paragraph in pieces of at most ``cap``, cut after a sentence, line or word in the second half."""
    while len(paragraph) > cap:
        ends = (paragraph.rfind(mark, cap // 2, cap) + len(mark) for mark in (". ", "\n", " ") if paragraph.rfind(mark, cap // 2, cap) > 0)
        cut = next(ends, cap)
        yield paragraph[:cut].strip()
        paragraph = paragraph[cut:].strip()
    if paragraph:
        yield paragraph


def narrative_parts(text: str, budget: Budget) -> list[tuple[str, str]]:
    """(carried over, body) of each part: whole up to the cap, else paragraphs packed to the target, each part after the tail of the last."""
    if len(text) <= budget.cap:
        return [("", text)] if text else []
    bodies, held, size = [], [], 0
    for p in (piece for para in re.split(r"\n{2,}", text) for piece in _within(para, budget.cap)):
        if held and size + len(p) + 2 > budget.target:
            bodies.append("\n\n".join(held))
            held, size = [], 0
        held.append(p)
        size += len(p) + 2
    if held:
        bodies.append("\n\n".join(held))
    tails = ["", *(b[-budget.overlap :] if budget.overlap else "" for b in bodies[:-1])]
    return list(zip(tails, bodies, strict=True))


def sections(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(title, subtitle, kind, content) by ``##`` and ``###`` headings; tables stand between [TABLE] and [/TABLE] lines."""
    title = subtitle = ""
    held: list[str] = []

    def closed(kind: str):
        if any(line.strip() for line in held):
            yield title, subtitle, kind, "\n".join(held).strip("\n")
        held.clear()

    inside = False
    for line in text.split("\n"):
        if line == "[TABLE]" or line == "[/TABLE]":
            yield from closed("table" if inside else "text")
            inside = line == "[TABLE]"
        elif not inside and re.match(r"#{2,3} ", line):
            yield from closed("text")
            title, subtitle = (title, line[4:].strip()) if line.startswith("###") else (line[3:].strip(), "")
        else:
            held.append(line)
    yield from closed("table" if inside else "text")


def kind_of(title: str, table: bool) -> str:
    """audit_opinion, fact_summary, note, financial table or narrative by the section's title."""
    low = re.sub(r"\s+", "", title.lower())
    if re.search("audit|감사보고서|감사의견|검토보고서|내부회계", low):
        return "audit_opinion"
    if re.search("cover|overview|summary|표지|회사의개요|핵심투자위험|요약재무", low):
        return "fact_summary"
    if re.search("note|주석", low):
        return "note_table" if table else "note_narrative"
    if table and re.search("statement|balance|income|cashflow|재무상태표|손익|자본변동표|현금흐름표|재무제표|연결재무|별도재무", low):
        return "financial_table"
    return "narrative"


def _letters(text: str) -> float:
    visible = re.sub(r"\s+", "", text)
    return sum(map(str.isalpha, visible)) / len(visible) if visible else 0.0


def chunks_of(text: str | None, name: str, least: int = LEAST, letters: float = 0.12) -> list[tuple[str, str, str, bool, str]]:
    """(title, subtitle, kind, table, chunk) of one document; chunks begin with name and titles; short ones and such of few letters are left out."""
    out = []
    for title, subtitle, kind, content in sections(text or ""):
        table = kind == "table"
        what = kind_of(title, table)
        crumb = " > ".join(filter(None, (f"[{name}]", title, subtitle)))
        if table:
            bodies = ["[TABLE]\n" + "\n".join(p) + "\n[/TABLE]" for p in table_parts(content.split("\n"), BUDGETS[what])]
        else:
            bodies = [(f"...{tail}\n" if tail else "") + body for tail, body in narrative_parts(content, BUDGETS[what])]
        out += [(title, subtitle, what, table, f"{crumb}\n{b}") for b in bodies if len(crumb) + 1 + len(b) >= least and _letters(b) >= letters]
    return out


def budgeted_chunks(docs: DataFrame, name_col: str, least: int = LEAST, letters: float = 0.12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, idx, title, subtitle, kind, has_table, chunk; null and empty texts give none. A document is cut by itself, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, i, *c) for key, name, text in zip(b["id"], b["name"], b["text"], strict=True) for i, c in enumerate(chunks_of(text, name or "", least, letters))]
            yield pd.DataFrame(rows, columns=["id", "idx", "title", "subtitle", "kind", "has_table", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(name_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, idx int, title string, subtitle string, kind string, has_table boolean, chunk string").withColumnRenamed("id", id_col)


def long_splits(docs: DataFrame, size: int = 12_000, joiner: str = "\n\n", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, part, piece: paragraphs packed up to ``size`` characters, separators counted; a longer paragraph stands alone.

    A native fold over the paragraphs that keeps where pieces begin; the pieces are put together once, at the end.
    """
    paragraphs = F.filter(F.split(text_col, r"\n[ \t]*\n"), lambda p: F.trim(p) != "")
    cut = docs.select(F.col(id_col), paragraphs.alias("_p"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("starts"), F.lit(1).alias("k"))

    def step(a, p):
        together = a["used"] + len(joiner) + F.length(p)
        fits = (F.size(a["starts"]) > 0) & (together <= size)
        return F.struct(F.when(fits, together).otherwise(F.length(p)).alias("used"), F.when(fits, a["starts"]).otherwise(F.array_append(a["starts"], a["k"])).alias("starts"), (a["k"] + 1).alias("k"))

    begun = cut.select("*", F.aggregate("_p", start, step)["starts"].alias("_s"))
    piece = lambda s, k: F.array_join(F.slice("_p", s, F.coalesce(F.get("_s", k + 1), F.size("_p") + 1) - s), joiner)
    return begun.select(id_col, F.posexplode_outer(F.transform("_s", piece)).alias("part", "piece")).filter("part IS NOT NULL")
