"""Cutting documents into chunks: paragraphs, sections with tables kept apart, keyword windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


def paragraph_chunks(docs: DataFrame, size: int = 1200, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs at blank lines, sliced every ``size`` characters, squeezed; slices under ``least`` dropped: id, para, part, chunk."""
    paras = docs.select(id_col, F.posexplode(F.split(F.col(text_col), r"\n[ \t]*\n?")).alias("para", "p")).filter("length(p) > 0")
    starts = F.sequence(F.lit(0), F.floor((F.length("p") - 1) / size).cast("int"))
    cut = paras.select(id_col, "para", F.explode(starts).alias("part"), "p").withColumn("chunk", T.squeezed(F.substr("p", F.col("part") * size + 1, F.lit(size))))
    return cut.filter(F.length("chunk") >= least).select(id_col, "para", "part", "chunk")


@dataclass(frozen=True)
class ChunkPlan:
    """Targets of the section chunker, in characters."""

    target: int = 900
    table_whole: int = 1350
    overlap: int = 120
    least: int = 80
    header: int = 60
    digit_share: float = 0.3


PLANS = {"v3": ChunkPlan(), "v5": ChunkPlan(table_whole=3000, target=900, overlap=150), "note": ChunkPlan(target=500, table_whole=700, overlap=80, least=60)}
_HEADER = re.compile(r"^(?:#{1,3} +|[IVX]+\. |[0-9]{1,2}(?:\.[0-9]{1,2})?\.? +)?\S.{0,60}$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _is_table(line: str, plan: ChunkPlan) -> bool:
    digits = sum(c.isdigit() for c in line)
    return len(line) > 10 and re.search(r"\d{3}", line) is not None and digits / len(line) > plan.digit_share or line.count("|") >= 2


def _packed(parts: list[str], joiner: str, limit: int, overlap: int) -> Iterator[str]:
    held: list[str] = []
    for p in parts:
        if held and sum(map(len, held)) + len(joiner) * len(held) + len(p) > limit:
            yield joiner.join(held)
            held = [held[-1]] if overlap and len(held[-1]) < overlap and len(held) > 1 else []
        held.append(p)
    if held:
        yield joiner.join(held)


def section_pieces(text: str | None, plan: ChunkPlan) -> list[tuple[str, str, str]]:
    """(section, kind, chunk) of one document; line logic runs in order, as earlier lines decide on later ones."""
    section, run, kind, out = "", [], None, []

    def flush():
        if run:
            whole = "\n".join(run)
            if kind == "table":
                parts = [whole] if len(whole) <= plan.table_whole else list(_packed(run, "\n", plan.target, 0))
            else:
                parts = list(_packed(_SENTENCE.split(" ".join(run)), " ", plan.target, plan.overlap))
            out.extend((section, kind, p) for p in parts if len(p) >= plan.least)
        run.clear()

    for line in (text or "").split("\n"):
        line = line.strip()
        if not line:
            continue
        if line.startswith("#") and _HEADER.match(line) and len(line) < plan.header:
            flush()
            section = line.lstrip("# ")
            continue
        now = "table" if _is_table(line, plan) else "text"
        if now != kind:
            flush()
            kind = now
        run.append(line)
    flush()
    return out


def section_chunks(docs: DataFrame, plan: ChunkPlan = PLANS["v3"], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Section- and table-aware chunks: id, idx, section, kind, chunk. Null and empty texts give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, i, *piece) for key, text in zip(b["id"], b["text"], strict=True) for i, piece in enumerate(section_pieces(text, plan))]
            yield pd.DataFrame(rows, columns=["id", "idx", "section", "kind", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, idx int, section string, kind string, chunk string").withColumnRenamed("id", id_col)


def chunk_type(head: Column) -> Column:
    """audit, fact, note, financial or narrative by the first words that fit, in this order."""
    h = F.lower(head)
    return F.when(h.rlike("audit|opinion"), "audit").when(h.rlike("summary|fact"), "fact").when(h.rlike("note [0-9]|footnote"), "note").when(h.rlike("balance|income|cash flow"), "financial").otherwise("narrative")


def statement_scope(text: Column) -> Column:
    """consolidated, separate or unknown in the first 500 characters, spaces removed; consolidated wins."""
    head = F.lower(F.regexp_replace(F.substring(text, 1, 500), " ", ""))
    return F.when(head.contains("consolidated"), "consolidated").when(head.contains("separate"), "separate").otherwise("unknown")


def breadcrumb(*levels: Column) -> Column:
    """Non-empty levels joined by ' > '."""
    return F.array_join(F.filter(F.array(*levels), lambda x: F.coalesce(x, F.lit("")) != ""), " > ")


def embedding_text(labels: dict[str, Column], body: Column) -> Column:
    """Labelled header lines, empty values left out, and the body."""
    lines = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}: "), v.cast("string"))) for k, v in labels.items()]
    return F.concat_ws("\n", *lines, body)


def topic_tags(text: Column, lexicon: dict[str, str], most: int = 5) -> Column:
    """Tags whose pattern is found in the first 4000 characters, in the lexicon's order."""
    head = F.lower(F.substring(text, 1, 4000))
    return F.slice(F.array_compact(F.array(*(F.when(head.rlike(p), tag) for tag, p in lexicon.items()))), 1, most)


def keyword_windows(docs: DataFrame, keyword: str, reach: int = 500, apart: int = 600, most: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text around a keyword's places, each at least ``apart`` from the last taken: id, start, chunk."""
    pattern = re.compile(keyword)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"], strict=True):
                last, taken = -apart, 0
                for m in pattern.finditer(text or ""):
                    if taken < most and m.start() - last >= apart:
                        last, taken = m.start(), taken + 1
                        rows.append((key, m.start(), text[max(0, m.start() - reach) : m.end() + reach]))
            yield pd.DataFrame(rows, columns=["id", "start", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, start long, chunk string").withColumnRenamed("id", id_col)
