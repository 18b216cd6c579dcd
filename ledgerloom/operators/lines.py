"""Chunks by the kind of lines: numeric rows and the labels beside them form tables, the rest is narrative.

Each line of a text becomes one letter, so what a line is by its neighbours can be said as two replacements in a short
string: a label beside a numeric line becomes part of the table, and so may the label after it, and so on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters of a line's kind.
BLANK, SECTION, NUMERIC, LABEL, ABSORBED, NARRATIVE = "BSNLMX"
_SPACES = " \t\r\f\v"


@dataclass(frozen=True)
class LineRules:
    """What opens a section, what ends a sentence, and which letters a chunk must have enough of."""

    section: str = r"^(?:[IVX]+\.|[0-9]+\.)\s*.{2,40}$|^#{1,3} .{2,40}$"
    ends: str = ".!?"
    letters: str = r"[^\W\d_]"
    title: int = 60
    least: int = 150
    table: int = 2500
    narrative: int = 900
    overlap: int = 150
    share: float = 0.12


LATIN = LineRules()
# Section openers of filings in Hangul and the ends of its sentences.
HANGUL = LineRules(
    section=r"^(?:(?:[IVX]+\.|[0-9]+\.)\s*.{2,40}$|【.{2,30}】|제\s*\d+\s*[기장편]|사\s*업\s*보\s*고\s*서|감\s*사\s*보\s*고\s*서|분\s*기\s*보\s*고\s*서|연\s*결\s*재\s*무\s*제\s*표|재\s*무\s*상\s*태\s*표"
    r"|손\s*익\s*계\s*산\s*서|포\s*괄\s*손\s*익|주\s*주\s*총\s*회|이\s*사\s*회|감\s*사\s*위\s*원|독립된\s*감사인|[가나다라마바사아자차카타파하]\.\s*.{2,30}|\(\d+\)\s*.{2,30})",
    ends="다요음됨함임.",
    letters="[가-힣]",
)


def line_letter(line: Column, rules: LineRules = LATIN) -> Column:
    """The letter of a trimmed line by itself."""
    digits = F.length(line) - F.length(F.regexp_replace(line, r"\p{Nd}", ""))
    numbers, gaps = F.regexp_count(line, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*%?")), F.regexp_count(line, F.lit("  +"))
    numeric = (F.length(line) > 8) & (numbers >= 2) & ((digits / F.length(line) > 0.3) | (gaps >= 2))
    section = (F.length(line) < rules.title) & line.rlike(rules.section)
    return F.when(line == "", BLANK).when(section, SECTION).when(numeric, NUMERIC).when((F.length(line) <= 30) & (digits <= 3), LABEL).otherwise(NARRATIVE)


def absorbed(letters: Column) -> Column:
    """Labels that belong to a table: the nearest filled line, at most three lines on, is numeric, or the nearest before
    is numeric or itself such a label. Sections part."""
    ahead = F.regexp_replace(letters, f"{LABEL}(?={BLANK}{{0,2}}{NUMERIC})", ABSORBED)
    return F.regexp_replace(ahead, rf"(\G(?!^)|[{NUMERIC}{ABSORBED}])({BLANK}{{0,2}}){LABEL}", f"$1$2{ABSORBED}")


def tagged_lines(docs: DataFrame, rules: LineRules = LATIN, *keep: str, text_col: str = "text") -> DataFrame:
    """``keep`` columns, lines (trimmed), letters (one a line, in order). A null text has no lines. Row by row, no shuffle."""
    lines = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_SPACES)))
    cut = docs.select(*keep, lines.alias("lines"))
    return cut.select(*keep, "lines", absorbed(F.array_join(F.transform("lines", lambda x: line_letter(x, rules)), "")).alias("letters"))


def table_chunks(prefix: str, table: str, rules: LineRules) -> Iterator[str]:
    """A table whole up to 1.2 times the target; else rows filled up to the target, each part under the first two rows if there are more than four."""
    if len(prefix) + len(table) <= rules.table * 1.2:
        yield prefix + table
        return
    rows = table.split("\n")
    head = prefix + "".join(f"{r}\n" for r in rows[:2]) if len(rows) > 4 else prefix
    part = head
    for row in rows[2:] if len(rows) > 4 else rows:
        if len(part) + len(row) > rules.table:
            yield part.strip()
            part = head
        part += f"{row}\n"
    yield part.strip()


def narrative_chunks(prefix: str, text: str, rules: LineRules) -> Iterator[str]:
    """Sentences filled up to the target; the next chunk begins with the last sentence when that is shorter than the overlap."""
    end = f"(?<=[{re.escape(rules.ends)}])"
    part, last = prefix, ""
    for sentence in filter(lambda s: len(s) >= 5, map(str.strip, re.split(rf"{end}\s*\n|{end}\s{{2,}}|\n\s*\n", text))):
        if len(part) + len(sentence) > rules.narrative:
            yield part.strip()
            part = prefix + (f"{last}\n" if last and len(last) < rules.overlap else "")
        part += f"{sentence}\n"
        last = sentence
    yield part.strip()


def chunks_of(lines: list[str], letters: str, name: str, rules: LineRules) -> Iterator[tuple[str, str, str]]:
    """(section, kind, chunk) of a text's tagged lines: of each section its tables, then its narrative."""
    title, at = "", 0
    bounds = [*(i for i, c in enumerate(letters) if c == SECTION), len(lines)]
    for end in bounds:
        prefix = "".join(f"{x}\n" for x in (" ".join(filter(None, (f"[{name}]" if name else "", title))),) if x)
        blocks: list[tuple[bool, str]] = []
        filled = [k for k in range(at, end) if letters[k] != BLANK]
        for table, run in groupby(filled, key=lambda k: letters[k] in NUMERIC + ABSORBED):
            own = list(run)
            blocks.append((table, "\n".join(lines[own[0] : own[-1] + 1])))
        for table, block in blocks:
            if table and len(prefix) + len(block) >= rules.least:
                yield from ((title, "table", c) for c in table_chunks(prefix, block, rules))
        narrative = "\n".join(b for table, b in blocks if not table)
        if narrative.strip():
            yield from ((title, "narrative", c) for c in narrative_chunks(prefix, narrative, rules))
        if end < len(lines):
            title, at = lines[end], end + 1


def worth_keeping(chunk: str, rules: LineRules) -> bool:
    """Long enough, with enough letters under its first line if that names the document, and not of figures alone."""
    body = re.sub(r"^\[.*?\]\s*.*?\n", "", chunk, count=1)
    visible = re.sub(r"\s", "", body)
    return len(chunk) >= rules.least and len(visible) > 0 and len(re.findall(rules.letters, visible)) / len(visible) >= rules.share and re.fullmatch(r"[\d\s,.\-–—:/|%\[\]()]+", body) is None


def line_chunks(docs: DataFrame, rules: LineRules = LATIN, name_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, idx, section, kind, chunk: tables with their header repeated, narrative with an overlap, each under the name and section.

    Texts shorter than the least chunk and null ones give none; null and repeated ids each give their row's chunks. Lines
    are tagged by expressions; only filling chunks, which goes by what was filled before, runs in Python, a row at a time.
    """
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("")) if name_col else F.lit("")
    rows = docs.filter(F.length(text_col) >= rules.least).select(F.col(id_col).alias("id"), name.alias("name"), F.col(text_col).alias("text"))
    tagged = tagged_lines(rows, rules, "id", "name")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, called, lines, letters in zip(b["id"], b["name"], b["lines"], b["letters"], strict=True):
                kept = [c for c in chunks_of(list(lines), letters, called, rules) if worth_keeping(c[2], rules)]
                out += [(key, k, *c) for k, c in enumerate(kept)]
            yield pd.DataFrame(out, columns=["id", "idx", "section", "kind", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return tagged.mapInPandas(run, f"id {kind}, idx int, section string, kind string, chunk string").withColumnRenamed("id", id_col)
