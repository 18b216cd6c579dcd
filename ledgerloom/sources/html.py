"""Text and parts of HTML pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCKS = frozenset("p div li ul ol br tr table h1 h2 h3 h4 h5 h6 article section header footer nav title td th".split())
_SKIPPED = frozenset(("script", "style", "noscript"))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.held, self.depth = [], [], 0

    def flush(self):
        line = re.sub(r"\s+", " ", "".join(self.held)).strip()
        if line:
            self.lines.append(line)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in _SKIPPED:
            self.depth += 1
        elif tag in _BLOCKS:
            self.flush()

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.depth = max(0, self.depth - 1)
        elif tag in _BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.depth:
            self.held.append(data)


def visible_lines(html: str | None) -> list[str]:
    """Visible text of a page, a line a block; broken mark-up is read as far as it goes."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.lines


def page_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id and visible text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "text": ["\n".join(visible_lines(h)) for h in b["html"]]})

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInPandas(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def count_tags(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(f"<{tag}[ >]"))


# Tags as HTMLParser reads them whatever stands around them: plain names, and attributes without entities or angles.
_TAG = re.compile(r"""(<(?:/[a-zA-Z][a-zA-Z0-9]*|[a-zA-Z][a-zA-Z0-9]*(?:[ \t\n\r\f]+[a-zA-Z]+(?:=(?:"[^"<>&]*"|'[^'<>&]*'|[^\s"'<>=&/`]+))?)*)[ \t\n\r\f]*>)""")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())  # text after these may be read otherwise


@lru_cache(4096)
def _span(attrs: tuple) -> tuple[int, int]:
    """Columns and rows that a cell takes."""
    found = dict(attrs)
    size = lambda name: max(1, min(int(v), 1000)) if (v := found.get(name) or "").isdecimal() else 1
    return size("colspan"), size("rowspan")


class _TagReader(HTMLParser):
    def handle_starttag(self, tag, attrs):
        self.found = (False, tag, attrs)

    def handle_endtag(self, tag):
        self.found = (True, tag, None)


@lru_cache(4096)
def _tag(written: str) -> tuple | None:
    """Whether a tag ends, its name and attributes; null for one after which text is no plain text."""
    reader = _TagReader()
    reader.feed(written)
    return None if reader.found[1] in _RAW else reader.found


class _TableReader(HTMLParser):
    """Tables of a page as rows of (text, columns, rows) cells; a table inside a cell is a table of its own and leaves the cell empty there."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open = [], []  # of each open table: rows, held text or None, spans

    def read(self, page: str) -> list:
        """The page's tables; tag by tag where all tags are plain, else, as with broken mark-up, through HTMLParser."""
        pieces = _TAG.split(page)
        tags = [_tag(t) for t in pieces[1::2]]
        if page.count("<") != len(tags) or None in tags:
            self.feed(page)
            self.close()
            return self.finish()
        for text, (ends, name, attrs) in zip(pieces[::2], tags, strict=False):
            if text and self.open:
                self.handle_data(unescape(text))
            if ends:
                self.handle_endtag(name)
            else:
                self.handle_starttag(name, attrs)
        if pieces[-1]:
            self.handle_data(unescape(pieces[-1]))
        return self.finish()

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"rows": [], "held": None, "span": (1, 1)})
        elif self.open and tag == "tr":
            self._close_cell()
            self.open[-1]["rows"].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            self.open[-1]["held"], self.open[-1]["span"] = [], _span(tuple(attrs)) if attrs else (1, 1)

    def handle_endtag(self, tag):
        if self.open and tag in ("td", "th", "tr"):
            self._close_cell()
        elif self.open and tag == "table":
            self._close_table()

    def handle_data(self, data):
        if self.open and self.open[-1]["held"] is not None:
            self.open[-1]["held"].append(data)

    def _close_cell(self):
        now = self.open[-1]
        if now["held"] is not None:
            if not now["rows"]:
                now["rows"].append([])
            now["rows"][-1].append((" ".join("".join(now["held"]).split()), *now["span"]))
            now["held"] = None

    def _close_table(self):
        self._close_cell()
        self.tables.append(self.open.pop()["rows"])

    def finish(self) -> list:
        while self.open:
            self._close_table()
        return self.tables


def grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells laid out: a cell's text stands in every column and row it spans; what no cell reaches is empty."""
    out, held = [], {}  # column -> (text, rows still to fill)
    for cells in rows:
        line, at = [], 0
        waiting = cells[::-1]
        reach = max(held, default=-1)  # what this row holds on to lies before ``at``
        while waiting or at <= reach:
            if at in held:
                text, left = held.pop(at)
                line.append(text)
                if left > 1:
                    held[at] = (text, left - 1)
                at += 1
            elif waiting:
                text, wide, high = waiting.pop()
                for _ in range(wide):
                    if at in held:  # cells from above stay where they are
                        break
                    line.append(text)
                    if high > 1:
                        held[at] = (text, high - 1)
                    at += 1
            else:
                line.append("")
                at += 1
        out.append(line)
    return out


def markdown(rows: list[list[str]]) -> str:
    """A grid as Markdown, its first row the header; rows without text are left out, short ones filled up."""
    wide = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([c.replace("|", r"\|") for c in r] + [""] * (wide - len(r))) + " |" for r in rows if any(r)]
    return "\n".join([*lines[:1], *(["| " + " | ".join(["---"] * wide) + " |"] if lines else []), *lines[1:]])


def page_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, idx, n_rows, n_columns, markdown: the tables of each page that hold any text, in order of their ends, spans laid out.

    Broken mark-up is read as far as it goes; null and empty pages have no tables; a page is read for itself, no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, html in zip(b["id"], b["html"], strict=True):
                grids = [g for g in map(grid, _TableReader().read(html or "")) if any(map(any, g))]
                out += [(key, k, len(g), max(map(len, g)), markdown(g)) for k, g in enumerate(grids)]
            yield pd.DataFrame(out, columns=["id", "idx", "n_rows", "n_columns", "markdown"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(run, f"id {kind}, idx int, n_rows int, n_columns int, markdown string").withColumnRenamed("id", id_col)
