"""Budgeted assembly, token windows, annotated numbers and tables with spans."""

import random
import re

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import values as V
from ledgerloom.operators import assembly
from ledgerloom.plans import line_queries
from ledgerloom.sources import html

SF = "/root/testdata/sf0.001"


def _brute_assembled(text, most, r=assembly.LATIN):
    if text is None:
        return None, None
    if len(text) <= most:
        out = f"[head]\n{text[:1000]}"
        return (out + f"\n\n[body]\n{text[1000:]}" if text[1000:].strip() else out), None
    head = text[:1000].strip(" \t\r\n\f\v")
    ranked = []
    for k, p in enumerate(re.split(r"\n\s*\n", text[1000:])):
        p = p.strip(" \t\r\n\f\v")
        if len(p) < 5:
            continue
        kind, score = "body", 0
        if any(w in p for w in r.notes):
            kind, score = "note", -5
        elif any(w in p for w in ("\t", "  ", "|")) and len(re.findall(r"[0-9,]+(?:\.[0-9]+)?", p)) >= 3:
            kind, score = "financial", 8
        score += 2 * sum(w in p.lower() for w in r.keywords) + 20 * any(w in p for w in r.first) - 10 * any(w in p for w in r.doubtful)
        ranked.append((kind == "note", -score, k, kind, p))
    if not ranked:
        return f"[head]\n{head}\n\n[body]\n{text[1000:most]}", 0
    out, used, last, n = [f"[head]\n{head}"], 0, None, 0
    for *_, kind, p in sorted(ranked):
        if used + len(p) + 30 > most - 50 - len(head):
            continue
        if kind != last:
            out.append(f"\n{r.labels[kind]}")
            last = kind
        out.append(p)
        used += len(p) + 30
        n += 1
    return "\n".join(out) + ("" if n else "\n"), n


def _documents():
    rng = random.Random(3)
    words = ["total", "Revenue", "license", "plain", "before correction", "[low quality", "1,000  2.5 3 | 4", "word", "equity"]
    texts = ["\n\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    return [(k, t) for k, t in enumerate(texts)] + [(100, None), (101, ""), (102, "x" * 5000), (102, "y"), (None, "a\n\n" * 900), (103, "h" * 1000 + "\n \n" + "z" * 1400), (104, "short\n\nbody")]


@pytest.mark.parametrize("most", [1500, 2500, 12_000])
def test_assembly_equals_brute_force(spark, most):
    rows = _documents()
    got = assembly.assembled(spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id int, text string, head string"), most).collect()
    order = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(((r.doc_id, r.assembled, r.n_taken) for r in got), key=order) == sorted(((i, *_brute_assembled(t, most)) for i, t in rows), key=order)
    assert all(len(r.assembled) <= most + 60 for r in got if r.n_taken is not None)


def test_assembly_of_filings(spark):
    docs = line_queries.filings(spark, SF)
    got = {r.doc_id: (r.assembled, r.n_taken) for r in assembly.assembled(docs, 2500).collect()}
    assert got == {r.doc_id: _brute_assembled(r.text, 2500) for r in docs.collect()}


@pytest.mark.parametrize("most,overlap", [(128, 24), (5, 0), (7, 6), (3, 2), (1, 0)])
def test_every_token_is_in_a_window_and_overlaps_are_exact(spark, most, overlap):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 40").union(spark.createDataFrame([(1000, None), (1001, " \n "), (1002, "w " * 50)], "doc_id long, text string"))
    texts = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    found = {}
    for r in assembly.token_windows(docs, most, overlap).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == {k for k, t in texts.items() if t}
    for key, windows in found.items():
        windows.sort(key=lambda r: r.idx)
        end = 0
        for r in windows:
            assert r.chunk.split() == texts[key][r.first_token : r.first_token + r.n_tokens] and r.n_tokens <= most
            assert r.first_token + r.shared_tokens == end and r.shared_tokens <= min(overlap, end)
            end = r.first_token + r.n_tokens
        assert end == len(texts[key])


def test_windows_begin_with_what_they_share():
    assert list(assembly.windows_of([3, 3, 3, 3], 6, 3)) == [(0, 2, 0), (1, 3, 1), (2, 4, 1)]
    assert list(assembly.windows_of([5, 1, 6], 6, 2)) == [(0, 2, 0), (2, 3, 0)]  # sharing would leave no room
    assert list(assembly.windows_of([], 6, 2)) == []


@pytest.mark.parametrize(
    "text,unit,want",
    [
        ("up (1,234) to 5.5", "million", "up (1,234)[=-1.2 billion] to 5.5[=5.5 million]"), ("a, b", "thousand", "a, b"), ("7", "", "7"), ("7", None, "7"), (None, "thousand", None),
        ("", "thousand", ""), ("no number", "thousand", "no number"), ("12", "unknown", "12[=12]"), ("1,2", "thousand", "1,2[=12,000]"),
    ],
)
def test_annotated_numbers(spark, text, unit, want):
    df = spark.createDataFrame([(text, unit)], "t string, u string")
    assert df.select(V.annotated_numbers(F.col("t"), F.col("u"))).head()[0] == want


@pytest.mark.parametrize(
    "rows,want",
    [
        ([[("a", 2, 1), ("b", 1, 1)], [("c", 1, 1)]], [["a", "a", "b"], ["c"]]),
        ([[("a", 1, 2), ("b", 1, 1)], [("c", 1, 1)], [("d", 1, 1)]], [["a", "b"], ["a", "c"], ["d"]]),
        ([[("a", 1, 1), ("b", 1, 3)], [("c", 1, 1)], []], [["a", "b"], ["c", "b"], ["", "b"]]),
        ([[("a", 2, 2)], [("c", 2, 1)]], [["a", "a"], ["a", "a", "c", "c"]]),
        ([], []),
    ],
)
def test_spans_are_laid_out(rows, want):
    assert html.grid(rows) == want


def test_page_tables_on_odd_pages(spark):
    pages = [
        (1, None), (2, ""), (3, "<table></table>"), (4, "<table><tr><td>only | one"), (None, "<TABLE><TR><TH COLSPAN='2'>a<TD>b</TR><tr><td colspan=x>c <b>d</b>\n e</td></tr></TABLE>"),
        (5, "<table><tr><td>out<table><tr><td>in</table></td><td>z</td></tr></table>"), (5, "<td>no table</td>"),
    ]
    got = [(r.page_id, r.idx, r.n_rows, r.n_columns, r.markdown) for r in html.page_tables(spark.createDataFrame(pages, "page_id int, html string")).collect()]
    assert sorted(got, key=lambda t: (t[0] is not None, t)) == [
        (None, 0, 2, 3, "| a | a | b |\n| --- | --- | --- |\n| c d e |  |  |"), (4, 0, 1, 1, "| only \\| one |\n| --- |"), (5, 0, 1, 1, "| in |\n| --- |"), (5, 1, 1, 2, "| out | z |\n| --- | --- |"),
    ]


def test_tables_read_tag_by_tag_are_those_of_the_parser():
    bits = ["<table>", "</table>", "<TR>", "</tr>", "<td>", "<td colspan=2>", "<td rowspan='3'>", "</td>", "a &amp; b", "&lt", "x|y", " \n ", "<p>", "<br/>", "<td", "<!-- c -->", "<script>", "</script>", "<td a=b=c>", "&", "<", "<td x='&amp;'>", "&#65", "<td colspan>"]
    draw, fed = random.Random(7), 0
    for k in range(4000):
        page = "<table><tr><td>" + "".join(draw.choice(bits[:13] if k % 2 else bits) for _ in range(draw.randint(0, 14)))
        plain = html._TableReader()
        plain.feed(page)
        plain.close()
        reader = html._TableReader()
        reader.feed = lambda page, reader=reader: (reader.__dict__.setdefault("fed", True), html.HTMLParser.feed(reader, page))
        assert reader.read(page) == plain.finish()
        fed += hasattr(reader, "fed")
    assert 500 < fed < 2500  # the others went without the parser


def test_a_span_in_raised_digits_is_none():
    assert html._TableReader().read("<table><td colspan=²>a</table>") == [[[("a", 1, 1)]]]
