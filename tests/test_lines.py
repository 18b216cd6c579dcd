"""Row-local cell facts and the line-tagging chunker against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import cells, lines
from ledgerloom.plans import line_queries

SF = "/root/testdata/sf0.001"


def test_cell_facts_are_of_rows_not_of_ids(spark):
    text = "단위: 백만\n매출액\n12,345\n영업이익\n(2,000)"
    rows = [(None, text), (None, text), (7, text), (7, text.replace("12,345", "900,000").replace("백만", "천")), (8, None), (9, "")]
    got = sorted((r.doc_id is not None, r.doc_id, r.metric, r.value) for r in cells.cell_facts(spark.createDataFrame(rows, "doc_id long, text string"), cells.HANGUL).collect())
    assert [x for x in got if not x[0]] == [(False, None, "operating_profit", -2e9)] * 2 + [(False, None, "revenue", 1.2345e10)] * 2
    assert [x[2:] for x in got if x[0]] == [("operating_profit", -2e9), ("revenue", 9e8), ("revenue", 1.2345e10)]  # two million won of profit are out of range


def test_cell_facts_shuffle_nothing(spark):
    plan = cells.cell_facts(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def _by_rule(letters):
    """Labels beside numeric lines, one line after another, each decision seen by the next."""
    now = list(letters)

    def nearest(k, step):
        for i in range(k + step, k + 4 * step, step):
            if not 0 <= i < len(now) or now[i] == "S":
                return None
            if now[i] != "B":
                return now[i]

    for k, c in enumerate(now):
        if c == "L" and (nearest(k, 1) == "N" or nearest(k, -1) in ("N", "M")):
            now[k] = "M"
    return "".join(now)


def test_absorption_equals_the_rule_line_by_line(spark):
    every = ["".join(p) for n in range(1, 7) for p in itertools.product("BNLX", repeat=n)]
    rng = random.Random(1)
    every += ["".join(rng.choice("BBLLLNSX") for _ in range(60)) for _ in range(500)]
    got = spark.createDataFrame([(x,) for x in every], "s string").select("s", lines.absorbed(F.col("s")).alias("got")).collect()
    assert len(got) == len(every) and all(r.got == _by_rule(r.s) for r in got)


def _brute_chunks(text, name, r):
    """Another writing of the chunker: lists and flags, no letters."""
    if text is None or len(text) < r.least:
        return []
    sections, title, held = [], "", []
    for line in (x.strip(" \t\r\f\v") for x in text.split("\n")):
        if line and len(line) < r.title and re.search(r.section, line):
            sections.append((title, held))
            title, held = line, []
        else:
            held.append(line)
    sections.append((title, held))
    out = []
    for title, body in sections:
        kinds = []
        for line in body:
            digits, tokens = sum(c.isdecimal() for c in line), len(re.findall(r"\d+(?:[.,]\d+)*%?", line))
            if not line:
                kinds.append("B")
            elif len(line) > 8 and tokens >= 2 and (digits / len(line) > 0.3 or len(re.findall("  +", line)) >= 2):
                kinds.append("N")
            else:
                kinds.append("L" if len(line) <= 30 and digits <= 3 else "X")
        kinds = _by_rule("".join(kinds))
        blocks, kind, block = [], None, []
        for line, k in zip(body, kinds, strict=True):
            now = None if k == "B" else k in "NM"
            if now is None:
                if block:
                    block.append("")
                continue
            if kind is not None and now != kind:
                blocks.append((kind, "\n".join(block).strip()))
                block = []
            kind = now
            block.append(line)
        if block:
            blocks.append((kind, "\n".join(block).strip()))
        label = f"[{name}]" if name else ""
        prefix = f"{label} {title}\n" if label and title else f"{label or title}\n" if label or title else ""
        for is_table, block in blocks:
            if not is_table or len(prefix + block) < r.least:
                continue
            if len(prefix + block) <= r.table * 1.2:
                out.append((title, "table", prefix + block))
                continue
            rows = block.split("\n")
            head, data = (rows[:2], rows[2:]) if len(rows) > 4 else ([], rows)
            now = lead = prefix + "".join(x + "\n" for x in head)
            for row in data:
                if len(now) + len(row) > r.table:
                    out.append((title, "table", now.strip()))
                    now = lead + row + "\n"
                else:
                    now += row + "\n"
            out.append((title, "table", now.strip()))
        text_of = "\n".join(b for t, b in blocks if not t)
        if not text_of.strip():
            continue
        now, last = prefix, ""
        for s in re.split(r"(?<=[.!?])\s*\n|(?<=[.!?])\s{2,}|\n\s*\n", text_of):
            s = s.strip()
            if len(s) < 5:
                continue
            if len(now) + len(s) > r.narrative:
                out.append((title, "narrative", now.strip()))
                now = prefix + last + "\n" + s + "\n" if 0 < len(last) < r.overlap else prefix + s + "\n"
            else:
                now += s + "\n"
            last = s
        out.append((title, "narrative", now.strip()))

    def fine(chunk):
        body = re.sub(r"^\[.*?\]\s*.*?\n", "", chunk, count=1)
        seen = [c for c in body if not c.isspace()]
        return len(chunk) >= r.least and seen and sum(c.isalpha() for c in seen) / len(seen) >= r.share and not re.match(r"^[\d\s,.\-–—:/|%\[\]()]+$", body)

    return [c for c in out if fine(c[2])]


def test_line_chunks_equal_brute_force(spark):
    docs = line_queries.filings(spark, SF).withColumn("name", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("No "), F.col("doc_id"))))
    rules = lines.LineRules(table=160, narrative=400)
    for r in (lines.LATIN, rules):
        got = {}
        for row in lines.line_chunks(docs, r, "name").orderBy("doc_id", "idx").collect():
            got.setdefault(row.doc_id, []).append((row.section, row.kind, row.chunk))
        want = {d.doc_id: c for d in docs.collect() if (c := _brute_chunks(d.text, d.name or "", r))}
        assert got == want
        assert any(k == "table" for c in want.values() for _, k, _ in c)


def test_line_chunks_edges(spark):
    table = "\n".join(["Item and amount", "Number  Quantity  Price"] + [f"row {k}  {k * 7}  {k * 1001}" for k in range(200)])
    long = "no sentence end here " * 400
    rows = [(1, None), (2, ""), (3, "short"), (None, table), (4, table), (4, table), (5, long), (6, "\n" * 500), (7, "12 345\n" * 100)]
    found = lines.line_chunks(spark.createDataFrame([(i, t, "clash", "x") for i, t in rows], "doc_id long, text string, lines string, letters string")).collect()
    assert {r.doc_id for r in found} == {None, 4, 5}
    parts = [r.chunk for r in found if r.doc_id is None and r.kind == "table"]
    head, rows = "\n".join(table.split("\n")[1:3]) + "\n", table.split("\n")[3:]  # the first line has no numeric line beside it
    assert len(parts) > 1 and all(p.startswith(head) and len(p) <= 2500 for p in parts)
    assert len([r for r in found if r.doc_id == 4 and r.kind == "table"]) == 2 * len(parts)
    assert [line for p in parts for line in p[len(head) :].split("\n")] == rows


@pytest.mark.parametrize("name", ["filing_cell_facts", "tagged_lines"])
def test_queries_find_something(spark, name):
    found = line_queries.QUERIES[name](spark, SF)
    assert found.count() > 100 and ("absorbed" not in found.columns or found.filter("absorbed > 0").count() > 50)
