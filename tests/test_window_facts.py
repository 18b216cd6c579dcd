"""Amounts in sentences and columns: values known beforehand, edges, and the union of the three readers."""

import dataclasses
import random

import pytest

from ledgerloom.operators import cells, window_facts as W
from ledgerloom.plans import line_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("raw,want", [("71,839억원", 7.1839e12), ("-△ 5", -5.0), ("△1,000 천원", -1e6), ("0", None), (",", None), ("12.5조", 1.25e13), ("3백만", 3e6), ("7만", 7e4)])
def test_amounts(raw, want):
    assert W.amount(raw, W.HANGUL) == want


def test_sentences():
    text = "2025년 사업연도 동안 한빛은 매출액 71,839억원으로 전기 대비 10.2% 증가하였으며, 영업이익 약 28,540억원으로 늘었다. 매출액 1억원"
    assert W.inline_facts_of(text, W.HANGUL) == {"revenue": 7.1839e12, "operating_profit": 2.854e12}
    assert W.inline_facts_of("(단위: 백만원)\n표\n매출액: 500 당기순이익 12", W.HANGUL) == {"revenue": 5e8, "net_income": 1.2e7}
    assert W.inline_facts_of("매출액 12", W.HANGUL) == {} and W.inline_facts_of("", W.HANGUL) == {}
    assert W.inline_facts_of("Revenue of 3.5 billion usd, net loss was -2 million", W.LATIN) == {"revenue": 3.5e9, "net_income": -2e6}


@pytest.mark.parametrize(
    "text,want",
    [
        ("수익(매출액)│4,512,334,640│1,668,557,445│6,180,892,085", {"revenue": 6180892085.0}),
        ("(단위: 백만원)\n매출액│5,000│4,000\n영업이익(손실)│900", {"revenue": 5e9, "operating_profit": 9e8}),
        ("(단위: 백만원)\n매출액 (단위: 천원)│500,000", {"revenue": 5e8}),  # the row's own unit counts
        ("(단위: 백만원)\n매출액│1,000\n영업이익│700", {"revenue": 1e9}),  # a profit of seven tenths of the revenue is none
        ("(단위: 백만원)\n자산총계│1,000\n자본총계│1,000", {}),  # two metrics of one amount
        ("(단위: 백만원)\n매출액│10\n영업수익│900", {"revenue": 9e8}),  # the first label's amounts are too small
        ("(단위: 천원)\n매출액│2,000,000,000\n당기순이익│99,999", {"revenue": 2e12}),  # too small to count
        ("매출액│2,000,000,000,000│\n자산총계│2,000,000\n자본총계│150,000,000", {"revenue": 2e12}),  # what is in reach of two labels is of neither
        ("매출액증가│900,000,000", {}),
        ("", {}),
    ],
)
def test_columns(text, want):
    assert W.table_facts_of(text, W.HANGUL) == want


def test_small_amounts_are_brought_to_the_revenue():
    assert W._plausible({"revenue": 2e12, "equity": 1.5e7, "total_assets": 3e12, "total_liabilities": 1e3}) == {"revenue": 2e12, "equity": 1.5e13, "total_assets": 3e12, "total_liabilities": 1e3}


def test_the_readers_fill_each_other(spark):
    cell = "(단위: 백만원)\n매출액\n1,000"
    rows = [(1, cell + "\n영업이익│300│", "매출액 5억원"), (1, "말 뿐", "매출액 5억원"), (None, cell, None), (None, None, "순이익 3억원"), (2, "", ""), (3, "자본총계│900,000,000", "매출액 5억원")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id int, text string, clean string, facts string")
    got = sorted(((r.doc_id, r.metric, r.value, r.reader) for r in W.every_fact(df, cells.HANGUL, W.HANGUL, clean_col="clean").collect()), key=lambda t: (t[0] is not None, t))
    assert got == [
        (None, "net_income", 3e8, "sentences"), (None, "revenue", 1e9, "cells"), (1, "operating_profit", 3e8, "columns"), (1, "revenue", 5e8, "sentences"), (1, "revenue", 1e9, "cells"), (3, "equity", 9e8, "columns"),
    ]


def test_nothing_is_shuffled_and_plain_readers_agree(spark):
    docs = line_queries.filings(spark, SF)
    found = W.every_fact(docs)
    plan = W.every_fact(docs.limit(5).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_cell: dict = {}
    for r in cells.cell_facts(docs).collect():
        by_cell.setdefault(r.doc_id, {})[r.metric] = r.value
    want = set()
    for k, t in texts.items():
        own = by_cell.get(k, {})
        both = {m: (v, "cells") for m, v in own.items()} | {m: (v, "columns") for m, v in W.table_facts_of(t, W.LATIN).items() if m not in own}
        want |= {(k, m, *v) for m, v in (both or {m: (v, "sentences") for m, v in W.inline_facts_of(t, W.LATIN).items()}).items()}
    assert {(r.doc_id, r.metric, r.value, r.reader) for r in found.collect()} == want and len(want) > 100


@pytest.mark.parametrize("rules", [W.LATIN, W.HANGUL])
def test_labels_found_by_their_words_are_those_of_the_patterns(rules):
    words = ["Revenue", "SALES", "ſales", "total equity", " ", "\n", "net ıncome", "NET İNCOME", "operating loss", "total assets", "│", "| ", "1,000,000,000", "500", "(unit: million)", "수익(매출액)", "매출액", "영업이익(손실)", "순이익", "자본총계", "단위: 백만원", "x", "7 billion", "5억원", ":"]
    draw = random.Random(5)
    patterns = dataclasses.replace(rules, begins={})
    for _ in range(1500):
        text = "".join(draw.choice(words) + draw.choice(["", " "]) for _ in range(draw.randint(1, 14)))
        assert W.table_facts_of(text, rules) == W.table_facts_of(text, patterns)
        assert W.inline_facts_of(text, rules) == W.inline_facts_of(text, patterns)


def test_a_label_s_unit_is_looked_for_once(monkeypatch):
    seen, plain = [], W.unit_at
    monkeypatch.setattr(W, "unit_at", lambda *a: seen.append(a) or plain(*a))
    assert W.table_facts_of("(unit: million)\nRevenue | 500 | 400 | 300 | 200", W.LATIN) == {"revenue": 5e8} and len(seen) == 1
