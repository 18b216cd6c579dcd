"""Table cells, budgeted chunks, cleaning rules and filters on literals and against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cleaning as K
from ledgerloom.operators import budgets, cells, filters, quality, search
from ledgerloom.sources import archives

SF = "/root/testdata/sf0.001"


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values)))
    return row.select(make(*(F.col(f"c{i}") for i in range(len(values)))).alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("cell,value", [("1,234", 1234.0), ("(1,234)", -1234.0), ("△ 55", -55.0), ("-7.5", -7.5), ("12 (주3)", 12.0), ("9 *2", 9.0), ("12%", None), ("", None), ("abc", None), ("1.2.3", None), (None, None)])
def test_cell_numbers(spark, cell, value):
    assert one(spark, cells.cell_number, cell) == value


@pytest.mark.parametrize("cell,metric", [("매출액", "revenue"), ("II. 영업이익(손실)", "operating_profit"), ("가. 자본총계 (주1)", "equity"), ("1) 매출액", "revenue"), ("매출액 증가", None), ("", None)])
def test_label_cells(spark, cell, metric):
    assert one(spark, lambda c: cells.label_metric(c, cells.HANGUL_LABELS), cell) == metric


def test_cell_facts_on_literals(spark):
    lines = {
        "unit applies": ("(단위 : 백만원)", "1. 매출액", "", "12,345", "11,000", "영업이익", "(2,000)"),
        "first of a metric": ("단위: 천원", "매출액", "500,000", "매출", "900,000"),
        "a word between": ("단위: 백만원", "매출액", "해당없음", "5,000"),
        "shared amounts": ("단위: 백만원", "매출액", "700", "자본총계", "700"),
        "out of range first": ("매출액", "12", "단위: 백만원", "매출액", "800"),
        "far away": ("단위: 백만원", "매출액", *[""] * 9, "800"),
    }
    docs = spark.createDataFrame([(k, "\n".join(v)) for k, v in lines.items()] + [("none", None), ("empty", "")], "doc_id string, text string")
    got = sorted(map(tuple, cells.cell_facts(docs, cells.HANGUL).collect()))
    assert got == [("first of a metric", "revenue", 5e8), ("out of range first", "revenue", 8e8), ("unit applies", "operating_profit", -2e9), ("unit applies", "revenue", 1.2345e10)]


def test_table_parts_repeat_the_header_and_keep_totals():
    rows = ["name | value", *(f"row {i} | {i * 1000}" for i in range(40)), "total | 99"]
    parts = budgets.table_parts(rows, budgets.Budget(100, 200))
    assert all(p[0] == rows[0] and len(p) > 1 for p in parts) and [r for p in parts for r in p[1:]] == rows[1:]
    assert all(sum(map(len, p)) + len(p) - 1 <= 200 or p[-1].startswith("total") for p in parts)
    assert not any(p[1].startswith("total") for p in parts) and budgets.table_parts(["only a header"], budgets.Budget(9, 9)) == []


def test_narrative_parts_keep_all_text_and_the_cap():
    text = "\n\n".join(["A sentence of some words. " * n for n in (3, 90, 1, 1, 40, 7)])
    parts = budgets.narrative_parts(text, budgets.BUDGETS["narrative"])
    bodies = [b for _, b in parts]
    assert re.sub(r"\s+", "", "".join(bodies)) == re.sub(r"\s+", "", text) and all(len(b) <= 1200 for b in bodies)
    assert [t for t, _ in parts] == ["", *(b[-100:] for b in bodies[:-1])]
    assert budgets.narrative_parts("short", budgets.BUDGETS["narrative"]) == [("", "short")] and budgets.narrative_parts("", budgets.BUDGETS["narrative"]) == []
    assert budgets.narrative_parts("x" * 3000, budgets.Budget(10, 1000))[0] == ("", "x" * 1000)


def test_budgeted_chunks_of_sections(spark):
    table = "[TABLE]\nitem | amount\n" + "\n".join(f"line of words {i} | {i}" for i in range(30)) + "\n[/TABLE]"
    text = f"## Financial statements\n### Balance\n{table}\nwords " + "about the year " * 20 + "\n## Notes\n" + "note text " * 30
    docs = spark.createDataFrame([(1, "Firm", text), (2, "Firm", None), (3, None, ""), (4, "Firm", "tiny")], "doc_id int, name string, text string")
    got = budgets.budgeted_chunks(docs, "name").orderBy("doc_id", "idx").collect()
    assert [(r["doc_id"], r["title"], r["subtitle"], r["kind"], r["has_table"]) for r in got] == [(1, "Financial statements", "Balance", "financial_table", True), (1, "Financial statements", "Balance", "narrative", False), (1, "Notes", "", "note_narrative", False)]
    assert got[0]["chunk"].startswith("[Firm] > Financial statements > Balance\n[TABLE]\nitem | amount\n")


def test_long_splits_equal_plain_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")

    def packed(text, size=2000):
        out = []
        for p in (p for p in re.split(r"\n[ \t]*\n", text) if p.strip(" ")):
            if out and len(out[-1]) + 2 + len(p) <= size:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return out

    got = {}
    for r in budgets.long_splits(docs, 2000).orderBy("doc_id", "part").collect():
        got.setdefault(r["doc_id"], []).append(r["piece"])
    assert got == {r["doc_id"]: w for r in docs.collect() if (w := packed(r["text"]))}


@pytest.mark.parametrize("text,noise", [("가나다", False), ("------", True), ("", True), ("漢字 text", True), ('ALIGN="left"', True), ("1", False), ("aab", True), ("abc", False)])
def test_noise_text(spark, text, noise):
    assert one(spark, K.noise_text, text) is noise


@pytest.mark.parametrize("make,text,want", [
    (K.respaced, "R e v e n u e 2 0 2 4", "Revenue 2024"), (K.respaced, "two words", "two words"), (K.corrupted, "donâ€™t", True), (K.corrupted, "don't", False),
    (K.cut_off, "It ends.", False), (K.cut_off, 'He said "no."', False), (K.cut_off, "It ends with", True), (K.cut_off, " ", False),
    (K.no_evidence, None, True), (K.no_evidence, "N/A", True), (K.no_evidence, "page 3", False), (K.positive_amount, "1234567", "1,234,567"), (K.positive_amount, "-5", None),
    (K.opinion, "an unqualified opinion", "unqualified"), (K.opinion, "a qualified opinion; otherwise fairly", "qualified"), (K.opinion, "nothing", None), (K.opinion, "감사의견: 적정의견", "unqualified"),
    (K.unit_annotation, "표 (단위: 백만원)", "단위: 백만원"), (K.unit_annotation, "none", None), (lambda c: K.followed_by_amount(c, "Sales"), "Sales\n| (1,234)", True), (lambda c: K.followed_by_amount(c, "Sales"), "Sales of 1,234", False),
    (K.time_horizon, "the long-term outlook", "long"), (K.report_kind, "2023 사업보고서", "annual"), (lambda c: K.made_up_numbers(c), "100 200 3000", True), (lambda c: K.made_up_numbers(c), "101 200 3000", False),
])
def test_rules_on_literals(spark, make, text, want):
    assert one(spark, make, text) == want


def test_names_and_spans(spark):
    assert one(spark, lambda c: K.without_names(c, ["Acme", "Acme Foods"]), "Acme Foods, sales of Acme?") == "sales of"
    assert one(spark, lambda c: K.replaced(c, {"A": "x", "AB": "y"}), "AB A") == "y x"
    got = one(spark, lambda c: K.section_spans(c, {"two": "II\\.", "one": "I\\.", "none": "IX\\."}), "I. first II. second")
    assert [tuple(s) for s in got] == [("one", 1, 10), ("two", 10, 20)]
    assert one(spark, lambda c: K.field_faults(c), "as an AI 漢 あ、ㄱ  x") == ["foreign", "kana", "punctuation", "spacing", "jamo", "instruction"]


def test_company_filter_keeps_all_without_a_match(spark):
    rows = spark.createDataFrame([(1, "Acme", "x"), (2, None, "acme here"), (3, "Other", None)], "id int, company string, text string")
    assert {r["id"] for r in filters.of_company(rows, ["ACME"], ["company"], "text").collect()} == {1, 2}
    assert filters.of_company(rows, ["none"], ["company"], "text").count() == 3 and filters.of_company(rows.limit(0), ["x"], ["company"], "text").count() == 0


def test_suspicious_values(spark):
    flag = lambda m, v, t=None: spark.createDataFrame([(m, v, t)], "m string, v double, t string").select(cells.suspicious(F.col("m"), F.col("v"), F.lit(True), F.col("t")).alias("s")).collect()[0]["s"]
    assert flag("revenue", None) and flag("revenue", 999.0) and not flag("revenue", 2e6) and not flag("eps", 5.0)
    assert flag("treasury_stock_amount", 5e9, "Per share price") and not flag("treasury_stock_amount", 5e9, "in all")



def test_generic_xml_registry_manifest_and_refill(spark, tmp_path):
    assert archives.xml_lines(b"<a><b> x  y </b><n:c xmlns:n='u'>z</n:c><d/></a>") == "b: x y\nc: z" and archives.xml_lines(b"no xml") == ""
    assert one(spark, archives.xbrl_nodes, "<a>Sales</a><b> </b><c>x</c><d>net\n income</d>") == ["Sales", "net income"]
    (tmp_path / "r.xml").write_text("<result>" + "".join(f"<list><corp_code>{i}</corp_code><corp_name>{n}</corp_name><stock_code>{s}</stock_code></list>" for i, (n, s) in enumerate([("Longer name", "000001"), ("Short", "000002"), ("None", " ")])) + "</result>")
    every, listed = archives.read_registry(spark, f"{tmp_path}/r.xml")
    assert every.count() == 3 and [r["corp_name"] for r in listed.collect()] == ["Short", "Longer name"]
    files = spark.createDataFrame([("b", "x"), ("a", "annual"), ("c", None), ("d", "half")], "path string, tier string")
    got = archives.manifest(files, {"annual": 1, "half": 2}).collect()
    assert [(r["path"], r["rank"], r["status"]) for r in got] == [("a", 1, "pending"), ("d", 2, "pending"), ("b", 3, "pending"), ("c", 3, "pending")]
    documents = spark.createDataFrame([("1", " "), ("2", "own"), ("3", None), (None, None)], "receipt string, text string")
    texts = spark.createDataFrame([("1", "new text"), ("2", "other"), ("1", "new text")], "receipt string, text string")
    assert sorted((r["receipt"] or "", r["text"]) for r in archives.refilled(documents, texts, 3).filter("receipt in ('1', '2')").collect()) == [("1", "new"), ("2", "own")]
    assert archives.refilled(documents, texts).count() == 4


def test_search_falls_back_and_handles_nulls(spark):
    rows = spark.createDataFrame([(1, "a long enough passage of text", "Acme", "x", [1.0, 0.0]), (2, None, None, "x", [0.0, 1.0]), (3, "another passage that is long enough", "Other", None, None)], "doc_id int, text string, company string, category string, embedding array<double>")
    found = lambda **ask: [(r["doc_id"], r["source_no"]) for r in search.staged_search(rows, search.Request(vector=[1.0, 0.0], **ask), F.lit(0.5)).collect()]
    assert found(terms=["passage"]) == [(1, 0), (3, 0)]
    assert found(terms=[], category="none such") == [(1, 1), (3, 1)]
    assert found(terms=["passage"], company="acme", variants=["acme"]) == [(1, 0)]
    assert search.staged_search(rows.limit(0), search.Request(vector=[1.0, 0.0], terms=["x"]), F.lit(0.5)).count() == 0


def test_answer_scores_on_literals(spark):
    answer = "Conclusion: according to the annual report of 2024 revenue rose to 1,234 million. Evidence follows."
    assert one(spark, lambda q, a, c: F.round(quality.context_precision(q, a, c, F.lit(0)), 3), "Revenue in 2024?", answer, "annual") == round(0.35 + 0.13 + 0.25 + 0.15, 3)
    assert one(spark, lambda q, a, c: quality.context_precision(q, a, c, F.lit(0)), "Revenue?", None, "x") == 0.1
    assert one(spark, lambda q, a: quality.context_recall(q, a, F.array(F.lit("revenue")), "revenue"), "Revenue?", "") == 0.0
    assert one(spark, lambda a, c: F.round(quality.faithfulness(a, c), 3), answer, "axiom") == round(0.13 + 0.18 + 0.20 + 0.15 + 0.12, 3)
