"""Scored names and anchored fields on made filings."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import metadata

LINE = "주식회사 한빛"


@pytest.mark.parametrize(
    "text,want",
    [
        ("보고서\n회사명 : 한빛전자  대표\n(주)다른회사", ("한빛전자", "label", 15, None, 0.9)),
        ("제출인: 가나\n상호: 다라\n", ("다라", "label", 14, None, 0.9)),
        ("회사명: 12345\n" + LINE, (LINE, "line", 10, 1, 0.7)),  # figures are no name
        ("회사명: Acme\n" + LINE, (LINE, "line", 10, 1, 0.7)),  # nor is one without a letter of the script
        ("1. 주식회사 한빛\n" + "글\n" * 90 + LINE, (LINE, "line", 7, 91, 0.7)),  # a section's title is none, late lines count less
        ("글\n" * 85 + "가" * 90 + " ㈜", (None, None, None, None, None)),
        ("재무상태표 주식회사 한빛", (None, None, None, None, None)),
        ("주식회사 한빛\n주식회사 나라", (LINE, "line", 10, 0, 0.7)),
        ("", (None, None, None, None, None)),
        (None, (None, None, None, None, None)),
    ],
)
def test_names(spark, text, want):
    found = metadata.document_names(spark.createDataFrame([(1, text)], "doc_id int, text string"), metadata.HANGUL)
    assert tuple(found.select("name", "kind", "score", "line", "confidence").head()) == want


def test_latin_names_and_repeated_ids(spark):
    rows = [(1, "Issuer: Acme Holdings\nother"), (1, "Annual report\nBolt & Nut GmbH\n"), (None, "no name here"), (None, "x\n" * 100 + "Big Co")]
    got = metadata.document_names(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id int, text string, label string"))
    assert sorted((r.doc_id or 0, r["name"] or "", r.score or 0, r.confidence or 0) for r in got.collect()) == [(0, "", 0, 0), (0, "Big Co", 7, 0.7), (1, "Acme Holdings", 13, 0.9), (1, "Bolt & Nut GmbH", 10, 0.7)]


def test_fields_are_anchored_in_their_page(spark):
    fields = {"date": ((r"filed on ([0-9.]+)", 0.9), (r"date[: ]+([0-9.]+)", 0.6)), "title": ((r"Title: (\w+)", 0.8), (r"Name: (\w+)", 0.8))}
    rows = [(1, "cover\fdate: 2024.1.2\fName: b Title: a"), (2, "filed on 2023.1.1 date 2022.2.2"), (3, None), (None, "Title: bad"), (4, "z" * 3000 + "Title: late")]
    found = metadata.anchored_fields(spark.createDataFrame(rows, "doc_id int, text string"), fields, valid={"title": lambda v: F.when(v != "bad", v)})
    got = {(r.doc_id, r.field): (r.value, r.source_text, r.source_page, r.confidence) for r in found.collect()}
    none = (None, None, None, 0.0)
    assert got == {
        (1, "date"): ("2024.1.2", "date: 2024.1.2", 2, 0.6), (1, "title"): ("a", "Title: a", 3, 0.8), (2, "date"): ("2023.1.1", "filed on 2023.1.1", 1, 0.9), (2, "title"): none,
        (3, "date"): none, (3, "title"): none, (None, "date"): none, (None, "title"): none, (4, "date"): none, (4, "title"): none,
    }
