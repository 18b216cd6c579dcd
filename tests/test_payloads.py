"""Nested payloads against a walk over parsed JSON."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels as L
from ledgerloom.operators import payloads


def _walk(v, path=""):
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from _walk(x, f"{path}.{k}" if path else k)
    elif isinstance(v, list) and v:
        for k, x in enumerate(v):
            yield from _walk(x, f"{path}[{k}]")
    else:
        kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", int: "BIGINT", type(None): "VOID"}[type(v)]
        yield path, kind, {"OBJECT": "{}", "ARRAY": "[]", "BOOLEAN": str(v).lower(), "VOID": None}.get(kind, v if isinstance(v, str) else str(v))


def _random(rng, depth):
    if depth and rng.random() < 0.7:
        if rng.random() < 0.5:
            return {f"k{rng.randrange(5)}": _random(rng, depth - 1) for _ in range(rng.randrange(4))}
        return [_random(rng, depth - 1) for _ in range(rng.randrange(4))]
    return rng.choice([1, -5, "text", "", "日本", True, False, None, 10**12])


def test_leaves_equal_a_walk(spark):
    rng = random.Random(4)
    values = [_random(rng, 5) for _ in range(150)] + [{"a": {"b": [{"c": [[1, "x"]]}]}}, [], {}, "scalar", 7, None]
    rows = [(k % 20, json.dumps(v)) for k, v in enumerate(values)] + [(99, None), (99, ""), (99, "{broken"), (None, '{"q": 1}'), (None, '{"q": 1}'), (50, json.dumps(json.dumps({"in": {"side": "twice"}})))]
    got = payloads.leaves(spark.createDataFrame([(i, p, "clash", "x") for i, p in rows], "id long, p string, path string, _path string").select("id", "p"), "p", "id").collect()
    want = []
    for i, p in rows:
        try:
            v = json.loads(p)
            v = json.loads(v) if isinstance(v, str) and v.startswith("{") else v
        except (TypeError, json.JSONDecodeError):
            continue
        want += [(i, *leaf) for leaf in _walk(v)]
    order = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_leaves_stop_at_the_depth(spark):
    df = spark.createDataFrame([('{"a":{"b":{"c":1}}}',)], "p string")
    assert [tuple(r) for r in payloads.leaves(df, "p", depth=2).collect()] == [("a.b", "OBJECT", '{"c":1}')]


@pytest.mark.parametrize(
    "payload,amount,unit",
    [
        ("5", 5.0, "number"), ("-2.5", -2.5, "number"), ('"3 million"', 3e6, "currency"), ('"12%"', 12.0, "%"), ('"none"', None, None), ('{"amount": 4, "value": "7 billion"}', 7e9, "currency"),
        ('{"other": 4}', None, None), ('["x", {"number": "9%"}, 5]', 9.0, "%"), ('[["2 bn"]]', 2e9, "currency"), ("[]", None, None), ("true", None, None), (None, None, None), ("no json", None, None),
        ('{"value": {"text": {"amount": 1}}}', 1.0, "number"), ('{"value": null, "amount": 3}', None, None),
    ],
)
def test_metric_values(spark, payload, amount, unit):
    assert tuple(payloads.metric_value(spark.createDataFrame([(payload,)], "p string"), "p").select("amount", "unit").head()) == (amount, unit)


def test_foreign_fields(spark):
    rows = [(1, json.dumps({"summary": "plain", "points": ["甲 in a list", "fine", "x" * 40 + "乙丙" + "y" * 40], "deep": {"er": {"q": "丁\n戊"}}})), (2, "no json 己 here"), (3, None), (4, '"plain"')]
    got = {(r.id, r.field): (r.n, r.snippets) for r in payloads.foreign_fields(spark.createDataFrame(rows, "id int, p string"), "p", "id").collect()}
    assert got == {
        (1, "points[0]"): (1, ["甲 in a list"]), (1, "points[2]"): (2, ["x" * 15 + "乙丙" + "y" * 15]), (1, "deep.er.q"): (2, ["丁 戊"]), (2, "raw_text"): (1, ["no json 己 here"]),
    }


def test_quality_run_edges(spark):
    full = {"company_name": "Fine Co", "category": "audit", "summary": "s" * 60}
    rows = [
        (1, json.dumps(full), True, True), (1, json.dumps(full | {"summary": "s"}), True, True), (2, None, True, False), (3, None, False, False), (4, json.dumps(full | {"notes": ["甲"]}), True, True),
        (5, "{}", None, None), (None, "no json", True, True), (6, json.dumps(full | {"category": "Other"}), True, True),
    ]
    df = spark.createDataFrame(rows, "id int, p string, analysed boolean, report boolean")
    found = payloads.quality_run(df, "p", F.col("analysed"), F.col("report"), "id", L.name_issues)
    got = sorted(((r.id, "|".join(r.issues), r.severity) for r in found.collect()), key=lambda t: (t[0] is not None, t))
    assert got == [
        (None, "COMPANY_EMPTY|EMPTY_SUMMARY|WEAK_CATEGORY", "HIGH"), (1, "", "none"), (1, "SHORT_SUMMARY", "MEDIUM"), (2, "NO_ANALYSIS", "LOW"), (3, "", "none"), (4, "FOREIGN", "CRITICAL"),
        (5, "COMPANY_EMPTY|EMPTY_SUMMARY|WEAK_CATEGORY|NO_REPORT", "HIGH"), (6, "WEAK_CATEGORY", "LOW"),
    ]
    assert {r.issue: r.n for r in payloads.quality_counts(found).collect()}["(clean)"] == 2


def test_an_amount_s_expression_grows_as_a_chain(spark):
    df = spark.createDataFrame([('[[[[{"value":[{"text":"2 bn"}]}]]]]',)], "p string")
    size = lambda depth: len(payloads.metric_value(df, "p", depth=depth)._jdf.queryExecution().analyzed().toString())
    assert size(4) - size(3) < 1.2 * (size(2) - size(1))
    assert [payloads.metric_value(df, "p", depth=k).head()["amount"] for k in (6, 7)] == [None, 2e9]
