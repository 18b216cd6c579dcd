"""The queue source across restarts, and functions called from SQL."""

import difflib
import json

from pyspark.sql import functions as F

from ledgerloom.functions import registered
from ledgerloom.streaming import queue

SF = "/root/testdata/sf0.001"


def _work(tasks):
    n = F.try_variant_get(F.try_parse_json("args"), "$.n", "long")
    return tasks.select("task_id", (n * n).cast("string").alias("result"), F.when(n.isNull(), F.lit("no n")).alias("error"))


def test_the_queue_goes_on_from_its_offset(spark, tmp_path):
    q, target, failed, mark = (f"{tmp_path}/{x}" for x in ("q", "done", "failed", "mark"))
    assert queue.dispatch(q, []) == []

    def run():
        queue.results(queue.queued(spark, q), target, mark, _work, failed).awaitTermination(120)

    ids = queue.dispatch(q, [("square", {"n": 3}), ("square", {"é": "日本"})]) + queue.dispatch(q, [("square", {"n": 4})])
    run()
    first = {r.task_id: r.result for r in spark.read.parquet(target).collect()}
    assert first == {ids[0]: "9", ids[2]: "16"} and [r.task_id for r in spark.read.parquet(failed).collect()] == [ids[1]]
    run()  # nothing new
    assert spark.read.parquet(target).count() == 2
    more = queue.dispatch(q, [("square", {"n": 5})])
    run()
    assert {r.task_id: r.result for r in spark.read.parquet(target).collect()} == first | {more[0]: "25"}
    assert queue.outcome(spark, target, more[0]) == "25" and queue.outcome(spark, target, ids[1]) is None
    offsets = [json.loads(line) for f in (tmp_path / "mark" / "offsets").iterdir() if not f.name.startswith(".") for line in f.read_text().splitlines() if "segments" in line]
    assert max(o["segments"] for o in offsets) == 3


def test_sql_calls_table_functions(spark):
    registered.register(spark)
    spark.read.parquet(f"{SF}/documents.parquet").createOrReplaceTempView("d")
    texts = {r.doc_id: r.text for r in spark.table("d").collect()}
    got = {}
    for r in spark.sql("SELECT doc_id, w.* FROM d, LATERAL token_windows(text, 50, 10) w").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {k for k, t in texts.items() if t.split()}
    for key, windows in got.items():
        words, windows = texts[key].split(), sorted(windows, key=lambda r: r.idx)
        assert all(r.chunk.split() == words[r.first_token : r.first_token + r.n_tokens] for r in windows)
        assert windows[-1].first_token + windows[-1].n_tokens == len(words) and all(b.first_token == a.first_token + 40 for a, b in zip(windows, windows[1:], strict=False))
    lines = spark.sql("SELECT count(*) FROM d, LATERAL filled_lines(text)").head()[0]
    assert lines == sum(bool(x.strip()) for t in texts.values() for x in t.split("\n"))
    assert spark.sql("SELECT line FROM visible_lines('<p>a<script>no</script><p>b')").collect() == [("a",), ("b",)]


def test_sql_calls_scalar_and_aggregate_functions(spark):
    registered.register(spark)
    rows = [("samsung elec", "samsing"), ("apple", "apple inc"), (None, "x"), ("x", None), ("abc", ""), ("", ""), ("abc", "xyz")]
    spark.createDataFrame(rows, "q string, n string").createOrReplaceTempView("pairs")
    got = [r[0] for r in spark.sql("SELECT name_ratio(q, n) FROM pairs").collect()]
    assert got == [difflib.SequenceMatcher(None, *rows[0]).ratio(), 1.0, None, None, 0.0, 0.0, 0.0]
    by_lang = {r.lang: r.t for r in spark.sql("SELECT lang, longest_text(text) t FROM d GROUP BY lang").collect()} if spark.catalog.tableExists("d") else {}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert all(len(t) == max(len(d.text) for d in docs if d.lang == lang) for lang, t in by_lang.items())
