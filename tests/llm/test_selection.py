"""Importance resampling, kd-tree clustering and the word table against brute force, SQL and the library."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import kd_clusters, queries, resampling, word_table
from tests import oracles
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_resampling", "op12_kd_clusters"])
def test_queries_equal_sql(spark, name):
    assert oracles.rows_of_spark(queries.queries()[name](spark, SF)) == oracles.rows_of_sql(oracles.connection(SF), queries.oracle_sql()[name])


def _brute_resample(docs, target, percent=5, least=20, buckets=10_000, seed=42):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    of = [(i, grams(t), len(words(t))) for i, t in docs]
    s, t = Counter(b for _, g, _ in of for b in g), Counter(b for x in target for b in grams(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in s}
    out = []
    for i, g, n in of:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=lambda t: tuple((x is not None, x) for x in t))


COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def test_resampling_equals_brute_force(spark, docs, odd_rows):
    rows = odd_rows + [(100 + i, f"Word{i % 7} and ÄÖ more_words, {'x1 ' * (i % 40)}tail-{i % 3}") for i in range(60)] + [(100, "Word0 and ÄÖ more_words, tail-0")]
    target = ["word1 and äö more words", None, "", "x1 X1 x1 tail"]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id long, text string, words string")
    for percent, least in ((5, 20), (50, 3), (100, 0)):
        got = rows_of(resampling.resample(docs(rows), bench, percent, least), *COLUMNS)
        # rows that tie in everything but their features share their ranks among themselves
        assert got == _brute_resample([r[:2] for r in rows], target, percent, least)


def test_resampling_of_nothing(spark, docs):
    bench = spark.createDataFrame([(1, "some text")], "item_id long, text string")
    assert resampling.resample(docs([(1, "x")]).limit(0), bench).count() == 0
    rows = [(1, "one two three"), (2, None)]
    assert rows_of(resampling.resample(docs(rows), bench.limit(0), 100, 0), *COLUMNS) == _brute_resample(rows, [], 100, 0)


def test_gain_table_has_every_bucket(spark, docs):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    gains = resampling.gain_table(docs([(1, "a a a c")]), bench, 50)
    assert gains.count() == 50 and gains.agg(F.sum("s"), F.sum("t")).head()[0:2] == (9, 3)


def test_ranks_over_many_partitions(spark):
    many = spark.range(0, 5000, 1, 7).select("id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    got = sorted((-r.v, r.id, r.place) for r in resampling.ranked(many, F.col("v").desc(), F.col("id")).collect())
    assert [p for _, _, p in got] == list(range(1, 5001))


def test_native_plan(spark, docs):
    """No Python on the path, and texts are read through the scan's text column alone."""
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = resampling.features(docs([(1, "a b c")]).select("doc_id", resampling.words_of(F.col("text")).alias("words")), 100, "doc_id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and bench is not None


def _brute_clusters(rows, k=40, rounds=5, width=64, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda: [min((far(v, c), j) for j, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        owner = [j for _, j in near()]
        for j in range(len(cents)):
            own = [v for (_, v), o in zip(kept, owner, strict=True) if o == j]
            if own:
                cents[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = near()
    total = Counter()
    for d, j in last:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return [(i, j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(kept, last, strict=True)]


def _null_first(rows):
    return sorted(rows, key=lambda t: tuple((x is not None, x) for x in t))


@pytest.mark.parametrize("case", ["spread", "copies", "lattice", "few", "none"])
def test_clusters_equal_brute_force(spark, case):
    rng = np.random.default_rng(5)
    bad = [(900, None), (901, [0.5] * 63), (902, [0.5] * 65), (903, [None] + [0.5] * 63), (904, [math.nan] + [0.5] * 63), (905, [math.inf] * 64), (906, [])]
    v = {
        "spread": rng.normal(size=(230, 64)), "copies": np.repeat(rng.normal(size=(12, 64)), 20, axis=0), "lattice": rng.integers(0, 2, (200, 64)) / 256 * (np.arange(64) < 4),
        "few": rng.normal(size=(7, 64)), "none": np.zeros((0, 64)),
    }[case]
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += rows[:5] + [(None, r[1]) for r in rows[:3]] + bad
    df = spark.createDataFrame([(i, x, "clash", 1) for i, x in rows], "vec_id long, embedding array<float>, v string, cluster int").repartition(3)
    got = rows_of(kd_clusters.cluster(df), "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert got == _null_first(_brute_clusters(rows))


def test_tree_prunes_whole_nodes():
    rng = np.random.default_rng(0)
    cents = rng.integers(-300, 300, (5, 64))
    points = (cents[rng.integers(0, 5, 2000)] + rng.integers(-20, 20, (2000, 64))).astype(np.int64)
    tree = kd_clusters.Tree(points)
    nodes, _, rows, _ = tree.settle(cents)
    assert len(nodes) and len(rows) < 400  # most vectors go with their node
    want = ((tree.points[:, None] - cents[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (tree.labels(cents) == want).all()
    count, sums = tree.totals(cents)
    assert (count == np.bincount(want, minlength=5)).all() and all((sums[k] == tree.points[want == k].sum(axis=0)).all() for k in range(5))


def test_tree_is_exact_for_large_values():
    big = kd_clusters._MOST - 1
    points = np.array([[big] * 64, [-big] * 64, [big] * 63 + [big - 1]], np.int64)
    tree = kd_clusters.Tree(points, leaf=1)
    assert (tree.labels(points) == tree.order).all()
    assert kd_clusters.squared(points[:1], points[1:2])[0, 0] == 64 * (2 * big) ** 2


@pytest.fixture(scope="module")
def library(byte_bpe):
    tool = Tokenizer.from_file(byte_bpe)
    tool.no_truncation()
    tool.no_padding()
    return tool


@pytest.mark.parametrize("block", [1, 200, 4 << 20])
def test_word_table_equals_library(spark, docs, odd_rows, byte_bpe, library, block):
    rows = odd_rows + [(20, "x<|endoftext|> y<|endoftext|><|endoftext|>"), (21, " <|endoftext|>"), (22, "\n\n a  b   \n"), (23, "naïve 日本語 🎉🎉‍ text's"), (24, "<|endo ftext|>")]
    back = word_table.decode(word_table.encode(docs(rows), byte_bpe, block=block), byte_bpe, block=block)
    got = rows_of(back, "doc_id", "ids", "text")
    texts = [(i, t or "") for i, t in (r[:2] for r in rows)]
    want = [(i, e.ids, library.decode(e.ids, skip_special_tokens=False)) for (i, _), e in zip(texts, library.encode_batch([t for _, t in texts], add_special_tokens=False), strict=True)]
    assert got == _null_first(want)
    assert rows_of(word_table.round_trip(docs(rows), byte_bpe, block=block), "doc_id", "ids", "text") == got
    assert rows_of(word_table.digest(back), "doc_id", "n_tokens") == _null_first([(i, len(ids)) for i, ids, _ in want])


def test_word_table_query_equals_library(spark, byte_bpe, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_word_table(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_decoding_any_ids(spark, byte_bpe, library):
    rng = np.random.default_rng(1)
    rows = [(k, rng.integers(0, 50_257, 30).tolist()) for k in range(20)] + [(30, None), (31, []), (None, [50_256, 0]), (32, [60_000, 5, -3]), (33, [7, None, 8])]
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "doc_id long, ids array<int>, piece string").repartition(2)
    want = [(i, library.decode([t for t in x or [] if t is not None and 0 <= t < 50_257], skip_special_tokens=False)) for i, x in rows]
    assert rows_of(word_table.decode(df, byte_bpe, block=50), "doc_id", "text") == _null_first(want)
    assert word_table.decode(df.limit(0), byte_bpe).count() == 0
