"""Operators 2, 9 and the pipeline against brute force."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import components, hyperminhash, shingles, suffix_dedup
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.001"


def _sets(rows):
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4))))
    return out


def _components(rows):
    """(doc_id, set size, least id reachable) of every row, by comparing all pairs."""
    sets, n = _sets(rows), len(rows)
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)].append(k)
    return [(k, len(sets[i]), (min(least[find(i)], default=None) if sets[i] else k)) for i, (k, _) in enumerate(rows)]


def _sorted(rows):
    return sorted(rows, key=lambda t: tuple((x is not None, x) for x in t))


def _variants(seed, n, words, edits):
    rng = np.random.default_rng(seed)
    base = [f"v{rng.integers(0, 10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for k in rng.integers(0, words, edits):
            w[k] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_brute_force(docs, odd_rows):
    rows = list(odd_rows)
    rows += [(100 + i, t) for i, t in enumerate(_variants(1, 12, 150, 4) + _variants(2, 30, 60, 1) + _variants(3, 8, 9, 1) + ["a b c d e f g h", "A b c d e f g h i", "one two three"])]
    rows += [(200, rows[20][1]), (201, rows[20][1]), (201, rows[20][1])]
    got = hyperminhash.near_duplicates(docs(rows))
    assert _sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()]) == _sorted(_components(rows))
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got.collect())
    assert hyperminhash.near_duplicates(docs([])).count() == 0


def test_one_row_of_each_group_stays(docs):
    """Repeated ids with other texts, repeated rows and null ids."""
    a, b, c = ("".join(f"{x}{i} " for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b + "end"), (4, c), (4, c), (4, c + "end"), (None, c), (None, "n " + a), (None, "only null ids one two"), (None, "only null ids one two"), (None, "only  null ids one two"), (5, None), (5, None), (None, "")]
    got = hyperminhash.one_of_each(docs(rows))
    out = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == docs([]).columns and set(out) <= set(rows)
    words = [(k, (t or "").split()[:1]) for k, t in out]
    assert sorted(w for w in words if w[0] is not None) == [(1, ["a0"]), (2, ["b0"]), (4, ["c0"]), (5, []), (5, [])]
    assert sorted(w for k, w in words if k is None) == [[], ["only"]]
    assert hyperminhash.one_of_each(docs([])).count() == 0


def test_crowded_band_is_compared_in_blocks(docs, monkeypatch):
    """Chains of copies, each like the next only, in blocks far smaller than their bands."""
    monkeypatch.setattr(hyperminhash, "_BLOCK", 4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(24):
        for k in range(i * 4, i * 4 + 4):
            base[k % 120] = f"x{i}-{k}"
        rows.append((i, " ".join(base)))
    rows += [(50 + i, t) for i, t in enumerate(_variants(9, 20, 100, 6))]
    got = hyperminhash.near_duplicates(docs(rows))
    assert _sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()]) == _sorted(_components(rows))


def test_near_copies_without_ids_bring_one_text_each(spark, docs):
    """2,000 different texts under one id, or none: each class fetches its own text alone."""
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join([*base, f"own{k}", f"end{k}"]) for k in range(1000)]
    rows = docs([(None, t) for t in texts] + [(7, t + " more") for t in texts])
    keyed = rows.select("doc_id", hyperminhash._text_key("text").alias("text_key"))
    wanted = keyed.select(F.monotonically_increasing_id().alias("cls"), F.lit(b"").alias("digest"), F.lit(b"").alias("sketch"), hyperminhash._row_key().alias("best"))
    fetched = hyperminhash._texts_of(wanted, rows.select("doc_id", "text"))
    assert fetched.count() == 2000 and fetched.select("text").distinct().count() == 2000
    few = docs([(None, t) for t in texts[:150]] + [(7, t + " more") for t in texts[:50]])
    assert {(r.doc_id, r.component_id) for r in hyperminhash.near_duplicates(few).collect()} == {(None, 7), (7, 7)}


def test_a_block_of_close_classes_gives_a_forest():
    """However many pairs of a block are linked, it returns fewer links than classes, and the same components."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(6):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        for _ in range(25):
            own = base.copy()
            own[rng.integers(0, 60, 3)] = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
            sets.append(np.unique(own))
    n = len(sets)
    for left in (np.ones(n, bool), np.arange(n) % 3 > 0):
        table = hyperminhash.pa.table({"cls": np.arange(n), "comp": np.arange(n), "left": left, "size": [len(s) for s in sets], "sketch": hyperminhash.pa.array([hyperminhash.sketch(s).tobytes() for s in sets], "binary"), "whole": hyperminhash.pa.array([s.tobytes() for s in sets], "binary")})
        got = hyperminhash._across(table, 75).to_pylist()
        side = lambda i, j: left.all() or left[i] != left[j]
        want = [(i, j) for i in range(n) for j in range(i) if side(i, j) and hyperminhash.linked(sets[i], sets[j], 75)]
        assert len(got) < n < len(want) and all(r["sure"] and hyperminhash.linked(sets[r["a"]], sets[r["b"]], 75) for r in got)
        label = {True: list(range(n)), False: list(range(n))}
        for ours, pairs in ((True, [(r["a"], r["b"]) for r in got]), (False, want)):
            for i, j in pairs:
                x, y = label[ours][i], label[ours][j]
                label[ours] = [min(x, y) if v in (x, y) else v for v in label[ours]]
        assert label[True] == label[False]


def test_small_sets_share_bands():
    """Pairs at the threshold of 5 to 20 shingles: one in ten thousand misses at most."""
    rng = np.random.default_rng(1)
    missed = total = 0
    for both, one, two in ((3, 1, 0), (6, 1, 1), (6, 2, 0), (9, 2, 1), (12, 2, 2), (15, 3, 2), (15, 5, 0)):
        for _ in range(1500):
            own = rng.integers(0, 1 << 63, both + one + two, dtype=np.uint64) << np.uint64(1)
            a, b = (hyperminhash.sketch(np.sort(own[k])) for k in (np.arange(both + one), np.r_[:both, both + one : both + one + two]))
            near = (hyperminhash.band_keys(a[None]) == hyperminhash.band_keys(b[None])).any() and hyperminhash.estimate(a, b) >= hyperminhash._LEAST_ESTIMATE
            missed, total = missed + (not near), total + 1
    assert missed <= total / 1000, (missed, total)


def test_sketch_estimates():
    rng = np.random.default_rng(5)
    for n in (4, 30, 300, 5000):
        errors = []
        for _ in range(40):
            both, a, b = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (3 * n, n // 2 + 1, n // 2 + 1))
            x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
            true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
            errors.append(float(hyperminhash.estimate(hyperminhash.sketch(x), hyperminhash.sketch(y))) - true)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_shingles_split_at_ascii_space_only():
    (a,), (b,), (c,) = ([s.tolist() for s in shingles.shingle_sets([t])] for t in ("A b\u3000c\x0bD e f", "a  b\u3000c d E F", "a b c d e f"))
    assert a == b != c


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(99, 98)]])
def test_components(spark, edges):
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def _without_repeats(rows, length=400):
    seen = collections.Counter()
    raws = [(t or "").encode() for _, t in rows]
    for r in raws:
        seen.update(r[i : i + length] for i in range(len(r) - length + 1))
    out = []
    for (k, _), r in zip(rows, raws):
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


def _repeat_rows():
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdefgh é\n"), n))
    p, q, e = text(700), text(399), text(400)
    return [
        (1, text(300) + p + text(200)), (2, p[:500] + text(50)), (3, text(20) + p[200:] + text(10) + q), (4, q), (5, q + "x"), (6, e), (7, text(100) + e), (8, "ab" * 600), (9, text(250) + "\0" * 450 + text(10)),
        (10, "\0" * 420), (11, None), (12, ""), (None, text(450)), (13, p), (13, p), (14, text(30) + e[1:] + text(500)), (15, e[:-1] + text(9)), (16, (text(150) + "\n") * 4), (17, text(9000)),
    ]


_COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_equal_brute_force(docs):
    rows = _repeat_rows()
    assert rows_of(suffix_dedup.remove_repeats(docs(rows)), *_COLUMNS) == _sorted(_without_repeats(rows))
    assert suffix_dedup.remove_repeats(docs([])).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_large_buckets_are_split(docs, most):
    rows = _repeat_rows()
    assert rows_of(suffix_dedup.remove_repeats(docs(rows), bucket_most=most), *_COLUMNS) == _sorted(_without_repeats(rows))


def test_what_is_left_of_texts(docs):
    """The operator gives the bytes that are left and the runs that went; the digests follow from these."""
    half = "é" * 199 + "z"
    rows = [*_repeat_rows(), (20, "é" + half + "abc"), (21, "ĩ" + half + "def"), (22, "ab" + "k" * 400 + "cd"), (23, "k" * 400)]
    want = {(k, sha): (n, gone, runs) for k, n, gone, runs, sha in _without_repeats(rows)}
    raws = collections.defaultdict(list)
    for k, t in rows:
        raws[k].append((t or "").encode())
    found = suffix_dedup.without_repeats(docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        spans, kept = [(s["start"], s["stop"]) for s in r["spans"]], bytes(r["kept"])
        assert want[r["doc_id"], hashlib.sha256(kept).hexdigest()] == (r["n_bytes"], sum(b - a for a, b in spans), len(spans))
        assert spans == sorted(spans) and kept in [b"".join(x[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(x)])) for x in raws[r["doc_id"]]]
    left = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(rows)).filter("doc_id >= 20").collect()}
    assert {k: (r["spans"], r["text"]) for k, r in left.items()} == {20: ("1:401", "\ufffdabc"), 21: ("1:401", "\ufffddef"), 22: ("2:402", "abcd"), 23: ("0:400", "")}


def test_sample_ranks_sort_rows():
    rng = np.random.default_rng(6)
    rows = rng.integers(0, 2, (60, 130), dtype=np.uint8)
    rows[10:20] = rows[5]
    rows[15, 129] ^= 1
    sizes = rng.integers(100, 131, 60)
    for r, n in zip(rows, sizes):
        r[n:] = 0
    text = [r[:n].tobytes() for r, n in zip(rows, sizes)]
    order = np.argsort(suffix_dedup.sample_ranks(rows, sizes), kind="stable")
    assert [text[i] for i in order] == sorted(text)


def test_steps_of_buckets_equal_all_pairs():
    """Buckets of many sizes, with suffixes that end early, NUL bytes and clashing anchor hashes, against comparison of all pairs."""
    rng = np.random.default_rng(8)
    side, gram, length = suffix_dedup.SIDE, suffix_dedup.GRAM, suffix_dedup.LENGTH
    bucket = np.repeat(np.arange(9), [1, 2, 2, 3, 5, 8, 2, 13, 40])
    m = len(bucket)
    grid = np.zeros((m, side + length), np.uint8)
    before, after = rng.integers(60, side + 1, m), rng.integers(gram + 60, length + 1, m)
    for r in range(m):
        grid[r, rng.integers(60, side) : rng.integers(length, side + length)] = 7
        if bucket[r] == 7 and r % 2:
            grid[r, length - 1] = 9
        grid[r, : side - before[r]] = 0
        grid[r, side + after[r] :] = 0
    grid[:, side : length - 1] = 5
    lo, hi = np.where(bucket == 5, 20, 0), np.where(bucket == 5, 110, side)
    least, greatest = suffix_dedup.repeated(bucket, before, after, grid, lo, hi)
    for r in range(m):
        steps = []
        for s in np.flatnonzero(bucket == bucket[r]).tolist():
            fits = [a for a in range(lo[r], hi[r] + 1) if min(before[r], before[s]) >= a and min(after[r], after[s]) >= length - a]
            steps += [a for a in fits if s != r and (grid[r, side - a : side - a + length] == grid[s, side - a : side - a + length]).all()]
        assert (least[r], greatest[r]) == (min(steps, default=side + 1), max(steps, default=-1)), r


def test_repeats_in_long_texts(docs):
    """Texts over a megabyte, and a passage in many texts with other surroundings each."""
    rng = np.random.default_rng(12)
    text = lambda n: "".join(rng.choice(list("abcdefgh \n"), n))
    long, passage = text(1_200_000), text(450)
    rows = [(1, long), (2, text(500) + long[700_000:701_000] + text(500)), (3, long[:600]), *((10 + i, text(120) + passage + text(130)) for i in range(150))]
    got = dict((r[0], r[1:]) for r in rows_of(suffix_dedup.remove_repeats(docs(rows), bucket_most=64), *_COLUMNS))
    assert got[1][1:3] == (1600, 2) and got[2][1:3] == (1000, 1) and got[3][1:3] == (600, 1)
    assert [(k, *got[k]) for k in range(10, 160)] == _without_repeats(rows[3:])


def test_pipeline_stages(spark):
    """Each stage on its predecessor's rows: what it drops, keeps and returns."""
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns = now.columns
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        now = stage(spark, now, SF).cache()
        if name == "packing":
            break
        assert now.columns == columns
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert set(after) <= set(before)
        if name == "toxicity":
            assert len(set(before) - set(after) - toxic) <= 0.02 * len(before)
        if name == "near_duplicates":
            rows = sorted(before.items())
            assert set(after) == {k for k, _, c in _components(rows) if k == c}
        if name != "secrets":
            assert all(after[k] == before[k] for k in after)
    total = {}
    for r in now.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert set(total) == set(after)
    assert zlib.crc32(b"") == 0 and corpus_pipeline.ORACLE_SQL is None


def test_pipeline_on_odd_tables(spark, docs, tmp_path, odd_rows):
    """run() over nulls, empty and repeated rows, ids that several rows bear, and extra columns with names used inside."""
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi"
    near = " ".join(f"near{k}" for k in range(80))
    rows = [*odd_rows, (30, near), (31, near + " more"), (32, f"before {bench} after"), (33, "token = abcdefghijklmnop0 stays"), (33, "another text under the same id")]
    rows += [(100 + k, f"bad vile words{k % 7} number {k}" if k % 6 == 0 else f"plain fair words{k % 7} number {k}") for k in range(60)]
    docs(rows).write.parquet(f"{tmp_path}/full/documents.parquet")
    docs(rows).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for where in ("full", "none"):
        spark.createDataFrame([(100 + k, 1, int(k % 6 == 0)) for k in range(60)] + [(None, 0, 1), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{where}/labels.parquet")
        spark.createDataFrame([(1, bench), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/{where}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    ids = {r.doc_id for r in out}
    assert {1, 2, 6, 7, 8, None, 30, 33} <= ids and 31 not in ids and 32 not in ids
    whole = collections.Counter()
    for r in out:
        whole[r.doc_id] += r.length
    rows_of_33 = {(r.doc_tokens) for r in out if r.doc_id == 33}
    assert whole[33] == sum(rows_of_33) and whole[30] == sum({r.doc_tokens for r in out if r.doc_id == 30})
    fill = collections.Counter()
    for r in out:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048
