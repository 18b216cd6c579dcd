"""Operators 3, 5, 6 and 7 against brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from ledgerloom.llm import decontamination, queries, secret_scan, toxicity, url_rules
from tests import oracles
from tests.llm.conftest import rows_of

SF = "/root/testdata/sf0.01"


def test_toxicity_on_the_held_out_fold(spark):
    got = queries.op3_toxicity(spark, SF).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")["toxic"]
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index]).all()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5).astype(int) == got["predicted"]).all()
    held = labels[[i for i in labels.index if i in got.index and got.loc[i, "held_out"]]]
    scores = got.loc[held.index, "score"]
    assert np.mean((scores >= 0.5).astype(int) == held) > 0.9
    assert scores[held == 1].mean() > scores[held == 0].mean() + 0.3


def test_toxicity_learns_from_the_sample_alone(docs, spark):
    """All tasks scan, and only the sample's rows reach the one training task."""
    rows = docs([(i, f"text {i}") for i in range(400)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    sample = toxicity._sample(rows, labels, toxicity.Ftrl(sample=50), "doc_id", "text", "toxic")
    assert sample.count() == 50 and sample.rdd.getNumPartitions() == 1
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Repartition 1, true") < plan.index("Join")


def test_toxicity_equals_plain_ftrl():
    """The learner against the textbook's per-coordinate formulas over dictionaries."""
    p = toxicity.Ftrl(bits=12, alpha=0.7, beta=1.0, l1=0.5, l2=0.3, epochs=3)
    rng = np.random.default_rng(9)
    rows = [(np.unique(rng.integers(0, 40, 6)), int(rng.integers(0, 2))) for _ in range(60)]
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            own = [*x.tolist(), "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in own:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    m = toxicity.fit(rows, p)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert m.index.tolist() == sorted(want) and np.allclose(m.weight, [want[i] for i in sorted(want)], rtol=1e-5)
    assert abs(m.bias - weight("bias")) < 1e-9


def test_toxicity_edges(docs, odd_rows, spark):
    labels = spark.createDataFrame([(4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.learn(docs(odd_rows), labels)
    out = toxicity.score(docs(odd_rows), model)
    assert out.count() == len(odd_rows) and {r["score"] for r in out.collect()} == {0.5}
    assert toxicity.score(docs([]), model).count() == 0
    kept = toxicity.reject(docs(odd_rows), toxicity.Model(10, np.zeros(0, np.int64), np.zeros(0, np.float32), -1.0))
    assert kept.columns == docs([]).columns and kept.count() == len(odd_rows)


def test_ftrl_finds_the_word():
    p = toxicity.Ftrl(bits=16, l1=1.0)
    rows = [(toxicity.features(f"w{i} w{i * 7 % 31} {'bad' if i % 3 == 0 else 'good'} w{i % 5}", p.bits), int(i % 3 == 0)) for i in range(300)]
    m = toxicity.fit(rows, p)
    table = np.zeros(1 << p.bits)
    table[m.index] = m.weight
    score = lambda t: table[toxicity.features(t, p.bits)].sum() + m.bias
    assert score("w1 bad w2") > 0 > score("w1 good w2") and len(m.index) < 200


def test_urls_equal_sql(spark):
    cols, rows = oracles.rows_of_spark(queries.op5_url_rules(spark, SF))
    assert (cols, rows) == oracles.rows_of_sql(oracles.connection(SF), queries.OP5_SQL)


def test_url_rules_are_the_contracts():
    assert [(r.verdict, r.text) for r in queries.URL_RULES] == [
        ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
    ]


def test_urls_equal_rules_by_hand(spark):
    """Every url of the smallest pages against the contract's sentences, said once more in plain Python."""
    rules = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    for row in queries.op5_url_rules(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url"), "page_id").collect():
        rest = row.url.split("://", 1)[1] if row.url and "://" in row.url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if (h := r.partition("/")[0]) and (host == h or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
        best = max(fits, key=len, default=None)
        assert (row.host, row.path, row.rule, row.verdict) == (host, path, best, rules.get(best, "allow"))


def test_urls_edges(spark):
    urls = [
        (1, None), (2, ""), (3, "no scheme.com/en/"), (4, "HTTP://A.Example.COM/en/71?q=1"), (5, "x://example.com/en/8"), (6, "x://notexample.com/en/7"), (7, "x://com/en/"), (8, "x://a.com:80/en/"),
        (9, "x://b.net#/de/"), (10, "x://ÄB.net/de/9/"), (11, "x://example.net/de/8" + "y" * 9000), (12, "x://a/x.com/en/"), (None, "x://q.org/es/"), (None, "x://q.org/es/"), (13, "x://?a://b.com/en/"),
    ]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in urls], "page_id long, url string, host string, rule string").repartition(2)
    got = rows_of(url_rules.judge_urls(pages, queries.URL_RULES), "page_id", "host", "rule", "verdict")
    found = {r[0]: r[1:] for r in got if r[0] is not None}
    assert found[1] == ("", None, "allow") and found[3] == ("", None, "allow")
    assert found[4] == ("a.example.com", "example.com/en/7", "allow") and found[5][1:] == ("com/en/", "block")
    assert found[6][1:] == ("com/en/", "block") and found[7][1:] == ("com/en/", "block") and found[8][1:] == (None, "allow")
    assert found[9] == ("b.net", None, "allow") and found[10] == ("Äb.net", "net/de/", "allow") and found[11][1:] == ("example.net/de/8", "block")
    assert found[12][1:] == (None, "allow") and found[13] == ("", None, "allow") and len([r for r in got if r[0] is None]) == 2
    assert url_rules.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


@pytest.mark.parametrize("pattern", ["a*b", "**x", "?c*", "*.com/**", "ab", "a**b?"])
def test_automaton_equals_regex(pattern):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcx/."), rng.integers(0, 9))) for _ in range(300)] + ["a.com/b", "", "ab"]
    rx = re.compile("".join({"**": ".*", "*": "[^/]*", "?": "."}.get(p, re.escape(p)) for p in re.findall(r"\*\*|\*|\?|[^*?]", pattern)), re.S)
    tool = url_rules.Automaton([pattern] + ["zz" * 30] * 3 + [pattern])
    got = tool.run([t.encode() for t in texts])
    want = [rx.fullmatch(t) is not None for t in texts]
    assert got[:, 0].tolist() == want and got[:, 4].tolist() == want


def _brute_base(text):
    kind = re.compile(r"(?:" + "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey")) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    out = [(m.start(), m.end(), 0) for m in kind.finditer(text) if len(m.group(1)) >= 12]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_secrets(docs):
    live, shared = "Zq9" + "aB3x" * 6, "Kq7" + "bC4y" * 6
    rows = [
        (1, f"use {live} now", "a"), (2, f"again {live}", "a"), (3, f"see {shared}", "a"), (4, f"see {shared}", "b"), (5, None, "a"), (6, "", None), (7, "é PASSWORD = 'abcdefghijkl12' token:short api_key=ABCDEFGH1234", "b"),
        (8, "AKIA" + "Z" * 14 + " deadbeefdeadbeef0 AKIAshort", None), (None, f"x {live}", "a"), (7, "token=password=abcdefghijklm secret : \"aaaaaaaaaaaa\"", "c"), (9, "ſecret=abcdefghijklmnop " * 2000, "d"),
    ]
    got = secret_scan.digest(docs(rows)).toPandas()
    assert len(got) == len(rows)
    by = {(r.doc_id if r.doc_id == r.doc_id else None, r.base_sha256): r for r in got.itertuples()}
    for k, t, _ in rows:
        base = _brute_base(t or "")
        text = ",".join(f"{secret_scan.KINDS[x]}:{s}:{e}" for s, e, x in base)
        r = by[(k, hashlib.sha256(text.encode()).hexdigest())]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x == i for *_, x in base) for i in range(3))
        added = [s for s in r.spans.split(",") if s.startswith("live")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("live")] == ([x for x in text.split(",") if x])
        assert bool(added) == (t is not None and live in t)
    clean = {r["doc_id"]: r for r in secret_scan.redact(docs(rows)).collect() if r["doc_id"] in (1, 3, 5, 8)}
    assert clean[1]["text"] == "use [secret] now" and clean[3]["text"] == f"see {shared}" and clean[5]["text"] is None
    assert clean[8]["text"] == "[secret] [secret] AKIAshort" and clean[8]["n_chars"] == len(clean[8]["text"])
    assert secret_scan.digest(docs([])).count() == 0
    assert {r["widely_copied"] for r in secret_scan.ownership(docs(rows)).collect()} == {True, False}


def test_secrets_of_many_repositories_are_copies(docs):
    """Repeats in one document and in ten are live, those in eleven documents of one owner are not."""
    often, ten, many = (f"{c}q9" + "aB3x" * 6 for c in "XYZ")
    rows = [(1, f"{often} " * 40, "a")] + [(i, f"see {ten}", "a") for i in range(10)] + [(i, f"see {many}", "a") for i in range(10)] + [(None, f"see {many}", "a")]
    owned = {r["seen"]: (r["owners"], r["repos"], r["widely_copied"]) for r in secret_scan.ownership(docs(rows)).collect()}
    assert owned == {40: (1, 1, False), 10: (1, 10, False), 11: (1, 11, True)}
    assert sum(r["n_added"] for r in secret_scan.digest(docs(rows)).collect()) == 50
    text = " ".join(r["text"] for r in secret_scan.redact(docs(rows)).collect())
    assert often not in text and ten not in text and text.count(many) == 11


def test_copied_base_spans_are_told(docs):
    """Base spans stay, whoever holds them; those that several owners or many repositories hold are counted as copies."""
    rows = [(1, "token=abcdefghijkl and password: abcdefghijkl", "a"), (2, "secret = 'abcdefghijkl'", "b"), (3, "AKIA" + "Q" * 16, "a"), (4, "x" * 3 + " deadbeefdeadbeef12", "c"), (4, "deadbeefdeadbeef12", "c")]
    got = sorted((r["doc_id"], r["n_assign"], r["n_copied"]) for r in secret_scan.digest(docs(rows)).collect())
    assert got == [(1, 2, 2), (2, 1, 1), (3, 0, 0), (4, 0, 0), (4, 0, 0)]


def test_wider_spans_equal_all_pairs():
    rng = np.random.default_rng(11)
    for _ in range(200):
        text = "".join(rng.choice(list("aB3 x-é"), rng.integers(0, 300), p=[0.3, 0.3, 0.2, 0.05, 0.05, 0.05, 0.05]))
        base = sorted((s, s + int(rng.integers(1, 60)), 0) for s in rng.integers(0, max(1, len(text)), rng.integers(0, 5)).tolist())
        runs = [m.span() for m in re.finditer("[A-Za-z0-9+/_-]{20,}", text)]
        want = [(s, e) for s, e in runs if not any(a < e and b > s for a, b, _ in base) and "a" in text[s:e].replace("x", "a") and "B" in text[s:e] and "3" in text[s:e]]
        assert secret_scan.wider_spans(text, base) == want


def test_redaction_with_null_and_repeated_ids(docs):
    live = ["Zq9" + c * 4 + "aB3x" * 5 for c in "MNOP"]
    rows = [(None, f"one {live[0]}", "a"), (None, f"two {live[1]}", "b"), (1, f"three {live[2]}", "a"), (1, f"four {live[3]}", "a"), (1, f"four {live[3]}", "a")]
    assert sorted(r["text"] for r in secret_scan.redact(docs(rows)).collect()) == ["four [secret]", "four [secret]", "one [secret]", "three [secret]", "two [secret]"]


def test_decontamination(docs, spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho".split()
    near = list(item)
    near[4] = near[11] = "changed"
    rows = [
        (1, "before " * 5 + " ".join(item) + " after" * 3), (2, "x\n" + " ".join(near).upper()), (3, " ".join(item[:6])), (4, None), (5, ""), (6, " ".join(reversed(item))), (None, " ".join(item)),
        (7, " ".join(f"w{i}" for i in range(20_000)) + " " + " ".join(item)), (1, "nothing"), (8, " ".join(w if i % 2 else "no" for i, w in enumerate(item))),
    ]
    bench = spark.createDataFrame([(10, " ".join(item), 1), (11, None, 2), (12, "", 3), (13, "too short", 4), (10, " ".join(item), 5)], "item_id long, text string, passages int")
    got = decontamination.contaminated(docs(rows), bench)
    assert sorted([r["doc_id"] for r in got.collect()], key=lambda x: (x is not None, x)) == [None, 1, 2, 7]
    first = {r["doc_id"]: r["passages"][0] for r in got.collect()}
    assert (first[1]["item_id"], first[1]["first_word"], first[1]["words"], first[1]["same"]) == (10, 5, 17, 17) and first[2]["same"] == 15
    kept = decontamination.remove_contaminated(docs(rows), bench, block_chars=10)
    assert rows_of(kept, "doc_id") == [(1,), (3,), (4,), (5,), (6,), (8,)] and kept.columns == docs([]).columns
    assert decontamination.contaminated(docs(rows), bench.limit(0)).count() == 0 and decontamination.contaminated(docs([]), bench).count() == 0


def test_decontamination_finds_every_whole_item(spark):
    """Brute force: documents that hold an item's words in a row are reported, and all reported ones hold a close copy."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    norm = lambda t: " " + b" ".join(t.encode().lower().split()).decode() + " "
    items = [norm(t) for t in bench["text"]]
    whole = {i for i, t in zip(docs["doc_id"], docs["text"]) if any(x in norm(t) for x in items)}
    got = {r["doc_id"] for r in queries.op7_decontamination(spark, SF).collect()}
    assert whole <= got and len(got) <= len(whole) + 0.01 * len(docs)


@pytest.mark.parametrize("words", range(7, 14))
def test_no_substitution_hides_every_seed(words):
    """All placements of as many differing words as the rule allows."""
    masks, most = decontamination.masks_for(13, 75), words - -(-75 * words // 100)
    places = [{p + k for k, bit in enumerate(m) if bit == "1"} for m in masks for p in range(words - len(m) + 1)]
    assert all(any(not seed & set(differing) for seed in places) for differing in itertools.combinations(range(words), most))
    assert decontamination.hiding(masks, words) == next(k for k in range(words + 1) if any(all(seed & set(d) for seed in places) for d in itertools.combinations(range(words), k)))


def _brute_passages(text, items, least, percent):
    doc, out = text.lower().split(), []
    for k, t in items:
        item = t.lower().split()
        for shift in range(1 - len(item), len(doc)):
            a, b, need = max(0, shift), min(len(doc), shift + len(item)), min(least, len(item))
            same = [doc[i] == item[i - shift] for i in range(a, b)]
            good = [i for i in range(len(same) - need + 1) if 100 * sum(same[i : i + need]) >= percent * need]
            if good:
                out.append((k, a + good[0], good[-1] + need - good[0], sum(same[good[0] : good[-1] + need])))
    return sorted(out)


@pytest.mark.parametrize("least,percent", [(13, 75), (8, 50), (20, 90)])
def test_decontamination_of_substituted_passages(docs, spark, least, percent):
    rng = np.random.default_rng(least)
    items = [(i, " ".join(f"w{rng.integers(0, 400)}" for _ in range(n))) for i, n in enumerate([7, 8, 9, 10, 11, 12, 13, 14, 17, 20, 40] * 3)]
    rows = []
    for i, (_, t) in enumerate(items):
        for share in (0.1, 0.25, 0.25, 0.3, 0.5):
            body = [w if rng.random() >= share else f"x{rng.integers(0, 99)}" for w in t.split()]
            rows.append((len(rows), " ".join(["pre"] * (i % 3) + body + ["post"] * (i % 2))))
        for start in range(4):
            rows.append((len(rows), " ".join("gone" if k % 4 == start else w for k, w in enumerate(t.split()))))
    rows += [(len(rows) + i, " ".join("gone" if k in (2, 6, 10) else w for k, w in enumerate(t.split()[:13]))) for i, (_, t) in enumerate(items)]
    want = {k: p for k, t in rows if (p := _brute_passages(t, items, least, percent))}
    got = decontamination.contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string"), least, percent)
    assert {r["doc_id"]: [tuple(p) for p in r["passages"]] for r in got.collect()} == want
    kept = decontamination.remove_contaminated(docs(rows), spark.createDataFrame(items, "item_id long, text string"), least, percent)
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in rows} - set(want)


def test_short_items_are_found_where_asked_for(docs, spark):
    rng = np.random.default_rng(5)
    items = [(n, " ".join(f"i{n}-{k}" for k in range(n))) for n in range(1, 8)]
    rows = []
    for n, t in items:
        for gone in range(-1, n):
            rows.append((len(rows), "a b " + " ".join("x" if k == gone else w for k, w in enumerate(t.split())) + f" c{rng.integers(9)}"))
    want = {k: p for k, t in rows if (p := _brute_passages(t, items, 13, 75))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r["doc_id"]: [tuple(p) for p in r["passages"]] for r in decontamination.contaminated(docs(rows), bench, shortest=1).collect()} == want
    assert {p["item_id"] for r in decontamination.contaminated(docs(rows), bench).collect() for p in r["passages"]} == {7}


def test_a_phrase_repeated_on_both_sides(docs, spark, monkeypatch):
    monkeypatch.setattr(decontamination, "_HITS_AT_ONCE", 50)
    seeds = decontamination.Seeds([(1, "ha " * 60), (2, "ha ho " * 20)], 13, 75)
    words = decontamination.shingles.word_hashes(("ha " * 90).encode())[0]
    assert max(map(len, seeds.hits(words))) <= 50 + 60
    assert {p[0] for p in seeds.passages(words)} == {1}


def test_blocks_of_the_benchmark_give_one_row_a_document(docs, spark):
    items = [(k, " ".join(f"{c}{i}" for i in range(15))) for k, c in ((3, "a"), (None, "b"), (1, "c"), (None, "d"))]
    both, one = " x ".join(t for _, t in items), f"y {items[0][1]}"
    rows = [(1, both), (1, both), (1, one), (2, one), (None, both), (None, one), (3, "z"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = rows_of(decontamination.contaminated(docs(rows), bench), "doc_id", "n_passages", "passages")
    split = decontamination.contaminated(docs(rows), bench, block_chars=10)
    assert rows_of(split, "doc_id", "n_passages", "passages") == whole and len(whole) == 6 and split.columns == ["doc_id", "n_passages", "passages"]
    for most in (10, 1 << 20):
        kept = decontamination.remove_contaminated(docs(rows), bench, block_chars=most)
        assert kept.columns == docs([]).columns and rows_of(kept, "doc_id", "text") == [(3, "z"), (4, None)]
