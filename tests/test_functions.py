"""Column expressions on small literals, Hangul rules among them."""

import math
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import labels as L
from ledgerloom.functions import text as T
from ledgerloom.functions import values as V
from ledgerloom.operators import chunking as C
from ledgerloom.operators import extraction as X
from ledgerloom.operators import facts as ops
from ledgerloom.operators import quality as Q
from ledgerloom.operators import records as R
from ledgerloom.operators import retrieval as S


def one(spark, expression, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).collect()[0][0]


@pytest.mark.parametrize(
    ("name", "good"),
    [("Alpha Beta", True), ("12345", False), ("1,234.5", False), ("2024-01-01", False), ("report.pdf", False), ("", False), ("   ", False), ("This is. A sentence", False), ("What?", False), ("x" * 61, False), ("삼성전자", True), (None, None)],
)
def test_company_names(spark, name, good):
    got = one(spark, lambda c: T.plausible_company(c), name)
    assert (got is not None) == bool(good)


def test_company_key(spark):
    assert one(spark, T.company_key, "Alpha Beta, Inc.") == one(spark, T.company_key, "ALPHA-BETA co") == "alphabeta"
    assert one(spark, T.company_key, "(주)한빛") == "한빛"


@pytest.mark.parametrize(("word", "want"), [("회사", "회사는"), ("법인", "법인은"), ("Corp", "Corp는")])
def test_particle(spark, word, want):
    assert one(spark, lambda c: T.particle(c, "은", "는"), word) == want


def test_readability_orders_texts(spark):
    clean = one(spark, lambda c: T.readability(c, T.HANGUL), "이 회사는 종이를 만들어 판매합니다 그리고 수출합니다")
    broken = one(spark, lambda c: T.readability(c, T.HANGUL), "ㄱㄴㄷㄹ ㅏㅑㅓㅕ ㅁㅂㅅㅇ ㅋㅌㅍㅎ")
    symbols = one(spark, lambda c: T.readability(c, T.HANGUL), "#$%& @@@@ ### $$$ %%% &&& ***")
    assert clean > 0.5 > max(broken, symbols) and one(spark, T.readability, "") == 0 and one(spark, T.readability, None) in (None, 0)


@pytest.mark.parametrize(("text", "confidence", "tag"), [("A clean sentence of plain words", 0.95, "good"), ("#$ %& ** ## @@ !!", 0.1, "very_low"), (" ", 0.9, "empty")])
def test_quality_tags(spark, text, confidence, tag):
    assert one(spark, lambda c: T.quality_tag(c, F.lit(confidence)), text) == tag


@pytest.mark.parametrize(("raw", "want"), [("1,234", 1234.0), ("(5.5)", -5.5), ("△7", -7.0), ("▲ 7", -7.0), ("-", None), ("", None), ("3 [2]", 3.0), ("1.2.3", None), (None, None)])
def test_numbers(spark, raw, want):
    assert one(spark, V.parsed_number, raw) == want


@pytest.mark.parametrize(("text", "want"), [("grew 120.5%", (120.5, "%")), ("about 3 billion and 2 million", (3e9, "currency")), ("21 million", (2.1e7, "currency")), ("paid 1,250 USD", (1250.0, "currency")), ("nothing", (None, None))])
def test_amounts(spark, text, want):
    assert tuple(one(spark, V.amount_phrase, text)) == want


def test_dates_and_years(spark):
    assert one(spark, V.dates_in, "2024.1.5 then 2024-01-05, 2023/12/31") == ["2024-01-05", "2023-12-31"]
    assert one(spark, V.years_in, "2021 x2019 2021 1999 20195") == [2019, 2021]
    assert str(one(spark, V.any_date, "20240131")) == "2024-01-31" and one(spark, V.any_date, "soon") is None
    assert one(spark, lambda c: V.fiscal_year(c.cast("date"), F.lit(True)), "2024-03-31") == 2023
    assert one(spark, lambda c: V.fiscal_year(c.cast("date"), F.lit(True)), "2024-08-31") == 2024


def test_json(spark):
    get = lambda f: lambda c: F.try_variant_get(f(c), "$.a", "long")
    assert one(spark, get(V.loaded_json), '{"a": 1}') == 1 and one(spark, get(V.loaded_json), '"{\\"a\\": 2}"') == 2 and one(spark, get(V.loaded_json), "no") is None
    assert one(spark, get(V.salvaged_json), 'Here: ```json\n{"a": 3}\n``` done') == 3 and one(spark, get(V.salvaged_json), 'x {"a": 4} y') == 4 and one(spark, get(V.salvaged_json), "none") is None


def test_text_rules(spark):
    assert one(spark, T.clean_lines, "<b>Hello  world</b>\n- 12 -\nx\nAll rights reserved.\ndeadbeefdeadbeef01 end") == "Hello world\nend"
    assert one(spark, T.lines_once, "a\nb\na\nc\nb") == "a\nb\nc"
    assert one(spark, lambda c: T.cut_at_sentence(c, 30), "A first whole sentence. And a second one that is long") == "A first whole sentence."
    assert one(spark, lambda c: T.cut_at_sentence(c, 30), "No end in sight for this very long sentence") == ""
    assert one(spark, T.query_terms, "The quick brown foxes of quick hills") == ["quick", "brown", "foxes", "hills"]
    assert one(spark, T.without_asterisks, "**bold** and\n* item") == "bold and\nitem"
    assert one(spark, T.collapsed_repeats, "a----------b ##### c") == "a-b # c"
    assert one(spark, lambda c: T.has_foreign(c), "漢字だ text") is True and one(spark, lambda c: T.has_foreign(c), None) is False
    assert one(spark, lambda c: T.jaccard(F.split(c, " "), F.array(F.lit("a"), F.lit("b"))), "b c") == pytest.approx(1 / 3)


def test_labels(spark):
    assert one(spark, L.period_type, "Q2 report") == "quarterly" and one(spark, L.period_type, "Semi-annual report") == "semiannual"
    assert one(spark, L.name_issues, "ACME 12345 #") == ["digits", "symbols", "shouting"] and one(spark, L.name_issues, None) == ["empty"]
    assert one(spark, L.trivial, "?!") is True and one(spark, L.trivial, None) is True and one(spark, L.trivial, "ok") is False


def test_sections():
    text = "# Business\nWe make paper. We sell it in many countries and to many firms, which is good for everyone here.\n" + "\n".join(f"Sales {i},123 45,678 99,000" for i in range(5)) + "\nThe end of it all is near, as this last paragraph of text will tell you at some length."
    pieces = C.section_pieces(text, C.PLANS["v3"])
    assert [k for _, k, _ in pieces] == ["text", "table", "text"] and {s for s, _, _ in pieces} == {"Business"}
    assert C.section_pieces(None, C.PLANS["v3"]) == [] and C.section_pieces("", C.PLANS["v5"]) == []
    long = C.section_pieces("A sentence of some length stands here. " * 200, C.PLANS["v3"])
    assert len(long) > 5 and all(len(p) <= 900 + 120 for _, _, p in long)


def test_line_work():
    assert X.nearest_amounts("revenue 21 million and operating profit (3 million)", {"revenue": ["revenue"], "op": ["operating profit"]}) == [("op", -3e6, "currency"), ("revenue", 2.1e7, "currency")]
    assert X.text_rank("", 3) == [] and X.text_rank(None) == []
    ranked = X.text_rank("Paper sales grew in spring. Paper sales fell in autumn. Weather was nice for walks. Paper sales of the year were flat. Totally unrelated remark here.", 2)
    assert len(ranked) == 2 and all("Paper" in s for s in ranked)
    assert X.quotes("Sales were 120 and 340 in the year. Short. A plain remark without any figures at all.", 1) == ["Sales were 120 and 340 in the year."]
    assert X.markdown_tables("a  b\n1  2\n3  4\n\nplain")[0].split("\n")[:2] == ["| a | b |", "| --- | --- |"]


def _brute_ranked(parts, n):
    """Chosen sentences by all pairs' cosines."""
    words = [set(re.findall(r"\w{2,}", s.lower())) for s in parts]
    df = {w: sum(w in own for own in words) for own in words for w in own}
    size = len(parts)
    idf = {w: math.log(size / k) + 1 for w, k in df.items()}
    norm = [math.sqrt(sum(idf[w] ** 2 for w in own)) for own in words]
    sim = [[sum(idf[w] ** 2 for w in words[i] & words[j]) / (norm[i] * norm[j]) if i != j and words[i] & words[j] else 0.0 for j in range(size)] for i in range(size)]
    sim = [[x / sum(own) for x in own] if sum(own) else own for own in sim]
    links = [[(j, sim[j][i]) for j in range(size) if sim[j][i]] for i in range(size)]
    rank = [1 / size] * size
    for _ in range(30):
        rank = [0.15 / size + 0.85 * sum(x * rank[j] for j, x in own) for own in links]
    score = [r * (1 + 0.2 * (len(re.findall(r"\d+", s)) >= 2) + 0.1 * (i < 3)) for i, (r, s) in enumerate(zip(rank, parts))]
    return [parts[i] for i in sorted(sorted(range(size), key=lambda i: (-round(score[i], 12), i))[:n])]


@pytest.mark.parametrize("first", [3, 430])
def test_text_rank_takes_all_sentences(first):
    """Sentences that share words only from number ``first`` on, against all pairs."""
    parts = [f"Alone{i} stands{i} by{i} itself{i}." for i in range(first)] + [f"Topic {i % 7} of paper{i % 3} and mill{i % 5}, {i * i % 11} in all." for i in range(40)]
    parts = list(dict.fromkeys(parts))
    got = X.text_rank("\n".join(parts), 4)
    assert got == _brute_ranked(parts, 4) and all(s.startswith("Topic") for s in got)


def test_corrections(spark):
    fix = lambda shown: one(spark, lambda c: X.corrected_numbers(c, F.lit(100.0), F.lit(shown)), f"was {shown:.0f}")
    assert fix(1000.0) == "was 100" and fix(300.0) == "was 300" and fix(10.0) == "was 100"


def test_ranks_and_unknowns(spark):
    rank = lambda v: one(spark, lambda c: ops.rank_of(c, ops.PERIOD_RANK, 4), v)
    assert [rank(v) for v in ("annual", "semiannual", "quarterly", "event", "?", None)] == [0, 1, 2, 3, 4, 4]
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "k long, p string")
    assert {r["k"] for r in ops.unknown_passes(rows, "p", "a").collect()} == {1, 2}


def test_quality_scores(spark):
    assert one(spark, lambda c: Q.language_quality(c), "a fine answer of enough length") == 1.0 and one(spark, lambda c: Q.language_quality(c), "{bad}") == pytest.approx(0.5)
    assert one(spark, lambda c: Q.correctness(F.array(F.lit("paper"), F.lit("salt")), c, F.lit(False)), "They make paper and salad") == pytest.approx(0.9)
    assert one(spark, lambda c: Q.correctness(F.array(), c, F.lit(True)), "This is not disclosed") == 1.0
    assert one(spark, lambda c: Q.same_as_evidence(c, F.lit("A b. C d.")), "A b. C d") is True
    assert one(spark, lambda c: S.grounding(c, F.lit("sales of 1,200")), "1200 and 999") == 0.5 and one(spark, lambda c: S.grounding(c, F.lit("x")), "no numbers") == 0.8


def test_gradient_and_islands(spark):
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate((0.9, 0.88, 0.5, 0.49, 0.48))], "k string, id long, s double")
    assert [r["id"] for r in R.gradient_cutoff(rows, ["k"], "s", "id").orderBy("place").collect()] == [0, 1]
    runs = spark.createDataFrame([(1, i, c) for i, c in enumerate("aabbba")], "k long, i long, c string")
    assert [(r["kind"], r["n"]) for r in R.islands(runs, ["k"], "i", F.col("c")).orderBy("island").collect()] == [("a", 2), ("b", 3), ("a", 1)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert S.nearest_each(none, none, 3).count() == 0 and S.nearest(none, [1.0], 3).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert C.section_chunks(docs).count() == 0 and X.summaries(docs).count() == 0 and C.paragraph_chunks(docs).count() == 0


def test_nearest_each_is_exact(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(60, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "vec_id long, embedding array<float>").repartition(5)
    got = S.nearest_each(rows.filter("vec_id % 10 = 0"), rows, 4, block=2).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        want = np.argsort(-np.maximum(np.round(u @ u[q], 6), 0), kind="stable")[:4].tolist()
        assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
