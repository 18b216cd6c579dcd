"""Texts put together within budgets: the best paragraphs of a document, and windows of tokens with an exact overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACES = " \t\r\n\f\v"


@dataclass(frozen=True)
class AssemblyRules:
    """Which words make a paragraph a note, a correction or weigh it up, and the labels of its sections."""

    notes: tuple[str, ...] = ("license", "copyright", "footnote", "appendix")
    keywords: tuple[str, ...] = ("revenue", "profit", "assets", "equity", "total", "number")
    first: tuple[str, ...] = ("before correction", "after correction")
    doubtful: tuple[str, ...] = ("[low quality",)
    labels: Mapping[str, str] = field(default_factory=lambda: {"head": "[head]", "body": "[body]", "financial": "[figures]", "note": "[notes]"})
    head: int = 1000
    slack: int = 30
    least: int = 5


LATIN = AssemblyRules()


def paragraph_scores(paragraph: Column, rules: AssemblyRules = LATIN) -> tuple[Column, Column]:
    """(kind, score) of a paragraph: notes 5 less, tables with three numbers or more 8 more, 2 a keyword, 20 for corrections, 10 less for doubtful ones."""
    has = lambda words, text: F.greatest(F.lit(False), *(F.contains(text, F.lit(w)) for w in words))
    note = has(rules.notes, paragraph)
    table = has(("\t", "  ", "|"), paragraph) & (F.regexp_count(paragraph, F.lit(r"[0-9,]+(?:\.[0-9]+)?")) >= 3)
    kind = F.when(note, "note").when(table, "financial").otherwise("body")
    low, points = F.lower(paragraph), F.when(note, -5).when(table, 8).otherwise(0)
    for word in rules.keywords:
        points = points + F.when(F.contains(low, F.lit(word.lower())), 2).otherwise(0)
    return kind, points + F.when(has(rules.first, paragraph), 20).otherwise(0) - F.when(has(rules.doubtful, paragraph), 10).otherwise(0)


def assembled(docs: DataFrame, most: int = 12_000, rules: AssemblyRules = LATIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, assembled, n_taken, n_paragraphs: a text within about ``most`` characters, its best paragraphs after its head.

    A text that fits stays whole, under labels. Else its first ``rules.head`` characters are followed by paragraphs by
    score, ties by place, notes last, each taken if it still fits and skipped if not; a label stands where the kind
    changes. Texts that are null give null. One fold over a document's paragraphs, and no more are kept than fit; nothing
    is shuffled.
    """
    text, label = F.coalesce(F.col(text_col), F.lit("")), rules.labels
    strip = lambda c: F.btrim(c, F.lit(_SPACES))
    rest = F.substr(text, F.lit(rules.head + 1), F.length(text))
    scored = lambda p, k: F.struct(F.when(paragraph_scores(p, rules)[0] == "note", 1).otherwise(0).alias("late"), (-paragraph_scores(p, rules)[1]).alias("less"), k.alias("at"), paragraph_scores(p, rules)[0].alias("kind"), p.alias("p"))
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), text.alias("text"), strip(F.substr(text, F.lit(1), F.lit(rules.head))).alias("head"), F.transform(F.split(rest, r"\n\s*\n"), strip).alias("paras"))
    ranked = cut.select("*", F.array_sort(F.filter(F.transform("paras", scored), lambda s: F.length(s["p"]) >= rules.least)).alias("ranked"))
    room = most - 50 - F.length("head")  # what paragraphs may take beside the head
    needed = lambda s: F.length(s["p"]) + rules.slack
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("k"))
    step = lambda a, s: F.struct(
        F.when(a["used"] + needed(s) <= room, a["used"] + needed(s)).otherwise(a["used"]).alias("used"),
        F.when(a["used"] + needed(s) <= room, F.array_append(a["taken"], a["k"])).otherwise(a["taken"]).alias("taken"),
        (a["k"] + 1).alias("k"),
    )
    taken = ranked.withColumn("taken", F.aggregate("ranked", start, step)["taken"])
    chosen = taken.withColumn("chosen", F.transform("taken", lambda k: F.get("ranked", k)))
    named = F.create_map(*(F.lit(x) for pair in label.items() for x in pair))
    lines = F.transform("chosen", lambda s, k: F.when((k == 0) | (F.get("chosen", k - 1)["kind"] != s["kind"]), F.concat(F.lit("\n"), F.element_at(named, s["kind"]), F.lit("\n"), s["p"])).otherwise(s["p"]))
    long = F.concat_ws("\n", F.concat(F.lit(label["head"] + "\n"), "head"), F.array_join(lines, "\n"))
    body = F.substr("text", F.lit(rules.head + 1), F.length("text"))
    whole = F.concat(F.lit(label["head"] + "\n"), F.substr("text", F.lit(1), F.lit(rules.head)), F.when(strip(body) != "", F.concat(F.lit("\n\n" + label["body"] + "\n"), body)).otherwise(F.lit("")))
    fits = F.length("text") <= most
    out = F.when(F.col("none"), None).when(fits, whole).when(F.size("ranked") == 0, F.concat(F.lit(label["head"] + "\n"), "head", F.lit("\n\n" + label["body"] + "\n"), F.substr("text", F.lit(rules.head + 1), F.lit(most - rules.head)))).otherwise(long)
    return chosen.select(F.col("id").alias(id_col), out.alias("assembled"), F.when(fits, F.lit(None)).otherwise(F.size("taken")).alias("n_taken"), F.size("ranked").alias("n_paragraphs"))


def windows_of(sizes: list[int], most: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(first, end, shared) of windows over pieces of some sizes: up to ``most`` tokens, one piece at least; each begins with
    the last pieces of the one before that hold ``overlap`` tokens at most and leave room for something new."""
    first = end = 0
    while end < len(sizes):
        start, total = end, sum(sizes[first:end])
        while end < len(sizes) and (end == start or total + sizes[end] <= most):
            total += sizes[end]
            end += 1
        yield first, end, start - first
        first, kept = end, 0
        while end < len(sizes) and first > start and kept + sizes[first - 1] <= overlap and kept + sizes[first - 1] + sizes[end] <= most:
            first -= 1
            kept += sizes[first]


def token_windows(docs: DataFrame, most: int = 512, overlap: int = 64, ends: str = r"(?<=[.!?])\s+|\n+", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, idx, first_token, n_tokens, shared_tokens, chunk: windows of whole sentences, every token in one or more.

    Tokens are runs without white space. A sentence longer than ``most`` is cut into pieces of ``most`` tokens. Windows
    overlap by the last sentences of the one before, ``overlap`` tokens at most. Texts without tokens and null ones give
    none; each row is cut for itself, whatever its id. No shuffle.
    """
    sentence = re.compile(ends)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"], strict=True):
                words = [s.split() for s in sentence.split(text or "")]
                pieces = [w[k : k + most] for w in words for k in range(0, len(w), most)]
                starts = [0]
                for p in pieces:
                    starts.append(starts[-1] + len(p))
                for idx, (a, z, shared) in enumerate(windows_of([len(p) for p in pieces], most, overlap)):
                    rows.append((key, idx, starts[a], starts[z] - starts[a], starts[a + shared] - starts[a], " ".join(w for p in pieces[a:z] for w in p)))
            yield pd.DataFrame(rows, columns=["id", "idx", "first_token", "n_tokens", "shared_tokens", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, idx int, first_token long, n_tokens long, shared_tokens long, chunk string").withColumnRenamed("id", id_col)
