"""Drawing facts, classes, dates, summaries and tables out of documents."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import values as V
from ledgerloom.operators import records

# Own wording: class -> pattern, in order of precedence for ties.
CLASSES = {"report": r"annual|report|year", "legal": r"license|court|law", "technical": r"token|password|api|error", "general": r"the|und|que|les"}
EVENTS = {"merger": r"merger|acqui", "dividend": r"dividend", "offering": r"offering|capital increase", "correction": r"correct|amend", "licence": r"licen[cs]e"}


def classified(text: Column, classes: Mapping[str, str] = CLASSES, head: int = 300) -> Column:
    """The class with most hits, those in the head counting three times; of equals the first, none: other."""
    low = F.lower(text)
    scored = [F.struct((3 * T.count_of(F.substring(low, 1, head), p) + T.count_of(F.substr(low, F.lit(head + 1), F.length(low)), p)).alias("n"), F.lit(-i).alias("place"), F.lit(c).alias("name")) for i, (c, p) in enumerate(classes.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise("other")


def event_type(title: Column, text: Column, events: Mapping[str, str] = EVENTS, within: int = 500) -> Column:
    """The first event the title names, else the first in the text's beginning; else null."""
    t, head = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(text, 1, within))
    chain = None
    for source in (t, head):
        for name, pattern in events.items():
            chain = F.when(source.rlike(pattern), name) if chain is None else chain.when(source.rlike(pattern), name)
    return chain


def insights(rows: DataFrame) -> DataFrame:
    """Rule insights on ratios: debt low to 50, moderate to 100, high to 200, then critical; margin loss, thin to 5, fair to 15, then strong."""
    d, m = F.col("debt_ratio"), F.col("operating_margin")
    debt = F.when(d.isNull(), None).when(d <= 50, "low").when(d <= 100, "moderate").when(d <= 200, "high").otherwise("critical")
    margin = F.when(m.isNull(), None).when(m < 0, "loss").when(m <= 5, "thin").when(m <= 15, "fair").otherwise("strong")
    return rows.select("company", "fiscal_year", debt.alias("debt_level"), margin.alias("margin_level"))


def one_liner(company: Column, year: Column, revenue: Column, margin: Column) -> Column:
    """A sentence of revenue and margin; parts without a value are left out, without any there is none."""
    parts = F.concat_ws(", ", F.when(revenue.isNotNull(), F.concat(F.lit("revenue "), F.format_string("%.0f", revenue))), F.when(margin.isNotNull(), F.concat(F.lit("margin "), F.format_string("%.1f", margin), F.lit("%"))))
    return F.when(parts != "", F.concat(company, F.lit(" "), year.cast("string"), F.lit(": "), parts, F.lit(".")))


def first_known(candidates: Sequence[tuple[Column, float]]) -> Column:
    """(name, confidence) of the first plausible candidate, in order of trust; confidence 0 without any."""
    names = [(T.plausible_company(c), trust) for c, trust in candidates]
    chain = None
    for n, trust in names:
        chain = F.when(n.isNotNull(), F.lit(trust)) if chain is None else chain.when(n.isNotNull(), F.lit(trust))
    return F.struct(F.coalesce(*(n for n, _ in names)).alias("name"), chain.otherwise(0.0).alias("confidence"))


def metric_pairs(raw: Column) -> Column:
    """Array of (metric, value) of "name: 1,234 | other: 5"; parts without a number are left out."""
    parts = F.transform(F.split(raw, r"\|"), lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"^([^:]*):", 1))).alias("metric"), V.parsed_number(F.regexp_extract(p, r":\s*(.*)$", 1)).alias("value")))
    return F.filter(parts, lambda s: s["value"].isNotNull() & (s["metric"] != ""))


def labelled_dates(text: Column, labels: Mapping[str, str]) -> Column:
    """Map of label to the first date after its pattern; labels without a date are left out."""
    date = r"[^0-9\n]{0,20}((?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2})"
    found = F.create_map(*(x for k, p in labels.items() for x in (F.lit(k), F.regexp_extract(text, f"(?i){p}{date}", 1))))
    return F.map_filter(found, lambda _, v: v != "")


def suggestions(queries: DataFrame, names: DataFrame, least: float = 0.38, most: int = 3) -> DataFrame:
    """Names closest to a query text: 1 - edit distance / longer length of at least ``least``, the best few; ties by name."""
    q, n = F.lower(F.trim("query")), F.lower(F.trim("name"))
    ratio = F.round(1 - F.levenshtein(q, n) / F.greatest(F.length(q), F.length(n)), 6)
    from pyspark.sql import Window

    found = queries.join(names, F.abs(F.length(q) - F.length(n)) <= (1 - least) * F.greatest(F.length(q), F.length(n))).withColumn("ratio", ratio).filter(F.col("ratio") >= least)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.col("ratio").desc(), "name"))).filter(F.col("place") <= most)


def canonical_names(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Rows with the canonical name of their key, or the squeezed name where the alias table (alias, canonical) has none."""
    keyed = aliases.select(T.company_key(F.col("alias")).alias("_k"), "canonical").groupBy("_k").agg(F.min("canonical").alias("canonical"))
    return rows.withColumn("_k", T.company_key(F.col(name))).join(keyed, "_k", "left").withColumn("canonical", F.coalesce("canonical", T.squeezed(F.col(name)))).drop("_k")


def name_mismatches(rows: DataFrame, stored: str, inferred: Column) -> DataFrame:
    """Rows whose name inferred from elsewhere differs, by key, from the stored one; rows without either are no mismatch."""
    key = T.company_key(F.col(stored))
    return rows.withColumn("inferred", inferred).filter(F.col("inferred").isNotNull() & (key != "") & (key != T.company_key(F.col("inferred"))))


def year_of_text(docs: DataFrame, id_col: str, text_col: str, otherwise: Column) -> DataFrame:
    """The year 2010 to 2030 a text's beginning has most often, the first seen of equals; else ``otherwise``."""
    years = F.regexp_extract_all(F.substring(text_col, 1, 5000), F.lit(r"(?:^|[^0-9])(20[0-9]{2})(?:$|[^0-9])"), F.lit(1))
    seen = docs.select(id_col, F.posexplode(years).alias("place", "year")).filter(F.col("year").between("2010", "2030"))
    best = records.most_frequent(seen, [id_col], "year", "place").select(id_col, F.col("year").cast("int").alias("_y"))
    return docs.join(best, id_col, "left").select(id_col, F.coalesce("_y", otherwise).alias("fiscal_year"))


def corrected_numbers(text: Column, value: Column, shown: Column) -> Column:
    """Text in which the shown number is replaced by the known value when they differ by more than five times."""
    ratio = F.try_divide(F.abs(shown), F.abs(value))
    off = (ratio > 5) | (ratio < 0.2)
    return F.when(off, F.replace(text, F.format_string("%.0f", shown), F.format_string("%.0f", value))).otherwise(text)


# Functions below work line by line or sentence by sentence within one document, in vectorised batches of documents.

_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"\w{2,}")


def _linked_words(words: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sentence, word, weight) of the unit vectors of idf-weighted words, less words that only one sentence has.

    Those add to a sentence's length but to no similarity with another.
    """
    df = Counter(w for own in words for w in own)
    place = {w: i for i, w in enumerate(df)}
    row = np.repeat(np.arange(len(words)), [len(own) for own in words])
    col = np.fromiter((place[w] for own in words for w in own), np.int64, len(row))
    shared = np.fromiter(df.values(), np.int64, len(df))
    weight = np.array([math.log(len(words) / n) + 1 for n in shared.tolist()])[col]
    weight /= np.sqrt(np.bincount(row, weight**2, len(words)))[row]
    keep = shared[col] > 1
    return row[keep], col[keep], weight[keep]


def text_rank(text: str | None, n: int = 3, damping: float = 0.85, rounds: int = 30) -> list[str]:
    """The n most central sentences of 20 to 500 characters, in their order: cosine of idf-weighted word sets, then PageRank.

    All sentences take part. The similarities are the product of the sentence-word matrix and its transpose less
    the diagonal, and are never made: a round costs as much as the text has words.
    """
    parts = [s.strip() for s in _SENTENCE.split(text or "")]
    parts = list(dict.fromkeys(s for s in parts if 20 <= len(s) <= 500))
    if len(parts) <= n:
        return parts
    row, col, weight = _linked_words([list(dict.fromkeys(_WORD.findall(s.lower()))) for s in parts])

    def through(x: np.ndarray) -> np.ndarray:
        own = weight * x[row]
        return np.bincount(row, weight * (np.bincount(col, own)[col] - own), len(parts)) if len(row) else np.zeros(len(parts))

    total = np.maximum(through(np.ones(len(parts))), 1e-12)
    rank = np.full(len(parts), 1 / len(parts))
    for _ in range(rounds):
        rank = (1 - damping) / len(parts) + damping * through(rank / total)
    numbers = np.array([len(re.findall(r"\d+", s)) >= 2 for s in parts])
    score = rank * (1 + 0.2 * numbers + 0.1 * (np.arange(len(parts)) < 3))
    chosen = sorted(np.lexsort([np.arange(len(parts)), -np.round(score, 12)])[:n])
    return [parts[i] for i in chosen]


def _per_document(docs: DataFrame, id_col: str, text_col: str, work, name: str, at_once: int = 64) -> DataFrame:
    """id, place and each piece of ``work`` of a text; a worker holds the texts of ``at_once`` rows as Python strings, not those of a batch."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, at_once):
                keys, texts = (c.to_pylist() for c in b.slice(start, at_once).columns)
                rows = [(key, i, piece) for key, text in zip(keys, texts, strict=True) for i, piece in enumerate(work(text))]
                ids, places, pieces = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(places, pa.int32()), pa.array(pieces, pa.string())], ["id", "place", name])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, place int, {name} string").withColumnRenamed("id", id_col)


def summaries(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Central sentences of each document: id, place, sentence."""
    return _per_document(docs, id_col, text_col, lambda t: text_rank(t, n), "sentence")


def quotes(text: str | None, most: int = 3) -> list[str]:
    """Evidence quotes of 25 to 110 characters: sentences with two numbers first, then one, then a name, in their order."""
    parts = [s.strip() for s in _SENTENCE.split(text or "")]
    parts = list(dict.fromkeys(s for s in parts if 25 <= len(s) <= 110))
    tier = lambda s: 0 if len(re.findall(r"\d{2,}", s)) > 1 else 1 if re.search(r"\d{2,}", s) else 2 if re.search(r"\b[A-Z]\w+ [A-Z]\w+", s) else 3
    best = sorted(range(len(parts)), key=lambda i: (tier(parts[i]), i))[:most]
    return [parts[i] for i in sorted(best)]


def evidence(docs: DataFrame, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _per_document(docs, id_col, text_col, lambda t: quotes(t, most), "quote")


def markdown_tables(text: str | None, least: int = 3) -> list[str]:
    """Runs of at least ``least`` lines that split at bars or two spaces into the run's most common number of cells, as Markdown."""
    out, run = [], []

    def flush():
        width = Counter(map(len, run)).most_common(1)[0][0] if run else 0
        rows = [r for r in run if len(r) == width]
        if len(rows) >= least:
            lines = ["| " + " | ".join(r) + " |" for r in rows]
            out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        run.clear()

    for line in (text or "").split("\n"):
        cells = [c.strip() for c in re.split(r"\s*\|\s*|\s{2,}", line.strip()) if c.strip()]
        if len(cells) > 1:
            run.append(cells)
        else:
            flush()
    flush()
    return out


def tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return _per_document(docs, id_col, text_col, markdown_tables, "table_text")


_AMOUNT = re.compile(r"(\(?-?\d[\d,]*(?:\.\d+)?\)?)\s*(%|billion|million|thousand)?")
_SCALE = {"billion": 1e9, "million": 1e6, "thousand": 1e3}


def nearest_amounts(line: str, words: Mapping[str, Sequence[str]]) -> list[tuple[str, float, str]]:
    """(metric, value, unit) of each metric a line names: the amount nearest to the metric's word, each amount used once."""
    low, amounts = line.lower(), []
    for m in _AMOUNT.finditer(line):
        number = float(re.sub(r"[(),]", "", m[1]))
        value = (-number if m[1].startswith("(") else number) * _SCALE.get(m[2] or "", 1.0)
        amounts.append((m.start(), value, "%" if m[2] == "%" else "currency"))
    pairs = []
    for metric, names in words.items():
        for w in names:
            for hit in re.finditer(re.escape(w), low):
                pairs += [(abs(at - hit.end()) if at >= hit.end() else hit.start() - at + 3, metric, i) for i, (at, _, _) in enumerate(amounts)]
    out, used_metric, used_amount = [], set(), set()
    for _, metric, i in sorted(pairs):
        if metric not in used_metric and i not in used_amount:
            used_metric.add(metric)
            used_amount.add(i)
            out.append((metric, amounts[i][1], amounts[i][2]))
    return sorted(out)


def line_facts(docs: DataFrame, words: Mapping[str, Sequence[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metrics named in each document's lines with their nearest amounts, the first line of a metric winning: id, metric, value, unit, line_no."""
    kind = docs.schema[id_col].dataType.simpleString()
    words = {k: tuple(v) for k, v in words.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"], strict=True):
                seen = set()
                for no, line in enumerate((text or "").split("\n")):
                    for metric, value, unit in nearest_amounts(line, words):
                        if metric not in seen:
                            seen.add(metric)
                            rows.append((key, metric, value, unit, no))
            yield pd.DataFrame(rows, columns=["id", "metric", "value", "unit", "line_no"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, metric string, value double, unit string, line_no int").withColumnRenamed("id", id_col)
