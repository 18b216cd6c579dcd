"""Names against texts: containment by one automaton over all names, and closeness by longest matching blocks.

The side that is matched against goes out in blocks of bounded size, built into an automaton or a count matrix once a
worker; the other side stays where it is. So there is no nested loop of rows, and no shuffle but of what was found.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from difflib import SequenceMatcher

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLOCK_BYTES = 8 << 20
_built: dict[str, object] = {}


def _once(key: str, make):
    """What ``make`` gives, kept in this worker until another key is asked for."""
    if key not in _built:
        _built.clear()
        _built[key] = make()
    return _built[key]


def _blocks(names: DataFrame, most: int) -> Iterator[list[str]]:
    """Distinct filled names in blocks of about ``most`` bytes by a hash, one block at the driver at a time."""
    filled = names.select(F.col(names.columns[0]).cast("string").alias("name")).filter("name <> ''").distinct()
    size = filled.agg(F.sum(F.octet_length("name")).alias("n")).head()["n"] or 0
    n = -(-size // most)
    for k in range(n):
        yield [r.name for r in filled.filter(F.pmod(F.xxhash64("name"), F.lit(n)) == k).collect()]


def _automaton(names: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for n in names:
        found.add_word(n, n)
    found.make_automaton()
    return found


def contained(texts: DataFrame, names: DataFrame, text_col: str, name_col: str, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """Columns of ``texts`` but the text itself, and ``name``: a row for each distinct name that a row's text contains.

    Names and texts are compared as they stand; fold both before where case shall not count. Null and empty names are
    in no text; null texts contain none. Equal rows each give their rows. Names go out ``block_bytes`` at a time, a pass
    over the texts each; a text is read once a pass, however many names there are.
    """
    keep = [c for c in texts.columns if c != text_col]
    rows = texts.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join([*(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep), "name string"])

    def search(own: list[str]) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool = _once(key, lambda: _automaton(own)) if own else None
            for b in batches:
                found = [sorted({n for _, n in tool.iter(t)}) if tool and t else [] for t in b.column(len(keep)).to_pylist()]
                rows_of = b.take(pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found])))
                yield pa.RecordBatch.from_arrays([*rows_of.columns[: len(keep)], pa.array([n for f in found for n in f], pa.string())], [*keep, "name"])

        return rows.mapInArrow(run, schema)

    passes = [search(own) for own in _blocks(names.select(name_col), block_bytes)]
    return functools.reduce(DataFrame.unionByName, passes) if passes else search([])


def either_contains(queries: DataFrame, stored: DataFrame, query_col: str, name_col: str, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """query, name, kind: pairs of distinct filled values, lower-cased, of which one contains the other; kind is exact or fuzzy.

    Null and empty values match nothing.
    """
    fold = lambda df, c, name: df.select(F.lower(c).alias(name)).filter(F.col(name) != "").distinct()
    q, n = fold(queries, query_col, "query"), fold(stored, name_col, "name")
    inside = contained(q.select("query", F.col("query").alias("t")), n, "t", "name", block_bytes)
    around = contained(n.select("name", F.col("name").alias("t")).withColumnRenamed("name", "of"), q, "t", "query", block_bytes).select(F.col("name").alias("query"), F.col("of").alias("name"))
    return inside.unionByName(around).distinct().withColumn("kind", F.when(F.col("query") == F.col("name"), "exact").otherwise("fuzzy"))


def documents_of_names(queries: DataFrame, docs: DataFrame, query_col: str, name_col: str, id_col: str = "doc_id", most: int = 30) -> DataFrame:
    """query, id, kind, place: documents whose stored name is the query's or one contains the other, exact ones first, then by id, ``most`` a query."""
    pairs = either_contains(queries, docs, query_col, name_col)
    named = docs.select(F.col(id_col).alias("id"), F.lower(name_col).alias("name"))
    order = Window.partitionBy("query").orderBy(F.col("kind"), F.col("id").asc_nulls_last())
    placed = named.join(pairs, "name").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return placed.select("query", F.col("id").alias(id_col), "kind", "place")


class Nearest:
    """Names with their character counts, asked for the closest to a query."""

    def __init__(self, names: list[str]):
        self.names = sorted(names)
        self.sizes = np.array([len(n) for n in self.names])
        letters = {c: k for k, c in enumerate(sorted({c for n in self.names for c in n}))}
        self.letters, self.counts = letters, np.zeros((len(self.names), len(letters)), np.int32)
        for k, n in enumerate(self.names):
            np.add.at(self.counts[k], [letters[c] for c in n], 1)

    def best(self, query: str, least: float, most: int) -> list[tuple[str, float]]:
        """The ``most`` names of the highest ratio from ``least`` on; longer names and then names in order go first among equals.

        Characters in common bound the ratio from above, so names are looked at from the highest bound down and none
        after the bound falls below the worst that is kept.
        """
        own = np.zeros(len(self.letters), np.int32)
        for c in query:
            if c in self.letters:
                own[self.letters[c]] += 1
        bound = 2.0 * np.minimum(self.counts, own).sum(axis=1) / np.maximum(self.sizes + len(query), 1)
        whole = np.array([n in query or query in n for n in self.names], bool)
        bound[whole] = 1.0
        kept: list[tuple[float, int, str]] = []
        match = SequenceMatcher(None)
        match.set_seq1(query)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < least or len(kept) == most and bound[k] < -kept[-1][0]:
                break
            name = self.names[k]
            if whole[k]:
                ratio = 1.0
            else:
                match.set_seq2(name)
                ratio = match.ratio()
            if ratio >= least:
                kept = sorted([*kept, (-ratio, -len(name), name)])[:most]
        return [(name, -ratio) for ratio, _, name in kept]


def closest_names(queries: DataFrame, names: DataFrame, query_col: str, name_col: str, least: float = 0.38, most: int = 3, block_bytes: int = _BLOCK_BYTES) -> DataFrame:
    """query, name, ratio, place: of each distinct query the closest names, lower-cased.

    The ratio is 1 where one contains the other, else twice the characters in longest matching blocks over both lengths.
    Null and empty values take no part. Names go out in blocks; each gives its best, and the best of those are kept.
    """
    asked = queries.select(F.lower(query_col).alias("query")).filter("query <> ''").distinct()

    def search(own: list[str]) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tool = _once(key, lambda: Nearest(own))
            for b in batches:
                yield pd.DataFrame([(q, n, r) for q in b["query"] for n, r in tool.best(q, least, most)], columns=["query", "name", "ratio"])

        return asked.mapInPandas(run, "query string, name string, ratio double")

    passes = [search(own) for own in _blocks(names.select(F.lower(name_col).alias("name")), block_bytes)]
    found = functools.reduce(DataFrame.unionByName, passes) if passes else search([])
    order = Window.partitionBy("query").orderBy(F.col("ratio").desc(), F.length("name").desc(), "name")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
