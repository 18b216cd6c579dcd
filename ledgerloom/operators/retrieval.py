"""Scoring, ranking and thinning out of passages and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def nearest(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k vectors most similar to one query: id and similarity, not below 0, to 6 digits; ties by id. An exact scan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_col, F.round(F.greatest(cosine(F.col(vec_col), q), F.lit(0.0)), 6).alias("similarity"))
    return scored.orderBy(F.col("similarity").desc(), id_col).limit(k)


def nearest_each(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 256) -> DataFrame:
    """The k most similar vectors of each query, exact: query_id, id, similarity, rank.

    Queries are taken in blocks of bounded size, each sent to every task; a task keeps k per query from its own
    rows, and only those are ranked together. The vectors are scanned once a block and never shuffled.
    """
    import numpy as np

    kind = vectors.schema[id_col].dataType.simpleString()
    out, held = None, []

    def scan(ids, matrix):
        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                rows = np.stack(b["v"].to_numpy()).astype(float)
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)
                sims = np.round(np.maximum(matrix @ rows.T, 0.0), 6)
                keys = b["id"].to_numpy()
                for q, s in zip(ids, sims, strict=True):
                    best = np.lexsort([keys, -s])[:k]
                    yield pd.DataFrame({"query_id": q, "id": keys[best], "similarity": s[best]})

        return run

    def block_of(rows):
        matrix = np.array([r[1] for r in rows], float)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
        table = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter("v is not null")
        return table.mapInPandas(scan([r[0] for r in rows], matrix), f"query_id {kind}, id {kind}, similarity double")

    for row in queries.select(id_col, vec_col).filter(F.col(vec_col).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block:
            out, held = block_of(held) if out is None else out.union(block_of(held)), []
    if held or out is None:
        part = block_of(held) if held else vectors.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, similarity double")
        out = part if out is None else out.union(part)
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_tf(terms: list[str], tokens: Column, k1: float = 1.5, b: float = 0.75, mean_length: float = 200.0) -> Column:
    """Term-frequency score without inverse document frequency, repeated query terms counted again, scaled to 0..1."""
    norm = k1 * (1 - b + b * F.size(tokens) / mean_length)
    total = F.lit(0.0)
    for t in map(F.lit, terms):
        tf = (F.size(tokens) - F.size(F.array_remove(tokens, t))).cast("double")
        total = total + tf * (k1 + 1) / (tf + norm)
    return F.least(total / max(1.5 * len(terms), 1.0), F.lit(1.0))


def keyword_overlap(terms: Column, tokens: Column) -> Column:
    """Share of the terms that occur among the tokens; no terms: 0."""
    return F.coalesce(F.try_divide(F.size(F.filter(terms, lambda t: F.array_contains(tokens, t))), F.size(terms)), F.lit(0.0))


def company_match(wanted: str, stored: Column, strict: bool = True) -> Column:
    """0.6 equal, 0.4 one holds the other, else 0; an empty stored name matches nothing when strict, else counts 0.6."""
    w, s = F.lit(_plain(wanted)), T.company_key(F.coalesce(stored, F.lit("")))
    held = F.contains(s, w) | F.contains(w, s)
    return F.when(s == "", 0.0 if strict else 0.6).when(s == w, 0.6).when(held, 0.4).otherwise(0.0)


def _plain(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def composite(vector: Column, lexical: Column, meta: Column) -> Column:
    return F.round(0.40 * vector + 0.25 * lexical + 0.35 * meta, 4)


def density_bonus(text: Column, signals: str = "[0-9]{3,}", step: float = 0.05, most: float = 0.15) -> Column:
    """Bonus for signals per hundred characters."""
    return F.least(F.lit(most), step * T.count_of(text, signals) / F.greatest(F.length(text) / 100.0, F.lit(1.0)))


def fused(rerank: Column, score: Column) -> Column:
    return F.round(0.75 * rerank + 0.25 * score, 6)


def merged(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Union of candidate lists in order of priority; the first of each key stays."""
    out = None
    for i, s in enumerate(sources):
        part = s.select(key, *columns).withColumn("_source", F.lit(i))
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy(key).orderBy("_source", *columns)
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(key, *columns, F.col("_source").alias("source_no"))


def diverse(pool: DataFrame, key: str, score: str, text: str, k: int, limit: float = 0.8, most: int = 50) -> DataFrame:
    """Greedy choice from the ``most`` best rows, at least ``k``: a row stays if no kept one's tokens are more similar than ``limit``.

    The pool is a top-k list, so its bound is the feature; the greedy choice runs in one task.
    """
    top = pool.orderBy(F.col(score).desc(), key).limit(max(most, k)).select(F.col(key).alias("key"), F.col(score).cast("double").alias("score"), T.tokens(F.substring(text, 1, 300)).alias("tokens"))
    kind = pool.schema[key].dataType.simpleString()

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple] = []
        for row in pdf.sort_values(["score", "key"], ascending=[False, True]).itertuples():
            own = set(row.tokens)
            if len(kept) < k and all(len(own & other) <= limit * len(own | other) for _, other in kept):
                kept.append(((row.key, row.score), own))
        return pd.DataFrame([r for r, _ in kept], columns=["key", "score"])

    return top.groupBy(F.lit(0).alias("all")).applyInPandas(choose, f"key {kind}, score double").withColumnRenamed("key", key)


def compressed(text: Column, terms: list[str], longer_than: int = 400, least: int = 80) -> Column:
    """The first sentence and those with a query term or a number of three digits, where enough is left; else the text."""
    sentences = F.split(text, r"(?<=[.!?])\s+")
    wanted = F.filter(sentences, lambda s, i: (i == 0) | s.rlike("[0-9]{3,}") | F.lower(s).rlike("|".join(terms) if terms else "(?!)"))
    short = F.array_join(wanted, " ")
    return F.when((F.length(text) > longer_than) & (F.length(short) >= least) & (F.size(sentences) > 3), short).otherwise(text)


def grounding(answer: Column, evidence: Column) -> Column:
    """Share of an answer's distinct numbers of three or more digits found in the evidence; 0.8 when it has none."""
    numbers = F.array_distinct(F.regexp_extract_all(F.regexp_replace(answer, ",", ""), F.lit("[0-9]{3,}"), F.lit(0)))
    plain = F.regexp_replace(evidence, ",", "")
    found = F.size(F.filter(numbers, lambda n: F.contains(plain, n)))
    return F.coalesce(F.try_divide(found, F.size(numbers)), F.lit(0.8))


def judged(chunks: DataFrame, key: str, text: str, score: str, least: int = 40) -> DataFrame:
    """Chunks long enough, not mostly symbols, the first of each 140-character beginning, best first."""
    rows = chunks.filter((F.length(text) >= least) & (T.count_of(F.col(text), r"[#$%&*]") < 0.05 * F.length(text)))
    w = Window.partitionBy(F.substring(F.lower(T.squeezed(F.col(text))), 1, 140)).orderBy(F.col(score).desc(), key)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def passage_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, text: str, limit: float, least: int = 6) -> DataFrame:
    """Pairs where the left row holds at least ``limit`` of the right row's distinct tokens.

    An inverted-list join over the right side's rare end: of a right row's tokens, ordered by their frequency among right
    rows, the first n - ceil(limit * n) + k must hold k of the left row's; k is ``least``, or all that are asked for if
    these are fewer. Left texts are cut into tokens once for that, and once more where a pair is left; its share is then
    taken from the whole sets. Rows that share an id are looked for together and compared each for itself, null ids too.
    """
    cut = lambda: F.array_distinct(T.tokens(F.col(text)))
    lt = left.select(F.col(left_id).alias("l"), text)
    rt = right.select(F.col(right_id).alias("r"), cut().alias("rt")).filter(F.size("rt") > 0).withColumn("j", F.md5(F.array_join("rt", " ")))
    placed = rt.dropDuplicates(["j"]).select("j", F.size("rt").alias("n"), F.explode("rt").alias("t"))
    seen = placed.groupBy("t").agg(F.count("*").alias("df"))
    # A share is rounded before it is compared, so a hair less than the limit passes too.
    asked = F.greatest(F.ceil(F.col("n") * F.lit(limit - 1e-6)), F.lit(1))
    ranked = placed.join(seen, "t").withColumn("k", F.row_number().over(Window.partitionBy("j").orderBy("df", "t")))
    most = ranked.withColumn("hits", F.least(asked, F.lit(least))).filter(F.col("k") <= F.col("n") - asked + F.col("hits"))
    found = lt.select("l", F.explode_outer(cut()).alias("t")).join(most.select("t", "j", "hits"), "t")
    near = found.groupBy("l", "j").agg(F.count("*").alias("hit"), F.first("hits").alias("hits")).filter("hit >= hits")
    wanted = near.groupBy("l").agg(F.collect_list("j").alias("js")).withColumnRenamed("l", "id")
    held = lt.join(wanted, F.col("l").eqNullSafe(F.col("id"))).select("l", cut().alias("lt"), F.explode("js").alias("j"))
    share = F.size(F.array_intersect("lt", "rt")) / F.size("rt")
    return held.join(rt, "j").withColumn("share", F.round(share, 6)).filter(F.col("share") >= limit).select(F.col("l").alias(left_id), F.col("r").alias(right_id), "share")
