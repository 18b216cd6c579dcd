"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashed unigrams, bigrams and one-word skip-grams of its lower-cased
words. Per-coordinate rates and L1 leave few weights, which travel to the tasks as two short arrays.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import common

_WORD = re.compile(r"\w+")
_KEPT: dict[str, int] = {}
_KEPT_MOST = 500_000


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner; ``sample`` bounds the labelled rows it is fitted on."""

    bits: int = 22
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.5
    epochs: int = 6
    sample: int = 12_000


@dataclass(frozen=True)
class Model:
    """Sparse weights: ascending feature numbers, their weights, and the bias."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def features(text: str, bits: int) -> np.ndarray:
    """Distinct hashed unigrams, bigrams and skip-grams of a whole text, ascending."""
    words = _WORD.findall(text.lower())
    kept, ids = _KEPT, []
    for w in words:
        h = kept.get(w)
        if h is None:
            h = _hash(w)
            if len(w) <= 40:
                if len(kept) >= _KEPT_MOST:
                    kept.clear()
                kept[w] = h
        ids.append(h)
    h = np.array(ids, np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    every = np.concatenate([h, h[:-1] * a + h[1:] + np.uint64(1), h[:-2] * b + h[2:] + np.uint64(2)])
    return np.unique(common.mix64(every) >> np.uint64(64 - bits)).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], p: Ftrl) -> Model:
    """FTRL-proximal over (features, label) rows, in a fixed shuffled order an epoch; the last coordinate is the bias."""
    size = (1 << p.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)

    def weights(at):
        za = z[at]
        w = -(za - np.sign(za) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)
        return np.where(np.abs(za) <= p.l1, 0.0, w)

    for _ in range(p.epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            at = np.append(x, size - 1)
            w = weights(at)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w.sum()))))) - y
            na = n[at]
            z[at] += g - (np.sqrt(na + g * g) - np.sqrt(na)) / p.alpha * w
            n[at] = na + g * g
    at = np.flatnonzero(np.abs(z[:-1]) > p.l1)
    return Model(p.bits, at, weights(at).astype(np.float32), float(weights(np.array([size - 1]))[0]))


def _train(batches, params: Ftrl):
    common.claim("toxicity", _KEPT.clear)
    rows = []
    for b in batches:
        for key, t, y in zip(b.column("doc_id"), b.column("text"), b.column("toxic"), strict=True):
            rows.append((key.as_py(), features(t.as_py(), params.bits).astype(np.int32), y.as_py()))
    rows.sort(key=lambda r: (r[0], r[2], len(r[1])))
    m = fit([(x, y) for _, x, y in rows], params)
    yield pa.RecordBatch.from_arrays([pa.array([m.index.astype("<i8").tobytes()]), pa.array([m.weight.astype("<f4").tobytes()]), pa.array([m.bias])], ["index", "weight", "bias"])


def held_out(doc_id):
    """Whether crc32 of the id's text leaves no remainder by 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


# The bias where learning left none: a text that speaks neither way is not toxic.
_SILENT = -1e-6


def learn(docs: DataFrame, labels: DataFrame, params: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most ``params.sample`` labelled rows outside the held-out fold, taken by hash of the id.

    Labels of one id that differ count as 1; null labels and ids are passed over. Without labelled rows the
    model scores 0.5 everywhere; where learning leaves no bias, texts without known features score just under it; null and empty texts teach the bias alone; an id that several rows bear teaches
    with each. The sample bounds the one training task, what is shuffled to it and the broadcast of its ids.
    """
    found = common.arrow_map(_sample(docs, labels, params, id_col, text_col, label_col), "ledgerloom.llm.toxicity:_train", "index binary, weight binary, bias double", params=params).collect()
    if not found:
        return Model(params.bits, np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    return Model(params.bits, np.frombuffer(found[0]["index"], "<i8"), np.frombuffer(found[0]["weight"], "<f4"), found[0]["bias"] or _SILENT)


def _sample(docs: DataFrame, labels: DataFrame, params: Ftrl, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """The labelled rows that learn() fits on, in one partition; every task scans its share of ``docs`` for them."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample)
    return common.id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").repartition(1)


def _scores(batches, model: Model):
    common.claim("toxicity", _KEPT.clear)
    table = np.zeros(1 << model.bits, np.float32)
    table[model.index] = model.weight
    for b in batches:
        scores = []
        for t in b.column("text"):
            total = float(table[features(t.as_py(), model.bits)].sum()) + model.bias
            scores.append(1 / (1 + math.exp(-max(-35.0, min(35.0, total)))))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), *(b.column(k) for k in range(2, b.num_columns))], ["doc_id", "score", *b.schema.names[2:]])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Null and empty texts have no features and get the bias alone. Null ids stay null and are not held out.
    Repeated rows each give a row; other columns are not read; texts are read whole. No shuffle.
    """
    out = common.arrow_map(common.id_text(docs, id_col, text_col), "ledgerloom.llm.toxicity:_scores", "doc_id long, score double", model=model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; columns and order of columns stay.

    A model that has learnt nothing rejects nothing. Null and empty texts get the bias alone, as in score(), and null texts stay null; null ids stay; repeated rows go or stay together; an
    empty table gives an empty one. Columns of any name pass through unread. No shuffle.
    """
    if not len(model.index) and not model.bias:
        return docs
    inner = docs.select(F.lit(None).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.struct(*docs.columns).alias("kept"))
    kind = inner.schema["kept"].dataType.simpleString()
    return common.arrow_map(inner, "ledgerloom.llm.toxicity:_scores", f"doc_id long, score double, kept {kind}", model=model).filter("score < 0.5").select("kept.*")
