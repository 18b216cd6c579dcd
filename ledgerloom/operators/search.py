"""Search of passages in stages: candidates from several sources, one score, penalties, and the filter on the company."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import labels as L
from ledgerloom.functions import text as T
from ledgerloom.operators import filters
from ledgerloom.operators import retrieval as R


@dataclass(frozen=True)
class Request:
    """What is searched for; empty parts do not count."""

    vector: Sequence[float]
    terms: Sequence[str]
    k: int = 10
    company: str = ""
    variants: Sequence[str] = ()
    category: str = ""
    years: Sequence[str] = ()
    domain: Sequence[str] = ()

    @property
    def fetch(self) -> int:
        return min(3 * self.k, 30)

    @property
    def pool(self) -> int:
        return min(max(3 * self.k, 15), 50)


def candidates(chunks: DataFrame, ask: Request, key: str, text: str, company: str, category: str, keyword_most: int = 40) -> DataFrame:
    """Chunks with ``vector_score`` and ``source_no``: nearest of company and category, nearest of the category, those with a long term, and the nearest of all where these give none.

    Every list is a top-k, so only its rows travel; a chunk of several lists counts for the first.
    """
    q = F.array(*(F.lit(float(x)) for x in ask.vector))
    scored = chunks.withColumn("vector_score", F.round(F.greatest(F.coalesce(R.cosine(F.col("embedding"), q), F.lit(0.0)), F.lit(0.0)), 6)).drop("embedding")
    nearest = lambda rows: rows.orderBy(F.col("vector_score").desc(), key).limit(ask.fetch)
    general = filters.matching(scored, {category: ask.category})
    lists = [nearest(general.filter(F.lower(F.col(company)).contains(ask.company.lower())))] if ask.company else []
    lists.append(nearest(general))
    long = sorted(dict.fromkeys(t.lower() for t in ask.terms), key=lambda t: (-len(t), t))[:4]
    if long:
        held = [F.lower(F.col(text)).contains(t) for t in long]
        in_year = functools.reduce(Column.__or__, (F.col(text).contains(y) for y in ask.years), F.lit(not ask.years))
        hits = functools.reduce(Column.__add__, (h.cast("int") for h in held))
        found = scored.filter(in_year & functools.reduce(Column.__or__, held)).withColumn("_hits", hits)
        lists.append(found.orderBy(F.col("_hits").desc(), key).limit(keyword_most).drop("_hits"))
    some = functools.reduce(DataFrame.unionByName, lists).agg((F.count("*") == 0).alias("_none"))  # one row
    lists.append(nearest(scored).join(F.broadcast(some), F.col("_none")).drop("_none"))
    return R.merged(lists, key, [c for c in scored.columns if c != key])


def score(rows: DataFrame, ask: Request, text: str, company: str, meta: Column) -> Column:
    """Composite of vector, terms and metadata; more for year, domain, figures and company; less for foreign script and JSON remains."""
    t = F.col(text)
    base = 0.40 * F.col("vector_score") + 0.25 * R.bm25_tf(list(ask.terms), T.tokens(t)) + 0.35 * meta
    if ask.years:
        base = base * F.when(functools.reduce(Column.__or__, (t.contains(y) for y in ask.years)), 1.08).otherwise(1.0)
    if ask.domain:
        base = base * L.domain_boost(t, tuple(ask.domain))
    base = base + F.least(F.lit(0.20), R.density_bonus(t))
    if ask.variants:
        head = F.lower(F.substring(text, 1, 3000))
        base = base * F.when(functools.reduce(Column.__or__, (head.contains(v.lower()) for v in ask.variants)), 1.35).otherwise(1.0)
    if ask.company:
        stored, wanted = F.lower(F.coalesce(F.col(company), F.lit(""))), F.lit(ask.company.lower())
        base = base * F.when(stored == "", 1.0).when(stored == wanted, 1.60).when(F.contains(stored, wanted) | F.contains(wanted, stored), 1.30).otherwise(1.0)
    head = F.substring(text, 1, 500)
    json = F.substring(text, 1, 300)
    penalty = F.when(T.count_of(head, r"\p{IsHan}") > 3, 0.15).otherwise(0.0) + F.when(T.count_of(head, "[ぁ-ヿ]") > 2, 0.10).otherwise(0.0) + F.when(T.count_of(json, r'\{"') + T.count_of(json, '":') >= 3, 0.12).otherwise(0.0)
    return F.round(F.when(penalty > 0, F.greatest(F.lit(0.01), base - penalty)).otherwise(base), 4)


def staged_search(chunks: DataFrame, ask: Request, meta: Column, key: str = "doc_id", text: str = "text", company: str = "company", category: str = "category", least: float = 0.08, shortest: int = 20) -> DataFrame:
    """The pool for a reranker: key, company, source_no and score, best first; ``meta`` scores the metadata of a row.

    Null and short texts are left out; rows of other companies too, where any row names the one asked for; no
    candidates give an empty table.
    """
    found = candidates(chunks, ask, key, text, company, category).filter(F.length(F.trim(text)) >= shortest)
    scored = found.withColumn("score", score(found, ask, text, company, meta))
    if ask.company and ask.variants:
        scored = filters.of_company(scored, ask.variants, [company], text)
    return scored.filter(F.col("score") >= least).orderBy(F.col("score").desc(), key).limit(ask.pool).select(key, company, "source_no", "score")


def rewrites(question: Column, company: Column, intent: Column, most: int = 6) -> Column:
    """Distinct wordings of a question: as it is, with the company, and with what its intent looks for."""
    wordings = {"ranking": ("largest", "ranking of"), "trend": ("change over years of", "growth of"), "outlook": ("outlook of", "risks of")}
    named = F.concat_ws(" ", F.nullif(company, F.lit("")), question)
    more = [F.when(intent == i, F.concat_ws(" ", F.lit(w), F.coalesce(F.nullif(company, F.lit("")), question))) for i, ws in wordings.items() for w in ws]
    return F.slice(F.array_distinct(F.array_compact(F.array(question, named, *more))), 1, most)
