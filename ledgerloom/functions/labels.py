"""Labels inferred from names and texts: file kinds, periods, scopes, table types, domains, issue codes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import text as T

DOMAINS = {"law": ("license", "court", "law"), "security": ("password", "token", "secret"), "language": ("the", "and", "of")}


def period_type(text: Column) -> Column:
    """event, quarterly, semiannual or annual by the words of a title; else unknown."""
    t = F.lower(text)
    return F.when(t.rlike("event|material fact"), "event").when(t.rlike("quarter|q[1-4]"), "quarterly").when(t.rlike("half|semi"), "semiannual").when(t.rlike("annual|year"), "annual").otherwise("unknown")


def table_type(head: Column) -> Column:
    """balance, income, cash, equity, retained or normal by a table's first lines."""
    h = F.lower(head)
    return F.when(h.rlike("total assets|liabilities"), "balance").when(h.rlike("revenue|sales|cost of"), "income").when(h.rlike("cash flow|operating activities"), "cash").when(h.rlike("changes in equity"), "equity").when(h.rlike("retained"), "retained").otherwise("normal")


def domain_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of a domain's words a text holds."""
    low, total = F.lower(text), F.lit(0)
    for w in words:
        total = total + F.contains(low, F.lit(w)).cast("int")
    return total


def domain_boost(text: Column, words: tuple[str, ...]) -> Column:
    """1.20 from three words on, 1.12 with any, else 1."""
    n = domain_hits(text, words)
    return F.when(n >= 3, 1.20).when(n >= 1, 1.12).otherwise(1.0)


def best_domain(text: Column, domains: Mapping[str, tuple[str, ...]] = DOMAINS) -> Column:
    """The domain with most words in a text; of equals the first; none: null."""
    scored = [F.struct(domain_hits(text, w).alias("n"), F.lit(-i).alias("p"), F.lit(d).alias("d")) for i, (d, w) in enumerate(domains.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["d"])


def trivial(message: Column) -> Column:
    """Fewer than two letters or digits."""
    return F.length(F.regexp_replace(F.coalesce(message, F.lit("")), r"[^\p{L}\p{N}]", "")) < 2


def name_issues(name: Column) -> Column:
    """Codes of what is wrong with a company name."""
    n = F.coalesce(T.squeezed(name), F.lit(""))
    return F.array_compact(
        F.array(
            F.when(n == "", "empty"),
            F.when(F.length(n) > 30, "too_long"),
            F.when(n.rlike("[0-9]{4,}"), "digits"),
            F.when(n.rlike("[#$%&*@]"), "symbols"),
            F.when((n != "") & (n == F.upper(n)) & n.rlike(r"\p{L}"), "shouting"),
        )
    )


def metadata_score(company: Column, wanted_company: str, language: Column, wanted_language: str, recency: Column) -> Column:
    """0.6 equal company, 0.4 one name inside the other; 0.3 language; 0.1 recent; at most 1."""
    c, w = F.lower(F.coalesce(company, F.lit(""))), F.lit(wanted_company.lower())
    score = F.when(c == w, 0.6).when((c != "") & (F.contains(c, w) | F.contains(w, c)), 0.4).otherwise(0.0)
    return F.least(F.lit(1.0), score + F.when(language == wanted_language, 0.3).otherwise(0.0) + F.when(recency, 0.1).otherwise(0.0))


def slots(text: Column, lexicon: Mapping[str, str]) -> Column:
    """Names of the slots whose pattern a text holds."""
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), s) for s, p in lexicon.items())))
