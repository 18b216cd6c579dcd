"""Queries of names against texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import matching
from ledgerloom.sources.tables import load


def _long_words(df, least: int, *keep: str):
    """Distinct words of ``least`` letters or more, lower-cased."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{least},}}"), F.lit(0))
    return df.select(*keep, F.explode(words).alias("name")).distinct()


def names_in_texts(spark, d):
    """Long words of the benchmark as a registry of names; of each name, the documents that hold it and the least of their ids."""
    docs = load(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    found = matching.contained(docs, _long_words(load(spark, d, "benchmark"), 9), "text", "name")
    return found.groupBy("name").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def sources_either_way(spark, d):
    """For each source as a question, the first thirty documents of it and of sources whose name holds it or lies in it."""
    docs = load(spark, d, "documents")
    return matching.documents_of_names(docs, docs, "source", "source")


def closest_words(spark, d):
    """Long words of the benchmark as questions, long words of what users wrote as names."""
    asked = _long_words(load(spark, d, "benchmark"), 10)
    names = _long_words(load(spark, d, "conversations").filter("role = 'user'"), 10)
    return matching.closest_names(asked, names, "name", "name").select("query", "name", F.round("ratio", 6).alias("ratio"), "place")


QUERIES = {f.__name__: f for f in (names_in_texts, sources_either_way, closest_words)}

ORACLES = {
    "names_in_texts": r"""WITH names AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}{9,}')) AS name FROM benchmark)
        SELECT name, count(*) AS n, min(doc_id) AS first_doc FROM documents JOIN names ON contains(lower(text), name) GROUP BY 1""",
    "sources_either_way": """WITH q AS (SELECT DISTINCT lower(source) AS query FROM documents WHERE source <> ''), m AS (
          SELECT query, doc_id, CASE WHEN lower(source) = query THEN 'exact' ELSE 'fuzzy' END AS kind FROM documents JOIN q ON source <> '' AND (contains(lower(source), query) OR contains(query, lower(source)))),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY kind, doc_id NULLS LAST) AS INTEGER) AS place FROM m) SELECT * FROM r WHERE place <= 30""",
}
