"""Queries of scored metadata over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import metadata
from ledgerloom.sources.tables import load

# Who grants a licence, in the documents' own lines.
LICENCES = metadata.NameRules(
    labels=((r"(?i)licensed under the\s+(.+?)(?:,|\s{2,}|\n|$)", 10), (r"(?i)released under the\s+(.+?)(?:\.|\s{2,}|\n|$)", 9)),
    names=(r"[A-Z][\p{L}]+(?: [A-Z][\p{L}]+)* [A-Z][\p{L}]+", r"[A-Z][\p{L}]{7,}"),
    marks=("License", "Of"),
    against=("rights reserved",),
)
FIELDS = {
    "contact": ((r"([a-z]+\.\d+@[a-z0-9.]+)", 0.9), (r"\+1 (\(\d{3}\) 555-\d{4})", 0.7)),
    "licence": ((r"(?i)licensed under the ([A-Z][a-z]+)", 0.8), (r"(?i)released under the ([A-Z]+)", 0.8)),
    "address": ((r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b", 0.5),),
}


def document_names(spark, d):
    return metadata.document_names(load(spark, d, "documents"), LICENCES).withColumn("confidence", F.round("confidence", 2))


def anchored_fields(spark, d):
    """A line is a page here."""
    return metadata.anchored_fields(load(spark, d, "documents"), FIELDS, page_break="\n").select("doc_id", "field", "value", F.md5(F.col("source_text").cast("binary")).alias("source"), "source_page", "confidence")


QUERIES = {f.__name__: f for f in (document_names, anchored_fields)}

_SQUEEZE = r"trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g'))"
_SECTION = r"^(?:[IVX]+\.|[0-9]+\.)\s*\S"


def _field_sql(name: str, patterns) -> str:
    picks = " UNION ALL ".join(
        f"SELECT doc_id, text, {c}::DOUBLE AS confidence, {k} AS k, substr(trim(regexp_extract(substr(text, 1, 3000), '{p}', 1)), 1, 100) AS value, substr(trim(regexp_extract(substr(text, 1, 3000), '{p}', 0)), 1, 200) AS src FROM documents"
        for k, (p, c) in enumerate(patterns)
    )
    return f"""SELECT d.doc_id, '{name}' AS field, value, md5(src) AS source, CASE WHEN value IS NOT NULL THEN greatest(1, list_position(list_transform(string_split(d.text, chr(10)), lambda p: contains(p, substr(src, 1, 50))), true))::BIGINT END AS source_page, coalesce(confidence, 0.0)::DOUBLE AS confidence
      FROM documents d LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, k) AS n FROM ({picks}) WHERE src <> '' AND value <> '') f ON f.doc_id = d.doc_id AND n = 1"""


def _label(pattern: str, points: int, k: int) -> str:
    return f"SELECT doc_id, {points + 5} AS score, {k} AS k, trim(substr(trim(regexp_extract(substr(text, 1, 5000), '{pattern}', 1)), 1, 50)) AS name FROM documents"


ORACLES = {
    "document_names": rf"""WITH labels AS ({" UNION ALL ".join(_label(p, n, k) for k, (p, n) in enumerate(LICENCES.labels))}
        ), label AS (SELECT * FROM labels WHERE name <> '' AND NOT regexp_matches(name, '^\p{{Nd}}+$') AND NOT regexp_matches(name, '{_SECTION}') AND NOT contains(name, 'rights reserved') AND regexp_matches(name, '\p{{L}}')
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1
        ), lines AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(substr(text, 1, 10000), '\r?\n'), lambda x: {_SQUEEZE}), lambda x: x <> '') AS ls FROM documents
        ), each AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) - 1 AS k FROM lines
        ), named AS (SELECT *, trim(regexp_extract(s, '{LICENCES.names[0]}', 0)) AS a, trim(regexp_extract(s, '{LICENCES.names[1]}', 0)) AS b FROM each WHERE NOT regexp_matches(s, '{_SECTION}') AND NOT contains(s, 'rights reserved')
        ), scored AS (SELECT doc_id, k, CASE WHEN length(a) BETWEEN 2 AND 50 THEN a WHEN length(b) BETWEEN 2 AND 50 THEN b END AS name,
            (contains(s, 'License') OR contains(s, 'Of'))::INT * 5 + (k < 80)::INT * 3 + (length(s) BETWEEN 3 AND 40)::INT * 2 - (length(s) > 80)::INT * 2 - regexp_matches(s, '^\p{{Nd}}+\.\s*')::INT * 4 AS score FROM named
        ), line AS (SELECT * FROM scored WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1)
        SELECT d.doc_id, coalesce(l.name, i.name) AS name, CASE WHEN l.name IS NOT NULL THEN 'label' WHEN i.name IS NOT NULL THEN 'line' END AS kind, coalesce(l.score, i.score)::INT AS score, CASE WHEN l.name IS NULL THEN i.k::INT END AS line,
          CASE WHEN l.name IS NOT NULL THEN 0.9 WHEN i.score >= 5 THEN 0.7 WHEN i.name IS NOT NULL THEN 0.5 END::DOUBLE AS confidence
        FROM documents d LEFT JOIN label l ON l.doc_id = d.doc_id LEFT JOIN (SELECT * FROM line WHERE score >= 3) i ON i.doc_id = d.doc_id""",
    "anchored_fields": " UNION ALL ".join(_field_sql(n, p) for n, p in FIELDS.items()),
}
