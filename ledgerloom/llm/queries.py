"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from ledgerloom.llm import common, decontamination, hyperminhash, kd_clusters, media, packing, resampling, secret_scan, sql, suffix_dedup, token_count, token_files, toxicity, url_rules, word_table


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark, sf_dir):
    return token_count.token_counts(_table(spark, sf_dir, "documents"), _byte_bpe())


def op2_near_duplicates(spark, sf_dir):
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op4_token_files(spark, sf_dir):
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), _byte_bpe(), common.fresh_dir(spark, "tokens"))
    return token_files.read_index(manifest)


# The contract's rules (fixed values); code and SQL both read this text.
URL_RULE_TEXT = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
URL_RULES = tuple(url_rules.Rule(*rule.split()) for rule in URL_RULE_TEXT.split(", "))


def op5_url_rules(spark, sf_dir):
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = rf"""
WITH rules(verdict, rule) AS (
  VALUES {", ".join(f"('{r.verdict}', '{r.text}')" for r in URL_RULES)}
), cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), hits AS (
  SELECT p.page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule) DESC) AS k
  FROM parts p JOIN rules r
    ON (p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(p.path, substr(r.rule, strpos(r.rule, '/')))
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id AND h.k = 1
"""


def op6_secret_scan(spark, sf_dir):
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_webp_media(spark, sf_dir):
    return media.describe(media.media_column(_table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op10_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), _byte_bpe())


def op11_resampling(spark, sf_dir):
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_kd_clusters(spark, sf_dir):
    return kd_clusters.cluster(_table(spark, sf_dir, "embeddings"))


def op13_word_table(spark, sf_dir):
    return word_table.digest(word_table.round_trip(_table(spark, sf_dir, "documents"), _byte_bpe()))


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_near_duplicates, op3_toxicity, op4_token_files, op5_url_rules, op6_secret_scan, op7_decontamination, op8_webp_media, op9_suffix_dedup, op10_packing, op11_resampling, op12_kd_clusters, op13_word_table)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_rules": OP5_SQL, "op11_resampling": sql.RESAMPLING, "op12_kd_clusters": sql.clusters()}
