"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which
is written and read again before the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers

from ledgerloom.llm import common, decontamination, hyperminhash, packing, secret_scan, toxicity


def drop_toxic(spark, docs, sf_dir):
    """Documents that score below 0.5, by a model learnt on labelled rows outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.learn(docs, labels))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: the least id."""
    return hyperminhash.one_of_each(docs)


def drop_contaminated(spark, docs, sf_dir):
    """Documents without a passage of ``benchmark``."""
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark, docs, sf_dir):
    """All documents, secrets replaced by a mark."""
    return secret_scan.redact(docs)


def pack(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# Learning, sketches and packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
