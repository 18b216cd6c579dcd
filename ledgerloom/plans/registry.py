"""All queries outside ``llm``, with their SQL."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("ledgerloom.plans.fact_queries", "ledgerloom.plans.record_queries", "ledgerloom.plans.text_queries", "ledgerloom.plans.quality_queries", "ledgerloom.plans.extraction_queries", "ledgerloom.plans.catalog_queries", "ledgerloom.plans.filing_queries", "ledgerloom.plans.answer_queries", "ledgerloom.plans.line_queries", "ledgerloom.plans.matching_queries", "ledgerloom.plans.payload_queries", "ledgerloom.plans.assembly_queries", "ledgerloom.plans.metadata_queries")


def _collected(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(name), attribute)
    return out


def queries() -> dict:
    return _collected("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collected("ORACLES")


def FLAGSHIP(spark, sf_dir):
    return queries()["fact_ranking_latest"](spark, sf_dir)
