"""Registry of the engine's queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.plans import assay_queries, claim_queries, evidence_queries, import_queries, model_queries, rule_queries, science_queries, stat_queries, table_queries, text_queries, validation_queries

MODULES = (rule_queries, table_queries, stat_queries, text_queries, science_queries, evidence_queries, import_queries, assay_queries, claim_queries, validation_queries, model_queries)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch liability summary: scan, regions, scores, one row per pair."""
    return rule_queries.batch_summary(spark, sf_dir)
