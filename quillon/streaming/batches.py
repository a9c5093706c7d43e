"""Liability scan over a stream of files: stateless, so each micro-batch stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.functions import rules
from quillon.sources.sequences import normalized


def stream_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites of the pairs in CSV files (antibody_id, VH, VL) as they arrive in a folder."""
    raw = spark.readStream.option("header", True).schema("antibody_id string, VH string, VL string").csv(path)
    return rules.scan_sites(rules.chains(normalized(raw), "antibody_id"), "antibody_id")


def write_sites(sites: DataFrame, path: str, checkpoint: str):
    """Append to Parquet; what has arrived is processed, then the query ends."""
    return sites.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
