"""The contract queries: SQL oracles, held-out accuracy, brute force, and the pipeline's stages."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import same_as_oracle  # noqa: E402

from quillon.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, data, name):
    same_as_oracle(spark, duck, data, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, data, name):
    docs = spark.read.parquet(f"{data}/documents.parquet").count()
    assert registry.QUERIES[name](spark, data).count() >= docs


def test_held_out(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet")
    q = registry.QUERIES["op6_quality"](spark, data).join(labels, "doc_id").filter("held_out")
    right = q.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.9
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").filter("lang IS NOT NULL")
    l = registry.QUERIES["op10_language_id"](spark, data).join(docs, "doc_id").filter("held_out")
    assert l.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = spark.createDataFrame(stage(spark, out, data).collect(), docs.schema)
        assert kept.columns == docs.columns, name
        assert 0 < kept.count() <= out.count()
        out = kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, data)
    assert pieces.select("doc_id").distinct().count() == out.count()
    assert corpus_pipeline.run(spark, data).count() == pieces.count()
