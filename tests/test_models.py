"""Bundles, one-shot evaluation, splits on disk, class resamples, variants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import models, validation


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(k, float(a), float(b), float(a + 0.1 * b > 0)) for k, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    return spark.createDataFrame(data, "k bigint, a double, b double, y double")


def test_bundle(spark, rows, tmp_path):
    model = models.pipeline("logistic", ["a", "b"], "y", regParam=0.01).fit(rows)
    path = f"{tmp_path}/bundle"
    models.save_bundle(model, "logistic", ["a", "b"], "1", path, spark)
    again, manifest = models.load_bundle(spark, path, "1")
    got = {r.k: r.prediction for r in models.frozen_predictions(rows.unionByName(rows.limit(3)), again, manifest, "k").collect()}
    assert np.mean([got[r.k] == r.y for r in rows.collect()]) > 0.95
    with pytest.raises(ValueError, match="version"):
        models.load_bundle(spark, path, "2")
    with pytest.raises(ValueError, match="missing features"):
        models.frozen_predictions(rows.drop("a"), again, manifest, "k")
    out = again.transform(rows)
    assert models.evaluate_once(out, "logistic", "y", f"{tmp_path}/done")["roc_auc"] > 0.98
    with pytest.raises(FileExistsError):
        models.evaluate_once(out, "logistic", "y", f"{tmp_path}/done")
    assert models.importances(model, ["a", "b"])[0][0] == "a"
    with pytest.raises(ValueError, match="no model"):
        models.pipeline("none", ["a"], "y")


def test_cross_validation_and_split(spark, rows, tmp_path):
    cv = {(r.model, r.metric): r.mean for r in models.cross_validated(rows, "k", ["logistic", "gradient_boosting"], ["a", "b"], "y", k=3).collect()}
    assert cv["logistic", "roc_auc"] > 0.98 and cv["gradient_boosting", "roc_auc"] > 0.9
    split = validation.stratified_split(rows, "k", "y")
    models.write_split(split, "split", "y", f"{tmp_path}/s")
    test = spark.read.parquet(f"{tmp_path}/s/test_features")
    assert set(test.columns) == {"k", "a", "b"} and spark.read.parquet(f"{tmp_path}/s/test_labels").columns == ["k", "y"]
    n = {r.y: (r["t"], r["n"]) for r in split.groupBy("y").agg(F.count(F.when(F.col("split") == "TEST", 1)).alias("t"), F.count("*").alias("n")).collect()}
    assert all(t == int(0.2 * m + 0.5) for t, m in n.values())


def test_class_resamples(spark, rows):
    df = rows.withColumn("s", F.round("a", 1)).withColumn("g", F.lit("x"))
    r = validation.class_resamples(df, ["g"], "s", "y", resamples=200).first()
    data = [(x.s, x.y) for x in df.collect()]
    pos, neg = [s for s, y in data if y == 1], [s for s, y in data if y == 0]
    roc = np.mean([(p > m) + (p == m) / 2 for p in pos for m in neg])
    assert abs(r.roc - roc) < 1e-12 and r.roc_low <= r.roc <= r.roc_high and r.pr_low <= r.pr <= r.pr_high
    assert validation.class_resamples(df.filter("y = 1"), ["g"], "s", "y").first().roc is None


def test_variants(spark):
    pool = ["EVQLVESGGGLVQPGGSLRLSCAASGFTFS"]
    a = models.variants(spark, pool, 50).collect()
    assert sorted(models.variants(spark, pool, 50).repartition(3).collect()) == sorted(a)
    assert {len(r.sequence) for r in a} == {len(pool[0])} and len({r.sequence for r in a}) > 30 and all(0 <= r.risk_score <= 100 for r in a)


def test_nearest_in_train(spark):
    from quillon.operators.identity import global_identity

    data = [("a", "ACDEF", "KLMNP"), ("b", "ACDEG", "KLMNQ"), ("c", "WWWWW", "KLMNP")]
    df = spark.createDataFrame(data, "id string, VH string, VL string")
    got = {r.id: r for r in validation.nearest_in_train(df, df.filter("id <> 'a'"), block=1).collect()}
    r = got["a"]
    vh, vl = [[global_identity(data[0][k], t[k]) for t in data[1:]] for k in (1, 2)]
    assert (r.max_VH, r.max_VL, r.max_min, r.max_mean) == (max(vh), max(vl), max(map(min, vh, vl)), max((x + y) / 2 for x, y in zip(vh, vl)))


def test_checksum_chain_and_sampling(spark):
    chain = validation.checksum_chain(["a", "b", "c"])
    assert len(set(chain)) == 3 and validation.checksum_chain(["a", "x", "c"])[0] == chain[0] and validation.checksum_chain(["a", "x", "c"])[2] != chain[2]
    assert validation.sampled_pairs(spark, 300, most=50).distinct().count() == 50
    assert validation.sampled_pairs(spark, 1).count() == 0
