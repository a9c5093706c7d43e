"""Models on feature tables: synthetic variants, a registry, cross-validation, selection, importances, frozen bundles with checks, mutation deltas."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import rules
from quillon.functions.sequences import RESIDUES, risk_level
from quillon.sources.sinks import _write_new

#: Motifs that variants are given; the seed of splits and models.
INJECTED = ("NG", "NS", "NN", "DG", "DS", "DA", "M", "NGS", "NAT")
SEED = 42


# ---- synthetic variants


def variants(spark: SparkSession, pool: list[str], n: int, seed: int = SEED, injected: float = 0.6) -> DataFrame:
    """(id, sequence, risk_score, risk_level, high_risk) of n variants: up to four substitutions, often one to three motifs, labelled by the rules as VH alone.

    Each row has its own generator, seeded by its id, so the rows don't depend on how they are dealt. All letters stay standard, so no variant is invalid.
    """
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("sequence", T.StringType())])
    if n < 1 or not pool:
        raise ValueError("a positive number of variants and a pool are needed")

    def run(frames):
        for pdf in frames:
            out = []
            for k in pdf["id"]:
                rng = np.random.Generator(np.random.PCG64([seed, int(k)]))
                own = list(pool[int(rng.integers(len(pool)))].upper())
                for p in rng.permutation(len(own))[: int(rng.integers(5))]:
                    own[p] = [a for a in RESIDUES if a != own[p]][int(rng.integers(len(RESIDUES) - 1))]
                if rng.random() < injected:
                    for _ in range(int(rng.choice([1, 1, 2, 2, 3]))):
                        motif = INJECTED[int(rng.integers(len(INJECTED)))]
                        if len(own) >= len(motif):
                            at = int(rng.integers(len(own) - len(motif) + 1))
                            own[at : at + len(motif)] = motif
                out.append((k, "".join(own)))
            yield pd.DataFrame(out, columns=schema.names)

    made = spark.range(n).mapInPandas(run, schema)
    chains = made.select("id", F.lit("VH").alias("chain"), F.lit(0).alias("chain_order"), F.col("sequence").alias("seq"), F.lit(None).cast("string").alias("error"))
    total = rules.penalties(rules.scan_sites(chains, "id"), "id").groupBy("id").agg(F.sum("penalty").alias("__t"))
    score = rules.score_of(F.coalesce("__t", F.lit(0.0)))
    return made.join(total, "id", "left").select("id", "sequence", score.alias("risk_score"), risk_level(score).alias("risk_level"), (risk_level(score) == "High Risk").alias("high_risk"))


# ---- registry, cross-validation, selection

REGISTRY = {
    "logistic": ("binary", lambda **o: LogisticRegression(**o)),
    "random_forest": ("binary", lambda **o: RandomForestClassifier(seed=SEED, **o)),
    "gradient_boosting": ("binary", lambda **o: GBTClassifier(seed=SEED, **o)),
    "ridge": ("regression", lambda **o: LinearRegression(elasticNetParam=0.0, **({"regParam": 1.0} | o))),
    "random_forest_regressor": ("regression", lambda **o: RandomForestRegressor(seed=SEED, **o)),
    "gradient_boosting_regressor": ("regression", lambda **o: GBTRegressor(seed=SEED, **o)),
}


def pipeline(name: str, features: list[str], label: str, **options) -> Pipeline:
    """Assembled, standardised features and a registered model."""
    if name not in REGISTRY:
        raise ValueError(f"no model {name!r}; there are {', '.join(REGISTRY)}")
    model = REGISTRY[name][1](**options).setFeaturesCol("__x").setLabelCol(label)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="__raw"), StandardScaler(inputCol="__raw", outputCol="__x", withMean=True), model])


def folds(rows: DataFrame, key: str, k: int = 5, salt: str = "fold") -> DataFrame:
    """rows with fold, from 0, by a salted digest of the key: the same for a key whatever the other rows."""
    return rows.withColumn("fold", (F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % k).cast("int"))


def quality_of(predicted: DataFrame, name: str, label: str) -> dict[str, float]:
    if REGISTRY[name][0] == "binary":
        ev = BinaryClassificationEvaluator(labelCol=label)
        return {"roc_auc": ev.evaluate(predicted, {ev.metricName: "areaUnderROC"}), "pr_auc": ev.evaluate(predicted, {ev.metricName: "areaUnderPR"})}
    ev = RegressionEvaluator(labelCol=label)
    return {m: ev.evaluate(predicted, {ev.metricName: m}) for m in ("rmse", "mae", "r2")}


def cross_validated(rows: DataFrame, key: str, names: list[str], features: list[str], label: str, k: int = 5) -> DataFrame:
    """(model, metric, mean, sd, folds): each model fitted without, and measured on, each fold. Folds are by key for classes and numbers alike."""
    spark = rows.sparkSession
    data = folds(rows.select(key, *features, F.col(label).cast("double").alias(label)).na.drop(), key, k).cache()
    found = []
    try:
        for name in names:
            per = [quality_of(pipeline(name, features, label).fit(data.filter(F.col("fold") != f)).transform(data.filter(F.col("fold") == f)), name, label) for f in range(k)]
            for metric in per[0]:
                values = [p[metric] for p in per]
                found.append((name, metric, float(np.mean(values)), float(np.std(values)), k))
    finally:
        data.unpersist()
    return spark.createDataFrame(found, "model string, metric string, mean double, sd double, folds int")


def importances(model: PipelineModel, features: list[str], first: int = 10) -> list[tuple[str, float]]:
    """The first features by a tree model's importance, or by the size of a linear model's coefficient; ties by name."""
    last = model.stages[-1]
    weight = last.featureImportances.toArray() if hasattr(last, "featureImportances") else np.abs(last.coefficients.toArray())
    return sorted(zip(features, map(float, weight)), key=lambda x: (-x[1], x[0]))[:first]


def selected(grid: DataFrame, by: list[str], score: str, parameter: str, larger: bool) -> DataFrame:
    """The best parameter of each group by score, missing scores last; of equal scores the larger or the smaller parameter."""
    value = F.when(~F.isnan(score), F.col(score))
    tie = F.col(parameter) if larger else -F.col(parameter)
    order = F.struct(value.isNotNull(), F.coalesce(value, F.lit(0.0)), tie)
    return grid.groupBy(*by).agg(F.max_by(parameter, order).alias(parameter), F.max_by(score, order).alias(score))


# ---- frozen bundles


def manifest_of(model: PipelineModel, name: str, features: list[str], version: str) -> dict:
    last = model.stages[-1]
    content = last.toDebugString if hasattr(last, "toDebugString") else json.dumps([last.coefficients.toArray().tolist(), float(last.intercept)])
    scale = model.stages[1]
    body = json.dumps([content, scale.mean.toArray().tolist(), scale.std.toArray().tolist(), features], sort_keys=True)
    return {"model": name, "version": version, "features": features, "sha256": hashlib.sha256(body.encode()).hexdigest()}


def save_bundle(model: PipelineModel, name: str, features: list[str], version: str, path: str, spark: SparkSession) -> dict:
    """A model with its manifest at a new path; nothing is overwritten."""
    manifest = manifest_of(model, name, features, version)
    model.write().save(f"{path}/model")
    _write_new(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest


def load_bundle(spark: SparkSession, path: str, version: str) -> tuple[PipelineModel, dict]:
    """The model of a bundle, refused where its version or its content is not what the manifest says."""
    manifest = json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest.json").collect()))
    model = PipelineModel.load(f"{path}/model")
    if manifest["version"] != version:
        raise ValueError(f"bundle version {manifest['version']}, not {version}")
    if manifest_of(model, manifest["model"], manifest["features"], manifest["version"])["sha256"] != manifest["sha256"]:
        raise ValueError("the model differs from its manifest")
    return model, manifest


def frozen_predictions(rows: DataFrame, model: PipelineModel, manifest: dict, key: str) -> DataFrame:
    """(key, prediction, probability) of distinct inputs, each predicted once, for all rows that share them; columns must be the manifest's features."""
    features = manifest["features"]
    if missing := [f for f in features if f not in rows.columns]:
        raise ValueError(f"missing features: {', '.join(missing)}")
    ident = F.sha2(F.to_json(F.struct(*features), {"ignoreNullFields": "false"}), 256)
    keyed = rows.select(key, *features, ident.alias("__ident"))
    out = model.transform(keyed.select("__ident", *features).dropDuplicates(["__ident"]).na.drop())
    p = F.get(vector_to_array("probability"), F.lit(1)) if "probability" in out.columns else F.lit(None).cast("double")
    return keyed.select(key, "__ident").join(out.select("__ident", "prediction", p.alias("probability")), "__ident", "left").drop("__ident")


def evaluate_once(predicted: DataFrame, name: str, label: str, marker: str) -> dict[str, float]:
    """The held-out figures, once: the marker file is written first, and a second evaluation is refused."""
    _write_new(predicted.sparkSession, marker, b"evaluated\n")
    return quality_of(predicted, name, label)


def write_split(rows: DataFrame, split: str, label: str, path: str) -> None:
    """Training and validation rows with labels, test rows without, and the test labels apart; never overwritten."""
    test = F.col(split) == "TEST"
    rows.filter(~test).write.mode("errorifexists").partitionBy(split).parquet(f"{path}/train_validation")
    rows.filter(test).drop(label, split).write.mode("errorifexists").parquet(f"{path}/test_features")
    rows.filter(test).select(*[c for c in rows.columns if c not in (label, split)][:1], label).write.mode("errorifexists").parquet(f"{path}/test_labels")


# ---- embeddings and mutations


def mean_pool(states: Column, dim: int) -> Column:
    """The mean of a sequence's state vectors, entry by entry; null for none or for a vector of another length."""
    n = F.size(states)
    zero = F.array_repeat(F.lit(0.0), dim)
    total = F.aggregate(states, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    fits = (n > 0) & ~F.exists(states, lambda v: F.size(v) != dim)
    return F.when(fits, F.transform(total, lambda x: x / n))


def alignment_gaps(rows: DataFrame, embeddings: DataFrame, key: str, place: str) -> DataFrame:
    """One row: keys without an embedding, embeddings without a row, keys given twice, and keys whose place differs."""
    a = rows.select(key, F.col(place).alias("__a"), F.lit(1).alias("__l"))
    b = embeddings.select(key, F.col(place).alias("__b"), F.lit(1).alias("__r"))
    per = a.join(b, key, "full").groupBy(key).agg(F.count("__l").alias("l"), F.count("__r").alias("r"), F.max((~F.col("__a").eqNullSafe(F.col("__b"))).cast("int")).alias("moved"))
    n = lambda c: F.count(F.when(c, 1))
    both = (F.col("l") > 0) & (F.col("r") > 0)
    return per.agg(n(F.col("r") == 0).alias("missing"), n(F.col("l") == 0).alias("orphaned"), n((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"), n(both & (F.col("moved") == 1)).alias("moved"))


def mutation_deltas(cases: DataFrame, predictions: DataFrame, id_col: str, values: list[str]) -> DataFrame:
    """(id, error, then baseline, mutant and delta of each value) of mutations (chain, VH, VL, original, mutant) between two predictions (vh, vl, values).

    The edited chain's original must be the baseline's; the other chain stays. Predictions are looked up by both sequences, each pair once.
    """
    c = F.col
    heavy = F.upper(F.trim("chain")) == "VH"
    light = F.upper(F.trim("chain")) == "VL"
    bad = F.when(~(heavy | light), "UNKNOWN_CHAIN").when((F.coalesce("VH", F.lit("")) == "") | (F.coalesce("VL", F.lit("")) == ""), "MISSING_CHAIN").when(F.when(heavy, c("VH")).otherwise(c("VL")) != c("original"), "BASELINE_MISMATCH")
    rows = cases.select(id_col, bad.alias("error"), c("VH").alias("__bh"), c("VL").alias("__bl"), F.when(heavy, c("mutant")).otherwise(c("VH")).alias("__mh"), F.when(heavy, c("VL")).otherwise(c("mutant")).alias("__ml"))
    known = predictions.dropDuplicates(["vh", "vl"])
    side = lambda p, h, l: known.select(c("vh").alias(h), c("vl").alias(l), *[c(v).alias(f"{p}_{v}") for v in values], F.lit(True).alias(f"__{p}"))
    j = rows.join(side("baseline", "__bh", "__bl"), ["__bh", "__bl"], "left").join(side("mutant", "__mh", "__ml"), ["__mh", "__ml"], "left")
    error = F.coalesce("error", F.when(c("__baseline").isNull() | c("__mutant").isNull(), "NO_PREDICTION"))
    ok = lambda x: F.when(error.isNull(), x)
    return j.select(id_col, error.alias("error"), *[ok(x).alias(n) for v in values for n, x in ((f"baseline_{v}", c(f"baseline_{v}")), (f"mutant_{v}", c(f"mutant_{v}")), (f"delta_{v}", c(f"mutant_{v}") - c(f"baseline_{v}")))])
