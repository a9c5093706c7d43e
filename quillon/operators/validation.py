"""Validation: splits, nearest identities, resampling by class, retained findings, manifests, gates, entities and their references."""

from __future__ import annotations

import hashlib
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import aggregates
from quillon.operators.identity import global_identity
from quillon.operators.store import hierarchy_walk

#: Sequences of one block that every row is compared with.
BLOCK = 512
#: Entities with their key, and their references to other entities.
ENTITIES = {
    "enzyme_targets": ("target_id", {}),
    "protein_variants": ("variant_id", {"target_id": "enzyme_targets", "parent_variant_id": "protein_variants", "reference_variant_id": "protein_variants"}),
    "samples": ("sample_id", {"variant_id": "protein_variants"}),
    "experiment_batches": ("batch_id", {"wt_control_sample_id": "samples"}),
    "assay_results": ("result_id", {"batch_id": "experiment_batches", "sample_id": "samples"}),
    "kinetic_timecourse": ("observation_id", {"batch_id": "experiment_batches", "sample_id": "samples"}),
    "ai_predictions": ("prediction_id", {"variant_id": "protein_variants"}),
    "structure_assets": ("structure_id", {"variant_id": "protein_variants"}),
    "source_manifest": ("source_file_id", {}),
}


def stratified_split(rows: DataFrame, key: str, label: str, test: float = 0.2, salt: str = "split") -> DataFrame:
    """rows with split: of each class the given share, rounded, is TEST, by the order of a salted digest of the key; the same rows whatever their order."""
    order = F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))
    ranked = aggregates.running(rows.select(key, label, order.alias("__d"), F.lit(1).alias("__one")), [label], "__d", ["__one"])
    of = ranked.select(F.col(key).alias("__key"), F.when(F.col("before___one") < F.floor(F.col("total___one") * test + 0.5), "TEST").otherwise("TRAIN").alias("split"))
    return rows.join(of, F.col(key) == F.col("__key")).drop("__key")


def nearest_in_train(test: DataFrame, train: DataFrame, id_col: str = "id", chains: tuple[str, str] = ("VH", "VL"), block: int = BLOCK) -> DataFrame:
    """(id, max_VH, max_VL, max_min, max_mean) of the test pairs' identities with all training pairs.

    Training pairs come in blocks of bounded size, a scan of the test rows a block; a task aligns two equal chains once. No pair of rows is ever a row.
    """
    h, l = chains
    names = [f"max_{h}", f"max_{l}", "max_min", "max_mean"]
    schema = T.StructType([T.StructField(id_col, test.schema[id_col].dataType)] + [T.StructField(n, T.DoubleType()) for n in names])

    def scan(own: list) -> DataFrame:
        shared = test.sparkSession.sparkContext.broadcast(own)

        def run(frames):
            known: dict[tuple[str, str], float] = {}

            def same(a: str, b: str) -> float:
                if (a, b) not in known:
                    known[a, b] = global_identity(a, b)
                return known[a, b]

            for pdf in frames:
                out = []
                for key, vh, vl in zip(pdf[id_col], pdf[h], pdf[l]):
                    x = np.array([same(vh, b) for b, _ in shared.value])
                    y = np.array([same(vl, b) for _, b in shared.value])
                    out.append((key, x.max(), y.max(), np.minimum(x, y).max(), ((x + y) / 2).max()))
                yield pd.DataFrame(out, columns=schema.names)

        return test.select(id_col, h, l).mapInPandas(run, schema)

    out, pending = None, []
    for r in train.select(h, l).distinct().toLocalIterator():
        pending.append((r[0], r[1]))
        if len(pending) == block:
            out, pending = scan(pending) if out is None else out.unionByName(scan(pending)), []
    if pending:
        out = scan(pending) if out is None else out.unionByName(scan(pending))
    if out is None:
        raise ValueError("there are no training pairs")
    return out.groupBy(id_col).agg(*[F.max(n).alias(n) for n in names])


def cross_split_counts(identities: DataFrame, left_split: str, right_split: str, vh: str, vl: str) -> DataFrame:
    """One row: pairs across splits whose chains reach 0.90 and 0.80."""
    across = identities.filter(F.col(left_split) != F.col(right_split))
    return across.agg(*[F.count(F.when(F.col(c) >= t, 1)).alias(f"{c}_ge_{int(t * 100)}") for t in (0.9, 0.8) for c in (vh, vl)])


def class_resamples(rows: DataFrame, by: list[str], score: str, label: str, resamples: int = 2000, seed: int = 20260919) -> DataFrame:
    """(by, roc, roc_low, roc_high, pr, pr_low, pr_high): percentile intervals over resamples that keep each class's size.

    A resample is a multinomial draw a class over the group's distinct scores, whose counts one task holds.
    """
    names = ["roc", "roc_low", "roc_high", "pr", "pr_low", "pr_high"]
    schema = T.StructType([*[rows.schema[c] for c in by], *[T.StructField(n, T.DoubleType()) for n in names]])

    def areas(pos: np.ndarray, neg: np.ndarray) -> tuple[float, float]:
        """Of counts by falling score."""
        p, m = pos.sum(), neg.sum()
        tp, n = np.cumsum(pos), np.cumsum(pos + neg)
        roc = float((neg * (tp - pos / 2)).sum() / (p * m))
        return roc, float((pos * np.divide(tp, n, out=np.zeros(len(n)), where=n > 0)).sum() / p)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(score, ascending=False)
        key = [pdf[c].iloc[0] for c in by]
        pos, neg = own["__p"].to_numpy(np.int64), own["__m"].to_numpy(np.int64)
        p, m = int(pos.sum()), int(neg.sum())
        if not p or not m:
            return pd.DataFrame([[*key, *[None] * 6]], columns=schema.names)
        rng = np.random.Generator(np.random.PCG64(seed))
        draws = np.array([areas(rng.multinomial(p, pos / p), rng.multinomial(m, neg / m)) for _ in range(resamples)])
        (roc, pr), (low, high) = areas(pos, neg), np.quantile(draws, [0.025, 0.975], axis=0)
        return pd.DataFrame([[*key, roc, low[0], high[0], pr, low[1], high[1]]], columns=schema.names)

    positive = F.col(label) == 1
    counts = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count(F.when(positive, 1)).alias("__p"), F.count(F.when(~positive, 1)).alias("__m"))
    return counts.groupBy(*by).applyInPandas(run, schema)


def class_strata(rows: DataFrame, stratum: Column, label: Column, least: int = 15, least_class: int = 5) -> DataFrame:
    """(stratum, n, prevalence, status): no figure below `least` rows or `least_class` of a class."""
    a = rows.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.sum(label.cast("int")).alias("__p"))
    ok = (F.col("n") >= least) & (F.least(F.col("__p"), F.col("n") - F.col("__p")) >= least_class)
    return a.select("stratum", "n", F.when(ok, F.round(F.col("__p") / F.col("n"), 6)).alias("prevalence"), F.when(ok, "OK").otherwise("NOT_ESTIMABLE").alias("status"))


def sampled_pairs(spark: SparkSession, size: int, most: int = 10_000, seed: int = 7) -> DataFrame:
    """(left, right) positions: all pairs up to `most`, else that many distinct ones from a seeded generator, which picks the left one first."""
    if size * (size - 1) // 2 <= most:
        ids = spark.range(size)
        return ids.select(F.col("id").alias("left"), F.explode(F.sequence(F.lit(0), F.lit(max(size - 1, 0)))).alias("right")).filter("right > left").select("left", F.col("right").cast("long").alias("right"))
    rng, chosen = random.Random(seed), set()
    while len(chosen) < most:
        left = rng.randrange(size - 1)
        chosen.add((left, rng.randrange(left + 1, size)))
    return spark.createDataFrame(sorted(chosen), "`left` bigint, `right` bigint")


def oriented(feature: Column, value: Column, scores: tuple[str, ...]) -> Column:
    """A predictor's value, its sign fixed beforehand by its meaning: of calculated scores lower is riskier."""
    return F.when(feature.isin(*scores), -value).otherwise(value)


def retained_findings(continuous: DataFrame, classification: DataFrame, level: float = 0.1) -> DataFrame:
    """(kind, feature, assay, metric, value, q, n): associations that are not significant or not estimable, and every classification result."""
    a = continuous.filter((F.col("q") >= level) | F.col("q").isNull()).select(F.lit("continuous").alias("kind"), "feature", "assay", F.lit("rho").alias("metric"), F.col("rho").alias("value"), "q", "n")
    b = classification.select(F.lit("classification").alias("kind"), "feature", F.lit("composite").alias("assay"), F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"), F.lit(None).cast("double").alias("q"), "n")
    return a.unionByName(b)


def excluded_notes(rows: DataFrame, name: str, phrase: str) -> tuple[DataFrame, DataFrame]:
    """The rows without source notes that stand in a name column, and the notes for the audit. Together they are all rows."""
    note = F.coalesce(F.lower(F.regexp_replace(name, r"\s+", " ")).contains(phrase), F.lit(False))
    return rows.filter(~note), rows.filter(note)


def cluster_summary(assigned: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters, members, singletons, the largest and the median size."""
    sizes = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n_members"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), F.max("n").alias("largest"), F.percentile("n", F.lit(0.5)).alias("median"))


def manifest_issues(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, issue) of a manifest's entries (path, sha256, size) against files (path, content): MISSING, SHA256, SIZE."""
    own = files.select("path", F.sha2("content", 256).alias("__sha"), F.octet_length("content").cast("long").alias("__size"))
    j = manifest.join(own, "path", "left")
    there = F.col("__sha").isNotNull()
    issue = F.array_compact(F.array(F.when(~there, "MISSING"), F.when(there & (F.col("__sha") != F.col("sha256")), "SHA256"), F.when(there & (F.col("__size") != F.col("size")), "SIZE")))
    return j.select("path", F.explode(issue).alias("issue"))


def annotation_counts(rows: DataFrame, tokens: tuple[str, ...]) -> DataFrame:
    """(field, value, n) of the non-blank values of all columns whose name holds a token; nothing is inferred."""
    named = [(t, c) for t in tokens for c in rows.columns if t in c.upper()]
    if not named:
        return rows.sparkSession.createDataFrame([], "field string, value string, n bigint")
    cells = rows.select(F.explode(F.array(*[F.struct(F.lit(t).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for t, c in named])).alias("s")).select("s.*")
    return cells.filter("value <> ''").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def leakage_kinds(rows: DataFrame, kinds: dict[str, str], split: str) -> DataFrame:
    """(kind, split_a, split_b, n_shared) of several keys, from one shuffle of the keys' split sets."""
    long = rows.select(split, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key")) for k, c in kinds.items()])).alias("s")).filter("s.key IS NOT NULL")
    sets = long.groupBy("s.kind", "s.key").agg(F.array_sort(F.collect_set(split)).alias("__s")).filter(F.size("__s") > 1)
    pair = F.flatten(F.transform("__s", lambda a: F.transform(F.filter("__s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select("kind", F.explode(pair).alias("p")).groupBy("kind", F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count(F.lit(1)).alias("n_shared"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in either frame, by multiplicity, and whether there are none."""
    sides = a.withColumn("__w", F.lit(1)).unionByName(b.withColumn("__w", F.lit(-1))).groupBy(*a.columns).agg(F.sum("__w").alias("__w"))
    out = sides.agg(F.coalesce(F.sum(F.when(F.col("__w") > 0, F.col("__w"))), F.lit(0)).alias("only_left"), F.coalesce(F.sum(F.when(F.col("__w") < 0, -F.col("__w"))), F.lit(0)).alias("only_right"))
    return out.withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: a gate for joins that must match every row on both sides exactly once."""
    side = lambda df, n: df.groupBy(F.col(key)).agg(F.count(F.lit(1)).alias(n))
    j = side(left, "l").join(side(right, "r"), key, "full")
    n = lambda c: F.count(F.when(c, 1))
    a = j.agg(n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"), n(F.col("r").isNull()).alias("left_only"), n(F.col("l").isNull()).alias("right_only"), n((F.col("l") > 1) | (F.col("r") > 1)).alias("repeated"))
    return a.withColumn("ok", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("repeated") == 0))


def shown(rows: DataFrame, order: str, limit: int) -> DataFrame:
    """The first rows in the order they came in, for display: 1 to 10,000."""
    if not 1 <= limit <= 10_000:
        raise ValueError("a display limit is from 1 to 10,000")
    return rows.orderBy(order).limit(limit)


def ranked_metrics(rows: DataFrame, metric: str, name: str) -> DataFrame:
    """rows, a few, with place: the highest metric first, NaN and null last, ties by name."""
    from pyspark.sql import Window as W

    value = F.when(~F.isnan(metric), F.col(metric))
    return rows.withColumn("place", F.row_number().over(W.orderBy(F.desc_nulls_last(value), name)))


# ---- entities


def entity_issues(entities: dict[str, DataFrame], spec: dict[str, tuple[str, dict[str, str]]] = ENTITIES) -> DataFrame:
    """(entity, id, field, code) of repeated or missing keys and of references without their entity."""
    out = None
    for name, (key, references) in spec.items():
        if name not in entities:
            continue
        rows = entities[name]
        row = lambda df, field, code, name=name, key=key: df.select(F.lit(name).alias("entity"), F.col(key).cast("string").alias("id"), F.lit(field).alias("field"), F.lit(code).alias("code"))
        parts = [row(rows.groupBy(key).count().filter("count > 1"), key, "DUPLICATE_KEY"), row(rows.filter(F.col(key).isNull()), key, "MISSING_KEY")]
        for field, target in references.items():
            if target in entities:
                held = entities[target].select(F.col(spec[target][0]).alias(field)).distinct()
                parts.append(row(rows.filter(F.col(field).isNotNull()).join(held, field, "left_anti"), field, "MISSING_REFERENCE"))
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


def variant_issues(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """(variant_id, code) of a batch of variants (variant_id, target_id, parent_variant_id) before it is appended: references may resolve within the batch."""
    row = lambda df, code: df.select("variant_id", F.lit(code).alias("code"))
    every = existing.select("variant_id", "target_id", "parent_variant_id").unionByName(batch.select("variant_id", "target_id", "parent_variant_id").join(existing.select("variant_id"), "variant_id", "left_anti"))
    parent = every.select(F.col("variant_id").alias("parent_variant_id"), F.col("target_id").alias("__target"), F.lit(True).alias("__there"))
    j = batch.filter("parent_variant_id IS NOT NULL").join(parent, "parent_variant_id", "left")
    walk = hierarchy_walk(every.select(F.col("variant_id").alias("id"), F.col("parent_variant_id").alias("parent")))
    cycles = batch.join(walk.filter("cycle").select(F.col("id").alias("variant_id")), "variant_id", "left_semi")
    parts = [row(batch.join(existing.select("variant_id"), "variant_id", "left_semi"), "EXISTING_ID"), row(j.filter("__there IS NULL"), "MISSING_REFERENCE"), row(j.filter("__there AND NOT (__target <=> target_id)"), "CROSS_TARGET"), row(cycles, "PARENT_CYCLE")]
    return reduce(DataFrame.unionByName, parts)


def control_issues(batches: DataFrame, samples: DataFrame, variants: DataFrame, measured: DataFrame) -> DataFrame:
    """(id, code): batches whose control sample's variant isn't marked WT, and measurements of samples of another target than their batch's control."""
    own = samples.join(variants.select("variant_id", "target_id", "variant_role"), "variant_id")
    control = batches.join(own.select(F.col("sample_id").alias("wt_control_sample_id"), F.col("target_id").alias("__target"), "variant_role"), "wt_control_sample_id")
    bad = control.filter(~F.col("variant_role").eqNullSafe(F.lit("WT"))).select(F.col("batch_id").alias("id"), F.lit("NOT_WT_CONTROL").alias("code"))
    j = measured.join(own.select("sample_id", "target_id"), "sample_id").join(control.select("batch_id", "__target"), "batch_id")
    return bad.unionByName(j.filter("NOT (target_id <=> __target)").select(F.col("result_id").alias("id"), F.lit("CROSS_TARGET_BATCH").alias("code")))


def checksum_chain(statements: list[str]) -> list[str]:
    """Digests of versions, each over the one before and its own statements: a change anywhere changes all that follow."""
    out, last = [], ""
    for s in statements:
        last = hashlib.sha256(f"{last}\n{s}".encode()).hexdigest()
        out.append(last)
    return out
