"""Rules of assays and rate records: coded checks of a series, vetoes, saving by recomputation, fit diagnostics, input covariance."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The assay types that veto a rate; units of time.
ENDPOINT = ("endpoint", "end_point", "endpoint_assay", "终点", "终点测定")
TIME_UNITS = ("s", "min", "h")


def is_endpoint(assay_type: Column) -> Column:
    return F.lower(F.trim(F.coalesce(assay_type, F.lit("")))).isin(*ENDPOINT)


def blank_text(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def series_checks(observations: DataFrame, by: list[str], config: dict, series_key: list[str], provenance: list[str]) -> DataFrame:
    """(by, n, reasons, warnings) of each series, codes in a fixed order joined by `;`. Nothing is dropped, merged or converted.

    observations: by, observation_id, series_key and provenance columns, time_unit, signal_unit, assay_type, biological_replicate, technical_replicate,
    substrate_concentration, substrate_concentration_unit. config: start, end, time_unit, measurement_kind, blank_mode, missing_policy, exclusions (id -> reason).
    """
    n = lambda cond: F.count(F.when(cond, 1))
    start, end, unit = float(config["start"]), float(config["end"]), config["time_unit"]
    bad_config = not (math.isfinite(start) and math.isfinite(end) and start < end) or unit not in TIME_UNITS or config["blank_mode"] not in ("none", "per_observation", "matched_time") or config["missing_policy"] not in ("fail", "exclude") or any(not str(v).strip() for v in config["exclusions"].values())
    excluded = sorted(config["exclusions"])
    s = F.col("substrate_concentration").cast("double")
    agg = observations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("observation_id").alias("__ids"), F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in series_key])).alias("__series"),
        n(reduce(lambda a, b: a | b, [blank_text(F.col(c)) for c in provenance])).alias("__lost"),
        n(~F.col("time_unit").eqNullSafe(F.lit(unit)) | blank_text(F.col("signal_unit"))).alias("__units"), n(is_endpoint(F.col("assay_type"))).alias("__endpoint"),
        n(F.col("biological_replicate").isNull() | F.col("technical_replicate").isNull()).alias("__replicate"), n(s.isNull()).alias("__no_substrate"),
        n(s.isNotNull() & ((s < 0) | F.isnan(s) | (s == float("inf")) | blank_text(F.col("substrate_concentration_unit")))).alias("__bad_substrate"),
        F.collect_set(F.when(F.col("observation_id").isin(*excluded), F.col("observation_id"))).alias("__excluded"),
    )
    kind = (F.lit(config["measurement_kind"] != "TIME_COURSE")) | (F.col("__endpoint") > 0)
    first = [
        ("INVALID_CONFIGURATION", F.lit(bad_config)), ("NOT_TIME_COURSE", kind & F.lit(not bad_config)), ("DUPLICATE_OBSERVATION_ID", (F.col("__ids") < F.col("n")) & F.lit(not bad_config)),
        ("UNKNOWN_EXCLUSION", F.lit(bool(excluded) and not bad_config) & (F.size("__excluded") < len(excluded))), ("INCOMPLETE_PROVENANCE", (F.col("__lost") > 0) & F.lit(not bad_config)),
        ("MIXED_SERIES", (F.col("__series") > 1) & F.lit(not bad_config)), ("UNIT_MISMATCH", (F.col("__units") > 0) & F.lit(not bad_config)),
    ]
    clean = ~reduce(lambda a, b: a | b, [c for _, c in first])
    reasons = [*first, ("INVALID_SUBSTRATE", clean & (F.col("__bad_substrate") > 0))]
    warned = [
        ("INITIAL_RATE_NOT_VERIFIED", F.lit(True)), ("OLS_UNCERTAINTY_LIMITED", F.lit(True)), ("REPLICATE_ID_MISSING", clean & (F.col("__replicate") > 0)),
        ("SUBSTRATE_MISSING", clean & (F.col("__no_substrate") > 0)), ("NO_BLANK_CORRECTION", clean & F.lit(config["blank_mode"] == "none")),
    ]
    codes = lambda rules: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules])), ";")
    return agg.select(*by, "n", codes(reasons).alias("reasons"), codes(warned).alias("warnings"))


def fingerprint(columns: list[str], without: tuple[str, ...] = ("calculated_at_utc",)) -> Column:
    """SHA-256 of a row's JSON with sorted names, without its time of calculation."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in columns if c not in without)), {"ignoreNullFields": "false"}), 256)


def recomputed(offered: DataFrame, computed: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, state) of offered results: SAVED where every value equals the recomputed one exactly, else MISMATCH, UNKNOWN_SERIES or NOT_ESTIMABLE (no value to save)."""
    there = computed.select(*by, *[F.col(v).alias(f"__c_{v}") for v in values], F.lit(True).alias("__there"))
    j = offered.join(there, by, "left")
    same = reduce(lambda a, b: a & b, [F.col(v).eqNullSafe(F.col(f"__c_{v}")) for v in values])
    none = reduce(lambda a, b: a & b, [F.col(v).isNull() for v in values])
    return j.select(*by, F.when(none, "NOT_ESTIMABLE").when(F.col("__there").isNull(), "UNKNOWN_SERIES").when(same, "SAVED").otherwise("MISMATCH").alias("state"))


def source_agreement(records: DataFrame, sources: DataFrame, sha: str, content: str) -> DataFrame:
    """records with source_state: VERIFIED where the source's bytes have the recorded digest, CORRUPT where they have another, MISSING without a source."""
    own = sources.select(F.col(sha), F.sha2(F.col(content).cast("binary"), 256).alias("__actual"))
    return records.join(own, sha, "left").withColumn("source_state", F.when(F.col("__actual").isNull(), "MISSING").when(F.col("__actual") == F.col(sha), "VERIFIED").otherwise("CORRUPT")).drop("__actual")


def level_checks(rates: DataFrame, by: list[str], s: str, v: str, km: Column | None = None) -> DataFrame:
    """(by, n, levels, issues) of rates over concentrations: repeated levels, few rates, a narrow span, a falling mean, a rate at zero, and the coverage of Km where it is given."""
    from pyspark.sql import Window as W

    means = rates.groupBy(*by, s).agg(F.avg(v).alias("__m"), F.count(F.lit(1)).alias("__n"), F.max(v).alias("__top"))
    falls = means.withColumn("__fall", F.col("__m") < F.lag("__m").over(W.partitionBy(*by).orderBy(s)))  # a row a level
    positive = F.when(F.col(s) > 0, F.col(s))
    a = falls.groupBy(*by).agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("levels"), F.max(F.col("__fall").cast("int")).alias("__fall"), F.min(positive).alias("__low"), F.max(positive).alias("__high"), F.max(F.when((F.col(s) == 0) & (F.col("__top") > 0), 1)).alias("__zero"), F.min("__m").alias("__least"), F.max("__m").alias("__most"))
    rules = [("NARROW_CONCENTRATION_RANGE", F.col("__high") / F.col("__low") < 10), ("FEW_RATES", F.col("n") < 6), ("TECHNICAL_REPEATS_RETAINED", F.col("levels") < F.col("n")), ("CONSTANT_RATE", F.col("__least") == F.col("__most")), ("ZERO_SUBSTRATE_POSITIVE_RATE", F.col("__zero") == 1), ("NONMONOTONIC_RATES", F.col("__fall") == 1)]
    if km is not None:
        low, high = F.col("__low") / km, F.col("__high") / km
        rules = [("EXTREME_COVERAGE", (high < 0.1) | (low > 10)), ("SATURATION_NOT_COVERED", high < 3), ("LOW_CONCENTRATIONS_NOT_COVERED", low > 0.5), *rules]
    return a.select(*by, "n", "levels", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules])), ";").alias("issues"))


def covariance_issue(load: np.ndarray, cov: np.ndarray) -> str | None:
    """Why a declared input covariance can't be used, or None: variances not negative, no loading means no covariance, symmetric, no negative eigenvalue, and L L' / 3.

    Compared in units of each quantity's own loading, so that quantities of any scale are judged alike.
    """
    load, cov = np.asarray(load, float), np.asarray(cov, float)
    if (np.diag(cov) < 0).any():
        return "NEGATIVE_VARIANCE"
    scale = np.abs(load).max(axis=1)
    idle = scale == 0
    if cov[idle].any() or cov[:, idle].any():
        return "COVARIANCE_LOADING_MISMATCH"
    unit = np.where(idle, 1.0, scale)
    with np.errstate(over="ignore", invalid="ignore"):
        c = cov / unit[:, None] / unit[None, :]
    if not np.isfinite(c).all():
        return "COVARIANCE_LOADING_MISMATCH"
    if not np.allclose(c, c.T, rtol=1e-12, atol=1e-12) or np.linalg.eigvalsh(c).min() < -1e-12 * max(1.0, np.abs(c).max()):
        return "INVALID_COVARIANCE"
    own = load / unit[:, None]
    return None if np.allclose(c, own @ own.T / 3, rtol=1e-12, atol=1e-12) else "COVARIANCE_LOADING_MISMATCH"


def not_finite(schema: T.StructType) -> Column:
    """Whether a row has a NaN or an infinity anywhere, in structs, arrays and maps too: the schema is walked once, the check is one expression."""

    def bad(c: Column, kind: T.DataType) -> Column | None:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.isnan(c) | (F.abs(c) == float("inf"))
        if isinstance(kind, T.StructType):
            parts = [b for f in kind if (b := bad(c.getField(f.name), f.dataType)) is not None]
            return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts]) if parts else None
        if isinstance(kind, T.ArrayType):
            return F.exists(c, lambda x: F.coalesce(bad(x, kind.elementType), F.lit(False))) if bad(F.lit(None), kind.elementType) is not None else None
        if isinstance(kind, T.MapType):
            return bad(F.map_values(c), T.ArrayType(kind.valueType))
        return None

    parts = [b for f in schema if (b := bad(F.col(f.name), f.dataType)) is not None]
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts]) if parts else F.lit(False)
