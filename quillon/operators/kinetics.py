"""Time-course decisions, blanks, linear rates, curvature, calibration, saturation fits, intervals and propagation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Fixed value: the 95 % point of the chi-squared distribution with one degree of freedom.
CHI2_95 = 3.841458820694124


def decide(rows: DataFrame, excluded: Column, time: Column, signal: Column, start: float, end: float, blank: Column | None = None) -> DataFrame:
    """rows with reason; the first that holds of: excluded, missing, not finite, outside the window, no blank, included."""
    finite = lambda c: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    reason = F.when(excluded, "USER_EXCLUSION").when(time.isNull() | signal.isNull(), "MISSING_TIME_OR_SIGNAL").when(~finite(time) | ~finite(signal), "INVALID_NUMERIC_VALUE").when(~time.between(start, end), "OUTSIDE_EXPLICIT_INTERVAL")
    if blank is not None:
        reason = reason.when(blank.isNull(), "UNMATCHED_BLANK")
    return rows.withColumn("reason", reason.otherwise("INCLUDED"))


def match_blanks(samples: DataFrame, blanks: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """samples with blank_value and corrected, by an equi-join on the keys: no interpolation. Blanks that repeat a key are averaged."""
    b = blanks.groupBy(*keys).agg(F.avg(signal).alias("blank_value"))
    return samples.join(b, keys, "left").withColumn("corrected", F.col(signal) - F.col("blank_value"))


def linear_rates(rows: DataFrame, by: list[str], time: str, signal: str) -> DataFrame:
    """Least squares per series; null where there are fewer than three distinct times; r_squared is null for a constant signal."""
    a = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(time).alias("__times"), F.regr_slope(signal, time).alias("slope"), F.regr_intercept(signal, time).alias("intercept"),
        F.regr_sxx(signal, time).alias("__sxx"), F.regr_syy(signal, time).alias("__syy"), F.regr_sxy(signal, time).alias("__sxy"), F.avg(time).alias("__mx"),
    )
    ok = F.col("__times") >= 3
    sse = F.greatest(F.lit(0.0), F.col("__syy") - F.col("__sxy") * F.col("__sxy") / F.col("__sxx"))
    mse = sse / (F.col("n") - 2)
    return a.select(
        *by, "n", F.when(ok, F.col("slope")).alias("slope"), F.when(ok, F.col("intercept")).alias("intercept"), F.when(ok & (F.col("__syy") > 0), 1 - sse / F.col("__syy")).alias("r_squared"),
        F.when(ok, F.sqrt(sse / F.col("n"))).alias("rmse"), F.when(ok, F.sqrt(mse / F.col("__sxx"))).alias("slope_se"), F.when(ok, F.sqrt(mse * (1 / F.col("n") + F.col("__mx") * F.col("__mx") / F.col("__sxx")))).alias("intercept_se"),
    )


def curvature(rows: DataFrame, by: list[str], time: str, signal: str) -> DataFrame:
    """(by, change): difference of the secants of the first and second half over the larger; series of at least four distinct, unrepeated times."""
    w = W.partitionBy(*by)
    r = rows.withColumns({"__k": F.row_number().over(w.orderBy(time)), "__n": F.count(F.lit(1)).over(w)})
    early = F.col("__k") <= F.floor(F.col("__n") / 2)

    def secant(half):
        t = F.when(half, F.col(time))
        return (F.max_by(F.when(half, F.col(signal)), t) - F.min_by(F.when(half, F.col(signal)), t)) / (F.max(t) - F.min(t))

    a = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(time).alias("d"), secant(early).alias("e"), secant(~early).alias("l"))
    change = F.abs(F.col("e") - F.col("l")) / F.greatest(F.abs("e"), F.abs("l"), F.lit(1e-300))
    return a.filter("n >= 4 AND n = d").select(*by, F.when(F.col("e").isNotNull() & F.col("l").isNotNull(), change).alias("change"))


def calibrate(rates: DataFrame, low: Column, high: Column, k: float, offset: float, valid: tuple[float, float]) -> DataFrame:
    """Rates with product_slope and its error, or why not; low and high are the extremes of the included signals."""
    outside = (low < valid[0]) | (high > valid[1])
    negative = F.least((low - offset) / k, (high - offset) / k) < 0
    status = F.when(outside, "OUTSIDE_CALIBRATION_RANGE").when(negative, "INVALID_CONVERTED_CONCENTRATION").otherwise("OK")
    return rates.withColumns({"status": status, "product_slope": F.when(status == "OK", F.col("slope") / k), "product_slope_se": F.when(status == "OK", F.col("slope_se") / abs(k))})


# ---- saturation kinetics: v = Vmax S / (Km + S)


def _profile_sse(s: np.ndarray, v: np.ndarray, log_km: float) -> tuple[float, float]:
    """Sum of squares with the best Vmax for a Km, and that Vmax."""
    f = s / (math.exp(log_km) + s)
    vmax = float(f @ v) / float(f @ f)
    r = v - vmax * f
    return float(r @ r), vmax


def _golden(f, a: float, b: float, steps: int = 200) -> float:
    g = (math.sqrt(5) - 1) / 2
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
        if abs(b - a) < 1e-14 * max(1.0, abs(a)):
            break
    return (a + b) / 2


def michaelis_menten(s, v) -> dict | None:
    """Km, Vmax, sse, rmse, r_squared; None where the data can't hold both: too few rates, or concentrations all far below or above Km."""
    s, v = np.asarray(s, float), np.asarray(v, float)
    if len(s) < 4 or len(set(s.tolist())) < 3 or (s < 0).any() or (v < 0).any() or not v.max() > 0 or not s.max() > 0:
        return None
    center = math.log(np.median(s[s > 0]))
    grid = np.linspace(center - 9, center + 9, 181)
    k = int(np.argmin([_profile_sse(s, v, x)[0] for x in grid]))
    x = _golden(lambda y: _profile_sse(s, v, y)[0], grid[max(0, k - 1)], grid[min(180, k + 1)])
    # Gauss-Newton polish in log parameters: the profile is flat to rounding near its minimum
    sse, vmax = _profile_sse(s, v, x)
    for _ in range(30):
        km = math.exp(x)
        f = s / (km + s)
        r = v - vmax * f
        j = np.column_stack([-vmax * s * km / (km + s) ** 2, vmax * f])
        step, *_ = np.linalg.lstsq(j, r, rcond=None)
        x, vmax = x + step[0], vmax * math.exp(step[1])
        if np.abs(step).max() < 1e-15:
            break
    km = math.exp(x)
    r = v - vmax * s / (km + s)
    sse, syy = float(r @ r), float(((v - v.mean()) ** 2).sum())
    if s.max() / km < 0.1 or s[s > 0].min() / km > 10 or not 1e-4 < km / math.exp(center) < 1e4:
        return None
    return {"km": km, "vmax": float(vmax), "sse": sse, "rmse": math.sqrt(sse / len(s)), "r_squared": 1 - sse / syy if syy else None}


def profile_intervals(s, v, level: float = CHI2_95) -> dict | None:
    """Intervals of Km and Vmax where N log(SSE / SSEmin) stays below the level; an end is None where the profile never rises that far."""
    fit = michaelis_menten(s, v)
    if fit is None or fit["sse"] <= 0:
        return None
    s, v = np.asarray(s, float), np.asarray(v, float)
    n = len(s)
    rise = lambda sse: n * math.log(max(sse, 1e-300) / fit["sse"]) - level

    def sse_vmax(log_v: float) -> float:
        vm = math.exp(log_v)
        inner = lambda y: float(((v - vm * s / (math.exp(y) + s)) ** 2).sum())
        x0 = math.log(fit["km"])
        return inner(_golden(inner, x0 - 6, x0 + 6))

    def end(f, x0: float, sign: int):
        a, step = x0, 0.01
        while step < 12:
            b = x0 + sign * step
            if f(b) > 0:
                for _ in range(200):
                    m = (a + b) / 2
                    if f(m) > 0:
                        b = m
                    else:
                        a = m
                    if abs(b - a) < 1e-13:
                        break
                return math.exp((a + b) / 2)
            a, step = b, step * 1.5
        return None

    x, y = math.log(fit["km"]), math.log(fit["vmax"])
    km = lambda z: rise(_profile_sse(s, v, z)[0])
    vm = lambda z: rise(sse_vmax(z))
    return fit | {"km_low": end(km, x, -1), "km_high": end(km, x, 1), "vmax_low": end(vm, y, -1), "vmax_high": end(vm, y, 1)}


FIT = ("km", "vmax", "sse", "rmse", "r_squared")
INTERVALS = (*FIT, "km_low", "km_high", "vmax_low", "vmax_high")


def fit_groups(rows: DataFrame, by: list[str], s: str, v: str, intervals: bool = False) -> DataFrame:
    """A fit per group; all null and status NOT_ESTIMABLE where there is none."""
    names = INTERVALS if intervals else FIT
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("status", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[[s, v]].dropna().sort_values([s, v])
        fit = (profile_intervals if intervals else michaelis_menten)(own[s], own[v])
        key = [pdf[c].iloc[0] for c in by]
        return pd.DataFrame([[*key, "NOT_ESTIMABLE" if fit is None else "ESTIMATED", *[None if fit is None else fit[n] for n in names]]], columns=schema.names)

    return rows.select(*by, s, v).groupBy(*by).applyInPandas(run, schema)


def propagate(spark, s: list[float], v: list[float], loadings: list[list[float]], half_width: float, draws: int, seed: int = 20261110) -> DataFrame:
    """(draw, km, vmax) of fits to rates with shared and own errors: draw i uses the seed's stream from i (L + n) on, so any task can make any draw."""
    load, s0, v0 = np.asarray(loadings, float), np.asarray(s, float), np.asarray(v, float)
    per = load.shape[1] + len(s0)
    schema = "draw bigint, km double, vmax double"

    def run(frames):
        for pdf in frames:
            out = []
            for i in pdf["id"]:
                rng = np.random.Generator(np.random.PCG64(seed).advance(int(i) * per))
                u = rng.random(per) * 2 - 1
                own = v0 * (1 + load @ u[: load.shape[1]]) + half_width * u[load.shape[1] :]
                fit = michaelis_menten(s0, np.maximum(own, 0))
                out.append((i, fit and fit["km"], fit and fit["vmax"]))
            yield pd.DataFrame(out, columns=["draw", "km", "vmax"])

    return spark.range(draws).mapInPandas(run, schema)


def summarize_draws(draws: DataFrame, values: list[str]) -> DataFrame:
    """Means, their errors, linear quantiles and the covariance; all null if any draw failed."""
    bad = F.max(F.expr(" OR ".join(f"{v} IS NULL" for v in values)))
    cols = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias(f"{v}_mcse"), F.percentile(v, F.lit(0.025)).alias(f"{v}_low"), F.percentile(v, F.lit(0.975)).alias(f"{v}_high"))]
    cov = F.covar_samp(*values).alias("covariance") if len(values) == 2 else F.lit(None).cast("double").alias("covariance")
    a = draws.agg(bad.alias("__bad"), F.count(F.lit(1)).alias("n"), *cols, cov)
    return a.select("n", F.col("__bad").alias("any_failed"), *[F.when(~F.col("__bad"), F.col(c)).alias(c) for c in a.columns if c not in ("__bad", "n")])
