"""Rank statistics, false-discovery control, classification and regression metrics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.operators.aggregates import average_ranks, running


def ranked(rows: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """rows with average ranks (name -> column to rank) within groups."""
    out = rows
    for name, c in columns.items():
        out = out.join(average_ranks(rows, by, c, name).drop("__ties"), [*by, c])
    return out


def usable(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, rho) over rows where both are there; rho is null below two rows or two distinct values on either side."""
    r = ranked(usable(rows, by, x, y), by, {"__rx": x, "__ry": y})
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("__rx", "__ry").alias("rho"), F.countDistinct(x).alias("__a"), F.countDistinct(y).alias("__b"))
    return out.select(*by, "n", F.when((F.col("n") >= 2) & (F.col("__a") >= 2) & (F.col("__b") >= 2), F.col("rho")).alias("rho"))


def partial_spearman(rows: DataFrame, by: list[str], x: str, y: str, z: str) -> DataFrame:
    """(by, n, rho) of x and y with z held: residual correlation of ranks in closed form; at least four rows."""
    r = ranked(usable(rows, by, x, y).filter(F.col(z).isNotNull()), by, {"__rx": x, "__ry": y, "__rz": z})
    a = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("__rx", "__ry").alias("xy"), F.corr("__rx", "__rz").alias("xz"), F.corr("__ry", "__rz").alias("yz"))
    rho = (F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.col("xz") ** 2) * (1 - F.col("yz") ** 2))
    return a.select(*by, "n", F.when(F.col("n") >= 4, rho).alias("rho"))


def effect_size(rho: Column) -> Column:
    a = F.abs(rho)
    return F.when(rho.isNull(), "NA").when(a < 0.2, "negligible").when(a < 0.4, "weak").when(a < 0.6, "moderate").when(a < 0.8, "strong").otherwise("very strong")


def spearman_matrix(rows: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """(feature, then a column per target): Spearman's rho of every feature and target over the rows where both are there.

    Where no column has gaps, each column is ranked once and all pairs come from one aggregate; gaps change the ranks of a pair, so then each pair is ranked by itself.
    """
    names = list(dict.fromkeys([*features, *targets]))
    whole = rows.select(*[F.col(c).cast("double").alias(c) for c in names])
    gaps = whole.agg(*[F.count(F.when(F.col(c).isNull() | F.isnan(c), 1)).alias(c) for c in names]).first()
    if not any(gaps):
        r = ranked(whole, [], {f"__{c}": c for c in names})
        sure = lambda f, t: (F.min(f) < F.max(f)) & (F.min(t) < F.max(t))
        cells = [F.struct(F.lit(f).alias("feature"), *[F.when(sure(f, t), F.corr(f"__{f}", f"__{t}")).alias(t) for t in targets]) for f in features]
        return r.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("s")).select("s.*")
    out = None
    for f in features:
        own = None
        for t in targets:
            one = spearman(whole, [], f, t).select(F.lit(f).alias("feature"), F.col("rho").alias(t))
            own = one if own is None else own.join(one, "feature", "full")
        out = own if out is None else out.unionByName(own)
    return out


def benjamini_hochberg(rows: DataFrame, p: str, by: list[str], *tie: str) -> DataFrame:
    """rows with q: the running minimum, from the largest p down, of p m / rank, at most 1; null p are left out of m.

    Rows of one p share their q, so sums and minima run over distinct p, dealt by ranges (see running); no group is one task.
    """
    n = rows.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("__n"))
    c = running(n, by, p, ["__n"]).withColumn("__raw", F.col(p) * F.col("total___n") / (F.col("before___n") + F.col("__n")))
    inside = W.partitionBy(*by, "__part").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    low = c.groupBy(*by, "__part").agg(F.min("__raw").alias("__low"))  # a row a range and group
    later = low.select(*[F.col(x).alias(f"__k_{x}") for x in by], F.col("__part").alias("__p"), F.min("__low").over(group.orderBy(F.desc("__part")).rowsBetween(W.unboundedPreceding, -1)).alias("__later"))
    same = reduce(lambda a, x: a & F.col(x).eqNullSafe(F.col(f"__k_{x}")), by, F.col("__part") == F.col("__p"))
    q = c.withColumn("__own", F.min("__raw").over(inside)).join(later, same).select(*[F.col(x).alias(f"__b_{x}") for x in by], F.col(p).alias("__value"), F.least(F.lit(1.0), "__own", "__later").alias("q"))
    met = reduce(lambda a, x: a & F.col(x).eqNullSafe(F.col(f"__b_{x}")), by, F.col(p) == F.col("__value"))
    return rows.join(q, met, "left").select(*rows.columns, "q")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def correlation_p(rho: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of a correlation with df degrees of freedom."""

    def p(r, d):
        if r is None or d is None or r != r or d < 1:
            return None
        return 0.0 if abs(r) >= 1 else t_two_sided(r * math.sqrt(d / (1 - r * r)), d)

    return pd.Series([p(r, d) for r, d in zip(rho, df)], dtype="float64")


def score_counts(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Distinct scores with their rows (n) and positives (tp), and running sums of both."""
    g = rows.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count(F.when(F.col(label) == 1, 1)).alias("tp"), F.count(F.lit(1)).alias("n"))
    return running(g, by, score, ["tp", "n"])


def roc_auc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """By ranks of distinct scores; null where a class is missing."""
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    a = score_counts(rows, by, score, label).groupBy(*by).agg(F.sum(F.col("tp") * rank).alias("s"), F.sum("tp").alias("p"), F.sum(F.col("n") - F.col("tp")).alias("m"))
    return a.select(*by, F.when((F.col("p") > 0) & (F.col("m") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m"))).alias("roc_auc"))


def pr_auc(rows: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Average precision; tied scores enter together."""
    above = F.col("tp") * (F.col("total_tp") - F.col("before_tp")) / (F.col("total_n") - F.col("before_n"))
    a = score_counts(rows, by, score, label).groupBy(*by).agg(F.sum(above).alias("s"), F.sum("tp").alias("p"))
    return a.select(*by, F.when(F.col("p") > 0, F.col("s") / F.col("p")).alias("pr_auc"))


def class_metrics(rows: DataFrame, by: list[str], predicted: Column, label: Column) -> DataFrame:
    n = lambda c: F.count(F.when(c, 1))
    a = rows.groupBy(*by).agg(n(predicted & label).alias("tp"), n(predicted & ~label).alias("fp"), n(~predicted & label).alias("fn"), n(~predicted & ~label).alias("tn"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return a.select(*by, F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def regression_metrics(rows: DataFrame, by: list[str], predicted: Column, actual: Column) -> DataFrame:
    e = predicted - actual
    a = rows.groupBy(*by).agg(F.sum(e * e).alias("sse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.var_pop(actual).alias("v"), F.count(actual).alias("n"))
    return a.select(*by, F.round(F.when(F.col("v") > 0, 1 - F.col("sse") / (F.col("v") * F.col("n"))), 6).alias("r2"), F.round("mae", 6).alias("mae"), F.round("rmse", 6).alias("rmse"))


def kendall_tau_b(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, tau) of each group's cells: concordant and discordant pairs come from counts per distinct (x, y), so pairs of rows never meet.

    A group's distinct cells are taken in one task and counted by merging, in n log n.
    """
    cells = usable(rows, by, x, y).groupBy(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("n", T.LongType()), T.StructField("tau", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values(["__x", "__y"])
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), int(own["__n"].sum()), tau_b(list(zip(own["__x"].tolist(), own["__y"].tolist(), own["__n"].tolist())))]], columns=schema.names)

    return cells.groupBy(*by).applyInPandas(run, schema)


def tau_b(cells: list[tuple[float, float, int]]) -> float | None:
    """cells: (x, y, count), sorted. A Fenwick tree over y holds the counts of smaller x."""
    ys = {v: k for k, v in enumerate(sorted({c[1] for c in cells}), 1)}
    tree = [0] * (len(ys) + 1)

    def below(k):
        s = 0
        while k:
            s += tree[k]
            k &= k - 1
        return s

    n = seen = net = 0
    tx = ty = 0
    by_y: dict[float, int] = {}
    k = 0
    while k < len(cells):
        end = k
        while end < len(cells) and cells[end][0] == cells[k][0]:
            end += 1
        for _, y, c in cells[k:end]:
            low, through = below(ys[y] - 1), below(ys[y])
            net += c * (low - (seen - through))
        group = 0
        for _, y, c in cells[k:end]:
            group += c
            by_y[y] = by_y.get(y, 0) + c
            j = ys[y]
            while j < len(tree):
                tree[j] += c
                j += j & -j
        seen += group
        tx += group * (group - 1) // 2
        k = end
    n = seen
    ty = sum(c * (c - 1) // 2 for c in by_y.values())
    total = n * (n - 1) // 2
    return net / math.sqrt((total - tx) * (total - ty)) if total > tx and total > ty else None


def bootstrap(rows: DataFrame, by: list[str], x: str, y: str, resamples: int = 2000, seed: int = 20260919, statistic: str = "spearman") -> DataFrame:
    """(by, rho, low, high, degenerate): percentile interval of Spearman's rho, Pearson's r or Kendall's tau-b over resamples of each group's rows, from one generator a group.

    A resample of rows is a multinomial draw of the counts of the group's distinct (x, y), which one task holds: what it costs is bounded by them, not by the rows.
    Resamples in which a side has one value have no correlation; they are counted and left out of the interval.
    """
    if statistic not in ("spearman", "pearson", "kendall"):
        raise ValueError(f"no statistic {statistic!r}")
    schema = T.StructType([*[rows.schema[c] for c in by], T.StructField("rho", T.DoubleType()), T.StructField("low", T.DoubleType()), T.StructField("high", T.DoubleType()), T.StructField("degenerate", T.LongType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.dropna(subset=[x, y]).sort_values([x, y])
        key = [pdf[c].iloc[0] for c in by]
        count = own["__n"].to_numpy(np.int64)
        n = int(count.sum())
        if n < 3:
            return pd.DataFrame([[*key, None, None, None, None]], columns=schema.names)
        rng = np.random.Generator(np.random.PCG64(seed))
        values = [own[c].to_numpy(float) for c in (x, y)]
        places = [np.unique(v, return_inverse=True)[1] for v in values]

        def rho(weights):
            if statistic == "kendall":
                used = weights > 0
                tau = tau_b(list(zip(values[0][used].tolist(), values[1][used].tolist(), weights[used].astype(int).tolist())))
                return np.nan if tau is None else tau
            centred = []
            for at, value in zip(places, values):
                if statistic == "pearson":
                    centred.append(value - weights @ value / n)
                    continue
                ties = np.bincount(at, weights)
                centred.append((np.cumsum(ties) - (ties - 1) / 2 - (n + 1) / 2)[at])  # average ranks less their mean
            u, v = centred
            spread = (weights @ (u * u)) * (weights @ (v * v))
            return weights @ (u * v) / np.sqrt(spread) if spread else np.nan

        draws = np.array([rho(rng.multinomial(n, count / n).astype(float)) for _ in range(resamples)])
        low, high = np.nanquantile(draws, [0.025, 0.975]) if (~np.isnan(draws)).any() else (None, None)
        return pd.DataFrame([[*key, rho(count.astype(float)), low, high, int(np.isnan(draws).sum())]], columns=schema.names)

    return rows.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("__n")).groupBy(*by).applyInPandas(run, schema)


def logistic_newton(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (intercept first) and standard errors of an unpenalised logistic model."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
        h = (z * (p * (1 - p))[:, None]).T @ z
        step = np.linalg.solve(h, z.T @ (y - p))
        w += step
        if np.abs(step).max() < 1e-10:
            break
    p = 1 / (1 + np.exp(-np.clip(z @ w, -35, 35)))
    return w, np.sqrt(np.diag(np.linalg.inv((z * (p * (1 - p))[:, None]).T @ z)))


def logistic(rows: DataFrame, features: list[str], label: str, steps: int = 25) -> list[tuple[str, float, float]]:
    """(term, coefficient, standard error) of an unpenalised logistic model: a distributed Newton step sums the gradient and curvature, a few numbers."""
    terms = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    data = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in [*features, label]))
    w = np.zeros(len(terms))
    k = len(terms)
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    h = np.eye(k)
    for _ in range(steps):
        margin = sum((t * float(v) for t, v in zip(terms[1:], w[1:])), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-margin))
        sums = data.agg(*[F.sum(t * (F.col(label) - p)) for t in terms], *[F.sum(terms[i] * terms[j] * p * (1 - p)) for i, j in upper]).first()
        g = np.array(sums[:k], float)
        for (i, j), v in zip(upper, sums[k:]):
            h[i, j] = h[j, i] = v
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    return [(n, float(a), float(b)) for n, a, b in zip(["intercept", *features], w, se)]


def wald(rows: list[tuple[str, float, float]]) -> list[tuple]:
    """(term, coefficient, standard error, odds ratio, its 95 % bounds, two-sided p) of a logistic model's terms."""
    out = []
    for term, a, se in rows:
        z = abs(a) / se if se else math.inf
        out.append((term, a, se, math.exp(a), math.exp(a - 1.959963984540054 * se), math.exp(a + 1.959963984540054 * se), math.erfc(z / math.sqrt(2))))
    return out
