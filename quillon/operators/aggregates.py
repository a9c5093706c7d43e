"""Aggregates, duplicate handling, populations and set audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.runtime import materialize


def classify_duplicates(rows: DataFrame, key: str, id_col: str, context: list[str], outcome: list[str], main: str) -> DataFrame:
    """Class of each duplicate group by the number of distinct contexts and outcomes; the smallest id represents it."""
    one = F.countDistinct(F.struct(*context)) == 1
    agg = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("representative"), one.alias("__c"), (F.countDistinct(*outcome) <= 1).alias("__o"), (F.countDistinct(main) == 1).alias("__m"))
    kind = F.when(F.col("n") == 1, "SINGLETON").when(F.col("__c") & F.col("__o"), "IDENTICAL_REPLICATE").when(F.col("__c"), "REPEATED_MEASUREMENT").when(F.col("__m"), "DISTINCT_CONTEXT").otherwise("AMBIGUOUS")
    return agg.select(key, "n", "representative", kind.alias("class"))


def resolve_groups(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Each row's representative, by aggregate and join rather than a window, so that a large group isn't one task."""
    keyed = rows.select(id_col, key.alias("__k"))
    low = keyed.groupBy("__k").agg(F.min(id_col).alias("representative"))
    j = keyed.join(low, keyed["__k"].eqNullSafe(low["__k"]))
    return j.select(id_col, "representative", F.when(F.col(id_col) == F.col("representative"), "kept").otherwise("collapsed").alias("resolution"))


def collapse_replicates(rows: DataFrame, key: str, value: str, name: str, composite: str, tag: str) -> DataFrame:
    """Median, minimum and maximum; the composite only where all replicates agree; the tags that occur."""
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.percentile(value, F.lit(0.5)).alias(f"median_{name}"), F.min(value).alias(f"min_{name}"), F.max(value).alias(f"max_{name}"),
        F.when(F.countDistinct(composite) == 1, F.min(composite)).alias("composite"), F.array_join(F.array_sort(F.collect_set(tag)), ";").alias("statuses"),
    )


def consistency(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    agg = rows.groupBy(key).agg(*[F.countDistinct(c).alias(n) for c, n in columns.items()])
    return agg.withColumn("inconsistent", reduce(lambda a, b: a | b, [F.col(n) > 1 for n in columns.values()]))


def missingness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column, from one aggregate over the rows."""
    blank = lambda c: F.count(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1))
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[blank(c).alias(c) for c in columns])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])).alias("s"))
    return long.select("s.column_name", F.col("n").alias("n_rows"), "s.n_missing", F.round(100.0 * F.col("s.n_missing") / F.col("n"), 4).alias("pct_missing"))


def distribution(rows: DataFrame, value: str, *by: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("min"), q.alias("__q"), F.max(value).alias("max"), F.round(F.avg(value), 6).alias("mean"))
    return agg.select(*by, "n", "min", *[F.round(F.col("__q")[k], 6).alias(n) for k, n in enumerate(("q25", "median", "q75"))], "max", "mean")


def prevalence(rows: DataFrame, columns: list[str]) -> DataFrame:
    parts = lambda c: F.struct(F.lit(c).alias("feature"), F.count(F.when(F.col(c) != 0, 1)).alias("nonzero"), F.count(c).alias("n"), F.avg(c).alias("m"))
    s = rows.agg(F.array(*[parts(c) for c in columns]).alias("a")).select(F.explode("a").alias("s"))
    return s.select("s.feature", "s.nonzero", F.round(F.col("s.nonzero") / F.col("s.n"), 6).alias("fraction"), F.round("s.m", 6).alias("mean"))


def first_match(rows: DataFrame, rules: list[tuple[Column, str, str]], rest: tuple[str, str]) -> DataFrame:
    """assignment and reason of the first rule that holds."""
    chain = lambda k: reduce(lambda c, r: c.when(r[0], r[k]), rules, F.when(F.lit(False), "")).otherwise(rest[k - 1])
    return rows.withColumns({"assignment": chain(1), "reason": chain(2)})


def composite_label(rows: DataFrame, key: str, state: Column, bad: str, allowed: int) -> DataFrame:
    n = F.count(F.when(state == bad, 1))
    return rows.groupBy(key).agg(F.when(F.count(F.when(state.isNull(), 1)) > 0, "BLOCKED").when(n <= allowed, "OK").otherwise("FLAGGED").alias("label"))


def set_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    count = lambda op, df: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return count("intersect", a.intersect(b)).unionByName(count("except", a.subtract(b))).unionByName(count("except_all", a.exceptAll(b)))


def leakage(rows: DataFrame, key: str, split: str) -> DataFrame:
    """Number of keys that two splits share, from the set of splits of each key: no self-join on a hot key."""
    sets = rows.groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("s")).filter(F.size("s") > 1)
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pair).alias("p")).groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count(F.lit(1)).alias("n_shared"))


def running(rows: DataFrame, by: list[str], value: str, weights: list[str]) -> DataFrame:
    """rows, unique by (by, value), with __part, and before_w and total_w for each weight: its sum over the group's smaller values, and over the group.

    No group is one task: rows are dealt by ranges of the value, summed within each range, and ranges are offset by the sums of those before, a row a range and group.
    """
    spread = materialize(rows.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = spread.groupBy(*by, "__part").agg(*[F.sum(w).alias(f"__s_{w}") for w in weights])
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    of = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    offsets = sums.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col("__part").alias("__p"), *[of(f"__s_{w}", earlier).alias(f"__o_{w}") for w in weights], *[of(f"__s_{w}", group).alias(f"total_{w}") for w in weights])
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__k_{c}")), by, F.col("__part") == F.col("__p"))
    inside = W.partitionBy(*by, "__part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = spread.withColumns({f"__i_{w}": of(w, inside) for w in weights}).join(offsets, same)
    return out.select(*rows.columns, "__part", *[(F.col(f"__i_{w}") + F.col(f"__o_{w}")).alias(f"before_{w}") for w in weights], *[f"total_{w}" for w in weights])


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean rank. The running count goes over distinct values, which are aggregated first."""
    n = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__ties"))
    return running(n, by, value, ["__ties"]).select(*by, value, (F.col("before___ties") + (F.col("__ties") + 1) / 2.0).cast("double").alias(name), "__ties")
