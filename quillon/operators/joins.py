"""Joins with audits: presence flags, coverage, integrity counters, candidate joins, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outer_with_indicator(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on the key, marked left_only, right_only or both. Column names other than the key must differ."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), key, "full")
    side = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return joined.withColumn("merge", side).drop("__l", "__r")


def coalesce_chain(frames: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Full outer joins on the case-folded key; each column is its first non-blank value in the frames' order."""
    out = None
    for k, f in enumerate(frames):
        part = f.select(F.lower(F.trim(key)).alias("__key"), *[F.col(c).alias(f"__{c}{k}") for c in columns if c in f.columns])
        out = part if out is None else out.join(part, "__key", "full")
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return out.select(F.col("__key").alias(key), *[F.coalesce(*[blank(f"__{c}{k}") for k, f in enumerate(frames) if c in f.columns]).alias(c) for c in columns])


def integrity(left: DataFrame, right: DataFrame, keys: list[str], check: str) -> DataFrame:
    """One row of counters of a composite-key join: matched, left_only, right_only, and matched rows whose check column differs."""
    j = left.select(*keys, F.col(check).alias("__a"), F.lit(1).alias("__l")).join(right.select(*keys, F.col(check).alias("__b"), F.lit(1).alias("__r")), keys, "full")
    n = lambda cond: F.count(F.when(cond, 1))
    l, r = F.col("__l").isNotNull(), F.col("__r").isNotNull()
    return j.agg(n(l & r).alias("matched"), n(l & ~r).alias("left_only"), n(~l & r).alias("right_only"), n(l & r & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("mismatched"))


def grams(seq: Column, k: int) -> Column:
    """Distinct k-mers of a sequence."""
    return F.when(F.length(seq) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(seq) - (k - 1)), lambda p: seq.substr(p, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def kmer_candidates(rows: DataFrame, id_col: str, chain_cols: list[str], k: int = 5) -> DataFrame:
    """Unordered pairs that share enough k-mers in every chain; left_id < right_id.

    Enough is 1 below 20 k-mers, else a tenth of the left row's, from 2 to 12. An inverted-index equi-join per chain, with prefixes on both sides: with k-mers ordered from
    rare to common, two rows that share `enough` meet in the first `size - enough + 1` of each, so the common k-mers at the ends meet nothing. This loses no pair, and
    only pairs that meet are counted in full.
    """
    out = None
    for c in chain_cols:
        own = rows.select(F.col(id_col).alias("id"), grams(F.col(c), k).alias("g")).filter(F.size("g") > 0)
        need = F.when(F.size("g") < 20, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(12), F.expr("size(g) div 10"))))
        own = own.select("id", "g", need.alias("need"))
        flat = own.select("id", "need", F.size("g").alias("n"), F.explode("g").alias("kmer"))
        frequency = flat.groupBy("kmer").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
        lone = F.col("n") - F.size("k")  # k-mers of no other row come first in the order and meet nothing
        ranked = flat.join(frequency, "kmer").groupBy("id", "need", "n").agg(F.sort_array(F.collect_list(F.struct("df", "kmer"))).alias("k"))
        posted = ranked.select("id", "need", "n", F.posexplode("k").alias("p", "x"), lone.alias("lone")).select("id", "need", "n", (F.col("p") + F.col("lone") + 1).alias("at"), "x.kmer")
        left = posted.filter("at <= n - need + 1").select("kmer", F.col("id").alias("l"), "need")
        right = posted.select("kmer", F.col("id").alias("r"), (F.col("n") - F.col("at") + 1).alias("after"))
        pairs = left.join(right, "kmer").filter("l < r AND after >= need").select("l", "r").distinct()
        full = pairs.join(own.select(F.col("id").alias("l"), F.col("g").alias("lg"), "need"), "l").join(own.select(F.col("id").alias("r"), F.col("g").alias("rg")), "r")
        shared = F.size(F.array_intersect("lg", "rg"))
        good = full.filter(shared >= F.col("need")).select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), shared.cast("long").alias(f"shared_{c}"))
        out = good if out is None else out.join(good, ["left_id", "right_id"])
    return out


def length_overlap_filter(pairs: DataFrame, left: Column, right: Column, threshold: float, k: int = 3) -> DataFrame:
    """Pairs whose lengths and k-mer overlap allow the threshold: length ratio, and shared k-mers over the smaller set of at least max(0.05, t - 0.65)."""
    ratio = F.least(F.length(left), F.length(right)) / F.greatest(F.length(left), F.length(right))
    a, b = grams(left, k), grams(right, k)
    overlap = F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    return pairs.filter((ratio >= threshold) & (overlap >= max(0.05, threshold - 0.65)))


def foreign_key_issues(child: DataFrame, child_id: str, fk: str, parent: DataFrame, pk: str, code: str) -> DataFrame:
    """(id, code) of child rows whose non-null key has no parent."""
    missing = child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return missing.select(F.col(child_id).cast("string").alias("id"), F.lit(code).alias("code"))
