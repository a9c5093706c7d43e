"""Evidence records, merged summaries, claim checks and contracts, as expressions and aggregates."""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "abstractText", "pmid", "pmcid", "doi", "isOpenAccess", "inPMC")])


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def parse_evidence(rows: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Records of a search result: citation key, validity (a title, and an abstract or a PMID), and whether the full text is open."""
    r = rows.select(id_col, F.from_json(json_col, EVIDENCE).alias("e"))
    get = lambda n: blank_to_null(F.col(f"e.{n}"))
    key = F.coalesce(get("pmid"), get("pmcid"), get("doi"), F.col(id_col).cast("string"))
    full = (F.col("e.isOpenAccess") == "Y") & get("pmcid").isNotNull() & (F.col("e.inPMC") == "Y")
    valid = get("title").isNotNull() & (get("abstractText").isNotNull() | get("pmid").isNotNull())
    return r.select(id_col, key.alias("citation_key"), F.coalesce(valid, F.lit(False)).alias("valid"), F.coalesce(full, F.lit(False)).alias("full_text"))


def cache_key(query: Column, source: Column, n: Column) -> Column:
    return F.concat(F.lower(F.trim(F.regexp_replace(query, r"\s+", " "))), F.lit("|"), source, F.lit("|"), n.cast("string"))


def site_summary(sites: DataFrame, id_col: str, first: int = 10) -> DataFrame:
    """(id, n_sites, categories, first_sites, fingerprint): the first sites in reporting order and a digest of all that is shown."""
    label = F.concat("chain", F.lit(":"), "motif", F.lit("@"), F.col("pos_start").cast("string"))
    a = sites.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_sites"), F.array_join(F.array_sort(F.collect_set("category")), ";").alias("categories"), F.slice(F.sort_array(F.collect_list(F.struct("chain_order", "motif_order", "pos_start", label.alias("s")))), 1, first).alias("f"))
    shown = a.select(id_col, "n_sites", "categories", F.array_join(F.transform("f", lambda x: x["s"]), ";").alias("first_sites"))
    return shown.withColumn("fingerprint", F.sha2(F.concat_ws("|", F.col("n_sites").cast("string"), "categories", "first_sites"), 256))


def stale(current: DataFrame, stored: DataFrame, id_col: str) -> DataFrame:
    """(id, state): fresh, stale, missing (not stored) or orphaned (stored only)."""
    j = current.select(id_col, F.col("fingerprint").alias("a")).join(stored.select(id_col, F.col("fingerprint").alias("b")), id_col, "full")
    return j.select(id_col, F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphaned").when(F.col("a") == F.col("b"), "fresh").otherwise("stale").alias("state"))


def numeric_claim_ok(claim: Column, fact: Column) -> Column:
    """A claimed number (text) equals the fact within 1e-6, or the fact rounded to the claim's decimals."""
    decimals = F.when(claim.contains("."), F.length(F.substring_index(claim, ".", -1))).otherwise(0)
    value = claim.try_cast("double")
    scale = F.pow(F.lit(10.0), decimals)
    return F.coalesce((F.abs(value - fact) <= 1e-6) | (F.abs(value - F.floor(fact * scale + 0.5) / scale) <= 1e-9), F.lit(False))


def clause_violations(text: Column, patterns: dict[str, str]) -> Column:
    """Names of forbidden patterns in clauses that aren't negated; the first that a clause hits."""
    clauses = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.;!?\n]")
    plain = F.filter(clauses, lambda c: ~c.rlike(r"\b(not|no|never|cannot)\b") | c.contains("not only"))
    hit = lambda c: reduce(lambda w, p: w.when(c.rlike(p[1]), p[0]), patterns.items(), F.when(F.lit(False), ""))
    return F.array_join(F.array_distinct(F.array_compact(F.transform(plain, hit))), ";")


def length_claims(text: Column, actual: Column) -> Column:
    """Sequence lengths that a text claims (`120 aa`, `length 120`) and that differ from the actual one."""
    t = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat(F.regexp_extract_all(t, F.lit(r"([0-9]+) ?(?:aa|residues)\b"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"length (?:of |is )?([0-9]+)"), F.lit(1)))
    return F.array_join(F.filter(F.array_distinct(found), lambda x: x != actual.cast("string")), ";")


def contract_issues(df: DataFrame, expected: T.StructType) -> list[str]:
    """Differences of a frame's schema from the expected one: order, names, types."""
    own = [(f.name, f.dataType.simpleString()) for f in df.schema]
    want = [(f.name, f.dataType.simpleString()) for f in expected]
    out = [f"missing {n}" for n, _ in want if n not in dict(own)] + [f"unexpected {n}" for n, _ in own if n not in dict(want)]
    out += [f"{n} is {dict(own)[n]}, not {t}" for n, t in want if n in dict(own) and dict(own)[n] != t]
    return out or ([] if own == want else ["columns are in another order"])


def stratified_metrics(rows: DataFrame, stratum: Column, predicted: Column, actual: Column, least: int = 15) -> DataFrame:
    """(stratum, n, mae, status); no figure where a stratum has fewer than `least` rows."""
    a = rows.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(predicted - actual)).alias("m"))
    ok = F.col("n") >= least
    return a.select("stratum", "n", F.when(ok, F.round("m", 6)).alias("mae"), F.when(ok, "OK").otherwise("NOT_ESTIMABLE").alias("status"))


def novelty_bin(similarity: Column) -> Column:
    return F.when(similarity.isNull(), "NO_NEIGHBOUR").when(similarity >= 1 - 1e-12, "EXACT").when(similarity >= 0.95, "0.95-1").when(similarity >= 0.9, "0.90-0.95").when(similarity >= 0.8, "0.80-0.90").otherwise("<0.80")


def bridges(edges: DataFrame, src: str, dst: str, kind: str, a: str, b: str) -> DataFrame:
    """(left, middle, right): paths of an edge of kind a and one of kind b that meet in a node."""
    both = edges.select(F.col(src).alias("m"), F.col(dst).alias("x"), kind).unionByName(edges.select(F.col(dst).alias("m"), F.col(src).alias("x"), kind))
    l, r = both.filter(F.col(kind) == a).select("m", F.col("x").alias("left")), both.filter(F.col(kind) == b).select("m", F.col("x").alias("right"))
    return l.join(r, "m").filter("left <> right").select("left", F.col("m").alias("middle"), "right")


def new_imports(batch: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch that the manifest doesn't hold yet."""
    return batch.join(manifest.select(*keys).distinct(), keys, "left_anti")


def split_flags(rows: DataFrame, split: str, label: str, overall: float, tolerance: float = 0.05, least_class: int = 10, least: int = 40) -> DataFrame:
    """(split, n, prevalence, flags) with review flags for drifting prevalence and small classes."""
    a = rows.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(label).cast("double")), 6).alias("prevalence"), F.sum(label).alias("p"))
    flags = F.array_compact(F.array(F.when(F.abs(F.col("prevalence") - overall) > tolerance, "PREVALENCE_SHIFT"), F.when(F.least(F.col("p"), F.col("n") - F.col("p")) < least_class, "SMALL_CLASS"), F.when(F.col("n") < least, "SMALL_SPLIT")))
    return a.select(split, "n", "prevalence", F.array_join(flags, ";").alias("flags"))


def hashed_vector(text: Column, dim: int = 512) -> Column:
    """Length-one vector of hashed 1- and 2-grams of characters, made in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vector(column: pd.Series) -> pd.Series:
        out = []
        for t in column:
            low = (t or "").lower()
            slots = [zlib.crc32(g.encode()) % dim for g in [*low, *map("".join, zip(low, low[1:]))]]
            v = np.bincount(slots, minlength=dim).astype(np.float64) if slots else np.zeros(dim)
            out.append((v / (np.linalg.norm(v) or 1.0)).astype(np.float32))
        return pd.Series(out)

    return vector(text)
