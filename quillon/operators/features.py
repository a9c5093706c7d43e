"""Feature tables and reports over sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.functions import rules, sequences

CATEGORIES = ("deamidation", "isomerization", "oxidation", "n_glyco", "o_glyco")
REGIONS = ("CDR1", "CDR2", "CDR3", "FW")
COUNTS = [f"{r}_count" for r in REGIONS] + [f"{c}_count" for c in CATEGORIES] + [f"{c}_cdr_count" for c in CATEGORIES]


def position_label() -> Column:
    return F.concat(F.col("pos_start").cast("string"), F.when(F.col("pos_end") > F.col("pos_start"), F.concat(F.lit("-"), F.col("pos_end").cast("string"))).otherwise(""))


def chain_report(sites: DataFrame, id_col: str = "antibody_id") -> DataFrame:
    """Counts by region as text, and the sites in reporting order."""
    n = lambda cond: F.count(F.when(cond, 1)).cast("string")
    region = F.col("region")
    line = F.concat(F.lit("["), "category", F.lit("] "), "motif", F.lit(" at "), position_label(), F.lit(" "), "region")
    lines = F.sort_array(F.collect_list(F.struct("motif_order", "pos_start", line.alias("line"))))
    summary = F.concat(F.lit("CDR sites: "), n(region != "FW"), F.lit(" (CDR1:"), n(region == "CDR1"), F.lit(", CDR2:"), n(region == "CDR2"), F.lit(", CDR3:"), n(region == "CDR3"), F.lit(")"))
    out = sites.groupBy(id_col, "chain").agg(summary.alias("summary"), lines.alias("lines"))
    return out.select(id_col, "chain", "summary", F.array_join(F.transform("lines", lambda x: x["line"]), ";").alias("report"))


def score_breakdown(sites: DataFrame, id_col: str) -> DataFrame:
    """Total penalty and its two splits, by kind and by region."""
    per = rules.penalties(sites, id_col)
    ptm = F.col("category").isin(*rules.GLYCO)
    s = lambda x: F.round(F.sum(x), 4)
    return per.groupBy(id_col).agg(
        s("penalty").alias("total_penalty"), s(F.when(ptm, F.col("penalty")).otherwise(0.0)).alias("ptm_penalty"), s(F.when(ptm, 0.0).otherwise(F.col("penalty"))).alias("chemical_penalty"),
        s("cdr_penalty").alias("cdr_penalty"), s(F.col("penalty") - F.col("cdr_penalty")).alias("framework_penalty"),
    )


def score_factors(sites: DataFrame, id_col: str = "antibody_id") -> DataFrame:
    text = F.concat("chain", F.lit(" "), "motif", F.lit("@"), position_label(), F.lit(" "), "category", F.lit(" ("), "region", F.lit(")"))
    listed = F.sort_array(F.collect_list(F.struct("chain_order", "pos_start", "motif_order", text.alias("t"))))
    return sites.groupBy(id_col).agg(listed.alias("l")).select(id_col, F.array_join(F.transform("l", lambda x: x["t"]), "; ").alias("factors"))


def chain_features(sites: DataFrame, id_col: str) -> DataFrame:
    """A row per chain, also without sites: score and penalty of the chain alone, counts by region and category. sites: scanned with outer=True."""
    cdr = F.col("region") != "FW"
    n = lambda cond: F.count(F.when(cond, 1))
    first = F.min_by(F.when(cdr, rules.CDR_WEIGHT).otherwise(1.0), F.struct("chain_order", "pos_start"))
    per = sites.groupBy(id_col, "chain", "category", "motif").agg(
        F.sum(F.when(cdr, rules.CDR_WEIGHT).otherwise(1.0)).alias("__all"), first.alias("__first"), F.max("seq_length").alias("seq_length"), F.max("error").alias("error"),
        F.count("motif").alias("total_count"), *[n(F.col("region") == r).alias(f"{r}_count") for r in REGIONS], n(cdr).alias("__cdr"),
    )
    penalty = F.coalesce(rules.base_penalty(F.col("category"), F.col("motif")), F.lit(0.0)) * (F.col("__all") * rules.LATER_WEIGHT + F.col("__first") * (1 - rules.LATER_WEIGHT))
    total = lambda c: F.sum(c).cast("long")
    out = per.groupBy(id_col, "chain").agg(
        F.max("seq_length").alias("seq_length"), F.max("error").alias("__error"), F.sum(F.when(F.col("motif").isNotNull(), penalty).otherwise(0.0)).alias("__t"), total("total_count").alias("total_count"),
        *[total(f"{r}_count").alias(f"{r}_count") for r in REGIONS],
        *[total(F.when(F.col("category") == c, F.col("total_count")).otherwise(0)).alias(f"{c}_count") for c in CATEGORIES],
        *[total(F.when(F.col("category") == c, F.col("__cdr")).otherwise(0)).alias(f"{c}_cdr_count") for c in CATEGORIES],
    )
    score = F.when(F.col("__error").isNull(), rules.score_of(F.col("__t")))
    return out.select(id_col, "chain", "seq_length", score.alias("score"), F.round(100 - score, 2).alias("penalty"), "total_count", *COUNTS)


def pair_features(chains: DataFrame, id_col: str) -> DataFrame:
    """VH_ and VL_ columns, and sums of both for counts, never for scores."""
    per_chain = ["score", "penalty", "total_count", *COUNTS]
    return chains.groupBy(id_col).agg(
        *[F.max(F.when(F.col("chain") == x, F.col(c))).alias(f"{x}_{c}") for x in ("VH", "VL") for c in per_chain],
        *[F.sum(c).cast("long").alias(f"{c}_combined") for c in ["total_count", *COUNTS]],
    )


def duplicate_audit(rows: DataFrame, *key: str) -> DataFrame:
    n = F.col("n")
    s = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(
        s("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), s(F.when(n > 1, n)).alias("duplicate_rows"), s(n - 1).alias("excess_rows"), s(F.expr("n * (n - 1) div 2")).alias("duplicate_pairs"),
    )


def infer_column(rows: DataFrame, column: str, order: Column, seq: Column, first: int = 100) -> DataFrame:
    """A column's chain by vote over its first rows."""
    head = rows.withColumn("__rn", F.row_number().over(W.partitionBy(column).orderBy(order))).filter(F.col("__rn") <= first)
    inferred = sequences.infer_chain(seq)
    c = head.groupBy(column).agg(F.count(F.when(inferred == "VH", 1)).alias("vh_count"), F.count(F.when(inferred == "VL", 1)).alias("vl_count"))
    h, l = F.col("vh_count"), F.col("vl_count")
    n = h + l
    sure = (F.greatest(h, l) / n >= 0.9) & ((n >= 3) | (F.least(h, l) == 0))
    return c.select(F.col(column).alias("column_name"), "vh_count", "vl_count", F.when(n == 0, "UNKNOWN").when(sure, F.when(h >= l, "VH").otherwise("VL")).otherwise("AMBIGUOUS").alias("inferred"))


def longest_residue_token(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 5) -> DataFrame:
    """The longest word of residues only, the first of equals in sort order, and whether there was one."""
    words = F.split(F.upper(F.regexp_replace(F.coalesce(text_col, F.lit("")), r"[^A-Za-z \n]", "")), " ")
    good = F.filter(words, lambda w: (F.length(w) >= least) & w.rlike(f"^[{sequences.RESIDUES}]+$") & ~w.contains("\n"))
    best = F.array_min(F.transform(good, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]
    return docs.select(id_col, F.coalesce(best, F.lit("")).alias("token"), F.when(best.isNull(), "unavailable").otherwise("user_provided").alias("provenance"))
