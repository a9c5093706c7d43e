"""Point mutations: edit, rescan, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.functions.sequences import RESIDUES

FORM = r"^\s*([A-Za-z])([0-9]{1,9})([A-Za-z])\s*$"


def parts(mutation: Column) -> tuple[Column, Column, Column]:
    get = lambda k: F.regexp_extract(mutation, FORM, k)
    return F.upper(get(1)), get(2).try_cast("int"), F.upper(get(3))


def mutation_error(seq: Column, mutation: Column) -> Column:
    """Null where the edit applies; else why not: form, residues, position, the residue found."""
    old, pos, new = parts(mutation)
    s = F.upper(seq)
    standard = lambda c: c.rlike(f"^[{RESIDUES}]$")
    return (
        F.when(~mutation.rlike(FORM), F.concat(F.lit("malformed mutation "), mutation))
        .when(~standard(old) | ~standard(new), F.concat(F.lit("non-standard residue in "), mutation))
        .when(old == new, F.concat(F.lit("no change in "), mutation))
        .when((pos < 1) | (pos > F.length(s)), F.concat(F.lit("position "), pos.cast("string"), F.lit(" is beyond length "), F.length(s).cast("string")))
        .when(s.substr(pos, F.lit(1)) != old, F.concat(F.lit("expected "), old, F.lit(" at position "), pos.cast("string"), F.lit(", found "), s.substr(pos, F.lit(1))))
    )


def apply_mutation(seq: Column, mutation: Column) -> Column:
    """The edited sequence, or the sequence itself where the edit doesn't apply."""
    _, pos, new = parts(mutation)
    return F.when(mutation_error(seq, mutation).isNull(), F.overlay(F.upper(seq), new, pos, F.lit(1))).otherwise(seq)


def both_sites(pairs: DataFrame, mutation: str, id_col: str = "antibody_id", outer: bool = False) -> DataFrame:
    """Sites of baseline and mutant VH with VL, marked by mutant, of the rows that the edit applies to. One scan of pairs."""
    m = F.lit(mutation)
    ok = pairs.filter(mutation_error(F.col("VH"), m).isNull())
    versions = F.explode(F.array(F.struct(F.lit(False).alias("mutant"), F.col("VH").alias("VH")), F.struct(F.lit(True).alias("mutant"), apply_mutation(F.col("VH"), m).alias("VH"))))
    rows = ok.select(id_col, "VL", versions.alias("v")).select(id_col, "v.mutant", "v.VH", "VL")
    return rules.scan_sites(rules.chains(rows, id_col, "mutant"), id_col, "mutant", outer=outer)


def compare_sites(pairs: DataFrame, mutation: str, id_col: str = "antibody_id") -> DataFrame:
    """Each site of either version: removed, added or unchanged. One aggregate, no join."""
    sites = both_sites(pairs, mutation, id_col)
    out = sites.groupBy(id_col, "chain", "category", "motif", "pos_start").agg(F.bool_or("mutant").alias("m"), F.bool_and("mutant").alias("only"))
    return out.select(id_col, "chain", "category", "motif", "pos_start", F.when(~F.col("m"), "removed").when(F.col("only"), "added").otherwise("unchanged").alias("change"))


def score_delta(pairs: DataFrame, mutation: str, id_col: str = "antibody_id") -> DataFrame:
    sites = both_sites(pairs, mutation, id_col, outer=True)
    weight = F.when(F.col("region") == "FW", 1.0).when(F.col("region").isNotNull(), rules.CDR_WEIGHT)
    per = sites.groupBy(id_col, "mutant", "category", "motif").agg(F.sum(weight).alias("a"), F.min_by(weight, F.struct("chain_order", "pos_start")).alias("f"), F.count("motif").alias("n"), F.count(F.when(F.col("region") != "FW", 1)).alias("c"))
    penalty = rules.base_penalty(F.col("category"), F.col("motif")) * (F.col("a") * rules.LATER_WEIGHT + F.col("f") * (1 - rules.LATER_WEIGHT))
    of = lambda mutant, x: F.sum(F.when(F.col("mutant") == mutant, x))
    score = lambda mutant: rules.score_of(F.coalesce(of(mutant, penalty), F.lit(0.0)))
    out = per.groupBy(id_col).agg(score(False).alias("baseline_score"), score(True).alias("mutant_score"), (of(True, F.col("n")) - of(False, F.col("n"))).alias("site_delta"), (of(True, F.col("c")) - of(False, F.col("c"))).alias("cdr_site_delta"))
    return out.select(id_col, "baseline_score", "mutant_score", F.round(F.col("mutant_score") - F.col("baseline_score"), 2).alias("score_delta"), "site_delta", "cdr_site_delta")


def category_counts(pairs: DataFrame, mutation: str, id_col: str = "antibody_id") -> DataFrame:
    sites = both_sites(pairs, mutation, id_col)
    return sites.groupBy(id_col, "category").agg(F.count(F.when(~F.col("mutant"), 1)).alias("before"), F.count(F.when(F.col("mutant"), 1)).alias("after"))
