"""Column expressions over residue sequences: normalisation, validation, hashing, regions, chain inference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 20 standard residues, the 26 letters with the ambiguous ones among them, default region bounds (1-based, inclusive).
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED = "ACDEFGHIKLMNPQRSTVWYUOBZXJ"
REGIONS = (("CDR1", 31, 35), ("CDR2", 50, 65), ("CDR3", 99, 110))
#: N-terminal and inner patterns that speak for a heavy or a light chain.
HEAVY_STARTS, HEAVY_INNER = ("EVQL", "QVQL", "VQL", "DVQL"), ("WGQG", "CSRW")
LIGHT_STARTS, LIGHT_INNER = ("DIQM", "DIVM", "EIVL", "QIVL"), ("CQQ", "FGG")


def normalize(seq: Column) -> Column:
    return F.upper(F.trim(F.coalesce(seq, F.lit(""))))


def invalid_residues(seq: Column, alphabet: str = RESIDUES) -> Column:
    """Sorted distinct letters outside the alphabet."""
    rest = F.regexp_replace(seq, f"[{alphabet}]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda x: x != ""))), "")


def validation_error(seq: Column, allow_empty: bool = False) -> Column:
    """Null if valid, else the first failed check: empty, non-ASCII, non-letter, residues outside the alphabet."""
    s = normalize(seq)
    return (
        F.when(s == "", F.lit(None) if allow_empty else F.lit("sequence is empty"))
        .when(s.rlike(r"[^\x00-\x7F]"), "sequence has non-ASCII characters")
        .when(s.rlike("[^A-Za-z]"), "sequence has non-letter characters")
        .when(s.rlike(f"[^{RESIDUES}]"), F.concat(F.lit("sequence has non-standard residues: "), invalid_residues(s)))
    )


def pair_status(vh: Column, vl: Column) -> Column:
    ok_h, ok_l = validation_error(vh).isNull(), validation_error(vl).isNull()
    return F.when(ok_h & ok_l, "VALID").when(ok_h | ok_l, "PARTIAL").otherwise("INVALID")


def pair_reasons(vh: Column, vl: Column) -> Column:
    part = lambda name, e: F.when(e.isNotNull(), F.concat(F.lit(f"{name} "), e))
    return F.concat_ws("; ", part("VH", validation_error(vh)), part("VL", validation_error(vl)))


def paired_hash(vh: Column, vl: Column) -> Column:
    return F.sha2(F.concat(normalize(vh), F.lit("\n"), normalize(vl)), 256)


def extended_normalize(seq: Column) -> Column:
    """White space removed everywhere, ASCII letters upper-cased."""
    s = F.regexp_replace(F.coalesce(seq, F.lit("")), r"\s+", "")
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def extended_status(seq: Column) -> Column:
    s = extended_normalize(seq)
    return F.when(s == "", "EMPTY").when(s.rlike(f"[^{EXTENDED}]"), "INVALID").when(s.rlike(f"[^{RESIDUES}]"), "AMBIGUOUS").otherwise("STANDARD")


def region_of(position: Column, regions=REGIONS) -> Column:
    """The first region whose bounds hold the position, else FW."""
    return reduce(lambda c, r: c.when(position.between(r[1], r[2]), r[0]), regions, F.when(F.lit(False), "")).otherwise("FW")


def risk_level(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").when(score >= 80, "Low Risk").when(score >= 60, "Medium Risk").otherwise("High Risk")


def chain_votes(seq: Column) -> tuple[Column, Column]:
    """Votes for a heavy and a light chain: three for the start, one for an inner pattern."""
    either = lambda tests: reduce(lambda a, b: a | b, tests).cast("int")
    votes = lambda starts, inner: either([seq.startswith(x) for x in starts]) * 3 + either([seq.contains(x) for x in inner])
    return votes(HEAVY_STARTS, HEAVY_INNER), votes(LIGHT_STARTS, LIGHT_INNER)


def infer_chain(seq: Column) -> Column:
    """VH, VL or UNKNOWN: a valid sequence of at least 80 residues, three votes or more, and no tie."""
    s = normalize(seq)
    h, l = chain_votes(s)
    sure = validation_error(seq).isNull() & (F.length(s) >= 80) & (F.greatest(h, l) >= 3) & (h != l)
    return F.when(sure, F.when(h > l, "VH").otherwise("VL")).otherwise("UNKNOWN")


def chain_confidence(seq: Column) -> Column:
    h, l = chain_votes(normalize(seq))
    return F.when(infer_chain(seq) == "UNKNOWN", 0.0).otherwise(F.round(F.least(F.lit(0.99), 0.7 + 0.1 * F.least(F.greatest(h, l), F.lit(2))), 2))
