"""Motif catalogue as data, site scanning over arrays of residues, risk scoring as expressions and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.sequences import REGIONS, normalize, region_of, risk_level, validation_error
from quillon.runtime import flat_map

#: Motif, category, base penalty, in reporting order. The two glycosylation rules are patterns, not fixed motifs.
CATALOGUE = (
    ("NG", "deamidation", 6.0),
    ("NS", "deamidation", 5.0),
    ("NN", "deamidation", 4.0),
    ("DG", "isomerization", 6.0),
    ("DS", "isomerization", 5.0),
    ("DA", "isomerization", 3.0),
    ("M", "oxidation", 4.0),
)
GLYCO = {"n_glyco": 9.0, "o_glyco": 2.0}
CDR_WEIGHT, LATER_WEIGHT = 1.3, 0.5
WINDOW, MIN_ST, FLANK = 7, 6, 3
VERSIONS = ("frozen_v1", "overlap_v2")


def chains(pairs: DataFrame, *keep: str) -> DataFrame:
    """A row per chain: the kept columns, chain, chain_order, seq (normalised), error."""
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("chain"), F.lit(k).alias("chain_order"), normalize(F.col(c)).alias("seq")) for k, c in enumerate(("VH", "VL"))]))
    out = pairs.select(*keep, rows.alias("c")).select(*keep, "c.chain", "c.chain_order", "c.seq")
    return out.withColumn("error", validation_error(F.col("seq")))


MOTIFS = {m: (c, k) for k, (m, c, _) in enumerate(CATALOGUE)}
SEQUON, HOTSPOT = len(CATALOGUE), len(CATALOGUE) + 1
CATEGORY_OF = [c for _, c, _ in CATALOGUE] + list(GLYCO)


def _without_overlap(at: np.ndarray, width: int) -> np.ndarray:
    """Of sorted positions those that stay from left to right without overlap; positions of different sequences are further apart than the width."""
    keep, last = [], -width
    for p in at.tolist():
        if p >= last + width:
            keep.append(p)
            last = p
    return np.array(keep, np.int64)


def find_hits(data: np.ndarray, version: str, categories: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Positions and motif numbers of all hits in residues, whose sequences are separated by WINDOW line feeds; unordered."""
    found: list[tuple[np.ndarray, int]] = []
    for motif, (category, number) in MOTIFS.items():
        if category in categories:
            hit = data[: len(data) - len(motif) + 1] == ord(motif[0])
            if len(motif) == 2:
                hit = hit & (data[1:] == ord(motif[1]))
            found.append((np.flatnonzero(hit), number))
    serine_threonine = (data == ord("S")) | (data == ord("T"))
    if "n_glyco" in categories:
        start = (data[:-2] == ord("N")) & (data[1:-1] != ord("P")) & (data[1:-1] != 10) & serine_threonine[2:]
        at = np.flatnonzero(start)
        found.append((_without_overlap(at, 3) if version == "frozen_v1" else at, SEQUON))
    if "o_glyco" in categories:
        count = np.concatenate(([0], np.cumsum(serine_threonine)))
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        dense = (count[WINDOW:] - count[:-WINDOW] >= MIN_ST) & (breaks[WINDOW:] == breaks[:-WINDOW])
        before = np.concatenate((np.zeros(WINDOW, np.int64), np.cumsum(dense), np.full(WINDOW - 1, dense.sum())))  # at p + WINDOW: dense windows that start at p or earlier
        p = np.flatnonzero(serine_threonine[:-1] & (data[1:] != ord("P")))
        found.append((p[before[p + WINDOW] > before[p]], HOTSPOT))
    return np.concatenate([f for f, _ in found]), np.concatenate([np.full(len(f), k, np.int64) for f, k in found])


def scan_sites(rows: DataFrame, *keep: str, regions=REGIONS, version: str = "overlap_v2", outer: bool = False, categories: tuple[str, ...] = tuple(dict.fromkeys(CATEGORY_OF))) -> DataFrame:
    """A row per site of the valid chains: kept columns, chain, chain_order, motif, category, pos_start, pos_end, region, context.

    outer keeps chains without a site, with null site columns. Only motifs of the categories are sought. Batches are scanned as one array of residues, in Arrow.
    """
    if version not in VERSIONS:
        raise ValueError(f"unsupported rule version {version!r}")
    wanted = frozenset(categories)
    own = [*keep, "chain", "chain_order", "error"]
    source = rows.select(*own, "seq")
    text, number = T.StringType(), T.IntegerType()
    site = [T.StructField("motif", text), T.StructField("category", text), T.StructField("motif_order", number), T.StructField("pos_start", number), T.StructField("pos_end", number), T.StructField("context", text)]
    schema = T.StructType([source.schema[c] for c in own] + [T.StructField("seq_length", number)] + site)
    gap = "\n" * WINDOW

    def run(batches):
        for b in batches:
            seqs, errors = b.column("seq").to_pylist(), b.column("error").to_pylist()
            valid = [s if e is None and s else "" for s, e in zip(seqs, errors)]
            joined = gap.join(valid) + gap
            data = np.frombuffer(joined.encode("ascii"), np.uint8)
            lengths = np.array([len(s) for s in valid], np.int64)
            starts = np.cumsum(lengths + WINDOW) - lengths - WINDOW
            at, kind = find_hits(data, version, wanted)
            order = np.lexsort((kind, at))
            at, kind = at[order], kind[order]
            owner = np.searchsorted(starts, at, "right") - 1
            width = np.where(kind == SEQUON, 3, np.where((kind == HOTSPOT) | (kind == MOTIFS["M"][1]), 1, 2))
            first = at - starts[owner]
            motif = [joined[p : p + w] for p, w in zip(at.tolist(), width.tolist())]
            context = [joined[max(s, p - FLANK) : min(e, p + w + FLANK)] if k >= SEQUON else "" for p, w, k, s, e in zip(at.tolist(), width.tolist(), kind.tolist(), starts[owner].tolist(), (starts + lengths)[owner].tolist())]
            columns = [pa.array(motif, pa.string()), pa.array([CATEGORY_OF[k] for k in kind.tolist()], pa.string()), pa.array(kind, pa.int32()), pa.array(first + 1, pa.int32()), pa.array(first + width, pa.int32()), pa.array(context, pa.string())]
            if outer:
                bare = np.setdiff1d(np.arange(len(valid)), owner)
                owner = np.concatenate((owner, bare))
                columns = [pa.concat_arrays([c, pa.nulls(len(bare), c.type)]) for c in columns]
            take = pa.array(owner)
            size = pa.array([len(s) if s is not None else None for s in seqs], pa.int32()).take(take)
            yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in own] + [size] + columns, names=schema.names)

    sites = flat_map(source, schema, run)
    region = F.when(F.col("pos_start").isNotNull(), region_of(F.col("pos_start"), regions))
    return sites.select(*own, "seq_length", "motif", "category", "motif_order", "pos_start", "pos_end", region.alias("region"), "context")


def base_penalty(category: Column, motif: Column) -> Column:
    table = [x for m, _, v in CATALOGUE for x in (F.lit(m), F.lit(v))]
    glyco = [x for c, v in GLYCO.items() for x in (F.lit(c), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*glyco), category), F.element_at(F.create_map(*table), motif), F.lit(0.0))


def penalties(sites: DataFrame, *key: str) -> DataFrame:
    """Per key, category and motif: the penalty and its parts. The first site counts whole, later ones half, sites in CDRs 1.3-fold.

    Rows must be distinct by (key, chain, motif, category, position, region), as scan_sites gives them. The key decides whose sites are counted
    together: without chain both chains share a motif's first site.
    """
    weight = F.when(F.col("region") == "FW", 1.0).otherwise(CDR_WEIGHT)
    order = F.struct("chain_order", "pos_start")
    first = F.min_by(F.struct(weight.alias("w"), (F.col("region") == "FW").alias("fw")), order)
    cdr = F.sum(F.when(F.col("region") != "FW", weight).otherwise(0.0))
    out = sites.filter("motif IS NOT NULL").groupBy(*key, "category", "motif").agg(F.sum(weight).alias("__all"), cdr.alias("__cdr"), first.alias("__first"))
    base = base_penalty(F.col("category"), F.col("motif"))
    more = 1 - LATER_WEIGHT
    return out.select(
        *key, "category", "motif",
        (base * (F.col("__all") * LATER_WEIGHT + F.col("__first.w") * more)).alias("penalty"),
        (base * (F.col("__cdr") * LATER_WEIGHT + F.when(F.col("__first.fw"), 0.0).otherwise(F.col("__first.w") * more))).alias("cdr_penalty"),
    )


def score_of(total: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - total)), 2)


def batch_summary(pairs: DataFrame, id_col: str = "antibody_id", regions=REGIONS) -> DataFrame:
    """One row per input row, duplicates of ids too: lengths, counts by region, warnings, status, score, level.

    Sites are aggregated once by row and motif, then by row; both share the partitioning by row, so there is one shuffle of partial counts.
    """
    rows = pairs.select(F.monotonically_increasing_id().alias("__row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("antibody_id"), "VH", "VL")
    sites = scan_sites(chains(rows, "__row", "antibody_id"), "__row", "antibody_id", regions=regions, outer=True)
    weight = F.when(F.col("region") == "FW", 1.0).when(F.col("region").isNotNull(), CDR_WEIGHT)
    at = lambda r: F.count(F.when(F.col("region") == r, 1)).alias(f"__{r}")
    chain = lambda c, x: F.max(F.when(F.col("chain") == c, x))
    warning = F.concat(F.col("chain"), F.lit(" "), F.col("error"))
    per_motif = (
        sites.groupBy("__row", "antibody_id", "category", "motif")
        .agg(F.sum(weight).alias("__all"), F.min_by(weight, F.struct("chain_order", "pos_start")).alias("__first"), F.count("motif").alias("__n"), *[at(r) for r in ("CDR1", "CDR2", "CDR3", "FW")],
             chain("VH", F.col("seq_length")).alias("__vh"), chain("VL", F.col("seq_length")).alias("__vl"), chain("VH", warning).alias("__wh"), chain("VL", warning).alias("__wl"))
    )
    ptm = F.col("category").isin(*GLYCO)
    penalty = base_penalty(F.col("category"), F.col("motif")) * (F.col("__all") * LATER_WEIGHT + F.col("__first") * (1 - LATER_WEIGHT))
    out = per_motif.groupBy("__row", "antibody_id").agg(
        F.max("__vh").cast("int").alias("VH_length"), F.max("__vl").cast("int").alias("VL_length"),
        *[F.sum(f"__{r}").cast("int").alias(f"{r}_risk_count") for r in ("CDR1", "CDR2", "CDR3", "FW")],
        F.sum(F.when(ptm, F.col("__n")).otherwise(0)).cast("int").alias("PTM_risk_count"),
        F.sum(F.when(~ptm, F.col("__n")).otherwise(0)).cast("int").alias("liability_risk_count"),
        F.sum("__n").cast("int").alias("total_risk_count"),
        F.max("__wh").alias("__wh"), F.max("__wl").alias("__wl"), F.coalesce(F.sum(penalty), F.lit(0.0)).alias("__total"),
    )
    bad_h, bad_l = F.col("__wh").isNotNull(), F.col("__wl").isNotNull()
    score = F.when(~(bad_h & bad_l), score_of(F.col("__total")))
    return out.select(
        "antibody_id", "VH_length", "VL_length", "CDR1_risk_count", "CDR2_risk_count", "CDR3_risk_count", "FW_risk_count", "PTM_risk_count", "liability_risk_count", "total_risk_count",
        F.concat_ws("; ", "__wh", "__wl").alias("warnings"),
        F.when(bad_h & bad_l, "error").when(bad_h | bad_l, "partial_error").otherwise("success").alias("analysis_status"),
        score.alias("risk_score"), risk_level(score).alias("risk_level"), F.lit(VERSIONS[1]).alias("rule_version"),
    )
