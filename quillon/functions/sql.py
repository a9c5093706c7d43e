"""SQL functions that Catalyst inlines, and the site scan as a table function."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillon.functions import rules
from quillon.functions.sequences import HEAVY_INNER, HEAVY_STARTS, LIGHT_INNER, LIGHT_STARTS, REGIONS, RESIDUES

SCALARS = (
    "CREATE OR REPLACE TEMPORARY FUNCTION region_of(p INT) RETURNS STRING RETURN CASE WHEN p BETWEEN 31 AND 35 THEN 'CDR1' WHEN p BETWEEN 50 AND 65 THEN 'CDR2' WHEN p BETWEEN 99 AND 110 THEN 'CDR3' ELSE 'FW' END",
    "CREATE OR REPLACE TEMPORARY FUNCTION risk_level(score DOUBLE) RETURNS STRING RETURN CASE WHEN score IS NULL THEN 'N/A' WHEN score >= 80 THEN 'Low Risk' WHEN score >= 60 THEN 'Medium Risk' ELSE 'High Risk' END",
    "CREATE OR REPLACE TEMPORARY FUNCTION valid_sequence(s STRING) RETURNS BOOLEAN RETURN upper(trim(coalesce(s, ''))) RLIKE '^[ACDEFGHIKLMNPQRSTVWY]+$'",
    "CREATE OR REPLACE TEMPORARY FUNCTION paired_hash(h STRING, l STRING) RETURNS STRING RETURN sha2(concat(upper(trim(coalesce(h, ''))), '\\n', upper(trim(coalesce(l, '')))), 256)",
)
INFER = """CREATE OR REPLACE TEMPORARY FUNCTION infer_chain(s STRING) RETURNS STRING RETURN
CASE WHEN upper(trim(coalesce(s, ''))) RLIKE '^[ACDEFGHIKLMNPQRSTVWY]{80,}$' THEN
  CASE WHEN greatest(heavy_votes(s), light_votes(s)) >= 3 AND heavy_votes(s) > light_votes(s) THEN 'VH' WHEN greatest(heavy_votes(s), light_votes(s)) >= 3 AND heavy_votes(s) < light_votes(s) THEN 'VL' ELSE 'UNKNOWN' END ELSE 'UNKNOWN' END"""


def _votes(name: str, starts, inner) -> str:
    return f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS INT RETURN
CASE WHEN upper(trim(s)) RLIKE '^({"|".join(starts)})' THEN 3 ELSE 0 END + CASE WHEN upper(trim(s)) RLIKE '{"|".join(inner)}' THEN 1 ELSE 0 END"""


class ScanSites:
    """Rows of all sites of a sequence, found as scan_sites finds them: motif, category, pos_start, pos_end, region, context. The version is optional."""

    def eval(self, seq: str, version: str = rules.VERSIONS[1]):
        s = (seq or "").strip().upper()
        if version not in rules.VERSIONS:
            raise ValueError(f"unsupported rule version {version!r}")
        if not s or set(s) - set(RESIDUES):
            return
        at, kind = rules.find_hits(np.frombuffer((s + "\n" * rules.WINDOW).encode(), np.uint8), version, frozenset(rules.CATEGORY_OF))
        for p, k in sorted(zip(at.tolist(), kind.tolist())):
            width = 3 if k == rules.SEQUON else 1 if k in (rules.HOTSPOT, rules.MOTIFS["M"][1]) else 2
            region = next((n for n, low, high in REGIONS if low <= p + 1 <= high), "FW")
            context = s[max(0, p - rules.FLANK) : p + width + rules.FLANK] if k >= rules.SEQUON else ""
            yield s[p : p + width], rules.CATEGORY_OF[k], p + 1, p + width, region, context


def register(spark: SparkSession) -> None:
    for sql in (*SCALARS, _votes("heavy_votes", HEAVY_STARTS, HEAVY_INNER), _votes("light_votes", LIGHT_STARTS, LIGHT_INNER), INFER):
        spark.sql(sql)
    spark.udtf.register("scan_sites", udtf(ScanSites, returnType="motif string, category string, pos_start int, pos_end int, region string, context string"))
