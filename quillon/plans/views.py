"""Derived inputs that the catalogue's queries share, in Spark and as CTEs for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Residues of a block's VH and VL; blocks that a document's ids leave room for.
VH, VL, BLOCKS = 120, 110, 100_000


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-sequences from whole documents: the standard residues among a text's letters, upper-cased, in blocks of a VH and a VL; the id is doc_id * BLOCKS + block."""
    residues = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    size = VH + VL
    d = table(spark, sf_dir, "documents").select("doc_id", residues.alias("r"))
    last = F.greatest(F.floor((F.length("r") + size - 1) / size).cast("int") - 1, F.lit(0))
    block = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("k"), F.col("r").substr(k * size + 1, F.lit(VH)).alias("VH"), F.col("r").substr(k * size + VH + 1, F.lit(VL)).alias("VL")))
    return d.select("doc_id", F.explode(block).alias("b")).select((F.col("doc_id") * BLOCKS + F.col("b.k")).cast("string").alias("antibody_id"), "b.VH", "b.VL")


PAIRS = f"""pairs AS (
  SELECT CAST(doc_id * {BLOCKS} + k AS VARCHAR) AS antibody_id, substr(r, k * {VH + VL} + 1, {VH}) AS VH, substr(r, k * {VH + VL} + {VH + 1}, {VL}) AS VL
  FROM (SELECT doc_id, regexp_replace(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS r FROM documents),
       LATERAL (SELECT unnest(generate_series(0, greatest((length(r) + {VH + VL - 1}) // {VH + VL} - 1, 0))) AS k))"""


def product_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct short pairs (id, VH, VL) from the whole table part: the standard residues of names and of brands with types."""
    letters = lambda c: F.regexp_replace(F.upper(c), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    p = table(spark, sf_dir, "part").select(letters(F.col("p_name")).alias("VH"), letters(F.concat("p_brand", "p_type")).alias("VL")).distinct()
    return p.select(F.sha2(F.concat("VH", F.lit("\n"), "VL"), 256).alias("id"), "VH", "VL")


PRODUCTS = """u AS (
  SELECT sha256(VH || chr(10) || VL) AS id, VH, VL FROM (SELECT DISTINCT regexp_replace(upper(p_name), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS VH,
    regexp_replace(upper(p_brand || p_type), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS VL FROM part))"""
CHAINS = PAIRS + """,
chains AS (
  SELECT antibody_id, 'VH' AS chain, 0 AS chain_order, VH AS seq FROM pairs
  UNION ALL SELECT antibody_id, 'VL', 1, VL FROM pairs)"""
POSITIONS = CHAINS + """,
positions AS (
  SELECT antibody_id, chain, chain_order, seq, p, substr(seq, p, 1) AS one, substr(seq, p, 2) AS two, substr(seq, p, 3) AS three
  FROM chains, LATERAL (SELECT unnest(generate_series(1, length(seq))) AS p) WHERE seq <> ''),
raw_sites AS (
  SELECT antibody_id, chain, chain_order, seq, p, two AS motif,
         CASE WHEN two[1] = 'N' THEN 'deamidation' ELSE 'isomerization' END AS category, 2 AS width FROM positions WHERE two IN ('NG', 'NS', 'NN', 'DG', 'DS', 'DA')
  UNION ALL SELECT antibody_id, chain, chain_order, seq, p, 'M', 'oxidation', 1 FROM positions WHERE one = 'M'
  UNION ALL SELECT antibody_id, chain, chain_order, seq, p, three, 'n_glyco', 3 FROM positions WHERE regexp_full_match(three, 'N[^P][ST]')
  UNION ALL SELECT antibody_id, chain, chain_order, seq, p, one, 'o_glyco', 1 FROM positions
    WHERE one IN ('S', 'T') AND substr(seq, p + 1, 1) <> 'P'
      AND EXISTS (SELECT 1 FROM (SELECT unnest(generate_series(greatest(p - 6, 1), least(p, length(seq) - 6))) AS w) x
                  WHERE length(regexp_replace(substr(seq, w, 7), '[^ST]', '', 'g')) >= 6)),
sites AS (
  SELECT antibody_id, chain, chain_order, motif, category, p AS pos_start, p + width - 1 AS pos_end,
         CASE WHEN p BETWEEN 31 AND 35 THEN 'CDR1' WHEN p BETWEEN 50 AND 65 THEN 'CDR2' WHEN p BETWEEN 99 AND 110 THEN 'CDR3' ELSE 'FW' END AS region,
         CASE WHEN category IN ('n_glyco', 'o_glyco') THEN substr(seq, greatest(1, p - 3), least(length(seq), p + width + 2) - greatest(1, p - 3) + 1) ELSE '' END AS context,
         CASE category WHEN 'n_glyco' THEN 9.0 WHEN 'o_glyco' THEN 2.0 WHEN 'oxidation' THEN 4.0
              ELSE CASE motif WHEN 'NG' THEN 6.0 WHEN 'NS' THEN 5.0 WHEN 'NN' THEN 4.0 WHEN 'DG' THEN 6.0 WHEN 'DS' THEN 5.0 WHEN 'DA' THEN 3.0 END END AS base
  FROM raw_sites)"""


def scored(partition: str) -> str:
    """A CTE `scored` of penalties per site, diminished within the partition."""
    return f""",
scored AS (
  SELECT *, CAST(base AS DOUBLE) * (CASE WHEN region = 'FW' THEN 1.0::DOUBLE ELSE 1.3::DOUBLE END)
         * (CASE WHEN row_number() OVER (PARTITION BY {partition} ORDER BY chain_order, pos_start) = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS penalty FROM sites)"""
