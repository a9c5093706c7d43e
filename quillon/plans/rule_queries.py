"""Sequence rules: scanning, scoring, features, mutations, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import rules, sequences
from quillon.operators import features, mutations
from quillon.plans.views import CHAINS, PAIRS, POSITIONS, pairs, scored, table
from quillon.sources import sequences as fasta

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def sites(spark: SparkSession, sf_dir: str, version: str = "overlap_v2", **options) -> DataFrame:
    return rules.scan_sites(rules.chains(pairs(spark, sf_dir), "antibody_id"), "antibody_id", version=version, **options)


SUMMARY = f"""WITH {POSITIONS}{scored('antibody_id, category, motif')},
agg AS (
  SELECT antibody_id, count(*) FILTER (region = 'CDR1') AS c1, count(*) FILTER (region = 'CDR2') AS c2, count(*) FILTER (region = 'CDR3') AS c3,
         count(*) FILTER (region = 'FW') AS fw, count(*) FILTER (category IN ('n_glyco', 'o_glyco')) AS ptm, count(*) AS n, sum(penalty) AS total
  FROM scored GROUP BY antibody_id),
j AS (
  SELECT p.antibody_id, length(VH) AS h, length(VL) AS l, a.*,
         round(greatest(0, least(100, 100 - coalesce(total, 0))), 2) AS score
  FROM pairs p LEFT JOIN agg a ON p.antibody_id = a.antibody_id)
SELECT antibody_id, CAST(h AS INT) AS VH_length, CAST(l AS INT) AS VL_length,
       CAST(coalesce(c1, 0) AS INT) AS CDR1_risk_count, CAST(coalesce(c2, 0) AS INT) AS CDR2_risk_count, CAST(coalesce(c3, 0) AS INT) AS CDR3_risk_count,
       CAST(coalesce(fw, 0) AS INT) AS FW_risk_count, CAST(coalesce(ptm, 0) AS INT) AS PTM_risk_count,
       CAST(coalesce(n, 0) - coalesce(ptm, 0) AS INT) AS liability_risk_count, CAST(coalesce(n, 0) AS INT) AS total_risk_count,
       concat_ws('; ', CASE WHEN h = 0 THEN 'VH sequence is empty' END, CASE WHEN l = 0 THEN 'VL sequence is empty' END) AS warnings,
       CASE WHEN h = 0 AND l = 0 THEN 'error' WHEN h = 0 OR l = 0 THEN 'partial_error' ELSE 'success' END AS analysis_status,
       CASE WHEN h > 0 OR l > 0 THEN score END AS risk_score,
       CASE WHEN h = 0 AND l = 0 THEN 'N/A' WHEN score >= 80 THEN 'Low Risk' WHEN score >= 60 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_level,
       'overlap_v2' AS rule_version
FROM j"""


@query("rules_batch_summary", SUMMARY)
def batch_summary(spark, sf_dir):
    return rules.batch_summary(pairs(spark, sf_dir))


SITE = "antibody_id, chain, motif, category, CAST(pos_start AS INT) AS pos_start, CAST(pos_end AS INT) AS pos_end, region, context"
COLUMNS = ("antibody_id", "chain", "motif", "category", "pos_start", "pos_end", "region", "context")
CATEGORIES = ("deamidation", "isomerization", "oxidation", "n_glyco", "o_glyco")
for _name, _where, _categories in (
    ("rules_sites_dipeptide", "category IN ('deamidation', 'isomerization')", CATEGORIES[:2]),
    ("rules_sites_oxidation", "category = 'oxidation'", CATEGORIES[2:3]),
    ("rules_sites_nglyco_v2", "category = 'n_glyco'", CATEGORIES[3:4]),
    ("rules_sites_oglyco", "category = 'o_glyco'", CATEGORIES[4:]),
    ("rules_site_context", "context <> ''", CATEGORIES[3:]),
    ("rules_region_lookup", "region <> 'FW'", CATEGORIES),
):
    query(_name, f"WITH {POSITIONS} SELECT {SITE} FROM sites WHERE {_where}")(lambda spark, sf_dir, where=_where, own=_categories: sites(spark, sf_dir, categories=own).filter(where).select(*COLUMNS))


@query(
    "rules_sites_nglyco_v1",
    f"""WITH RECURSIVE {CHAINS},
n AS (SELECT antibody_id, chain, seq, p FROM chains, LATERAL (SELECT unnest(generate_series(1, length(seq))) AS p) WHERE seq <> '' AND regexp_full_match(substr(seq, p, 3), 'N[^P][ST]')),
walk AS (
  SELECT antibody_id, chain, min(p) AS p FROM n GROUP BY antibody_id, chain
  UNION ALL
  SELECT antibody_id, chain, p FROM (SELECT w.antibody_id, w.chain, (SELECT min(n.p) FROM n WHERE n.antibody_id = w.antibody_id AND n.chain = w.chain AND n.p >= w.p + 3) AS p FROM walk w) q WHERE p IS NOT NULL)
SELECT antibody_id, chain, CAST(p AS INT) AS pos_start FROM walk""",
)
def nglyco_v1(spark, sf_dir):
    return sites(spark, sf_dir, "frozen_v1", categories=("n_glyco",)).filter("category = 'n_glyco'").select("antibody_id", "chain", "pos_start")


@query("rules_region_counts", f"WITH {POSITIONS} SELECT region, category, count(*) AS n FROM sites GROUP BY region, category")
def region_counts(spark, sf_dir):
    return sites(spark, sf_dir).groupBy("region", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "rules_report_summary",
    f"""WITH {POSITIONS} SELECT antibody_id, chain, 'CDR sites: ' || count(*) FILTER (region <> 'FW') || ' (CDR1:' || count(*) FILTER (region = 'CDR1') || ', CDR2:' || count(*) FILTER (region = 'CDR2') || ', CDR3:' || count(*) FILTER (region = 'CDR3') || ')' AS summary,
  string_agg('[' || category || '] ' || motif || ' at ' || pos_start || CASE WHEN pos_end > pos_start THEN '-' || pos_end ELSE '' END || ' ' || region, ';'
    ORDER BY CASE category WHEN 'deamidation' THEN 0 WHEN 'isomerization' THEN 1 WHEN 'oxidation' THEN 2 WHEN 'n_glyco' THEN 3 ELSE 4 END,
             CASE motif WHEN 'NG' THEN 0 WHEN 'DG' THEN 0 WHEN 'NS' THEN 1 WHEN 'DS' THEN 1 WHEN 'NN' THEN 2 WHEN 'DA' THEN 2 ELSE 0 END, pos_start) AS report
FROM sites GROUP BY antibody_id, chain""",
)
def report_summary(spark, sf_dir):
    return features.chain_report(sites(spark, sf_dir))


@query(
    "rules_score_breakdown",
    f"""WITH {POSITIONS}{scored('antibody_id, category, motif')}
SELECT antibody_id, round(sum(penalty), 4) AS total_penalty, round(coalesce(sum(penalty) FILTER (category IN ('n_glyco', 'o_glyco')), 0), 4) AS ptm_penalty,
       round(coalesce(sum(penalty) FILTER (category NOT IN ('n_glyco', 'o_glyco')), 0), 4) AS chemical_penalty,
       round(coalesce(sum(penalty) FILTER (region <> 'FW'), 0), 4) AS cdr_penalty, round(coalesce(sum(penalty) FILTER (region = 'FW'), 0), 4) AS framework_penalty
FROM scored GROUP BY antibody_id""",
)
def score_breakdown(spark, sf_dir):
    return features.score_breakdown(sites(spark, sf_dir), "antibody_id")


@query(
    "rules_score_per_chain",
    f"""WITH {POSITIONS}{scored('antibody_id, chain, category, motif')}
SELECT antibody_id, chain, round(sum(penalty), 4) AS penalty, round(greatest(0, 100 - sum(penalty)), 2) AS score FROM scored GROUP BY antibody_id, chain""",
)
def score_per_chain(spark, sf_dir):
    per = rules.penalties(sites(spark, sf_dir), "antibody_id", "chain").groupBy("antibody_id", "chain").agg(F.sum("penalty").alias("t"))
    return per.select("antibody_id", "chain", F.round("t", 4).alias("penalty"), rules.score_of(F.col("t")).alias("score"))


FACTORS = f"""WITH {POSITIONS} SELECT antibody_id, string_agg(chain || ' ' || motif || '@' || pos_start || CASE WHEN pos_end > pos_start THEN '-' || pos_end ELSE '' END || ' ' || category || ' (' || region || ')', '; '
  ORDER BY chain_order, pos_start, CASE category WHEN 'n_glyco' THEN 1 WHEN 'o_glyco' THEN 2 ELSE 0 END) AS factors FROM sites GROUP BY antibody_id"""


@query("rules_score_factors", FACTORS)
def score_factors(spark, sf_dir):
    return features.score_factors(sites(spark, sf_dir))


FEATURE_SQL = ", ".join(
    [f"count(*) FILTER (region = '{r}') AS {r}_count" for r in ("CDR1", "CDR2", "CDR3", "FW")]
    + [f"count(*) FILTER (category = '{c}') AS {c}_count" for c in CATEGORIES]
    + [f"count(*) FILTER (category = '{c}' AND region <> 'FW') AS {c}_cdr_count" for c in CATEGORIES]
)
COUNTS = [f"{r}_count" for r in ("CDR1", "CDR2", "CDR3", "FW")] + [f"{c}_count" for c in CATEGORIES] + [f"{c}_cdr_count" for c in CATEGORIES]
CHAIN_SQL = f"""WITH {POSITIONS}{scored('antibody_id, chain, category, motif')},
f AS (SELECT antibody_id, chain, sum(penalty) AS t, count(*) AS n, {FEATURE_SQL} FROM scored GROUP BY antibody_id, chain),
features AS (
  SELECT c.antibody_id, c.chain, CAST(length(c.seq) AS INT) AS seq_length, CASE WHEN c.seq <> '' THEN round(greatest(0, 100 - coalesce(t, 0)), 2) END AS score,
         CASE WHEN c.seq <> '' THEN round(100 - round(greatest(0, 100 - coalesce(t, 0)), 2), 2) END AS penalty, coalesce(n, 0) AS total_count, {", ".join(f"coalesce({c}, 0) AS {c}" for c in COUNTS)}
  FROM chains c LEFT JOIN f ON c.antibody_id = f.antibody_id AND c.chain = f.chain)"""


def chain_features(spark, sf_dir):
    return features.chain_features(rules.scan_sites(rules.chains(pairs(spark, sf_dir), "antibody_id"), "antibody_id", outer=True), "antibody_id")


query("features_chain", f"{CHAIN_SQL} SELECT * FROM features")(chain_features)


@query(
    "features_pair_combined",
    f"""{CHAIN_SQL} SELECT antibody_id, {", ".join(f"max({c}) FILTER (chain = '{x}') AS {x}_{c}" for x in ("VH", "VL") for c in ["score", "penalty", "total_count", *COUNTS])},
       {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}_combined" for c in ["total_count", *COUNTS])} FROM features GROUP BY antibody_id""",
)
def pair_features(spark, sf_dir):
    return features.pair_features(chain_features(spark, sf_dir), "antibody_id")


@query(
    "features_audit",
    f"""WITH {PAIRS}, g AS (SELECT VH, VL, count(*) AS n FROM pairs GROUP BY VH, VL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows, CAST(sum(n - 1) AS BIGINT) AS excess_rows,
       CAST(sum(n * (n - 1) // 2) AS BIGINT) AS duplicate_pairs FROM g""",
)
def audit(spark, sf_dir):
    return features.duplicate_audit(pairs(spark, sf_dir), "VH", "VL")


MUTATED = f"""{PAIRS.replace("pairs AS (", "pairs0 AS (")},
edit AS (SELECT antibody_id, VH, VL, substr(VH, 55, 1) AS old FROM pairs0),
applied AS (SELECT antibody_id, VH, VL, CASE WHEN length(VH) < 55 THEN 'position 55 is beyond length ' || length(VH) WHEN old <> 'N' THEN 'expected N at position 55, found ' || old END AS error,
  CASE WHEN old = 'N' THEN substr(VH, 1, 54) || 'Q' || substr(VH, 56) ELSE VH END AS mutated FROM edit)"""


@query("mutation_apply", f"WITH {MUTATED} SELECT antibody_id, mutated, error FROM applied")
def mutation_apply(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("antibody_id", mutations.apply_mutation(F.col("VH"), F.lit("N55Q")).alias("mutated"), mutations.mutation_error(F.col("VH"), F.lit("N55Q")).alias("error"))


_SITES_OF = POSITIONS.replace(PAIRS + ",", "")


def _mutation_ctes() -> str:
    """Sites of the baseline and the mutant as one pairs view, ids marked B or M, of rows that the edit applies to."""
    return f"""{MUTATED}, pairs AS (SELECT 'B' || antibody_id AS antibody_id, VH, VL FROM applied WHERE error IS NULL UNION ALL SELECT 'M' || antibody_id, mutated, VL FROM applied WHERE error IS NULL), {_SITES_OF.lstrip()}"""


@query(
    "mutation_compare_sets",
    f"""WITH {_mutation_ctes()},
b AS (SELECT substr(antibody_id, 2) AS id, chain, category, motif, pos_start FROM sites WHERE antibody_id[1] = 'B'),
m AS (SELECT substr(antibody_id, 2) AS id, chain, category, motif, pos_start FROM sites WHERE antibody_id[1] = 'M')
SELECT coalesce(b.id, m.id) AS antibody_id, coalesce(b.chain, m.chain) AS chain, coalesce(b.category, m.category) AS category, coalesce(b.motif, m.motif) AS motif, CAST(coalesce(b.pos_start, m.pos_start) AS INT) AS pos_start,
       CASE WHEN m.id IS NULL THEN 'removed' WHEN b.id IS NULL THEN 'added' ELSE 'unchanged' END AS change
FROM b FULL JOIN m ON b.id = m.id AND b.chain = m.chain AND b.category = m.category AND b.motif = m.motif AND b.pos_start = m.pos_start""",
)
def mutation_compare(spark, sf_dir):
    return mutations.compare_sites(pairs(spark, sf_dir), "N55Q")


@query(
    "mutation_score_delta",
    f"""WITH {_mutation_ctes()}{scored('antibody_id, category, motif')},
t AS (SELECT p.antibody_id, coalesce(sum(penalty), 0) AS t, count(penalty) AS n, count(penalty) FILTER (region <> 'FW') AS c FROM pairs p LEFT JOIN scored s ON p.antibody_id = s.antibody_id GROUP BY p.antibody_id)
SELECT substr(b.antibody_id, 2) AS antibody_id, round(greatest(0, 100 - b.t), 2) AS baseline_score, round(greatest(0, 100 - m.t), 2) AS mutant_score,
       round(round(greatest(0, 100 - m.t), 2) - round(greatest(0, 100 - b.t), 2), 2) AS score_delta, m.n - b.n AS site_delta, m.c - b.c AS cdr_site_delta
FROM t b JOIN t m ON b.antibody_id[1] = 'B' AND m.antibody_id[1] = 'M' AND substr(b.antibody_id, 2) = substr(m.antibody_id, 2)""",
)
def mutation_delta(spark, sf_dir):
    return mutations.score_delta(pairs(spark, sf_dir), "N55Q")


@query(
    "mutation_category_counts",
    f"""WITH {_mutation_ctes()} SELECT substr(antibody_id, 2) AS antibody_id, category, count(*) FILTER (antibody_id[1] = 'B') AS before, count(*) FILTER (antibody_id[1] = 'M') AS after FROM sites GROUP BY 1, 2""",
)
def mutation_counts(spark, sf_dir):
    return mutations.category_counts(pairs(spark, sf_dir), "N55Q")


INFER = """CASE WHEN length(seq) >= 80 AND greatest(h, l) >= 3 AND h <> l THEN CASE WHEN h > l THEN 'VH' ELSE 'VL' END ELSE 'UNKNOWN' END"""
VOTED = f"""WITH {CHAINS}, x AS (SELECT antibody_id, chain, 'DIQM' || seq AS seq FROM chains WHERE chain = 'VL' UNION ALL SELECT antibody_id, chain, 'EVQL' || seq FROM chains WHERE chain = 'VH' UNION ALL SELECT antibody_id, 'raw', seq FROM chains),
v AS (SELECT *, CASE WHEN regexp_matches(seq, '^(EVQL|QVQL|VQL|DVQL)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(seq, 'WGQG|CSRW') THEN 1 ELSE 0 END AS h,
  CASE WHEN regexp_matches(seq, '^(DIQM|DIVM|EIVL|QIVL)') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(seq, 'CQQ|FGG') THEN 1 ELSE 0 END AS l FROM x),
i AS (SELECT antibody_id, chain, {INFER} AS inferred FROM v)"""


def marked_chains(spark, sf_dir):
    c = rules.chains(pairs(spark, sf_dir), "antibody_id")
    lead = F.when(F.col("chain") == "VH", "EVQL").otherwise("DIQM")
    return c.select("antibody_id", "chain", F.concat(lead, "seq").alias("seq")).unionByName(c.select("antibody_id", F.lit("raw").alias("chain"), "seq"))


@query("infer_chain", f"{VOTED} SELECT antibody_id, chain, inferred, CASE WHEN inferred = 'UNKNOWN' THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM i")
def infer_chain(spark, sf_dir):
    return marked_chains(spark, sf_dir).select("antibody_id", "chain", sequences.infer_chain(F.col("seq")).alias("inferred"), sequences.chain_confidence(F.col("seq")).alias("confidence"))


@query(
    "infer_column_chain",
    f"""{VOTED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY CAST(antibody_id AS BIGINT)) AS rn FROM i WHERE chain <> 'raw') WHERE rn <= 100),
c AS (SELECT chain, count(*) FILTER (inferred = 'VH') AS vh_count, count(*) FILTER (inferred = 'VL') AS vl_count FROM f GROUP BY chain)
SELECT chain AS column_name, vh_count, vl_count, CASE WHEN vh_count + vl_count = 0 THEN 'UNKNOWN' WHEN greatest(vh_count, vl_count) / (vh_count + vl_count) >= 0.9 AND (vh_count + vl_count >= 3 OR least(vh_count, vl_count) = 0) THEN CASE WHEN vh_count >= vl_count THEN 'VH' ELSE 'VL' END ELSE 'AMBIGUOUS' END AS inferred FROM c""",
)
def infer_column(spark, sf_dir):
    rows = marked_chains(spark, sf_dir).filter("chain <> 'raw'")
    return features.infer_column(rows, "chain", F.col("antibody_id").cast("long"), F.col("seq"))


RAW = "SELECT doc_id, upper(trim(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g'))) AS s FROM documents"
LETTERS = "list_sort(list_distinct(string_split(regexp_replace(s, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g'), '')))"
VALIDATED = f"""WITH r AS ({RAW}), v AS (
  SELECT doc_id, s, CASE WHEN s = '' THEN 'sequence is empty' WHEN regexp_matches(s, '[^A-Za-z]') THEN 'sequence has non-letter characters'
    WHEN regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'sequence has non-standard residues: ' || array_to_string({LETTERS}, '') END AS error FROM r)"""


def raw_sequences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("s"))


@query("seq_validate", f"{VALIDATED} SELECT doc_id, error IS NULL AS ok, coalesce(error, '') AS error FROM v")
def seq_validate(spark, sf_dir):
    e = sequences.validation_error(F.col("s"))
    return raw_sequences(spark, sf_dir).select("doc_id", e.isNull().alias("ok"), F.coalesce(e, F.lit("")).alias("error"))


@query("seq_pair_status", f"WITH {PAIRS} SELECT antibody_id, CASE WHEN VH <> '' AND VL <> '' THEN 'VALID' WHEN VH <> '' OR VL <> '' THEN 'PARTIAL' ELSE 'INVALID' END AS status, concat_ws('; ', CASE WHEN VH = '' THEN 'VH sequence is empty' END, CASE WHEN VL = '' THEN 'VL sequence is empty' END) AS reasons FROM pairs")
def seq_pair_status(spark, sf_dir):
    return pairs(spark, sf_dir).select("antibody_id", sequences.pair_status(F.col("VH"), F.col("VL")).alias("status"), sequences.pair_reasons(F.col("VH"), F.col("VL")).alias("reasons"))


@query("seq_hash", f"WITH {PAIRS} SELECT antibody_id, sha256(VH || chr(10) || VL) AS sequence_hash FROM pairs")
def seq_hash(spark, sf_dir):
    return pairs(spark, sf_dir).select("antibody_id", sequences.paired_hash(F.col("VH"), F.col("VL")).alias("sequence_hash"))


@query(
    "seq_extended_normalize",
    """WITH r AS (SELECT doc_id, translate(regexp_replace(regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g'), '\\s+', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents)
SELECT doc_id, s AS normalized, CASE WHEN s = '' THEN 'EMPTY' WHEN regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWYUOBZXJ]') THEN 'INVALID' WHEN regexp_matches(s, '[^ACDEFGHIKLMNPQRSTVWY]') THEN 'AMBIGUOUS' ELSE 'STANDARD' END AS status FROM r""",
)
def seq_extended(spark, sf_dir):
    return raw_sequences(spark, sf_dir).select("doc_id", sequences.extended_normalize(F.col("s")).alias("normalized"), sequences.extended_status(F.col("s")).alias("status"))


@query(
    "longest_residue_token",
    """WITH t AS (SELECT doc_id, unnest(list_filter(string_split(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z \\n]', '', 'g')), ' '), lambda x: length(x) >= 5 AND regexp_full_match(x, '[ACDEFGHIKLMNPQRSTVWY]+'))) AS w FROM documents),
b AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, w) AS rn FROM t)
SELECT d.doc_id, coalesce(w, '') AS token, CASE WHEN w IS NULL THEN 'unavailable' ELSE 'user_provided' END AS provenance FROM documents d LEFT JOIN b ON d.doc_id = b.doc_id AND rn = 1""",
)
def longest_token(spark, sf_dir):
    return features.longest_residue_token(table(spark, sf_dir, "documents"))


FASTA = f"""WITH {PAIRS} SELECT upper(antibody_id) AS antibody_id, CASE WHEN CAST(antibody_id AS BIGINT) % 3 = 0 THEN '' ELSE VH END AS VH, VL, CASE WHEN CAST(antibody_id AS BIGINT) % 10 = 1 AND VL <> '' THEN 'duplicate VL' END AS error FROM pairs
WHERE (CAST(antibody_id AS BIGINT) % 3 <> 0 AND VH <> '') OR VL <> ''"""


@query("fasta_parse", FASTA)
def fasta_parse(spark, sf_dir):
    p = pairs(spark, sf_dir)
    n = F.col("antibody_id").cast("long")
    wrap = lambda c: F.concat(F.substring(c, 1, 60), F.lit("\n"), F.lower(F.substring(c, 61, 200)))
    heavy = F.when(n % 3 != 0, F.concat(F.lit(">"), "antibody_id", F.lit("_vh\n"), wrap("VH")))
    light = F.concat(F.lit(">"), "antibody_id", F.lit("|VL\n"), wrap("VL"))
    records = p.select(F.explode(F.array_compact(F.array(heavy, light, F.when(n % 10 == 1, light)))).alias("value"))
    return fasta.pivot_chains(fasta.parse_records(records))
