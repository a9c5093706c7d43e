"""Evidence, summaries, claim checks, contracts and similarity audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import evidence, identity, retrieval
from quillon.plans.registry import Registry
from quillon.plans.rule_queries import sites
from quillon.plans.science_queries import identities
from quillon.plans.views import POSITIONS, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

RECORD = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'T' || doc_id END AS title, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS abstract, CASE WHEN doc_id % 2 = 0 THEN CAST(1000000 + doc_id AS VARCHAR) ELSE '' END AS pmid, CASE WHEN doc_id % 7 = 0 THEN 'PMC' || doc_id ELSE '' END AS pmcid, CASE WHEN doc_id % 11 = 0 THEN 'N' ELSE 'Y' END AS oa FROM documents"""


@query("lit_parse_records", f"SELECT doc_id, coalesce(nullif(pmid, ''), nullif(pmcid, ''), CAST(doc_id AS VARCHAR)) AS citation_key, title <> '' AND (abstract <> '' OR pmid <> '') AS valid, oa = 'Y' AND pmcid <> '' AS full_text FROM ({RECORD})")
def parse_records(spark, sf):
    d, i = table(spark, sf, "documents"), F.col("doc_id")
    text = i.cast("string")
    record = F.struct(
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("T"), text)).alias("title"), F.when(i % 3 == 0, "").otherwise(F.col("lang")).alias("abstractText"), F.when(i % 2 == 0, (1000000 + i).cast("string")).otherwise("").alias("pmid"),
        F.when(i % 7 == 0, F.concat(F.lit("PMC"), text)).otherwise("").alias("pmcid"), F.lit("").alias("doi"), F.when(i % 11 == 0, "N").otherwise("Y").alias("isOpenAccess"), F.lit("Y").alias("inPMC"),
    )
    return evidence.parse_evidence(d.select("doc_id", F.to_json(record).alias("json")), "doc_id", "json")


@query("lit_cache_key", "SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) || '|' || role || '|' || turn AS cache_key FROM conversations")
def cache_key(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", evidence.cache_key(F.col("text"), F.col("role"), F.col("turn")).alias("cache_key"))


ORD = "CASE category WHEN 'n_glyco' THEN 7 WHEN 'o_glyco' THEN 8 WHEN 'oxidation' THEN 6 ELSE CASE motif WHEN 'NG' THEN 0 WHEN 'NS' THEN 1 WHEN 'NN' THEN 2 WHEN 'DG' THEN 3 WHEN 'DS' THEN 4 ELSE 5 END END"
SHOWN = f"""{POSITIONS}, o AS (SELECT *, row_number() OVER (PARTITION BY antibody_id ORDER BY chain_order, {ORD}, pos_start) AS rn FROM sites),
shown AS (SELECT antibody_id, count(*) AS n_sites, array_to_string(list_sort(list_distinct(list(category))), ';') AS categories, string_agg(chain || ':' || motif || '@' || pos_start, ';' ORDER BY rn) FILTER (rn <= 10) AS first_sites FROM o GROUP BY antibody_id)"""


@query("summary_fingerprint", f"WITH {SHOWN} SELECT *, sha256(n_sites || '|' || categories || '|' || first_sites) AS fingerprint FROM shown")
def summary_fingerprint(spark, sf):
    return evidence.site_summary(sites(spark, sf), "antibody_id")


@query("summary_stale", f"WITH {SHOWN}, f AS (SELECT *, sha256(n_sites || '|' || categories || '|' || first_sites) AS fingerprint FROM shown) SELECT antibody_id, CASE CAST(antibody_id AS BIGINT) % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'stale' ELSE 'fresh' END AS state FROM f")
def summary_stale(spark, sf):
    s = evidence.site_summary(sites(spark, sf), "antibody_id")
    n = F.col("antibody_id").cast("long") % 3
    stored = s.filter(n != 0).select("antibody_id", F.when(n == 1, "old").otherwise(F.col("fingerprint")).alias("fingerprint"))
    return evidence.stale(s, stored, "antibody_id")


@query("guard_numeric_claims", "SELECT o_orderkey, (o_orderkey % 3 = 0 OR abs(CAST(claim AS DOUBLE) - fact) <= 1e-6 OR abs(CAST(claim AS DOUBLE) - floor(fact * 10 + 0.5) / 10) <= 1e-9) AS ok FROM (SELECT o_orderkey, o_totalprice AS fact, CASE o_orderkey % 3 WHEN 0 THEN CAST(CAST(floor(o_totalprice + 0.5) AS BIGINT) AS VARCHAR) WHEN 1 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || '.5' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) + 7 AS VARCHAR) || '.0' END AS claim FROM orders)")
def numeric_claims(spark, sf):
    n, x = F.col("o_orderkey") % 3, F.col("o_totalprice")
    whole = lambda c: c.cast("long").cast("string")
    claim = F.when(n == 0, whole(F.floor(x + 0.5))).when(n == 1, F.concat(whole(F.floor(x)), F.lit(".5"))).otherwise(F.concat(whole(F.floor(x) + 7), F.lit(".0")))
    return table(spark, sf, "orders").select("o_orderkey", evidence.numeric_claim_ok(claim, x).alias("ok"))


FORBIDDEN = {"safety": "(safe|harmless)", "proof": "(proven|guarantee)", "clinical": "(patients|clinical)"}
CLAUSES = "CASE turn % 4 WHEN 0 THEN 'This is proven. It is not safe' WHEN 1 THEN 'Not only safe; for patients' WHEN 2 THEN 'never proven' ELSE 'a guarantee and a safe one' END"


@query("guard_clauses", f"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'proof' WHEN 1 THEN 'safety;clinical' WHEN 2 THEN '' ELSE 'safety' END AS violations FROM (SELECT conv_id, turn, {CLAUSES} AS text FROM conversations)")
def clauses(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.expr(CLAUSES).alias("text")).select("conv_id", "turn", evidence.clause_violations(F.col("text"), FORBIDDEN).alias("violations"))


@query("guard_length_claims", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars + 1 AS VARCHAR) ELSE '' END AS wrong FROM documents")
def length_claims(spark, sf):
    d = table(spark, sf, "documents")
    said = F.concat(F.lit("It has "), (F.col("n_chars") + F.when(F.col("doc_id") % 2 == 0, 1).otherwise(0)).cast("string"), F.lit(" residues."))
    return d.select("doc_id", evidence.length_claims(said, F.col("n_chars")).alias("wrong"))


@query("novelty_metrics", "SELECT CASE WHEN l_discount >= 0.08 THEN 'high' WHEN l_discount >= 0.04 THEN 'middle' ELSE 'low' END AS stratum, count(*) AS n, round(avg(abs(l_quantity * 1500 - l_extendedprice)), 6) AS mae, 'OK' AS status FROM lineitem GROUP BY 1")
def novelty_metrics(spark, sf):
    s = F.when(F.col("l_discount") >= 0.08, "high").when(F.col("l_discount") >= 0.04, "middle").otherwise("low")
    return evidence.stratified_metrics(table(spark, sf, "lineitem"), s, F.col("l_quantity") * 1500, F.col("l_extendedprice"))


@query("metric_deltas", "WITH m AS (SELECT o_orderstatus AS block, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS v, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS t FROM orders GROUP BY 1) SELECT block, round(t - v, 4) AS test_minus_validation, round(t - (SELECT t FROM m WHERE block = 'F'), 4) AS versus_baseline FROM m")
def metric_deltas(spark, sf):
    half = lambda k: F.avg(F.when(F.col("o_orderkey") % 2 == k, F.col("o_totalprice")))
    m = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("block")).agg(half(0).alias("v"), half(1).alias("t"))
    base = m.filter("block = 'F'").select(F.col("t").alias("b"))  # one row
    return m.crossJoin(F.broadcast(base)).select("block", F.round(F.col("t") - F.col("v"), 4).alias("test_minus_validation"), F.round(F.col("t") - F.col("b"), 4).alias("versus_baseline"))


@query("import_idempotence", "SELECT s_suppkey, s_name FROM supplier WHERE (s_nationkey, s_name) NOT IN (SELECT s_nationkey, s_name FROM supplier WHERE s_suppkey % 3 = 0)")
def idempotence(spark, sf):
    s = table(spark, sf, "supplier")
    return evidence.new_imports(s, s.filter("s_suppkey % 3 = 0"), ["s_nationkey", "s_name"]).select("s_suppkey", "s_name")


@query("split_flags", "WITH d AS (SELECT CASE WHEN doc_id % 10 < 6 THEN 'TRAIN' WHEN doc_id % 10 < 8 THEN 'VALIDATION' ELSE 'TEST' END AS split, toxic FROM labels), s AS (SELECT split, count(*) AS n, round(avg(toxic), 6) AS prevalence, sum(toxic) AS p FROM d GROUP BY 1) SELECT split, n, prevalence, concat_ws(';', CASE WHEN abs(prevalence - 0.12) > 0.05 THEN 'PREVALENCE_SHIFT' END, CASE WHEN least(p, n - p) < 10 THEN 'SMALL_CLASS' END, CASE WHEN n < 40 THEN 'SMALL_SPLIT' END) AS flags FROM s")
def split_flags(spark, sf):
    s = F.when(F.col("doc_id") % 10 < 6, "TRAIN").when(F.col("doc_id") % 10 < 8, "VALIDATION").otherwise("TEST")
    return evidence.split_flags(table(spark, sf, "labels").withColumn("split", s), "split", "toxic", 0.12)


@query("embedding_index", "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row_index, len(embedding) AS dim FROM embeddings")
def embedding_index(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("row_index"), F.size("embedding").cast("long").alias("dim"))


@query("prompt_template", "SELECT item_id, 'Question: ' || text || chr(10) || 'Context: ' || length(text) || ' characters' AS prompt FROM benchmark")
def prompt(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.format_string("Question: %s\nContext: %d characters", "text", F.length("text")).alias("prompt"))


@query("condition_completeness", "SELECT o_custkey, count(DISTINCT (o_orderstatus, o_orderpriority)) AS n_conditions, count(*) FILTER (o_orderpriority IS NULL OR o_orderstatus IS NULL) AS incomplete, count(DISTINCT (o_orderstatus, o_orderpriority)) = 1 AS pure FROM orders GROUP BY 1")
def conditions(spark, sf):
    n = F.countDistinct(F.struct("o_orderstatus", "o_orderpriority"))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(n.alias("n_conditions"), F.count(F.when(F.col("o_orderpriority").isNull() | F.col("o_orderstatus").isNull(), 1)).alias("incomplete"), (n == 1).alias("pure"))


@query("policy_edges")
def policy_edges(spark, sf):
    i = identities(spark, sf)[1]
    out = None
    for policy in ("SINGLE_CHAIN_OR", "PAIRED_AND", "PAIRED_MIN"):
        for t in (0.8, 0.9):
            e = identity.policy_edges(i, policy, t).select("left_id", "right_id", F.lit(policy).alias("policy"), F.lit(t).alias("threshold"), identity.edge_category(F.col("VH_identity"), F.col("VL_identity"), t).alias("category"))
            out = e if out is None else out.unionByName(e)
    return out


@query("identity_bridges")
def identity_bridges(spark, sf):
    i = identities(spark, sf)[1]
    e = identity.policy_edges(i, "SINGLE_CHAIN_OR", 0.8).withColumn("category", identity.edge_category(F.col("VH_identity"), F.col("VL_identity"), 0.8))
    return evidence.bridges(e, "left_id", "right_id", "category", "VH_ONLY", "VL_ONLY").orderBy("left", "middle", "right").limit(20)


@query("residual_similarity")
def residual(spark, sf):
    u, i = identities(spark, sf)
    both = i.select(F.col("left_id").alias("id"), F.col("right_id").alias("other"), "paired_identity").unionByName(i.select(F.col("right_id").alias("id"), F.col("left_id").alias("other"), "paired_identity"))
    train = F.substring("other", 1, 1) < "a"
    top = both.filter(train).groupBy("id").agg(F.max("paired_identity").alias("nearest"))
    test = u.select("id").filter(F.substring("id", 1, 1) >= "a")
    return test.join(top, "id", "left").select("id", "nearest", evidence.novelty_bin(F.col("nearest")).alias("bin"))


@query("hash_vectors")
def hash_vectors(spark, sf):
    v = table(spark, sf, "benchmark").select("item_id", evidence.hashed_vector(F.col("text")).alias("v"))
    return retrieval.cosine_top_k(v, "item_id", "v", v, "item_id", "v", 2)
