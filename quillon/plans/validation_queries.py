"""Validation: splits, gates, counts across splits, retained findings, manifests, entities, displays."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import evidence, identity, retrieval, validation
from quillon.plans.registry import Registry
from quillon.plans.science_queries import GRAPH, candidate_edges, identities
from quillon.plans.table_queries import KMERS
from quillon.plans.text_queries import BM25
from quillon.plans.views import product_pairs, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("split_stratified", "SELECT doc_id, quality, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('split' || doc_id)) - 1 < floor(count(*) OVER (PARTITION BY quality) * 0.2::DOUBLE + 0.5) THEN 'TEST' ELSE 'TRAIN' END AS split FROM labels")
def split_stratified(spark, sf):
    return validation.stratified_split(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality")


@query("residual_maxima")
def residual_maxima(spark, sf):
    u = product_pairs(spark, sf)
    train = F.substring("id", 1, 1) < "a"
    n = validation.nearest_in_train(u.filter(~train), u.filter(train))
    return n.withColumn("bin", evidence.novelty_bin(F.col("max_min")))


@query("cross_split_counts", "SELECT count(*) FILTER (vh >= 0.9) AS VH_ge_90, count(*) FILTER (vl >= 0.9) AS VL_ge_90, count(*) FILTER (vh >= 0.8) AS VH_ge_80, count(*) FILTER (vl >= 0.8) AS VL_ge_80 FROM (SELECT l_discount * 5 + 0.6 AS vh, l_tax * 4 + 0.7 AS vl FROM lineitem WHERE l_partkey % 3 <> l_suppkey % 3)")
def cross_split_counts(spark, sf):
    l = table(spark, sf, "lineitem").select((F.col("l_partkey") % 3).alias("a"), (F.col("l_suppkey") % 3).alias("b"), (F.col("l_discount") * 5 + 0.6).alias("VH"), (F.col("l_tax") * 4 + 0.7).alias("VL"))
    return validation.cross_split_counts(l, "a", "b", "VH", "VL")


@query("class_resamples")
def class_resamples(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("lang", F.floor(F.log2(F.col("n_chars") + 1) * 8).alias("score"), F.col("quality").alias("label"))
    return validation.class_resamples(d.filter("lang IS NOT NULL"), ["lang"], "score", "label")


@query("novelty_classes", "SELECT lang AS stratum, count(*) AS n, CASE WHEN count(*) >= 15 AND least(sum(toxic), count(*) - sum(toxic)) >= 5 THEN round(sum(toxic) / count(*), 6) END AS prevalence, CASE WHEN count(*) >= 15 AND least(sum(toxic), count(*) - sum(toxic)) >= 5 THEN 'OK' ELSE 'NOT_ESTIMABLE' END AS status FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def novelty_classes(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return validation.class_strata(d, F.col("lang"), F.col("toxic") == 1)


@query("sampled_pairs", "SELECT a.i AS \"left\", b.i AS \"right\" FROM (SELECT row_number() OVER () - 1 AS i FROM benchmark) a JOIN (SELECT row_number() OVER () - 1 AS i FROM benchmark) b ON a.i < b.i")
def sampled_pairs(spark, sf):
    return validation.sampled_pairs(spark, table(spark, sf, "benchmark").count(), most=20_000)


@query("oriented_predictors", "SELECT feature, round(sum(CASE WHEN feature = 'l_tax' THEN -v ELSE v END), 6) AS total FROM (UNPIVOT (SELECT l_quantity, l_tax FROM lineitem) ON l_quantity, l_tax INTO NAME feature VALUE v) GROUP BY feature")
def oriented_predictors(spark, sf):
    l = table(spark, sf, "lineitem").select("l_quantity", "l_tax").unpivot([], ["l_quantity", "l_tax"], "feature", "v")
    return l.groupBy("feature").agg(F.round(F.sum(validation.oriented(F.col("feature"), F.col("v"), ("l_tax",))), 6).alias("total"))


CONTINUOUS = "SELECT p_brand AS feature, p_type AS assay, round(avg(p_size) / 100, 6) AS rho, CASE WHEN count(*) > 2 THEN round(min(p_size) / 50.0, 6) END AS q, count(*) AS n FROM part GROUP BY 1, 2"


@query("retained_findings", f"SELECT 'continuous' AS kind, feature, assay, 'rho' AS metric, rho AS value, q, n FROM ({CONTINUOUS}) WHERE q >= 0.1 OR q IS NULL UNION ALL SELECT 'classification', p_brand, 'composite', 'roc_auc', round(avg(p_size) / 50, 6), NULL, count(*) FROM part GROUP BY p_brand")
def retained_findings(spark, sf):
    p = table(spark, sf, "part")
    n = F.count(F.lit(1))
    a = p.groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("assay")).agg(F.round(F.avg("p_size") / 100, 6).alias("rho"), F.when(n > 2, F.round(F.min("p_size") / F.lit(50.0), 6)).alias("q"), n.alias("n"))
    b = p.groupBy(F.col("p_brand").alias("feature")).agg(F.round(F.avg("p_size") / 50, 6).alias("roc_auc"), n.alias("n"))
    return validation.retained_findings(a, b)


@query("source_notes", "SELECT source, contains(lower(regexp_replace(text, '\\s+', ' ', 'g')), 'licensed under') AS excluded, count(*) AS n FROM documents GROUP BY 1, 2")
def source_notes(spark, sf):
    kept, notes = validation.excluded_notes(table(spark, sf, "documents"), "text", "licensed under")
    return kept.select("source", F.lit(False).alias("excluded")).unionByName(notes.select("source", F.lit(True).alias("excluded"))).groupBy("source", "excluded").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_summary", "SELECT count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_members, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, quantile_cont(n, 0.5) AS median FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def cluster_summary(spark, sf):
    return validation.cluster_summary(table(spark, sf, "orders"), "o_custkey")


@query("manifest_issues", "SELECT 'f' || item_id AS path, CASE item_id % 4 WHEN 1 THEN 'SHA256' WHEN 2 THEN 'SIZE' ELSE 'MISSING' END AS issue FROM benchmark WHERE item_id % 4 <> 0")
def manifest_issues(spark, sf):
    b, k = table(spark, sf, "benchmark"), F.col("item_id")
    path = F.concat(F.lit("f"), k.cast("string"))
    manifest = b.select(path.alias("path"), F.when(k % 4 == 1, "x").otherwise(F.sha2("text", 256)).alias("sha256"), (F.octet_length("text") + F.when(k % 4 == 2, 1).otherwise(0)).cast("long").alias("size"))
    return validation.manifest_issues(b.filter("item_id % 4 <> 3").select(path.alias("path"), F.encode("text", "UTF-8").alias("content")), manifest)


@query("annotation_counts", "SELECT 'PRIORITY' AS field, trim(o_orderpriority) AS value, count(*) AS n FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 2 UNION ALL SELECT 'STATUS', o_orderstatus, count(*) FROM orders GROUP BY 2")
def annotation_counts(spark, sf):
    return validation.annotation_counts(table(spark, sf, "orders"), ("PRIORITY", "STATUS", "IGHV"))


KINDS = "SELECT kind, k, CASE WHEN doc_id % 10 < 6 THEN 'TRAIN' WHEN doc_id % 10 < 8 THEN 'VALIDATION' ELSE 'TEST' END AS split FROM (SELECT doc_id, 'hash' AS kind, sha256(text) AS k FROM documents UNION ALL SELECT doc_id, 'length', CAST(n_chars AS VARCHAR) FROM documents UNION ALL SELECT doc_id, 'id', CAST(doc_id AS VARCHAR) FROM documents)"


@query("leakage_kinds", f"WITH s AS (SELECT DISTINCT kind, k, split FROM ({KINDS}) WHERE k IS NOT NULL) SELECT a.kind AS kind, a.split AS split_a, b.split AS split_b, count(*) AS n_shared FROM s a JOIN s b ON a.kind = b.kind AND a.k = b.k AND a.split < b.split GROUP BY 1, 2, 3")
def leakage_kinds(spark, sf):
    split = F.when(F.col("doc_id") % 10 < 6, "TRAIN").when(F.col("doc_id") % 10 < 8, "VALIDATION").otherwise("TEST")
    d = table(spark, sf, "documents").select(split.alias("split"), F.sha2("text", 256).alias("h"), "n_chars", "doc_id")
    return validation.leakage_kinds(d, {"hash": "h", "length": "n_chars", "id": "doc_id"}, "split")


@query("policy_equality", "SELECT 0::BIGINT AS only_left, 0::BIGINT AS only_right, true AS equal")
def policy_equality(spark, sf):
    i = identities(spark, sf)[1]
    pair = lambda policy: identity.policy_edges(i, policy, 0.8).select("left_id", "right_id")
    return validation.set_difference(pair("PAIRED_AND"), pair("PAIRED_MIN"))


@query("set_difference", "SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)) AS only_left, (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT ALL SELECT o_custkey FROM orders)) AS only_right, false AS equal")
def set_difference(spark, sf):
    return validation.set_difference(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), table(spark, sf, "customer").select(F.col("c_custkey").alias("k")))


@query("join_one_to_one", "WITH j AS (SELECT d.doc_id AS a, l.doc_id AS b FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, 0::BIGINT AS repeated, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS ok FROM j")
def join_one_to_one(spark, sf):
    return validation.one_to_one(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("join_hash_split", "SELECT d.doc_id, s.split FROM documents d LEFT JOIN (SELECT sha256(coalesce(text, '')) AS h, CASE WHEN min(doc_id) % 5 = 0 THEN 'TEST' ELSE 'TRAIN' END AS split FROM documents GROUP BY 1) s ON sha256(coalesce(d.text, '')) = s.h")
def join_hash_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    splits = d.groupBy("h").agg(F.when(F.min("doc_id") % 5 == 0, "TEST").otherwise("TRAIN").alias("split"))
    return d.join(splits, "h", "left").select("doc_id", "split")


@query("population_report", "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS duplicate_pairs, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT text, count(*) AS n FROM documents GROUP BY 1)")
def population_report(spark, sf):
    g = table(spark, sf, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256)).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"), F.sum(F.expr("n * (n - 1) div 2")).alias("duplicate_pairs"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"))


@query("eligible_labels", "SELECT quality, toxic, count(*) AS n FROM labels WHERE quality IN (0, 1) GROUP BY 1, 2")
def eligible_labels(spark, sf):
    return table(spark, sf, "labels").filter(F.col("quality").isin(0, 1)).groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("components_frequency", f"{GRAPH} SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM comp GROUP BY 1) GROUP BY size")
def components_frequency(spark, sf):
    u, c = candidate_edges(spark, sf)
    sizes = identity.components(u, "id", c, "left_id", "right_id").groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))


@query("degree_top", f"{KMERS}, e AS (SELECT left_id AS a, right_id AS b FROM cand UNION ALL SELECT right_id, left_id FROM cand) SELECT * FROM (SELECT a AS node, count(DISTINCT b) AS degree FROM e GROUP BY a ORDER BY degree DESC, node LIMIT 20)")
def degree_top(spark, sf):
    return identity.degrees(candidate_edges(spark, sf)[1], "left_id", "right_id").orderBy(F.desc("degree"), "node").limit(20)


@query("display_rows", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25")
def display_rows(spark, sf):
    return validation.shown(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 25)


@query("metric_ranking", "SELECT p_brand, CAST(row_number() OVER (ORDER BY m IS NULL, m DESC, p_brand) AS INT) AS place FROM (SELECT p_brand, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE round(avg(p_size), 1) END AS m FROM part GROUP BY 1)")
def metric_ranking(spark, sf):
    m = table(spark, sf, "part").groupBy("p_brand").agg(F.when(F.count(F.lit(1)) % 5 == 0, F.lit(float("nan"))).otherwise(F.round(F.avg("p_size"), 1)).alias("m"))
    return validation.ranked_metrics(m, "m", "p_brand").select("p_brand", "place")


@query("bm25_topk_whole", f"""WITH {BM25}, m AS (SELECT item_id, max(rank) AS n FROM br GROUP BY 1), z AS (SELECT b.item_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS k FROM benchmark b CROSS JOIN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 900) d LEFT JOIN br ON br.item_id = b.item_id AND br.doc_id = d.doc_id WHERE br.doc_id IS NULL)
SELECT item_id, doc_id, round(round(score, 8), 4) AS score, CAST(rank AS INT) AS rank FROM br WHERE rank <= 300 UNION ALL SELECT z.item_id, z.doc_id, 0.0, CAST(coalesce(m.n, 0) + z.k AS INT) FROM z LEFT JOIN m ON m.item_id = z.item_id WHERE coalesce(m.n, 0) + z.k <= least(300, (SELECT count(*) FROM documents))""")
def bm25_whole(spark, sf):
    d = table(spark, sf, "documents")
    top = retrieval.bm25_top_k(d, "doc_id", "text", table(spark, sf, "benchmark"), "item_id", "text", 300)
    return top.select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query("rag_search", f"WITH {BM25} SELECT item_id AS query_id, doc_id AS id, round(round(score, 8), 4) AS score, CAST(rank AS INT) AS rank FROM br WHERE rank <= 5")
def rag_search(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.search(table(spark, sf, "documents").select("doc_id", "text"), q, 5, "keyword").withColumn("score", F.round("score", 4))


SPEC = {"region": ("r_regionkey", {}), "nation": ("n_nationkey", {"n_regionkey": "region"}), "customer": ("c_custkey", {"c_nationkey": "nation"}), "orders": ("o_orderkey", {"o_custkey": "customer"})}


@query("entity_issues", "SELECT 'orders' AS entity, CAST(o_orderkey AS VARCHAR) AS id, 'o_custkey' AS field, 'MISSING_REFERENCE' AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0) UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), 'r_regionkey', 'DUPLICATE_KEY' FROM region WHERE r_regionkey = 1")
def entity_issues(spark, sf):
    own = {n: table(spark, sf, n) for n in SPEC}
    own["customer"] = own["customer"].filter("c_custkey % 9 <> 0")
    own["region"] = own["region"].unionByName(own["region"].filter("r_regionkey = 1"))
    return validation.entity_issues(own, SPEC)


VARIANTS = "SELECT c_custkey AS variant_id, c_nationkey AS target_id, CASE WHEN c_custkey % 50 = 7 THEN c_custkey + 1 WHEN c_custkey % 50 = 8 THEN c_custkey - 1 WHEN c_custkey % 11 = 0 THEN -5 WHEN c_custkey < 10 THEN NULL ELSE c_custkey // 2 END AS parent_variant_id, c_custkey % 3 = 0 AS old FROM customer"


@query("variant_issues", f"""WITH RECURSIVE v AS ({VARIANTS}), b AS (SELECT * FROM v WHERE NOT old OR variant_id % 30 = 0), walk AS (SELECT variant_id AS start, parent_variant_id AS p, 1 AS n FROM v UNION ALL SELECT w.start, v.parent_variant_id, n + 1 FROM walk w JOIN v ON v.variant_id = w.p WHERE n < 64)
SELECT variant_id, 'EXISTING_ID' AS code FROM b WHERE old UNION ALL SELECT variant_id, 'MISSING_REFERENCE' FROM b WHERE parent_variant_id IS NOT NULL AND parent_variant_id NOT IN (SELECT variant_id FROM v)
UNION ALL SELECT b.variant_id, 'CROSS_TARGET' FROM b JOIN v ON v.variant_id = b.parent_variant_id WHERE v.target_id <> b.target_id UNION ALL SELECT variant_id, 'PARENT_CYCLE' FROM b WHERE variant_id IN (SELECT start FROM walk WHERE n = 64)""")
def variant_issues(spark, sf):
    v = table(spark, sf, "customer").selectExpr(
        "c_custkey AS variant_id", "c_nationkey AS target_id", "CASE WHEN c_custkey % 50 = 7 THEN c_custkey + 1 WHEN c_custkey % 50 = 8 THEN c_custkey - 1 WHEN c_custkey % 11 = 0 THEN -5 WHEN c_custkey < 10 THEN NULL ELSE c_custkey div 2 END AS parent_variant_id"
    )
    return validation.variant_issues(v.filter("variant_id % 3 <> 0 OR variant_id % 30 = 0"), v.filter("variant_id % 3 = 0"))


@query("control_issues", """WITH v AS (SELECT p_partkey AS variant_id, p_size % 3 AS target_id, p_size % 4 = 0 AS wt FROM part),
b AS (SELECT s_suppkey AS batch_id, s_suppkey AS sample_id FROM supplier WHERE s_suppkey IN (SELECT variant_id FROM v))
SELECT 'B' || batch_id AS id, 'NOT_WT_CONTROL' AS code FROM b JOIN v ON v.variant_id = b.sample_id WHERE NOT wt
UNION ALL SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey, 'CROSS_TARGET_BATCH' FROM lineitem JOIN v m ON m.variant_id = l_partkey JOIN b ON b.batch_id = l_suppkey JOIN v c ON c.variant_id = b.sample_id WHERE m.target_id <> c.target_id""")
def control_issues(spark, sf):
    p = table(spark, sf, "part")
    variants = p.select(F.col("p_partkey").alias("variant_id"), (F.col("p_size") % 3).alias("target_id"), F.when(F.col("p_size") % 4 == 0, "WT").otherwise("MUTANT").alias("variant_role"))
    samples = p.select(F.col("p_partkey").alias("sample_id"), F.col("p_partkey").alias("variant_id"))
    batch = F.concat(F.lit("B"), F.col("s_suppkey").cast("string"))
    batches = table(spark, sf, "supplier").select(batch.alias("batch_id"), F.col("s_suppkey").alias("wt_control_sample_id"))
    l = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("result_id"), F.col("l_partkey").alias("sample_id"), F.concat(F.lit("B"), F.col("l_suppkey").cast("string")).alias("batch_id"))
    return validation.control_issues(batches, samples, variants, l)
