"""Joins, aggregates, windows, sets and store rules over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.operators import aggregates, joins, store
from quillon.plans.registry import Registry
from quillon.plans.views import PAIRS, PRODUCTS, pairs, product_pairs, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query("join_outer_audit", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.n_chars, l.quality, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'both' WHEN d.doc_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge FROM documents d FULL JOIN (SELECT doc_id, quality FROM labels WHERE toxic = 0 UNION ALL SELECT -1 - doc_id, quality FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id")
def outer_audit(spark, sf):
    l = table(spark, sf, "labels")
    l = l.select(F.when(F.col("toxic") == 1, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), "quality")
    return joins.outer_with_indicator(table(spark, sf, "documents").select("doc_id", "n_chars"), l, "doc_id")


@query(
    "join_chain_coalesce",
    """WITH a AS (SELECT lower(trim(c_name)) AS k, c_mktsegment AS segment, '' AS note FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT lower(trim(upper(c_name))) AS k, CASE WHEN c_acctbal > 0 THEN 'POSITIVE' END AS segment, CASE WHEN c_acctbal > 0 THEN 'b' ELSE ' ' END AS note FROM customer WHERE c_custkey % 3 = 0),
c AS (SELECT lower(trim(c_name)) AS k, 'c' AS note FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(a.k, b.k, c.k) AS name, coalesce(nullif(trim(a.segment), ''), nullif(trim(b.segment), '')) AS segment, coalesce(nullif(trim(a.note), ''), nullif(trim(b.note), ''), nullif(trim(c.note), '')) AS note
FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k""",
)
def chain_coalesce(spark, sf):
    c = table(spark, sf, "customer")
    positive = F.col("c_acctbal") > 0
    a = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("").alias("note"))
    b = c.filter("c_custkey % 3 = 0").select(F.upper("c_name").alias("name"), F.when(positive, "POSITIVE").alias("segment"), F.when(positive, "b").otherwise(" ").alias("note"))
    d = c.filter("c_custkey % 5 = 0").select(F.col("c_name").alias("name"), F.lit("c").alias("note"))
    return joins.coalesce_chain([a, b, d], "name", ["segment", "note"])


@query("join_left_check", "SELECT count(*) AS n_rows, count(*) FILTER (l.doc_id IS NULL) AS unmatched, count(*) FILTER (l.q <> (d.n_chars > 1000)) AS mismatched, CAST(sum(coalesce(l.quality, -1)) AS BIGINT) AS filled FROM documents d LEFT JOIN (SELECT doc_id, quality, quality = 1 AS q FROM labels) l ON d.doc_id = l.doc_id")
def left_check(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", "quality", (F.col("quality") == 1).alias("q"), F.lit(1).alias("m"))
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(l, "doc_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("m").isNull(), 1)).alias("unmatched"), F.count(F.when(F.col("q") != (F.col("n_chars") > 1000), 1)).alias("mismatched"), F.sum(F.coalesce("quality", F.lit(-1))).cast("long").alias("filled"))


@query("join_left_many_to_one", "SELECT n_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment")
def many_to_one(spark, sf):
    j = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("join_semi", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def semi(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'")
    return table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("join_anti", "SELECT 'document without label' AS gap, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'label without document', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def anti(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return d.join(l, "doc_id", "left_anti").select(F.lit("document without label").alias("gap"), "doc_id").unionByName(l.join(d, "doc_id", "left_anti").select(F.lit("label without document").alias("gap"), "doc_id"))


@query(
    "join_integrity",
    """WITH a AS (SELECT l_orderkey AS k1, l_linenumber AS k2, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS k1, l_linenumber AS k2, min(l_quantity) AS q FROM lineitem WHERE l_discount > 0.02 GROUP BY 1, 2)
SELECT count(*) FILTER (a.k1 IS NOT NULL AND b.k1 IS NOT NULL) AS matched, count(*) FILTER (b.k1 IS NULL) AS left_only, count(*) FILTER (a.k1 IS NULL) AS right_only, count(*) FILTER (a.k1 IS NOT NULL AND b.k1 IS NOT NULL AND a.q IS DISTINCT FROM b.q) AS mismatched
FROM a FULL JOIN b ON a.k1 = b.k1 AND a.k2 = b.k2""",
)
def join_integrity(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k1"), F.col("l_linenumber").alias("k2"), "l_quantity", "l_discount")
    return joins.integrity(l.groupBy("k1", "k2").agg(F.max("l_quantity").alias("q")), l.filter("l_discount > 0.02").groupBy("k1", "k2").agg(F.min("l_quantity").alias("q")), ["k1", "k2"], "q")


KMERS = f"""WITH {PRODUCTS},
k AS (SELECT id, 'VH' AS c, list_distinct(list_transform(generate_series(1, length(VH) - 4), lambda p: substr(VH, p, 5))) AS g FROM u WHERE length(VH) >= 5 UNION ALL SELECT id, 'VL', list_distinct(list_transform(generate_series(1, length(VL) - 4), lambda p: substr(VL, p, 5))) FROM u WHERE length(VL) >= 5),
f AS (SELECT id, c, unnest(g) AS m, len(g) AS n FROM k),
s AS (SELECT a.id AS l, b.id AS r, a.c AS c, count(*) AS shared, any_value(a.n) AS n FROM f a JOIN f b ON a.c = b.c AND a.m = b.m AND a.id < b.id GROUP BY 1, 2, 3),
ok AS (SELECT * FROM s WHERE shared >= CASE WHEN n < 20 THEN 1 ELSE greatest(2, least(12, n // 10)) END),
cand AS (SELECT h.l AS left_id, h.r AS right_id, h.shared AS shared_VH, v.shared AS shared_VL FROM ok h JOIN ok v ON h.c = 'VH' AND v.c = 'VL' AND h.l = v.l AND h.r = v.r)"""


@query("join_kmer_candidates", f"{KMERS} SELECT * FROM cand")
def kmer_candidates(spark, sf):
    return joins.kmer_candidates(product_pairs(spark, sf), "id", ["VH", "VL"])


G3 = "list_distinct(list_transform(generate_series(1, length({0}) - 2), lambda p: substr({0}, p, 3)))"
FILTERED = " AND ".join(f"least(length(a.{c}), length(b.{c})) / greatest(length(a.{c}), length(b.{c})) >= 0.8 AND len(list_intersect({G3.format('a.' + c)}, {G3.format('b.' + c)})) / greatest(least(len({G3.format('a.' + c)}), len({G3.format('b.' + c)})), 1) >= 0.15" for c in ("VH", "VL"))


@query("join_prefiltered_pairs", f"{KMERS} SELECT left_id, right_id FROM cand JOIN u a ON a.id = left_id JOIN u b ON b.id = right_id WHERE {FILTERED}")
def prefiltered(spark, sf):
    u = product_pairs(spark, sf)
    c = joins.kmer_candidates(u, "id", ["VH", "VL"]).select("left_id", "right_id")
    j = c.join(u.select(F.col("id").alias("left_id"), F.col("VH").alias("ah"), F.col("VL").alias("al")), "left_id").join(u.select(F.col("id").alias("right_id"), F.col("VH").alias("bh"), F.col("VL").alias("bl")), "right_id")
    for a, b in (("ah", "bh"), ("al", "bl")):
        j = joins.length_overlap_filter(j, F.col(a), F.col(b), 0.8)
    return j.select("left_id", "right_id")


@query(
    "fk_issues",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, 'MISSING_CUSTOMER' AS code FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'MISSING_NATION' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'MISSING_REGION' FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)""",
)
def fk_issues(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    a = joins.foreign_key_issues(table(spark, sf, "orders"), "o_orderkey", "o_custkey", c.filter("c_acctbal >= 0"), "c_custkey", "MISSING_CUSTOMER")
    b = joins.foreign_key_issues(c, "c_custkey", "c_nationkey", n.filter("n_regionkey <> 2"), "n_nationkey", "MISSING_NATION")
    return a.unionByName(b).unionByName(joins.foreign_key_issues(n, "n_nationkey", "n_regionkey", table(spark, sf, "region"), "r_regionkey", "MISSING_REGION"))


@query(
    "lineage",
    """SELECT o_orderkey, c_name, n_name, r_name, c_name IS NOT NULL AND n_name IS NOT NULL AND r_name IS NOT NULL AS complete, coalesce(r_name = 'ASIA', false) AS region_agrees
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def lineage(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    j = j.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    full = F.col("c_name").isNotNull() & F.col("n_name").isNotNull() & F.col("r_name").isNotNull()
    return j.select("o_orderkey", "c_name", "n_name", "r_name", full.alias("complete"), F.coalesce(F.col("r_name") == "ASIA", F.lit(False)).alias("region_agrees"))


WALK = """WITH RECURSIVE e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 10 = 3 THEN c_custkey + 1 WHEN c_custkey % 10 = 4 THEN c_custkey - 1 ELSE c_custkey // 2 END AS parent FROM customer),"""


@query(
    "hierarchy_cycle",
    WALK + """ walk AS (
  SELECT id AS start, id, parent, [id] AS path, false AS cycle FROM e
  UNION ALL SELECT w.start, e.id, e.parent, list_append(w.path, e.id), list_contains(w.path, e.id) FROM walk w JOIN e ON w.parent = e.id WHERE NOT w.cycle AND len(w.path) < 64)
SELECT start AS id, CAST(max(len(path)) AS INT) AS steps, bool_or(cycle) AS cycle FROM walk GROUP BY start""",
)
def hierarchy(spark, sf):
    parent = "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 10 = 3 THEN c_custkey + 1 WHEN c_custkey % 10 = 4 THEN c_custkey - 1 ELSE c_custkey div 2 END"
    return store.hierarchy_walk(table(spark, sf, "customer").selectExpr("c_custkey AS id", f"{parent} AS parent"))


@query("dup_groups", "SELECT source, lang, n_chars // 100 AS size_class, count(*) AS n, count(DISTINCT text) AS n_texts FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_groups(spark, sf):
    g = table(spark, sf, "documents").groupBy("source", "lang", F.expr("n_chars div 100").alias("size_class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"))
    return g.filter("n > 1")


@query(
    "dup_classification",
    """SELECT sha256(coalesce(text, '')) AS h, count(*) AS n, min(doc_id) AS representative,
 CASE WHEN count(*) = 1 THEN 'SINGLETON' WHEN count(DISTINCT (lang, source)) = 1 AND count(DISTINCT quality) <= 1 THEN 'IDENTICAL_REPLICATE' WHEN count(DISTINCT (lang, source)) = 1 THEN 'REPEATED_MEASUREMENT' WHEN count(DISTINCT lang) = 1 THEN 'DISTINCT_CONTEXT' ELSE 'AMBIGUOUS' END AS class
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def dup_classification(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return aggregates.classify_duplicates(d, "h", "doc_id", ["lang", "source"], ["quality"], "lang")


@query("dup_resolution", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY text) THEN 'kept' ELSE 'collapsed' END AS resolution FROM documents")
def dup_resolution(spark, sf):
    return aggregates.resolve_groups(table(spark, sf, "documents"), F.sha2("text", 256), "doc_id")


@query(
    "replicate_collapse",
    """SELECT l_orderkey, count(*) AS n, quantile_cont(l_quantity, 0.5) AS median_quantity, min(l_quantity) AS min_quantity, max(l_quantity) AS max_quantity, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS composite,
 array_to_string(list_sort(list_distinct(list(l_linestatus))), ';') AS statuses FROM lineitem GROUP BY l_orderkey""",
)
def replicate_collapse(spark, sf):
    return aggregates.collapse_replicates(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", "quantity", "l_returnflag", "l_linestatus")


@query("context_collapse", "SELECT o_custkey, o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1, 2, 3")
def context_collapse(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("group_consistency", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_status, count(DISTINCT o_orderpriority) AS n_priority, count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1 AS inconsistent FROM orders GROUP BY o_custkey")
def group_consistency(spark, sf):
    return aggregates.consistency(table(spark, sf, "orders"), "o_custkey", {"o_orderstatus": "n_status", "o_orderpriority": "n_priority"})


@query("missingness", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS n_missing, round(100.0 * count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') / count(*), 4) AS pct_missing FROM documents LEFT JOIN labels USING (doc_id)" for c in ("text", "lang", "source", "quality", "toxic")) + ")")
def missingness(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return aggregates.missingness(d, ["text", "lang", "source", "quality", "toxic"])


SUMMARY = "count({0}) AS n, min({0}) AS min, round(quantile_cont({0}, 0.25), 6) AS q25, round(quantile_cont({0}, 0.5), 6) AS median, round(quantile_cont({0}, 0.75), 6) AS q75, max({0}) AS max, round(avg({0}), 6) AS mean"


@query("distribution_summary", f"SELECT l_returnflag, {SUMMARY.format('l_extendedprice')} FROM lineitem GROUP BY l_returnflag")
def distribution(spark, sf):
    return aggregates.distribution(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@query("prevalence", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER ({c} <> 0) AS nonzero, round(count(*) FILTER ({c} <> 0) / count({c}), 6) AS fraction, round(avg({c}), 6) AS mean FROM lineitem" for c in ("l_discount", "l_tax", "l_quantity")))
def prevalence(spark, sf):
    return aggregates.prevalence(table(spark, sf, "lineitem"), ["l_discount", "l_tax", "l_quantity"])


@query("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query("entity_row_counts", " UNION ALL ".join(f"SELECT '{t}' AS entity, count(*) AS n_rows FROM {t}" for t in TABLES))
def entity_counts(spark, sf):
    return store.row_counts({t: table(spark, sf, t) for t in TABLES})


@query("population_assignment", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'excluded' WHEN q.doc_id IS NULL THEN 'excluded' WHEN n_chars < 200 THEN 'secondary' ELSE 'primary' END AS assignment, CASE WHEN text IS NULL OR trim(text) = '' THEN 'no text' WHEN q.doc_id IS NULL THEN 'no label' WHEN n_chars < 200 THEN 'short' ELSE 'eligible' END AS reason FROM documents LEFT JOIN (SELECT doc_id FROM labels) q USING (doc_id)")
def population(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.lit(1).alias("m")), "doc_id", "left")
    rules = [(F.col("text").isNull() | (F.trim("text") == ""), "excluded", "no text"), (F.col("m").isNull(), "excluded", "no label"), (F.col("n_chars") < 200, "secondary", "short")]
    return aggregates.first_match(d, rules, ("primary", "eligible")).select("doc_id", "assignment", "reason")


@query("composite_label", "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag IS NULL) > 0 THEN 'BLOCKED' WHEN count(*) FILTER (l_returnflag = 'R') <= 1 THEN 'OK' ELSE 'FLAGGED' END AS label FROM lineitem GROUP BY l_orderkey")
def composite(spark, sf):
    return aggregates.composite_label(table(spark, sf, "lineitem"), "l_orderkey", F.col("l_returnflag"), "R", 1)


@query("numeric_or_text_equal", "SELECT doc_id, TRY_CAST(substr(source, 4) AS DOUBLE) AS number, coalesce(TRY_CAST(substr(source, 4) AS DOUBLE) = doc_id % 20, false) AS equal, coalesce(nullif(trim(lang), ''), '<MISSING>') AS lang_token FROM documents")
def numeric_equal(spark, sf):
    n = F.substring("source", 4, 20).try_cast("double")
    return table(spark, sf, "documents").select("doc_id", n.alias("number"), F.coalesce(n == F.col("doc_id") % 20, F.lit(False)).alias("equal"), F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("<MISSING>")).alias("lang_token"))


ISSUES = [("o_custkey", "REQUIRED", "o_custkey IS NULL", "ERROR"), ("o_totalprice", "FINITE_NUMBER_REQUIRED", "o_totalprice IS NULL OR o_totalprice < 1000", "ERROR"), ("o_orderstatus", "UNKNOWN_STATUS", "o_orderstatus NOT IN ('F', 'O')", "WARNING"), ("o_orderpriority", "TEXT_ID_REQUIRED", "o_orderpriority LIKE '4%'", "WARNING")]


@query("record_issues", " UNION ALL ".join(f"SELECT o_orderkey AS id, '{f}' AS field, '{c}' AS code, '{s}' AS severity FROM orders WHERE {w}" for f, c, w, s in ISSUES))
def record_issues(spark, sf):
    return store.issues(table(spark, sf, "orders"), "o_orderkey", [(f, c, F.expr(w), s) for f, c, w, s in ISSUES])


@query("duplicate_row_issues", "SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, value ORDER BY event_id) AS rn FROM events) WHERE rn > 1")
def duplicate_rows(spark, sf):
    e = table(spark, sf, "events")
    return e.withColumn("rn", F.row_number().over(W.partitionBy("user_id", "event_type", "value").orderBy("event_id")).cast("long")).filter("rn > 1").select("event_id", "rn")


@query("set_union_by_name", "SELECT s_suppkey AS k, s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_custkey, c_nationkey, 'customer' FROM customer")
def set_union(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    return a.unionByName(table(spark, sf, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation")))


@query("set_overlap", "SELECT 'intersect' AS op, count(*) AS n FROM (SELECT n_chars FROM documents WHERE lang = 'en' INTERSECT SELECT n_chars FROM documents WHERE lang = 'fr') UNION ALL SELECT 'except', count(*) FROM (SELECT n_chars FROM documents WHERE lang = 'en' EXCEPT SELECT n_chars FROM documents WHERE lang = 'fr') UNION ALL SELECT 'except_all', count(*) FROM (SELECT n_chars FROM documents WHERE lang = 'en' EXCEPT ALL SELECT n_chars FROM documents WHERE lang = 'fr')")
def set_overlap(spark, sf):
    d = table(spark, sf, "documents")
    return aggregates.set_overlap(d.filter("lang = 'en'").select("n_chars"), d.filter("lang = 'fr'").select("n_chars"))


SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'TEST' WHEN doc_id % 5 = 1 THEN 'VALIDATION' ELSE 'TRAIN' END"


@query(
    "split_leakage",
    f"""WITH s AS (SELECT DISTINCT sha256(text) AS h, {SPLIT} AS split FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.h) AS n_shared FROM s a JOIN s b ON a.h = b.h AND a.split < b.split GROUP BY 1, 2""",
)
def split_leakage(spark, sf):
    return aggregates.leakage(table(spark, sf, "documents").select(F.sha2("text", 256).alias("h"), F.expr(SPLIT).alias("split")), "h", "split")


@query("matrix_pivot", "SELECT o_orderpriority, " + ", ".join(f"round(max(m) FILTER (o_orderstatus = '{s}'), 4) AS {s}" for s in "FOP") + " FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def pivot(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))


@query("export_view", f"WITH {PAIRS} SELECT antibody_id, nullif(CAST(length(VH) AS INT), 0) AS VH_length, nullif(CAST(length(VL) AS INT), 0) AS VL_length FROM pairs")
def export_view(spark, sf):
    return pairs(spark, sf).select("antibody_id", F.nullif(F.length("VH"), F.lit(0)).alias("VH_length"), F.nullif(F.length("VL"), F.lit(0)).alias("VL_length"))


@query("raw_row_json", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS source_row_json FROM nation""")
def raw_json(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", F.to_json(F.struct("*")).alias("source_row_json"))


@query("ttl_cache", "SELECT user_id, event_type, arg_max(value, ts) AS value FROM events WHERE ts > TIMESTAMP '2024-01-30 23:59:59' - INTERVAL 7 DAY GROUP BY 1, 2")
def ttl_cache(spark, sf):
    return store.live_entries(table(spark, sf, "events"), ["user_id", "event_type"], "value", "ts", F.expr("TIMESTAMP_NTZ '2024-01-30 23:59:59'"), 7)


@query("top_k_sort", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20)")
def top_k(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("memory_window", "SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4")
def memory_window(spark, sf):
    c = table(spark, sf, "conversations")
    last = c.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("rn <= 4")
    return last.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


@query("snapshot_lossless", """SELECT item_id, to_base64(encode(text)) AS payload, sha256(text) AS payload_sha256 FROM benchmark""")
def snapshot(spark, sf):
    return store.snapshot(table(spark, sf, "benchmark"), "item_id", "text")
