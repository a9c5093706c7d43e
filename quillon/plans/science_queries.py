"""Kinetics, identity graphs, features for learning and embedding audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.functions import rules
from quillon.operators import identity, joins, kinetics, learning, retrieval
from quillon.plans.registry import Registry
from quillon.plans.table_queries import KMERS
from quillon.plans.text_queries import COS
from quillon.plans.views import CHAINS, pairs, product_pairs, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

SERIES = "SELECT event_id, user_id, event_type, round(epoch(ts) - epoch(TIMESTAMP '2024-01-01'), 3) / 3600 AS t, value AS y FROM events"


def series(spark, sf):
    e = table(spark, sf, "events")
    hours = F.round((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / 1e6, 3) / 3600
    return e.select("event_id", "user_id", "event_type", hours.alias("t"), F.col("value").alias("y"))


FITS = f"""f AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT t) AS d, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_sxx(y, t) AS sxx, regr_syy(y, t) AS syy, regr_sxy(y, t) AS sxy, avg(t) AS mx, min(y) AS lo, max(y) AS hi FROM ({SERIES}) GROUP BY 1, 2),
o AS (SELECT *, greatest(0, syy - sxy * sxy / sxx) AS sse FROM f)"""


@query("kinetics_ols", f"WITH {FITS} SELECT user_id, event_type, n, round(CASE WHEN d >= 3 THEN b END, 6) AS slope, round(CASE WHEN d >= 3 THEN a END, 5) AS intercept, round(CASE WHEN d >= 3 AND syy > 0 THEN 1 - sse / syy END, 6) AS r_squared, round(CASE WHEN d >= 3 THEN sqrt(sse / n) END, 5) AS rmse, round(CASE WHEN d >= 3 THEN sqrt(sse / (n - 2) / sxx) END, 6) AS slope_se FROM o")
def ols(spark, sf):
    r = kinetics.linear_rates(series(spark, sf), ["user_id", "event_type"], "t", "y")
    return r.select("user_id", "event_type", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("r_squared", 6).alias("r_squared"), F.round("rmse", 5).alias("rmse"), F.round("slope_se", 6).alias("slope_se"))


@query("kinetics_decisions", f"SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'USER_EXCLUSION' WHEN y IS NULL OR t IS NULL THEN 'MISSING_TIME_OR_SIGNAL' WHEN NOT t BETWEEN 24 AND 480 THEN 'OUTSIDE_EXPLICIT_INTERVAL' ELSE 'INCLUDED' END AS reason FROM ({SERIES})")
def decisions(spark, sf):
    return kinetics.decide(series(spark, sf), F.col("event_id") % 17 == 0, F.col("t"), F.col("y"), 24.0, 480.0).select("event_id", "reason")


@query("kinetics_blank_match", f"""WITH s AS (SELECT *, CAST(floor(t) AS BIGINT) AS hour FROM ({SERIES})), b AS (SELECT user_id, hour, avg(y) AS blank FROM s WHERE event_type = 'view' GROUP BY 1, 2)
SELECT event_id, round(blank, 6) AS blank_value, round(y - blank, 6) AS corrected, CASE WHEN blank IS NULL THEN 'UNMATCHED_BLANK' ELSE 'INCLUDED' END AS reason FROM s LEFT JOIN b ON s.user_id = b.user_id AND s.hour = b.hour WHERE event_type <> 'view'""")
def blank_match(spark, sf):
    s = series(spark, sf).withColumn("hour", F.floor("t"))
    m = kinetics.match_blanks(s.filter("event_type <> 'view'"), s.filter("event_type = 'view'"), ["user_id", "hour"], "y")
    d = kinetics.decide(m, F.lit(False), F.col("t"), F.col("y"), -1.0, 1e6, F.col("blank_value"))
    return d.select("event_id", F.round("blank_value", 6).alias("blank_value"), F.round("corrected", 6).alias("corrected"), "reason")


@query("kinetics_curvature", f"""WITH r AS (SELECT user_id, event_type, t, y, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM ({SERIES})),
h AS (SELECT *, k <= n // 2 AS early FROM r),
s AS (SELECT user_id, event_type, count(*) AS n, count(DISTINCT t) AS d, (arg_max(y, t) FILTER (early) - arg_min(y, t) FILTER (early)) / nullif(max(t) FILTER (early) - min(t) FILTER (early), 0) AS e, (arg_max(y, t) FILTER (NOT early) - arg_min(y, t) FILTER (NOT early)) / nullif(max(t) FILTER (NOT early) - min(t) FILTER (NOT early), 0) AS l FROM h GROUP BY 1, 2)
SELECT user_id, event_type, round(abs(e - l) / greatest(abs(e), abs(l), 1e-300), 6) AS change FROM s WHERE n >= 4 AND n = d""")
def curvature(spark, sf):
    return kinetics.curvature(series(spark, sf), ["user_id", "event_type"], "t", "y").withColumn("change", F.round("change", 6))


@query("kinetics_calibration", f"WITH {FITS}, c AS (SELECT *, CASE WHEN lo < 0 OR hi > 60 THEN 'OUTSIDE_CALIBRATION_RANGE' WHEN least((lo - 0.5) / 2, (hi - 0.5) / 2) < 0 THEN 'INVALID_CONVERTED_CONCENTRATION' ELSE 'OK' END AS status FROM o WHERE d >= 3) SELECT user_id, event_type, status, round(CASE WHEN status = 'OK' THEN b / 2 END, 6) AS product_slope FROM c")
def calibration(spark, sf):
    s = series(spark, sf)
    by = ["user_id", "event_type"]
    r = kinetics.linear_rates(s, by, "t", "y").filter("slope IS NOT NULL").join(s.groupBy(*by).agg(F.min("y").alias("lo"), F.max("y").alias("hi")), by)
    return kinetics.calibrate(r, F.col("lo"), F.col("hi"), 2.0, 0.5, (0.0, 60.0)).select(*by, "status", F.round("product_slope", 6).alias("product_slope"))


@query("series_identity", f"SELECT sha256('[' || user_id || ',\"' || event_type || '\"]') AS series_id, user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type")
def series_identity(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.sha2(F.concat(F.lit("["), F.col("user_id").cast("string"), F.lit(',"'), "event_type", F.lit('"]')), 256).alias("series_id"), "user_id", "event_type", "n")


def rates(spark, sf):
    """Rates by concentration: part sizes as concentrations, saturating prices with noise from the key."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("enzyme"), F.col("p_size").cast("double").alias("s"), "p_partkey")
    noise = (F.col("p_partkey") * 7919 % 101 - 50) / 1000.0
    return p.groupBy("enzyme", "s").agg(F.avg(5 * F.col("s") / (20 + F.col("s")) + noise).alias("v"))


@query("mm_fit")
def mm_fit(spark, sf):
    return kinetics.fit_groups(rates(spark, sf), ["enzyme"], "s", "v")


@query("mm_profile")
def mm_profile(spark, sf):
    return kinetics.fit_groups(rates(spark, sf), ["enzyme"], "s", "v", intervals=True)


S7 = [2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0]


@query("mc_propagation")
def mc(spark, sf):
    load = [[0.02, 0.01, 0.0, 0.005, 0.01]] * len(S7)
    return kinetics.summarize_draws(kinetics.propagate(spark, S7, [5 * s / (20 + s) for s in S7], load, 0.02, 1024), ["km", "vmax"])


# ---- identity graphs


def identities(spark, sf):
    u = product_pairs(spark, sf)
    c = joins.kmer_candidates(u, "id", ["VH", "VL"]).select("left_id", "right_id")
    return u, identity.paired_identity(c, u)


@query("identity_pairs")
def identity_pairs(spark, sf):
    return identities(spark, sf)[1]


@query("cluster_greedy")
def cluster_greedy(spark, sf):
    u, i = identities(spark, sf)
    return identity.greedy_clusters(u, "id", i, 0.8)


def candidate_edges(spark, sf):
    u = product_pairs(spark, sf)
    return u, joins.kmer_candidates(u, "id", ["VH", "VL"]).select("left_id", "right_id")


REACH = """, e AS (SELECT left_id AS a, right_id AS b FROM cand UNION ALL SELECT right_id, left_id FROM cand), r(id, x) AS (SELECT id, id FROM u UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a), comp AS (SELECT id, min(x) AS component FROM r GROUP BY id)"""
GRAPH = KMERS.replace("WITH ", "WITH RECURSIVE ", 1) + REACH


@query("components_edges", f"{GRAPH} SELECT id, component FROM comp")
def components_edges(spark, sf):
    u, c = candidate_edges(spark, sf)
    return identity.components(u, "id", c, "left_id", "right_id")


@query("components_summary", f"{GRAPH}, z AS (SELECT component, count(*) AS n FROM comp GROUP BY 1) SELECT count(*) AS n_components, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, round(quantile_cont(n, 0.95), 4) AS p95 FROM z")
def components_summary(spark, sf):
    u, c = candidate_edges(spark, sf)
    z = identity.components(u, "id", c, "left_id", "right_id").groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return z.agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"), F.count(F.when(F.col("n") == 1, 1)).alias("singletons"), F.round(F.percentile("n", F.lit(0.95)), 4).alias("p95"))


ENTITY = """WITH RECURSIVE d AS (SELECT doc_id, sha256(text) AS h, CAST(n_chars AS VARCHAR) || lang AS k FROM documents), e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM d a JOIN d b ON (a.h = b.h OR a.k = b.k) AND a.doc_id <> b.doc_id),
r(id, x) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a), comp AS (SELECT id AS doc_id, min(x) AS component FROM r GROUP BY id)"""


def entity_components(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.concat(F.col("n_chars").cast("string"), "lang").alias("k"))
    return identity.entity_components(d, "doc_id", "h", "k")


@query("components_exact", f"{ENTITY} SELECT component, count(*) AS size, sha256(array_to_string(list_sort(list(CAST(doc_id AS VARCHAR))), chr(10))) AS component_hash FROM comp GROUP BY component")
def components_exact(spark, sf):
    return identity.hashed_components(entity_components(spark, sf), "doc_id")


GREEDY = f"""{ENTITY}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY component), t AS (SELECT sum(size) AS total FROM z),
o AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS k FROM z),
fold(k, component, size, split, a, b, c) AS (
  SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, '', 0.6::DOUBLE * total, 0.2::DOUBLE * total, 0.2::DOUBLE * total FROM t
  UNION ALL SELECT o.k, o.component, o.size, CASE WHEN a >= b AND a >= c THEN 'TRAIN' WHEN b >= c THEN 'VALIDATION' ELSE 'TEST' END,
    CASE WHEN a >= b AND a >= c THEN a - o.size ELSE a END, CASE WHEN NOT (a >= b AND a >= c) AND b >= c THEN b - o.size ELSE b END, CASE WHEN NOT (a >= b AND a >= c) AND NOT b >= c THEN c - o.size ELSE c END
  FROM fold JOIN o ON o.k = fold.k + 1)
SELECT component, size, split FROM fold WHERE k > 0"""


@query("split_greedy", GREEDY)
def split_greedy(spark, sf):
    sizes = entity_components(spark, sf).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return identity.greedy_split(sizes, "component", "size")


@query("degree_stats", f"{KMERS}, e AS (SELECT left_id AS a, right_id AS b FROM cand UNION ALL SELECT right_id, left_id FROM cand) SELECT a AS node, count(DISTINCT b) AS degree FROM e GROUP BY a")
def degree_stats(spark, sf):
    return identity.degrees(candidate_edges(spark, sf)[1], "left_id", "right_id")


@query("articulation_points")
def articulation(spark, sf):
    return identity.component_articulation(candidate_edges(spark, sf)[1], "left_id", "right_id")


# ---- vectors and features


@query("join_nearest", f"WITH {COS} SELECT query_id, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rk FROM c WHERE id <> query_id) WHERE rk = 1")
def nearest(spark, sf):
    e = table(spark, sf, "embeddings")
    top = retrieval.cosine_top_k(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 2).filter("query_id <> id")
    return retrieval.top_per(top.drop("rank"), "query_id", "score", "id", 1).select("query_id", "id", F.round("score", 6).alias("score"))


@query("embedding_audit", f"WITH {COS} SELECT q.label = v.label AS same_label, count(*) AS n, round(avg(score), 6) AS mean, round(min(score), 6) AS min, round(max(score), 6) AS max FROM c JOIN embeddings q ON q.vec_id = c.query_id JOIN embeddings v ON v.vec_id = c.id WHERE c.query_id <> c.id GROUP BY 1")
def embedding_audit(spark, sf):
    e = table(spark, sf, "embeddings")
    n = e.count()
    top = retrieval.cosine_top_k(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", n).filter("query_id <> id")
    label = e.select("vec_id", "label")
    j = top.join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("b")), "id")
    return j.groupBy((F.col("a") == F.col("b")).alias("same_label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.min("score"), 6).alias("min"), F.round(F.max("score"), 6).alias("max"))


@query("embedding_guards", "SELECT count(*) AS n, count(*) FILTER (len(embedding) <> 64) AS wrong_length, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0) AS not_finite, count(*) FILTER (list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) = 0) AS zero_norm, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS mean_norm FROM embeddings")
def embedding_guards(spark, sf):
    return learning.embedding_guards(table(spark, sf, "embeddings"), "embedding", 64)


#: The oracle's own values, by residue in the order ACDEFGHIKLMNPQRSTVWY.
ORACLE_PROPERTIES = {
    "hydropathy": "1.8 2.5 -3.5 -3.5 2.8 -0.4 -3.2 4.5 -3.9 3.8 1.9 -3.5 -1.6 -3.5 -4.5 -0.8 -0.7 4.2 -0.9 -1.3",
    "volume": "67 86 91 109 135 48 118 124 135 124 124 96 90 114 148 73 93 105 163 141",
    "charge": "0 0 -1 -1 0 0 0.5 0 1 0 0 0 0 0 1 0 0 0 0 0",
    "polarity": "8 1 101 101 0 0 63 0 90 0 0 91 42 91 52 98 69 0 26 36",
}


def _property_sql() -> str:
    values = lambda text: ", ".join(f"{v}::DOUBLE" for v in text.split())
    return ", ".join(f"list_transform(string_split(seq, ''), lambda x: ([{values(text)}])[instr('ACDEFGHIKLMNPQRSTVWY', x)]) AS {name}" for name, text in ORACLE_PROPERTIES.items())


@query("ml_property_features", f"WITH {CHAINS}, v AS (SELECT antibody_id, chain, length(seq) AS n, {_property_sql()} FROM chains WHERE seq <> '') SELECT antibody_id, chain, round(n / 120, 6) AS length, " + ", ".join(f"round(list_avg({p}), 6) AS {p}_mean, round(list_stddev_pop({p}), 5) AS {p}_std, round(list_min({p}), 6) AS {p}_min, round(list_max({p}), 6) AS {p}_max" for p in ORACLE_PROPERTIES) + " FROM v")
def property_features(spark, sf):
    c = rules.chains(pairs(spark, sf), "antibody_id").filter("seq <> ''")
    out = c.select("antibody_id", "chain", *learning.property_stats(F.col("seq")))
    return out.select("antibody_id", "chain", *[F.round(x, 5 if x.endswith("_std") else 6).alias(x) for x in out.columns[2:]])


@query("ml_kmer_bins")
def kmer_bins(spark, sf):
    shown = lambda c: F.array_join(F.transform(learning.hashed_kmers(F.col(c)), lambda x: F.round(x, 6).cast("string")), ";").alias(c)
    return pairs(spark, sf).select("antibody_id", shown("VH"), shown("VL"))


@query("ml_blocks", "SELECT feature, round(variance, 8) AS variance, variance = 0 AS zero_variance FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")")
def blocks(spark, sf):
    return learning.block_report(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


#: The three normal equations by Cramer's rule.
RIDGE = """WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_tax) AS mc, avg(l_extendedprice) AS my, stddev_pop(l_quantity) AS sa, stddev_pop(l_discount) AS sb, stddev_pop(l_tax) AS sc,
  corr(l_quantity, l_discount) AS ab, corr(l_quantity, l_tax) AS ac, corr(l_discount, l_tax) AS bc, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_, covar_pop(l_tax, l_extendedprice) AS cy FROM lineitem),
g AS (SELECT *, 1 + alpha / n AS d, ay / sa AS pa, by_ / sb AS pb, cy / sc AS pc FROM m, (VALUES (0.1::DOUBLE), (1.0), (10.0), (100.0)) x(alpha)),
w AS (SELECT *, d * (d * d - bc * bc) - ab * (ab * d - bc * ac) + ac * (ab * bc - d * ac) AS t,
  pa * (d * d - bc * bc) - ab * (pb * d - bc * pc) + ac * (pb * bc - d * pc) AS ta, d * (pb * d - bc * pc) - pa * (ab * d - bc * ac) + ac * (ab * pc - pb * ac) AS tb, d * (d * pc - pb * bc) - ab * (ab * pc - pb * ac) + pa * (ab * bc - d * ac) AS tc FROM g)
SELECT alpha, round(my - ta / t / sa * ma - tb / t / sb * mb - tc / t / sc * mc, 4) AS intercept, round(ta / t / sa, 5) AS quantity, round(tb / t / sb, 4) AS discount, round(tc / t / sc, 4) AS tax FROM w"""


@query("ml_ridge_grid", RIDGE)
def ridge(spark, sf):
    rows = learning.ridge_grid(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", [0.1, 1.0, 10.0, 100.0])
    digits = (4, 5, 4, 4)
    return spark.createDataFrame([(a, *(round(x, d) for x, d in zip(w, digits))) for a, w in rows], "alpha double, intercept double, quantity double, discount double, tax double")


@query("ml_hash_split", "SELECT doc_id, CASE WHEN u < 0.6::DOUBLE THEN 'TRAIN' WHEN u < 0.6::DOUBLE + 0.2::DOUBLE THEN 'VALIDATION' ELSE 'TEST' END AS split FROM (SELECT doc_id, ('0x' || substr(md5('split' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents)")
def hash_split(spark, sf):
    s = learning.hash_split(F.col("doc_id"), {"TRAIN": 0.6, "VALIDATION": 0.2, "TEST": 0.2})
    return table(spark, sf, "documents").select("doc_id", s.alias("split"))


