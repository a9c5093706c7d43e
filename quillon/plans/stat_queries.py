"""Statistics over documents with their labels and over line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import stats
from quillon.operators.aggregates import average_ranks
from quillon.plans.registry import Registry
from quillon.plans.rule_queries import CHAIN_SQL, chain_features
from quillon.plans.views import BLOCKS, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

LONG = "SELECT l_returnflag AS grp, l_quantity AS x, l_extendedprice AS y, l_discount AS z FROM lineitem"


def lineitem(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def ranks(*columns: str, source: str = LONG) -> str:
    return f"SELECT *, {', '.join(f'(rank() OVER (PARTITION BY grp ORDER BY {c}) + (count(*) OVER (PARTITION BY grp, {c}) - 1) / 2.0)::DOUBLE AS r{c}' for c in columns)} FROM ({source})"


@query("rank_avg", f"SELECT DISTINCT grp, x, rx AS rank FROM ({ranks('x')})")
def rank_avg(spark, sf):
    return average_ranks(lineitem(spark, sf), ["grp"], "x", "rank").drop("__ties")


@query("spearman_long", f"SELECT grp, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM ({ranks('x', 'y')}) GROUP BY grp")
def spearman_long(spark, sf):
    return stats.spearman(lineitem(spark, sf), ["grp"], "x", "y").withColumn("rho", F.round("rho", 8))


UNPIVOT = """SELECT f.feature || '|' || a.assay AS grp, f.x AS x, a.y AS y FROM
 (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS x FROM lineitem) f
 JOIN (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['price', 'supplier']) AS assay, unnest([l_extendedprice, l_suppkey::DOUBLE]) AS y FROM lineitem) a USING (l_orderkey, l_linenumber, l_partkey)"""


@query("spearman_matrix", f"SELECT split_part(grp, '|', 1) AS feature, round(max(rho) FILTER (grp LIKE '%|price'), 8) AS price, round(max(rho) FILTER (grp LIKE '%|supplier'), 8) AS supplier FROM (SELECT grp, corr(rx, ry) AS rho FROM ({ranks('x', 'y', source=UNPIVOT.replace('USING (l_orderkey, l_linenumber, l_partkey)', 'ON f.l_orderkey = a.l_orderkey AND f.l_linenumber = a.l_linenumber AND f.l_partkey = a.l_partkey'))}) GROUP BY grp) GROUP BY 1")
def spearman_matrix(spark, sf):
    l, keys = table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]
    features = l.select(*keys, F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    assays = l.select(*keys, F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("supplier"))
    m = stats.spearman_matrix(features.join(assays, keys), ["quantity", "discount", "tax"], ["price", "supplier"])
    return m.select("feature", F.round("price", 8).alias("price"), F.round("supplier", 8).alias("supplier"))


@query("partial_spearman", f"SELECT grp, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 8) AS rho FROM (SELECT grp, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM ({ranks('x', 'y', 'z')}) GROUP BY grp)")
def partial(spark, sf):
    return stats.partial_spearman(lineitem(spark, sf), ["grp"], "x", "y", "z").withColumn("rho", F.round("rho", 8))


P = "SELECT l_orderkey AS id, round(avg(l_discount) * 10, 6) AS p FROM lineitem GROUP BY 1"


@query("bh_fdr", f"SELECT id, round(least(1, min(raw) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS q FROM (SELECT id, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, id) AS raw FROM ({P}))")
def bh(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.round(F.avg("l_discount") * 10, 6).alias("p"))
    return stats.benjamini_hochberg(p, "p", [], "id").select("id", F.round("q", 8).alias("q"))


STRATA = "WITH t AS (SELECT quantile_cont(n_chars, 1/3::DOUBLE) AS a, quantile_cont(n_chars, 2/3::DOUBLE) AS b FROM documents), g AS (SELECT CASE WHEN n_chars <= a THEN 'low' WHEN n_chars <= b THEN 'middle' ELSE 'high' END AS grp, n_chars::DOUBLE AS x, (doc_id * 7919 % 1009)::DOUBLE AS y FROM documents, t)"


@query("strata_spearman", f"{STRATA} SELECT grp AS stratum, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM ({ranks('x', 'y', source='SELECT * FROM g')}) GROUP BY grp")
def strata(spark, sf):
    d = table(spark, sf, "documents").select(F.col("n_chars").cast("double").alias("x"), (F.col("doc_id") * 7919 % 1009).cast("double").alias("y"))
    cuts = d.agg(F.percentile("x", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))  # one row
    g = d.crossJoin(F.broadcast(cuts)).select("x", "y", F.when(F.col("x") <= F.col("c")[0], "low").when(F.col("x") <= F.col("c")[1], "middle").otherwise("high").alias("stratum"))
    return stats.spearman(g, ["stratum"], "x", "y").withColumn("rho", F.round("rho", 8))


SCORED = f"{CHAIN_SQL}, s AS (SELECT f.chain AS grp, f.score AS score, l.quality AS label FROM features f JOIN labels l ON CAST(f.antibody_id AS BIGINT) // {BLOCKS} = l.doc_id WHERE f.score IS NOT NULL)"


def scored(spark, sf):
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    doc = F.floor(F.col("antibody_id").cast("long") / BLOCKS).alias("doc_id")
    return chain_features(spark, sf).select(doc, F.col("chain").alias("grp"), "score").join(l, "doc_id").filter("score IS NOT NULL").select("grp", "score", "label")


@query("roc_auc", f"{SCORED} SELECT grp, round((sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 8) AS roc_auc FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS r FROM s) GROUP BY grp")
def roc(spark, sf):
    return stats.roc_auc(scored(spark, sf), ["grp"], "score", "label").withColumn("roc_auc", F.round("roc_auc", 8))


@query("pr_auc", f"{SCORED}, g AS (SELECT grp, score, count(*) FILTER (label = 1) AS tp, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT grp, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY grp ORDER BY score DESC)) SELECT grp, round(sum(tp * ctp / cn) / sum(tp), 8) AS pr_auc FROM c GROUP BY grp")
def pr(spark, sf):
    return stats.pr_auc(scored(spark, sf), ["grp"], "score", "label").withColumn("pr_auc", F.round("pr_auc", 8))


@query(
    "class_metrics",
    f"""{SCORED}, m AS (SELECT grp, count(*) FILTER (score >= 80 AND label = 1) AS tp, count(*) FILTER (score >= 80 AND label = 0) AS fp, count(*) FILTER (score < 80 AND label = 1) AS fn, count(*) FILTER (score < 80 AND label = 0) AS tn FROM s GROUP BY grp),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM m)
SELECT grp, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1 FROM r""",
)
def metrics(spark, sf):
    return stats.class_metrics(scored(spark, sf), ["grp"], F.col("score") >= 80, F.col("label") == 1)


REG = "SELECT l_returnflag AS grp, l_quantity * 1500 AS p, l_extendedprice AS a FROM lineitem"


@query("reg_metrics", f"SELECT grp, round(1 - sum((p - a) * (p - a)) / (var_pop(a) * count(a)), 6) AS r2, round(avg(abs(p - a)), 6) AS mae, round(sqrt(avg((p - a) * (p - a))), 6) AS rmse FROM ({REG}) GROUP BY grp")
def reg(spark, sf):
    return stats.regression_metrics(lineitem(spark, sf), ["grp"], F.col("x") * 1500, F.col("y"))


TAU = "SELECT lang AS grp, (n_chars // 100)::DOUBLE AS x, (doc_id % 97)::DOUBLE AS y FROM documents"


@query("kendall_tau_b", f"""WITH s AS (SELECT *, row_number() OVER () AS i FROM ({TAU})),
p AS (SELECT a.grp, sign(a.x - b.x) * sign(a.y - b.y) AS c, a.x = b.x AS tx, a.y = b.y AS ty FROM s a JOIN s b ON a.grp = b.grp AND a.i < b.i),
n AS (SELECT grp, count(*) AS n FROM s GROUP BY grp)
SELECT n.grp AS grp, any_value(n.n) AS n, round(sum(c) / sqrt((count(*) - count(*) FILTER (tx))::DOUBLE * (count(*) - count(*) FILTER (ty))), 8) AS tau FROM p JOIN n ON n.grp = p.grp GROUP BY n.grp""")
def kendall(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("grp"), F.expr("n_chars div 100").cast("double").alias("x"), (F.col("doc_id") % 97).cast("double").alias("y"))
    return stats.kendall_tau_b(d, ["grp"], "x", "y").withColumn("tau", F.round("tau", 8))


ASSOC = f"SELECT grp, corr(rx, ry) AS rho, count(*) AS n FROM ({ranks('x', 'y')}) GROUP BY grp"


@query("top_associations", f"SELECT grp, round(rho, 8) AS rho, CASE WHEN abs(rho) < 0.2 THEN 'negligible' WHEN abs(rho) < 0.4 THEN 'weak' WHEN abs(rho) < 0.6 THEN 'moderate' WHEN abs(rho) < 0.8 THEN 'strong' ELSE 'very strong' END AS effect FROM ({ASSOC}) ORDER BY abs(rho) DESC, grp LIMIT 10")
def top_associations(spark, sf):
    r = stats.spearman(lineitem(spark, sf), ["grp"], "x", "y").filter("rho IS NOT NULL")
    return r.orderBy(F.desc(F.abs("rho")), "grp").limit(10).select("grp", F.round("rho", 8).alias("rho"), stats.effect_size(F.col("rho")).alias("effect"))


@query("direction_consistency", f"SELECT grp, CASE WHEN rho IS NULL OR rho = 0 THEN 'undefined' WHEN (rho > 0) = (grp <> 'N') THEN 'consistent' ELSE 'opposite' END AS direction FROM ({ASSOC})")
def direction(spark, sf):
    r = stats.spearman(lineitem(spark, sf), ["grp"], "x", "y")
    return r.select("grp", F.when(F.col("rho").isNull() | (F.col("rho") == 0), "undefined").when((F.col("rho") > 0) == (F.col("grp") != "N"), "consistent").otherwise("opposite").alias("direction"))


@query("spearman_p_values")
def p_values(spark, sf):
    r = stats.spearman(lineitem(spark, sf), ["grp"], "x", "z")
    r = r.withColumn("p", stats.correlation_p(F.col("rho"), (F.col("n") - 2).cast("double")))
    return stats.benjamini_hochberg(r, "p", [], "grp")


@query("bootstrap_intervals")
def bootstrap(spark, sf):
    d = table(spark, sf, "documents").select("lang", F.col("n_chars").cast("double").alias("x"), F.length("text").cast("double").alias("y"))
    return stats.bootstrap(d, ["lang"], "x", "y")


@query("logistic_wald")
def logistic(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.log("n_chars").alias("log_chars"), (F.col("lang") == "en").cast("double").alias("english"), F.col("quality").alias("label"))
    rows = stats.wald(stats.logistic(d, ["log_chars", "english"], "label"))
    return spark.createDataFrame(rows, "term string, coefficient double, standard_error double, odds_ratio double, low double, high double, p double")


@query("bootstrap_correlations")
def bootstrap_correlations(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.floor("p_retailprice").cast("double").alias("y"))
    out = None
    for kind, draws in (("pearson", 2000), ("kendall", 200)):
        own = stats.bootstrap(p, ["p_brand"], "x", "y", resamples=draws, statistic=kind).withColumn("statistic", F.lit(kind))
        out = own if out is None else out.unionByName(own)
    return out
