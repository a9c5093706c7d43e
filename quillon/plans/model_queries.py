"""Models: variants, cross-validation, importances, selection, pooled embeddings, alignments, mutation deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import learning, models
from quillon.plans.registry import Registry
from quillon.plans.rule_queries import COUNTS, chain_features
from quillon.plans.stat_queries import CHAIN_SQL
from quillon.plans.views import PRODUCTS, product_pairs, table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

POOL = ["EVQLVESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAK", "QVQLVQSGAEVKKPGASVKVSCKASGYTFTGYYMHWVRQAPGQGLEWMGWINPNSGGTNYAQKFQGRVTMTRDTSISTAYMELSRLRSDDTAVYYCAR"]


@query("ml_variants")
def variants(spark, sf):
    return models.variants(spark, POOL, 800)


def features_of(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), "l_quantity", "l_discount", "l_tax", "l_extendedprice", (F.col("l_returnflag") == "R").cast("double").alias("returned"))


FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("ml_cross_validation")
def cross_validation(spark, sf):
    rows = features_of(spark, sf)
    a = models.cross_validated(rows, "key", ["logistic", "random_forest"], FEATURES, "returned", k=3)
    return a.unionByName(models.cross_validated(rows, "key", ["ridge"], FEATURES, "l_extendedprice", k=3))


@query("ml_importances")
def importances(spark, sf):
    rows = features_of(spark, sf).withColumn("label", F.col("l_extendedprice"))
    found = [(name, *x) for name in ("ridge", "random_forest_regressor") for x in models.importances(models.pipeline(name, FEATURES, "label").fit(rows), FEATURES)]
    return spark.createDataFrame(found, "model string, feature string, importance double")


FOLDS = "SELECT ('0x' || substr(md5('fold' || l_orderkey), 1, 8))::BIGINT % 5 AS fold, count(*) AS n FROM lineitem GROUP BY 1"


@query("ml_folds", f"SELECT CAST(fold AS INT) AS fold, n FROM ({FOLDS})")
def folds(spark, sf):
    return models.folds(table(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("ml_selection", "SELECT brand, arg_max(alpha, s * 1000 + alpha) AS larger, arg_max(alpha, s * 1000 - alpha) AS smaller, max(s) AS score FROM (SELECT p_brand AS brand, p_size::DOUBLE AS alpha, CAST(count(*) % 3 AS DOUBLE) AS s FROM part GROUP BY 1, 2) GROUP BY brand")
def selection(spark, sf):
    g = table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").cast("double").alias("alpha")).agg((F.count(F.lit(1)) % 3).cast("double").alias("score"))
    a = models.selected(g, ["brand"], "score", "alpha", larger=True).withColumnRenamed("alpha", "larger")
    return a.join(models.selected(g, ["brand"], "score", "alpha", larger=False).select("brand", F.col("alpha").alias("smaller")), "brand")


@query("ml_feature_blocks", f"{CHAIN_SQL} SELECT 'LENGTH' AS block, 1 AS n_features, CAST(var_pop(seq_length) = 0 AS INT) AS n_zero_variance FROM features UNION ALL SELECT 'RULE', {len(COUNTS)}, " + " + ".join(f"CAST(var_pop({c}) = 0 AS INT)" for c in COUNTS) + f" FROM features UNION ALL SELECT 'BOTH', {len(COUNTS) + 1}, " + " + ".join(f"CAST(var_pop({c}) = 0 AS INT)" for c in ["seq_length", *COUNTS]) + " FROM features")
def feature_blocks(spark, sf):
    return learning.blocks_report(chain_features(spark, sf), {"LENGTH": ["seq_length"], "RULE": COUNTS, "BOTH": ["seq_length", *COUNTS]})


@query("ml_mean_pool", "SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: i * (embedding[i]::DOUBLE + embedding[65 - i]::DOUBLE) / 2)), 6) AS weighted FROM embeddings")
def mean_pool(spark, sf):
    pooled = models.mean_pool(F.array("embedding", F.reverse("embedding")), 64)
    weighted = F.aggregate(F.transform(pooled, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return table(spark, sf, "embeddings").select("vec_id", F.round(weighted, 6).alias("weighted"))


@query("embedding_alignment", "SELECT count(*) FILTER (vec_id % 10 = 1) AS missing, 1::BIGINT AS orphaned, count(*) FILTER (vec_id % 10 = 2) AS repeated, count(*) FILTER (vec_id % 10 = 3) AS moved FROM embeddings")
def embedding_alignment(spark, sf):
    k = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select("vec_id", k.alias("place"))
    held = rows.filter(k % 10 != 1).withColumn("place", F.when(k % 10 == 3, -1).otherwise(k))
    held = held.unionByName(rows.filter(k % 10 == 2)).unionByName(spark.createDataFrame([(-7, 0)], "vec_id bigint, place bigint"))
    return models.alignment_gaps(rows, held, "vec_id", "place")


@query("ml_mutation_delta", f"""WITH {PRODUCTS}, c AS (SELECT id, VH, VL, CASE WHEN id < '8' THEN 'VH' WHEN id < 'f' THEN 'vl ' ELSE 'VX' END AS chain, VH || 'N' AS nh, VL || 'N' AS nl FROM u)
SELECT id, CASE WHEN id >= 'f' THEN 'UNKNOWN_CHAIN' WHEN VH = '' OR VL = '' THEN 'MISSING_CHAIN' WHEN id < '1' THEN 'BASELINE_MISMATCH' END AS error, CASE WHEN id < 'f' AND id >= '1' AND VH <> '' AND VL <> '' THEN CAST(length(VH) * 100 + length(VL) AS DOUBLE) END AS baseline_hic,
  CASE WHEN id < 'f' AND id >= '1' AND VH <> '' AND VL <> '' THEN CAST(CASE WHEN id < '8' THEN length(nh) * 100 + length(VL) ELSE length(VH) * 100 + length(nl) END AS DOUBLE) END AS mutant_hic,
  CASE WHEN id < 'f' AND id >= '1' AND VH <> '' AND VL <> '' THEN CASE WHEN id < '8' THEN 100.0 ELSE 1.0 END::DOUBLE END AS delta_hic FROM c""")
def mutation_delta(spark, sf):
    u = product_pairs(spark, sf)
    chain = F.when(F.col("id") < "8", "VH").when(F.col("id") < "f", "vl ").otherwise("VX")
    own = F.when(chain == "VH", F.col("VH")).otherwise(F.col("VL"))
    cases = u.select("id", "VH", "VL", chain.alias("chain"), F.when(F.col("id") < "1", "X").otherwise(own).alias("original"), F.concat(own, F.lit("N")).alias("mutant"))
    h, l = F.concat("VH", F.lit("N")), F.concat("VL", F.lit("N"))
    pairs = u.select(F.explode(F.array(F.struct("VH", "VL"), F.struct(h.alias("VH"), "VL"), F.struct("VH", l.alias("VL")))).alias("p")).select(F.col("p.VH").alias("vh"), F.col("p.VL").alias("vl"))
    predictions = pairs.withColumn("hic", (F.length("vh") * 100 + F.length("vl")).cast("double"))
    return models.mutation_deltas(cases, predictions, "id", ["hic"])
