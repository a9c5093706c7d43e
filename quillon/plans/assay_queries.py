"""Assays: checks of series, vetoes, recomputed records, sources, levels of saturation series, finite results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import assays, kinetics
from quillon.plans.registry import Registry
from quillon.plans.science_queries import FITS, rates, series
from quillon.plans.views import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

CONFIG = {"start": 0.0, "end": 10.0, "time_unit": "min", "measurement_kind": "TIME_COURSE", "blank_mode": "none", "missing_policy": "fail", "exclusions": {}}
OBSERVED = """o AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'x' ELSE CAST(event_id AS VARCHAR) END AS observation_id, user_id % 13 = 0 AND event_type = 'view' AS mixed, user_id % 11 = 0 AND event_id % 2 = 0 AS lost,
  user_id % 7 = 0 AND event_id % 3 = 0 AS other_unit, user_id % 3 = 0 AS endpoint, user_id % 4 = 1 AS no_replicate, CASE WHEN user_id % 8 = 1 THEN NULL WHEN user_id % 8 = 2 THEN -1.0 ELSE 2.0 END AS s FROM events),
a AS (SELECT user_id, count(*) AS n, count(DISTINCT observation_id) < count(*) AS dup, bool_or(mixed) AND NOT bool_and(mixed) AS mixed, bool_or(lost) AS lost, bool_or(other_unit) AS other_unit, bool_or(endpoint) AS endpoint, bool_or(no_replicate) AS no_replicate, bool_or(s IS NULL) AS no_s, bool_or(s < 0) AS bad_s FROM o GROUP BY user_id),
c AS (SELECT *, NOT (dup OR mixed OR lost OR other_unit OR endpoint) AS clean FROM a)"""


@query("kinetics_checks", f"""WITH {OBSERVED} SELECT user_id, n, concat_ws(';', CASE WHEN endpoint THEN 'NOT_TIME_COURSE' END, CASE WHEN dup THEN 'DUPLICATE_OBSERVATION_ID' END, CASE WHEN lost THEN 'INCOMPLETE_PROVENANCE' END,
  CASE WHEN mixed THEN 'MIXED_SERIES' END, CASE WHEN other_unit THEN 'UNIT_MISMATCH' END, CASE WHEN clean AND bad_s THEN 'INVALID_SUBSTRATE' END) AS reasons,
  concat_ws(';', 'INITIAL_RATE_NOT_VERIFIED', 'OLS_UNCERTAINTY_LIMITED', CASE WHEN clean AND no_replicate THEN 'REPLICATE_ID_MISSING' END, CASE WHEN clean AND no_s THEN 'SUBSTRATE_MISSING' END, CASE WHEN clean THEN 'NO_BLANK_CORRECTION' END) AS warnings FROM c""")
def checks(spark, sf):
    u, e = F.col("user_id"), F.col("event_id")
    rows = table(spark, sf, "events").select(
        "user_id", F.when(u % 5 == 0, "x").otherwise(e.cast("string")).alias("observation_id"), F.when((u % 13 == 0) & (F.col("event_type") == "view"), "B").otherwise("A").alias("sample_id"),
        F.when((u % 11 == 0) & (e % 2 == 0), " ").otherwise("sha").alias("source_sha256"), F.when((u % 7 == 0) & (e % 3 == 0), "h").otherwise("min").alias("time_unit"), F.lit("AU").alias("signal_unit"),
        F.when(u % 3 == 0, " End_Point ").otherwise("kinetic").alias("assay_type"), F.when(u % 4 == 1, None).otherwise(1).alias("biological_replicate"), F.lit(1).alias("technical_replicate"),
        F.when(u % 8 == 1, None).when(u % 8 == 2, -1.0).otherwise(2.0).alias("substrate_concentration"), F.lit("mM").alias("substrate_concentration_unit"),
    )
    return assays.series_checks(rows, ["user_id"], CONFIG, ["sample_id"], ["observation_id", "source_sha256"])


@query("kinetics_recompute", f"""WITH {FITS}, b AS (SELECT user_id, event_type, CASE WHEN d >= 3 THEN n END AS n FROM o)
SELECT user_id, event_type, CASE WHEN n IS NULL THEN 'NOT_ESTIMABLE' WHEN user_id % 3 = 0 THEN 'MISMATCH' ELSE 'SAVED' END AS state FROM b UNION ALL SELECT -1, 'none', 'UNKNOWN_SERIES'""")
def recompute(spark, sf):
    by = ["user_id", "event_type"]
    r = kinetics.linear_rates(series(spark, sf), by, "t", "y").select(*by, F.when(F.col("slope").isNotNull(), F.col("n")).alias("n"))
    offered = r.select(*by, (F.col("n") + F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)).alias("n")).unionByName(spark.createDataFrame([(-1, "none", 3)], "user_id bigint, event_type string, n bigint"))
    return assays.recomputed(offered, r, by, ["n"])


@query("source_agreement", "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'MISSING' WHEN item_id % 3 = 0 THEN 'CORRUPT' ELSE 'VERIFIED' END AS source_state FROM benchmark")
def source_agreement(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("sha", F.sha2("text", 256))
    kept = b.filter("item_id % 5 <> 0").select("sha", F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return assays.source_agreement(b.select("item_id", "sha"), kept, "sha", "content").select("item_id", "source_state")


RATES = "r AS (SELECT p_brand AS enzyme, p_size::DOUBLE AS s, avg(5 * p_size / (20 + p_size) + (p_partkey * 7919 % 101 - 50) / 1000.0) AS v FROM part GROUP BY 1, 2)"


@query("mm_level_checks", f"""WITH {RATES}, m AS (SELECT enzyme, s, round(v, 1) AS m, round(v, 1) < lag(round(v, 1)) OVER (PARTITION BY enzyme ORDER BY s) AS fall FROM r),
a AS (SELECT enzyme, count(*) AS n, coalesce(bool_or(fall), false) AS fall, min(s) AS low, max(s) AS high, min(m) AS least, max(m) AS most FROM m GROUP BY 1)
SELECT enzyme, n, n AS levels, concat_ws(';', CASE WHEN high / 20 < 0.1 OR low / 20 > 10 THEN 'EXTREME_COVERAGE' END, CASE WHEN high / 20 < 3 THEN 'SATURATION_NOT_COVERED' END, CASE WHEN low / 20 > 0.5 THEN 'LOW_CONCENTRATIONS_NOT_COVERED' END,
  CASE WHEN high / low < 10 THEN 'NARROW_CONCENTRATION_RANGE' END, CASE WHEN n < 6 THEN 'FEW_RATES' END, CASE WHEN least = most THEN 'CONSTANT_RATE' END, CASE WHEN fall THEN 'NONMONOTONIC_RATES' END) AS issues FROM a""")
def level_checks(spark, sf):
    return assays.level_checks(rates(spark, sf).withColumn("v", F.round("v", 1)), ["enzyme"], "s", "v", F.lit(20.0))


@query("finite_results", "SELECT vec_id, vec_id % 4 = 1 OR vec_id % 4 = 2 AS not_finite FROM embeddings")
def finite_results(spark, sf):
    e, k = table(spark, sf, "embeddings"), F.col("vec_id") % 4
    nested = e.select("vec_id", F.struct(F.when(k == 1, float("nan")).otherwise(1.0).alias("x"), F.array(F.struct(F.when(k == 2, float("inf")).otherwise(0.5).alias("y"))).alias("rows")).alias("fit"), F.when(k != 3, "t").alias("note"))
    return nested.select("vec_id", assays.not_finite(nested.schema).alias("not_finite"))


@query("result_fingerprint", """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_suppkey":' || s_suppkey || '}') AS fingerprint FROM supplier""")
def result_fingerprint(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name").withColumn("calculated_at_utc", F.current_timestamp())
    return s.select("s_suppkey", assays.fingerprint(s.columns).alias("fingerprint"))
