"""Append-only store rules: issues, references, hierarchies, row counts, snapshots, time-limited entries, imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.runtime import materialize


def issues(rows: DataFrame, id_col: str, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """(id, field, code, severity) of every rule that a record breaks."""
    found = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"), F.lit(s).alias("severity"))) for f, c, cond, s in rules]))
    return rows.select(F.col(id_col).alias("id"), F.explode(found).alias("i")).select("id", "i.*")


def hierarchy_walk(edges: DataFrame) -> DataFrame:
    """(id, steps, cycle) of each node's walk to its root, however long; edges: (id, parent), a row an id.

    Steps count the nodes visited, the repeated one of a cycle too. Walks to a root double their stride each round, so a chain of n takes log n joins; nodes that reach
    no root in the rounds that n nodes need are on, or lead to, a cycle and are walked one by one until they meet a node again.
    """
    n = edges.count()
    walk = materialize(edges.select("id", F.col("parent").alias("next"), F.lit(1).cast("long").alias("steps")), "strides")
    own = edges.select("id")
    known = own.select(F.col("id").alias("__k"))
    walk = materialize(walk.join(known, F.col("next") == F.col("__k"), "left").select("id", F.col("__k").alias("next"), "steps"), "strides")  # a parent that is no node ends the walk
    stride = 1
    while stride <= n and not walk.filter("next IS NOT NULL").isEmpty():
        ahead = walk.select(F.col("id").alias("__i"), F.col("next").alias("__n"), F.col("steps").alias("__s"))
        walk = materialize(walk.join(ahead, F.col("next") == F.col("__i"), "left").select("id", F.col("__n").alias("next"), (F.col("steps") + F.coalesce("__s", F.lit(0))).alias("steps")), "strides")
        stride *= 2
    done = [walk.filter("next IS NULL").select("id", F.col("steps").cast("int").alias("steps"), F.lit(False).alias("cycle"))]
    caught = walk.filter("next IS NOT NULL").select("id")
    if caught.isEmpty():
        return done[0]
    parent = edges.select(F.col("id").alias("__id"), F.col("parent").alias("__parent"))
    paths = materialize(caught.join(edges, "id").select("id", F.col("parent").alias("next"), F.array("id").alias("path")), "paths")
    while not paths.isEmpty():
        step = materialize(paths.join(parent, F.col("next") == F.col("__id")).select("id", F.col("__parent").alias("next"), F.concat("path", F.array("__id")).alias("path"), F.array_contains("path", F.col("__id")).alias("met")), "paths")
        done.append(step.filter("met").select("id", F.size("path").alias("steps"), F.lit(True).alias("cycle")))
        paths = step.filter("NOT met").select("id", "next", "path")
    return reduce(DataFrame.unionByName, done)


def row_counts(entities: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n_rows")) for name, df in entities.items()])


def live_entries(rows: DataFrame, key: list[str], value: str, at: str, now: Column, days: int) -> DataFrame:
    """The newest value of each key that is at most `days` old."""
    return rows.filter(F.col(at) > now - F.expr(f"INTERVAL {int(days)} DAY")).groupBy(*key).agg(F.max_by(value, at).alias(value))


def snapshot(rows: DataFrame, id_col: str, payload: str) -> DataFrame:
    return rows.select(id_col, F.regexp_replace(F.base64(F.encode(payload, "UTF-8")), r"\s", "").alias("payload"), F.sha2(payload, 256).alias("payload_sha256"))


def canonical_json(rows: DataFrame) -> Column:
    """A row as JSON with its columns in sorted order, nulls kept."""
    return F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})


def append_batch(batch: DataFrame, path: str, key: str, rules: list[tuple[str, str, Column, str]]) -> DataFrame:
    """Append a batch to a Parquet entity, all or nothing. Returns its issues; rows are written only where none is an ERROR.

    One writer at a time: the check and the write are two steps, so the caller holds whatever lock its store has.
    Keys that the entity holds already are issues too (EXISTING_ID), and so are keys that repeat within the batch (DUPLICATE_ID).
    """
    spark = batch.sparkSession
    found = issues(batch, key, rules)
    repeated = batch.groupBy(F.col(key).alias("id")).count().filter("count > 1").select("id", F.lit(key).alias("field"), F.lit("DUPLICATE_ID").alias("code"), F.lit("ERROR").alias("severity"))
    found = found.unionByName(repeated)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        held = batch.join(spark.read.parquet(path).select(key), key, "left_semi")
        found = found.unionByName(held.select(F.col(key).alias("id"), F.lit(key).alias("field"), F.lit("EXISTING_ID").alias("code"), F.lit("ERROR").alias("severity")))
    if found.filter("severity = 'ERROR'").isEmpty():
        batch.write.mode("append").parquet(path)
    return found
