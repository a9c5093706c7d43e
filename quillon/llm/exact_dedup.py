"""Exact dedup by two-pass Bloom filtering.

Pass 1 puts every row's 256-bit text hash into a blocked Bloom filter with counters that stop at two; a task sends
only the slots that it touched, at most twice each, and blocks are merged by block number. Pass 2 tests each row: if
all its slots were hit twice, the row is possibly repeated and shuffles; every other row is certainly unique and
passes straight through. The possibly repeated rows are then grouped by the whole hash, so a false alarm costs a shuffled row,
never a wrong result. The filter's blocks grow with the rows; they are broadcast in slices of bounded size, a scan a slice.

Defined cases: a null text equals an empty one; of equal texts the one with most code points, then the smallest id, null ids
last, stays; of wholly tied rows exactly one stays; an empty table gives an empty result; texts of any length count whole; input columns named like a result column are
replaced by it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import SPACE, table
from quillon.runtime import flat_map, materialize, prepare

SLOTS, PER_ROW, HASHES = 1 << 18, 16, 4
#: Blocks of 32 KB that one broadcast holds at most: 64 MB, for 33 million rows.
BROADCAST_BLOCKS = 2048
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def places(digests: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and the slots within it of each 32-byte digest."""
    words = digests.view("<u8").reshape(-1, 4)
    return (words[:, 0] % np.uint64(blocks)).astype(np.int64), digests.view("<u4").reshape(-1, 8)[:, 2 : 2 + HASHES] & np.uint32(SLOTS - 1)


def matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, in the JVM, where replacing one character at a time takes half as long as translate."""
    bare = reduce(lambda c, x: F.replace(c, F.lit(x)), SPACE.decode(), F.coalesce(text, F.lit("")))
    return F.unhex(F.sha2(bare, 256))


def repeated_blocks(digests: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): for each block, a bit for each slot that was hit at least twice."""

    def emit(batches):
        seen = [matrix(b.column(0).to_pylist()) for b in batches if b.num_rows]
        if not seen:
            return
        rows, count = np.unique(np.concatenate(seen).view("V32").ravel(), return_counts=True)
        rows = np.repeat(rows, np.minimum(count, 2)).view(np.uint8).reshape(-1, 32)  # a task's copies of one text count twice at most
        block, slots = places(np.ascontiguousarray(rows), blocks)
        order = np.argsort(block, kind="stable")
        own, first = np.unique(block[order], return_index=True)
        parts = np.split(slots[order].astype("<u4"), first[1:])
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([p.tobytes() for p in parts], pa.binary())], names=["block", "slots"])

    def merge(batches):
        for b in batches:
            out = []
            for parts in b.column(1).to_pylist():
                hits = np.bincount(np.frombuffer(b"".join(parts), "<u4"), minlength=SLOTS)
                out.append(np.packbits(hits >= 2).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["block", "bits"])

    slots = flat_map(digests, T.StructType([T.StructField("block", T.LongType()), T.StructField("slots", T.BinaryType())]), emit)
    grouped = slots.groupBy("block").agg(F.collect_list("slots").alias("parts"))  # a block's share of rows bounds it, and twice a task for hot ones
    return flat_map(grouped, T.StructType([T.StructField("block", T.LongType()), T.StructField("bits", T.BinaryType())]), merge)


def tester(low: int, high: int, blocks: int, shared):
    """0: a row of another slice, 1: unique, 2: possibly repeated."""

    @F.pandas_udf(T.ByteType())
    def state(digest: pd.Series) -> pd.Series:
        out = np.zeros(len(digest), np.int8)
        if len(digest):
            block, slots = places(matrix(digest), blocks)
            for k in np.unique(block[(block >= low) & (block < high)]):
                at = np.flatnonzero(block == k)
                bits, s = np.frombuffer(shared.value[int(k)], np.uint8), slots[at]
                out[at] = 1 + ((bits[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).all(axis=1)
        return pd.Series(out)

    return state


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """docs, dropped rows too, with keep_id, group_size, kept and text_sha256."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.drop(*[c for c in RESULT if c != id_col]).withColumns({"__digest": text_digest(F.col(text_col)), "__chars": F.length(F.coalesce(F.col(text_col), F.lit("")))})
    blocks = max(1, -(-PER_ROW * docs.count() // SLOTS))
    filters = materialize(repeated_blocks(rows.select("__digest"), blocks), "bloom")
    unique, maybe = [], []
    for low in range(0, blocks, broadcast_blocks):
        high = min(blocks, low + broadcast_blocks)
        own = {r[0]: bytes(r[1]) for r in filters.filter(F.col("block").between(low, high - 1)).toLocalIterator()}
        state = tester(low, high, blocks, spark.sparkContext.broadcast(own))
        tested = rows.withColumn("__state", state(F.col("__digest")))
        unique.append(tested.filter(F.col("__state") == 1).drop("__state"))
        maybe.append(tested.filter(F.col("__state") == 2).drop("__state"))
    passed, again = unique[0], maybe[0]
    for u, m in zip(unique[1:], maybe[1:]):
        passed, again = passed.unionByName(u), again.unionByName(m)
    again = materialize(again.withColumn("__row", F.monotonically_increasing_id()), "possibly_repeated")  # once written, row numbers are firm

    order = F.struct(-F.col("__chars"), F.col(id_col).isNull(), F.col(id_col), F.col("__row"))
    groups = materialize(again.groupBy("__digest").agg(F.min(order).alias("__top"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"), "groups")
    joined = again.join(groups, "__digest", "left")
    names = [c for c in rows.columns if not c.startswith("__")]
    sha = F.lower(F.hex(F.col("__digest"))).alias("text_sha256")
    repeated = joined.select(*names, F.when(F.col("__top").isNull(), F.col(id_col)).otherwise(F.col("__top")[id_col]).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("__top").isNull() | (F.col("__top")["__row"] == F.col("__row"))).alias("kept"), sha)
    return passed.select(*names, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha).unionByName(repeated)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *RESULT)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS rn
  FROM d)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, text_sha256 FROM w
"""
