"""Line dedup: lines found in many documents go from all of them.

Lines are exploded as 128-bit hashes of their normalised form, distinct documents are counted per hash with a
map-side combine, and the frequent hashes go back to the documents, whose other lines are reassembled by position.
Frequent hashes are broadcast while they are few; beyond that bound they are joined to the documents' hashes instead.

Defined cases: a null text counts as empty, one empty line; a line whose key is shorter than min_key is never dropped; a
key that repeats within a document counts once; very long texts are split whole; rows are documents, so repeated rows count each; an empty table
gives an empty result; input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import SPACE, row_key, table, texts
from quillon.runtime import flat_map, map_columns, materialize

#: So many hashes of 16 bytes are broadcast at most.
BROADCAST_HASHES = 200_000
KEPT = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())])


def line_hash(line: bytes, min_key: int) -> bytes | None:
    key = line.strip(SPACE).lower()  # bytes.lower() changes A-Z only
    if len(key) < min_key or (min_key > 1 and len(key.decode()) < min_key):
        return None
    return xxhash.xxh3_128_digest(key)


def keep_lines(text: bytes, drop, min_key: int) -> tuple[int, int, bytes]:
    """Lines, dropped lines and the text that stays."""
    lines = text.split(b"\n")
    if not drop:
        return len(lines), 0, text
    kept = [x for x in lines if line_hash(x, min_key) not in drop]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def frequent_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_key: int = 1) -> DataFrame:
    """(line_hash, n_docs) of the keys found in min_docs documents or more."""

    def run(batches):
        for b in batches:
            found = [list({h for x in t.split(b"\n") if (h := line_hash(x, min_key))}) for t in texts(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([h for x in found for h in x], pa.binary())], names=["line_hash"])

    hashes = flat_map(docs.select(text_col), T.StructType([T.StructField("line_hash", T.BinaryType())]), run)
    return hashes.groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_key: int = 1, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """docs with n_lines (before), n_dropped and kept_text."""
    spark = docs.sparkSession
    frequent = materialize(frequent_lines(docs, text_col, min_docs, min_key), "frequent_lines")
    if frequent.count() <= broadcast_hashes:
        shared = spark.sparkContext.broadcast(frozenset(bytes(r[0]) for r in frequent.select("line_hash").toLocalIterator()))

        def make():
            drop = shared.value
            return lambda b: _kept([keep_lines(t, drop, min_key) for t in texts(b.column(text_col))])

        return map_columns(docs, KEPT, make)

    def explode(batches):
        for b in batches:
            k1, k2, hs = [], [], []
            for a, c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
                own = {h for x in t.split(b"\n") if (h := line_hash(x, min_key))}
                hs += own
                k1 += [a] * len(own)
                k2 += [c] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(hs, pa.binary())], names=["__k1", "__k2", "line_hash"])

    keyed = docs.select("*", *row_key(id_col, text_col))
    schema = T.StructType([T.StructField("__k1", T.LongType()), T.StructField("__k2", T.LongType()), T.StructField("line_hash", T.BinaryType())])
    owned = flat_map(keyed.select("__k1", "__k2", text_col), schema, explode).join(frequent.select("line_hash"), "line_hash", "left_semi")
    per_doc = owned.groupBy("__k1", "__k2").agg(F.collect_set("line_hash").alias("__drop"))  # a document's own lines bound it

    def make_rows():
        return lambda b: _kept([keep_lines(t, set(d or ()), min_key) for t, d in zip(texts(b.column(text_col)), b.column("__drop").to_pylist())])

    return map_columns(keyed.join(per_doc, ["__k1", "__k2"], "left"), KEPT, make_rows, drop=("__k1", "__k2", "__drop"))


def _kept(rows: list[tuple[int, int, bytes]]) -> list[pa.Array]:
    return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT row_id, doc_id, l.line AS line, l.pos AS pos,
         translate(trim(l.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row_number() OVER () AS row_id, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) l),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN frequent f ON lines.key = f.key
GROUP BY row_id, doc_id
"""
