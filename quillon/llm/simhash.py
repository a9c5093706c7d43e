"""SimHash near-dedup with Golay-code keys.

A 64-bit fingerprint falls into segments of 22, 21 and 21 bits. Of two fingerprints that differ in at most two bits, some segment
agrees wholly, by the pigeonhole principle, and the next one differs in at most two bits. The (23, 12) Golay code is perfect, so
every 23-bit word decodes to one codeword; the words within one bit of a segment decode to at most six
codewords, and segments within two bits share one of them, as they share a word between them. A key is
(segment number, its bits, codeword index of the next segment): 33 bits and some 16 keys a fingerprint. Fingerprints that share a key are verified.

Copies collapse first: keys are made once a fingerprint, whatever its documents. A key of more than BUCKET fingerprints (a large family of near
copies) is not compared pairwise: its fingerprints are exploded to the 65 words within one bit, and those that share such a word, at most 65, are all
within two bits of each other; a star links them. Both ways are exact.

Defined cases: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle give one shingle; rows with a null
id are kept and never represent others; repeated rows agree; an empty table gives an empty result; of very long texts all shingles count; input columns named like a
result column are replaced by it. The text column is left out of the result, so that neither scratch tables nor the join by fingerprint carry texts; the rows of one
fingerprint (all empty texts, say) meet one row of that join, whose large partitions Spark splits.
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table, texts
from quillon.operators.graph import connected_components
from quillon.runtime import flat_map, map_columns, materialize

BUCKET = 256
MAX_BITS = 2
#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the (23, 12) Golay code.
GOLAY = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
FINGERPRINT = T.StructType([T.StructField("fingerprint", T.LongType())])
_xxh = partial(xxhash.xxh64_intdigest, seed=42)


def shingles(words: list[bytes], k: int) -> list[bytes]:
    if len(words) < k:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(k)))))


def fingerprint(text: bytes, k: int = 3) -> int:
    """Bits set in over half the shingles' hashes, as a signed 64-bit number."""
    own = shingles(text.lower().split(), k)
    if not own:
        return 0
    h = np.fromiter(map(_xxh, own), np.uint64, len(own))
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):
        total += np.unpackbits(h[at : at + 8192].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(total * 2 > len(h), bitorder="little").view("<i8")[0])


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23-bit words' low and high parts, and the error pattern of each syndrome."""

    def remainder(v: int) -> int:
        for b in range(22, 10, -1):
            if v >> b & 1:
                v ^= GOLAY << (b - 11)
        return v

    bits = [remainder(1 << b) for b in range(23)]
    low, high = np.zeros(1 << 12, np.uint32), np.zeros(1 << 11, np.uint32)
    for b in range(23):
        part, at = (low, b) if b < 12 else (high, b - 12)
        part[(np.arange(len(part)) >> at & 1) == 1] ^= np.uint32(bits[b])
    errors = np.zeros(1 << 11, np.uint32)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                e = (1 << a) | (1 << b) | (1 << c)
                errors[remainder(e)] = e
    return np.concatenate([low, high]), errors


def codewords(v: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each 23-bit word."""
    syndromes, errors = golay_tables()
    return (v ^ errors[syndromes[v & np.uint32(0xFFF)] ^ syndromes[(v >> np.uint32(12)) + np.uint32(1 << 12)]]) >> np.uint32(11)


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position in fps) of all keys of the uint64 fingerprints."""
    part = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]
    keys, owners = [], []
    for i in range(3):
        j = (i + 1) % 3
        near = np.stack([part[j]] + [part[j] ^ np.uint32(1 << b) for b in range(SEGMENTS[j][1])], axis=1)
        index = np.sort(codewords(near), axis=1)
        first = np.ones(index.shape, bool)
        first[:, 1:] = index[:, 1:] != index[:, :-1]
        row, col = np.nonzero(first)
        keys.append((np.int64(i) << 40) | (part[i][row].astype(np.int64) << 12) | index[row, col].astype(np.int64))
        owners.append(row)
    return np.concatenate(keys), np.concatenate(owners)


def linked_pairs(members: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b), a < b, of fingerprints within max_bits."""
    a, b = np.nonzero(np.triu(np.bitwise_count(members[:, None] ^ members[None, :]) <= max_bits, 1))
    return a, b


EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def fingerprint_links(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links that join all distinct fingerprints within two bits into the same components."""

    def explode(batches):
        for b in batches:
            fps = b.column(0).to_numpy()
            keys, owner = golay_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[owner])], names=["key", "fp"])

    def verify(batches):
        for b in batches:
            left, right = [], []
            for group in b.column(0).to_pylist():
                own = np.unique(np.array(group, np.int64))
                x, y = linked_pairs(own.view(np.uint64))
                left.append(own[x])
                right.append(own[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left) if left else np.zeros(0, np.int64)), pa.array(np.concatenate(right) if right else np.zeros(0, np.int64))], names=["a", "b"])

    keyed = flat_map(classes.select("fingerprint"), T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType())]), explode)
    sizes = materialize(keyed.groupBy("key").count().filter("count > 1"), "key_sizes")
    shared = keyed.join(sizes, "key")  # keys of one fingerprint end here
    grouped = shared.filter(F.col("count") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = flat_map(grouped, EDGE, verify)
    if sizes.filter(F.col("count") > bucket).isEmpty():
        return links
    hot = shared.filter(F.col("count") > bucket).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    near = hot.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("word"))
    balls = near.groupBy("word").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 at most
    return links.unionByName(balls.select("a", F.explode("fps").alias("b")).filter("a <> b"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket: int = BUCKET) -> DataFrame:
    """docs, but for the text, with fingerprint (signed 64 bits) and component_id, the smallest id of the documents reachable over links."""

    def make():
        return lambda b: [pa.array([fingerprint(t, shingle) for t in texts(b.column(text_col))], pa.int64())]

    marked = materialize(map_columns(docs, FINGERPRINT, make, drop=("component_id", text_col)), "fingerprints")
    classes = materialize(marked.groupBy("fingerprint").agg(F.min(id_col).alias("__rep")), "classes")
    nodes = connected_components(fingerprint_links(classes, bucket), "a", "b")
    rooted = classes.join(nodes, classes["fingerprint"] == nodes["node"], "left").select("fingerprint", "__rep", F.coalesce("root", "fingerprint").alias("__root"))
    lowest = rooted.groupBy("__root").agg(F.min("__rep").alias("component_id"))
    of_class = materialize(rooted.join(lowest, "__root").select("fingerprint", "component_id"), "components")
    return marked.join(of_class, "fingerprint").select(*marked.columns, "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_near_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
