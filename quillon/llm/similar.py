"""Near-duplicate groups by word-shingle similarity, with SimHash sketches as keys.

A document's distinct shingle hashes, sorted, fall into parts by their leading bits; parts have some 4 to 16 shingles at two neighbouring levels, which the
document's size picks, so similar documents share a level. The SimHash fingerprint of each of the first PARTS parts is a key, and so are the whole
document's Golay keys (see simhash). An edit changes few parts, so documents of similarity 0.8 share a key almost surely (some 98 % by the
parts alone at exactly 0.8, more above). Of sets of at most SHORT shingles, whose parts are too few, the smallest n - ceil(similarity * n) + 1 hashes are the
keys: two similar sets share one of them (prefix filtering). Sets that can be similar to one of SHORT have both kinds.

Documents of equal shingle sets are one class. Of the classes that share a key the smallest is compared with each of the others, by the exact
Jaccard similarity of their shingle sets; verified links join components. Where a key still holds several components, another of them gives the next
pivot, ROUNDS times: comparisons grow with the postings, not with the square of a group. Keys whose other classes then lie in several components are
open: their classes are joined by rare shingles (see rare_pairs), which misses no similar pair of theirs, so every similar pair that shares a key ends in one component:
ROUNDS is how often the cheap comparison is tried, not a limit.

A candidate pair's texts are fetched only if the parities of SKETCH counters of their shingles allow the similarity: each shingle that one set has and the other hasn't
changes one parity, so more different parities than that similarity leaves room for rule a pair out for certain.

Defined cases: null and empty texts have no shingles and form one group; texts of fewer words than a shingle are one shingle; null ids come last when a group's
representative is chosen; of wholly tied rows exactly one is it; an empty table gives an empty result; of very long texts all shingles count; columns named like a result column are replaced by it, names that start with two
underscores are reserved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import row_key, texts
from quillon.llm.simhash import _xxh, golay_keys, shingles
from quillon.operators.graph import connected_components
from quillon.runtime import discard, flat_map, map_columns, materialize

PARTS = 12
ROUNDS = 3
#: Row numbers of 8 bytes that a broadcast holds at most.
BROADCAST_ROWS = 2_000_000
SHORT = 64
LEAST = 3  # shingles of a part that make a key
#: Counters of shingles, 4 bytes each in a broadcast.
SLOTS = 1 << 20
#: Parities of a class.
SKETCH = 1024
#: Earlier shingles that a shingle of a prefix carries, so that a pair comes from its first common one alone; beyond them it can come twice.
EARLIER = 64
MARK = T.StructType([T.StructField("__class", T.LongType()), T.StructField("__n", T.IntegerType()), T.StructField("__keys", T.BinaryType()), T.StructField("__sketch", T.ArrayType(T.LongType()))])


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    own = shingles(text.lower().split(), k)
    return np.fromiter(map(_xxh, own), np.uint64, len(own))


def majority(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive groups of hashes."""
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).astype(np.int32)
    total = np.add.reduceat(bits, starts, axis=0)
    n = np.diff(np.append(starts, len(h)))[:, None]
    return np.packbits(total * 2 > n, axis=1, bitorder="little").view("<u8").ravel()


def keys_of(h: np.ndarray, parts: int = PARTS, similarity: float = 0.8) -> np.ndarray:
    """Keys of a document's sorted distinct shingle hashes."""
    if not len(h):
        return np.zeros(1, np.int64)
    out = []
    if len(h) * similarity <= SHORT + 1e-6:
        prefix = h[: len(h) - math.ceil(len(h) * similarity - 1e-6) + 1]
        out.append(((prefix >> np.uint64(1)) | np.uint64(1 << 63)).view(np.int64))  # negative, unlike the other keys
    if len(h) <= SHORT:
        return np.unique(out[0])
    out.append(golay_keys(majority(h, np.zeros(1, np.intp)))[0])
    level = max(0, (len(h) // 8).bit_length() - 1)
    for low in (level, level + 1):
        number = (h >> np.uint64(64 - low)).astype(np.int64) if low else np.zeros(len(h), np.int64)
        m = int(np.searchsorted(number, parts))
        if not m:
            continue
        starts = np.flatnonzero(np.concatenate(([True], number[1:m] != number[: m - 1])))
        size = np.diff(np.append(starts, m))
        mixed = h[:m] * np.uint64(0x9E3779B97F4A7C15)  # leading bits agree within a part
        print_ = majority(mixed ^ (mixed >> np.uint64(32)), starts)
        tag = np.uint64(low << 20) + number[starts].astype(np.uint64)
        key = (print_ ^ (tag * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        keep = (size >= LEAST) | (low == 0)
        out.append(((key[keep] >> np.uint64(2)) | np.uint64(1 << 62)).view(np.int64))
    return np.unique(np.concatenate(out))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def parities(h: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Parities of the numbers of a set's hashes in each slot, as 64-bit words."""
    odd = np.bincount((h >> np.uint64(8)).astype(np.int64) & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def room_for(n: Column, m: Column, similarity: float) -> Column:
    """The most hashes that only one of two similar sets of n and m hashes has."""
    return n + m - 2 * F.ceil((n + m) * (similarity / (1 + similarity)) - 1e-6)


def allowed(edges: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of classes that their sketches don't rule out."""
    of = lambda x: classes.select(F.col("__class").alias(x), F.col("__n").alias(f"n{x}"), F.col("__sketch").alias(f"s{x}"))
    different = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return edges.join(of("a"), "a").join(of("b"), "b").filter(different <= room_for(F.col("na"), F.col("nb"), similarity)).select("a", "b")


def verified(edges: DataFrame, bodies: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Edges (a, b) of classes whose similarity is reached; bodies: (class, text)."""
    a, b = bodies.select(F.col("__class").alias("a"), F.col("text").alias("ta")), bodies.select(F.col("__class").alias("b"), F.col("text").alias("tb"))
    joined = edges.join(a, "a").join(b, "b").select("a", "b", "ta", "tb")

    def run(batches):
        last: tuple[bytes | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            for x, y in zip(texts(batch.column(2)), texts(batch.column(3))):
                if x != last[0]:
                    last = (x, np.unique(shingle_hashes(x, shingle)))
                keep.append(jaccard(last[1], np.unique(shingle_hashes(y, shingle))) >= similarity)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return flat_map(joined, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]), run)


def rare_first(h: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a set by their slots' counts, then by value, and for each the greatest size of a set that can be similar if it is their first common one.

    Sets of a and b hashes are similar if similarity / (1 + similarity) * (a + b) are common; if the first is at position i, at most a - i are.
    """
    h = h[np.lexsort((h, counts[h >> np.uint64(44)]))]
    size = (len(h) - np.arange(len(h))) * ((1 + similarity) / similarity) - len(h)
    m = int(np.searchsorted(-size, -(similarity * len(h) - 1e-6), "right"))  # smaller ones are not similar by their size
    return h[:m], np.floor(size[:m] + 1e-6).astype(np.int64)


def rare_pairs(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of rows (class, label, text) of different labels: all similar pairs are among them.

    The larger set of a pair gives the hashes that leave room for a set of similarity * its size, the smaller one those that leave room for its own size.
    Shingles that many rows have come last, so a template of many rows makes no pairs unless it makes rows similar.
    """

    def count(batches):
        for b in batches:
            h = [np.unique(shingle_hashes(t, shingle)) for t in texts(b.column("text"))]
            slot, n = np.unique(np.concatenate([*h, np.zeros(0, np.uint64)]) >> np.uint64(44), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    schema = T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType())])
    found = flat_map(rows, schema, count).groupBy("slot").agg(F.sum("n").alias("n")).filter("n > 1").toPandas()
    counts = np.ones(SLOTS, np.int32)
    counts[found["slot"].to_numpy(np.int64)] = np.minimum(found["n"].to_numpy(np.int64), 2**31 - 1)
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def prefix(batches):
        for b in batches:
            h = [np.unique(shingle_hashes(t, shingle)) for t in texts(b.column("text"))]
            own, room = zip(*(rare_first(x, shared.value, similarity) for x in h)) if h else ((), ())
            size = [len(x) for x in own]
            row = [np.repeat(x, size) for x in (b.column("class").to_numpy(), b.column("label").to_numpy(), np.array([len(x) for x in h], np.int64))]
            token, room = np.concatenate([*own, np.zeros(0, np.uint64)]), np.concatenate([*room, np.zeros(0, np.int64)])
            word = [parities(x, 256).view("<i8") for x in h]
            words = [np.repeat(np.array([w[k] for w in word], np.int64), size) for k in range(4)]
            before = [x[: min(k, EARLIER)].view(np.int64) for x in own for k in range(len(x))]
            ends = np.cumsum([0, *map(len, before)]).astype(np.int32)
            earlier = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*before, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), *map(pa.array, row), pa.array(room), *map(pa.array, words), earlier], names=schema.names)

    names = ("class", "label", "n", "room", "w0", "w1", "w2", "w3")
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("token", *names)] + [T.StructField("earlier", T.ArrayType(T.LongType()))])
    tokens = materialize(flat_map(rows, schema, prefix), "tokens")
    other = tokens.filter("room >= n").select("token", *(F.col(x).alias(f"{x}2") for x in (*names, "earlier")))
    sizes = f"label <> label2 AND (n2 < n OR n2 = n AND class2 < class) AND n2 >= n * {similarity!r}D - 1e-6 AND n2 <= room AND n <= room2"
    different = sum((F.bit_count(F.col(f"w{k}").bitwiseXOR(F.col(f"w{k}2"))) for k in range(4)), F.lit(0))
    first = F.coalesce(~F.arrays_overlap("earlier", "earlier2"), F.lit(True))
    pairs = tokens.join(other, (tokens["token"] == other["token"]) & F.expr(sizes) & (different <= room_for(F.col("n"), F.col("n2"), similarity)) & first)
    return pairs.select(F.greatest("class", "class2").alias("a"), F.least("class", "class2").alias("b")).distinct()


def few(rows: DataFrame) -> DataFrame:
    """rows, marked for a broadcast where they are at most BROADCAST_ROWS; else they are joined by a shuffle."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """docs without all rows of a group but its representative. Texts are never copied, and stay in place while the rows that go are few enough to broadcast."""
    keyed = docs.select("*", *row_key(id_col, text_col))
    light, of_class = grouped(keyed, id_col, text_col, shingle, similarity, rounds)
    gone = light.join(of_class, "__class").filter("__k1 <> __best.k1 OR __k2 <> __best.k2").select("__k1", "__k2").distinct()
    left = keyed.join(few(materialize(gone, "gone")), ["__k1", "__k2"], "left_anti")
    twins = materialize(light.groupBy("__k1", "__k2").count().filter("count > 1").select("__k1", "__k2"), "twins")  # rows of one id and one text
    if twins.isEmpty():
        return left.select(*docs.columns)
    one = left.join(few(twins), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
    return left.join(few(twins), ["__k1", "__k2"], "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, rounds: int = ROUNDS) -> DataFrame:
    """docs with group_id (the smallest id of the group) and representative, true for one row of each group."""
    numbered = materialize(docs.drop(*({"group_id", "representative"} - {id_col, text_col})).withColumns({"__k1": F.monotonically_increasing_id(), "__k2": F.lit(0).cast("long")}), "numbered")
    light, of_class = grouped(numbered, id_col, text_col, shingle, similarity, rounds)
    best = light.select("__k1", "__class").join(of_class, "__class").select("__k1", F.col("__best.i").alias("group_id"), (F.col("__k1") == F.col("__best.k1")).alias("representative"))
    return numbered.join(best, "__k1").drop("__k1", "__k2")


def grouped(keyed: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """keyed: rows with __k1, __k2. Gives (__k1, __k2, __class) of all rows, and (__class, __best) with the id (i) and key (k1, k2) of the group's representative."""

    def make():
        def f(b: pa.RecordBatch) -> list[pa.Array]:
            h = [np.unique(shingle_hashes(t, shingle)) for t in texts(b.column(text_col))]
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(np.concatenate([*(parities(x) for x in h), np.zeros(0, np.int64)])))
            return [pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) for x in h], pa.int64()), pa.array([len(x) for x in h], pa.int32()), pa.array([keys_of(x, similarity=similarity).tobytes() for x in h], pa.binary()), sketch]

        return f

    light = materialize(map_columns(keyed.select("__k1", "__k2", F.col(id_col).alias("__id"), text_col), MARK, make, drop=(text_col,)), "marked")
    first = F.min(F.struct(F.col("__id").isNull().alias("u"), F.col("__id").alias("i"), F.col("__k1").alias("k1"), F.col("__k2").alias("k2")))
    classes = materialize(light.groupBy("__class", "__n").agg(first.alias("__first"), F.min("__keys").alias("__keys"), F.min("__sketch").alias("__sketch")), "classes")  # a class's keys and sketches are equal

    def explode(batches):
        for b in batches:
            k = [np.frombuffer(x, np.int64) for x in b.column(2).to_pylist()]
            size = [len(x) for x in k]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)), pa.array(np.repeat(b.column(0).to_numpy(), size)), pa.array(np.repeat(b.column(1).to_numpy(), size))], names=["key", "class", "n"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("class", T.LongType()), T.StructField("n", T.IntegerType())])
    postings = flat_map(classes.select("__class", "__n", "__keys"), schema, explode)
    span = materialize(postings.groupBy("key").agg(F.min("class").alias("__a"), F.max("class").alias("__b")).filter("__a < __b").select("key"), "span")  # a plain shuffle in the join, which Spark can split
    shared = materialize(postings.join(span, "key"), "shared")
    involved = classes.join(shared.select(F.col("class").alias("__class")).distinct(), "__class", "left_semi").select("__class", F.col("__first.k1").alias("__k1"), F.col("__first.k2").alias("__k2"))
    found_in = keyed.select("__k1", "__k2", F.col(text_col).alias("text")).join(few(materialize(involved, "involved")), ["__k1", "__k2"])
    bodies = materialize(found_in.select("__class", "text").dropDuplicates(["__class"]), "bodies")  # rows of one id and one text are there once

    found, labels, used = None, None, None

    def labelled() -> DataFrame:
        if labels is None:
            return shared.withColumn("label", F.col("class"))
        return shared.join(labels, F.col("class") == F.col("node"), "left").select("key", "class", "n", F.coalesce("root", "class").alias("label"))

    for _ in range(rounds):
        now = open_ = labelled()
        if used is not None:
            ends = used.withColumn("label", F.col("pivot")) if labels is None else used.join(labels, F.col("pivot") == F.col("node"), "left").select("key", "pivot", F.coalesce("root", "pivot").alias("label"))
            held = ends.groupBy("key").agg(F.collect_set("label").alias("held"), F.collect_set("pivot").alias("done"))  # a pivot a round
            now = materialize(now.join(held, "key"), "labelled")
            open_ = now.filter(~F.array_contains("held", F.col("label")))
        pivots = materialize(open_.groupBy("key").agg(F.min(F.struct("class", "n", "label")).alias("p")).select("key", F.col("p.class").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.label").alias("pl")), "pivots")
        pairs = now.join(pivots, "key").filter("class <> pivot AND label <> pl")
        if used is not None:
            pairs = pairs.filter(~F.array_contains("done", F.col("class")))
        likely = F.least("n", "pn") >= F.greatest("n", "pn") * similarity
        edges = materialize(pairs.filter(likely).select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct(), "candidates")
        if used is not None:
            discard(now)
        if pivots.isEmpty():
            break
        used = pivots.select("key", "pivot") if used is None else used.unionByName(pivots.select("key", "pivot"))
        if edges.isEmpty():  # by their sizes only: other classes of the keys can be similar
            continue
        links = materialize(verified(materialize(allowed(edges, classes, similarity), "allowed"), bodies, shingle, similarity), "links")
        discard(edges)
        found = links if found is None else found.unionByName(links)
        labels = connected_components(found, "a", "b")
    left = labelled() if used is None else labelled().join(used.withColumnRenamed("pivot", "class"), ["key", "class"], "left_anti")
    several = left.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key")
    rest = materialize(left.join(several, "key").select("class", "label").distinct(), "rest")
    if not rest.isEmpty():
        open_rows = materialize(few(rest).join(bodies, F.col("class") == F.col("__class")).select("class", "label", "text"), "open")
        links = materialize(verified(materialize(rare_pairs(open_rows, shingle, similarity), "candidates"), bodies, shingle, similarity), "links")
        found = links if found is None else found.unionByName(links)
        labels = connected_components(found, "a", "b")
    if labels is None:
        rooted = classes.withColumn("__root", F.col("__class"))
    else:
        rooted = classes.join(labels, F.col("__class") == F.col("node"), "left").withColumn("__root", F.coalesce("root", "__class")).drop("node", "root")
    best = rooted.groupBy("__root").agg(F.min("__first").alias("__best"))
    of_class = materialize(rooted.join(best, "__root").select("__class", "__best"), "groups")
    return light.select("__k1", "__k2", "__class"), of_class
