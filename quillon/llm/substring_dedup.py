"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere are removed.

1. Anchors. Each window of `length` bytes is owned by its leftmost smallest q-gram hash, so equal windows are owned by equal q-grams at
   equal offsets. Neighbouring windows share owners: some 1 position in 150 is an anchor, with the run of windows that it owns.
2. Buckets. Anchors are counted by q-gram hash with a map-side combine. Those that occur once own no repeated window and end here. Where all anchors of a
   q-gram own the same run of windows with the same bytes, by a 128-bit digest, all these windows are repeated.
3. Refinement. Other buckets hold classes of different runs. One text of each class is fetched, and bucket-pointer refinement sorts the suffixes of
   many whole buckets at once: initial buckets of q-grams, q a quarter of the length, get refined by the bucket numbers of later offsets, q and 2 q
   bytes on, each round reusing the numbers of the last, until numbers stand for whole windows. Windows that share a number are repeated.
4. Buckets of more than CLASSES classes (a passage that a great many documents embed) are never gathered: a run of windows is judged
   by digests of the bytes that all of them share, and of the bytes that any of them covers. A core found once means that none is repeated, a cover found
   again means that all are; what lies between the two is halved, and its halves judged in the next round, nine rounds at most.
5. Documents get their removed spans by one join.

Passages that repeat but are shorter than `length` are not removed; where `passage` is given, a shorter length, the bytes of strings of that length that repeat are
counted as well. Both come from one search: bytes that `length` covers lie in runs that `passage` covers, so the search for `length` reads those runs only.

Defined cases: null and empty texts have no bytes; texts shorter than `length` lose nothing; rows are documents, so repeated rows repeat each other; an
empty table gives an empty result; input columns named like a result column are replaced by it. Removal can split a character; kept bytes are binary.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import row_key, table, texts
from quillon.runtime import flat_map, map_columns, materialize

LENGTH = 400
GRAM = 100
#: Bytes of a shorter passage that is reported, not removed: some 40 words.
PASSAGE = 256
PASSAGE_GRAM = 64
CLASSES = 256
#: Bytes that are hashed at once, and bytes whose suffixes are sorted at once (but for the last bucket's).
CHUNK = 1 << 20
SORTED = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    out = []
    for base in (BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    up, down = powers(CHUNK * 2 if len(data) <= CHUNK * 2 else len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    h = (total[q:] - total[:-q]) * down[: len(data) - q + 1]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: suffix minima of one block meet prefix minima of the next."""
    n = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.uint64(2**64 - 1), np.uint64)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[w - 1 : w - 1 + n])


def owned_runs(data: bytes, bounds: list[tuple[int, int]], length: int, q: int) -> tuple[np.ndarray, ...]:
    """Of the documents at bounds in data: document, first window, number of windows, anchor's offset in the first, q-gram hash."""
    h = gram_hashes(np.frombuffer(data, np.uint8), q)
    key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    owner = (sliding_min(key, length - q + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    counts = np.array([max(0, e - s - length + 1) for s, e in bounds])
    starts = np.array([s for s, _ in bounds])
    doc = np.repeat(np.arange(len(bounds)), counts)
    window = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    own = owner[window]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    n = np.diff(np.append(first, len(own)))
    return doc[first], window[first] - starts[doc[first]], n, own[first] - window[first], h[own[first]].view(np.int64)


def anchors_of(batch: list[bytes], length: int, q: int):
    """Arrays (document, first window, windows, anchor offset, q-gram hash, digest of the run's bytes as two numbers) for a list of texts."""
    todo: list[tuple[int, int, bytes]] = []

    def flush():
        data = b"".join(t for _, _, t in todo)
        sizes = np.array([len(t) for _, _, t in todo])
        at = np.cumsum(sizes) - sizes
        doc, first, n, off, h = owned_runs(data, list(zip(at.tolist(), (at + sizes).tolist())), length, q)
        start = at[doc] + first
        view = memoryview(data)
        digests = b"".join([xxhash.xxh3_128_digest(view[s:e], seed=o) for s, e, o in zip(start.tolist(), (start + n + (length - 1)).tolist(), off.tolist())])
        halves = np.frombuffer(digests, "<i8").reshape(-1, 2)
        number, base = np.array([x[:2] for x in todo], np.int64).T
        todo.clear()
        return number[doc], base[doc] + first, n, off, h, halves[:, 0], halves[:, 1]

    size = 0
    for number, text in enumerate(batch):
        for base in range(0, max(1, len(text) - length + 1), CHUNK):  # long texts in parts that share length - 1 bytes
            part = text[base : base + CHUNK + length - 1]
            if len(part) >= length:
                todo.append((number, base, part))
                size += len(part)
            if size >= CHUNK // 2:
                yield flush()
                size = 0
    if todo:
        yield flush()


def gram_numbers(raw: bytes, q: int) -> np.ndarray:
    """Numbers of the q-grams at all places: sorted by hash, neighbours of one hash compared by their bytes."""
    h = gram_hashes(np.frombuffer(raw, np.uint8), q)
    order = np.argsort(h)
    other = np.diff(h[order]) != 0
    a, b = order[:-1][~other], order[1:][~other]
    width = 8 if q >= 8 else 1
    words = np.ndarray(len(raw) - width + 1, f"<u{width}", raw, strides=(1,))
    if any((words[a + k] != words[b + k]).any() for k in {*range(0, q - width + 1, width), q - width}):  # two grams of one hash: sorted by bytes instead
        grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), q)
        return np.unique(np.ascontiguousarray(grams).view(f"V{q}").ravel(), return_inverse=True)[1].astype(np.int64)
    out = np.empty(len(h), np.int64)
    out[order] = np.append(0, np.cumsum(other))
    return out


def repeated_windows(contexts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, the windows whose bytes occur at another place of the texts, by bucket-pointer refinement."""
    raw = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts])
    counts = sizes - length + 1
    ends = np.cumsum(counts)
    windows = np.arange(ends[-1]) + np.repeat(np.cumsum(sizes) - sizes - (ends - counts), counts)
    q = depth = max(1, length // 4)
    steps = []
    while depth < length:
        steps.append(min(depth, length - depth))
        depth += steps[-1]
    places = [windows]  # whose numbers a round has to refine, last round first
    for step in steps[:0:-1]:
        needed = np.zeros(len(raw), bool)
        needed[places[-1]] = needed[places[-1] + step] = True
        places.append(np.flatnonzero(needed))
    bucket = gram_numbers(raw, q)
    for step, at in zip(steps, reversed(places)):
        pair = bucket[at] * (int(bucket.max()) + 1) + bucket[at + step]
        bucket[at] = np.unique(pair, return_inverse=True)[1]
    number = bucket[windows]
    again = np.bincount(number)[number] > 1
    return [np.flatnonzero(again[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist())]


def runs(windows: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [first, last] of sorted numbers."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > 1)
    return list(zip(windows[np.append(0, cut + 1)].tolist(), windows[np.append(cut, len(windows) - 1)].tolist()))


RANGE = T.StructType(long("gram", "f1", "f2", "low", "high"))


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def refine(groups: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated windows from gathered buckets: (gram, classes: array of (f1, f2, text))."""

    def run(batches):
        for b in batches:
            counts = b.column(1).value_lengths().to_numpy()
            grams = np.repeat(b.column(0).to_numpy(), counts).tolist()
            f1, f2, text = (c.to_pylist() for c in b.column(1).flatten().flatten())
            ends = np.cumsum(counts).tolist()
            out, start, size = [], 0, 0
            for k, (before, end) in enumerate(zip([0, *ends], ends)):
                size += sum(map(len, text[before:end]))
                if size >= SORTED or k + 1 == len(ends):
                    for c, own in zip(range(start, end), repeated_windows(text[start:end], length)):
                        out += [(grams[c], f1[c], f2[c], low, high) for low, high in runs(own)]
                    start, size = end, 0
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=RANGE.names)

    return flat_map(groups, RANGE, run)


ACTIVE = T.StructType([*long("gram", "f1", "f2", "off", "from", "to"), T.StructField("text", T.BinaryType()), *long("done", "low", "high", "c1", "c2", "d1", "d2")])


def judged_intervals(text: bytes, off: int, spans: list[tuple[int, int]], length: int):
    """(from, to, first window, last window, core digest, cover digest) of the intervals of anchor offsets that the text has windows in.

    Intervals are the same for all classes of a bucket. Equal windows have equal anchor offsets, so they share their interval's core.
    """
    last = len(text) - length
    for lo, hi in spans:
        low, high = max(0, off - hi), min(last, off - lo)
        if low <= high:
            core = xxhash.xxh3_128_digest(text[off - lo : off - hi + length] + lo.to_bytes(8, "little"), seed=hi)
            cover = xxhash.xxh3_128_digest(text[low : high + length] + lo.to_bytes(8, "little") + (off - high).to_bytes(8, "little"), seed=hi)
            yield lo, hi, low, high, *_halves(core), *_halves(cover)


def halve(classes: DataFrame, length: int, q: int) -> DataFrame:
    """Ranges of repeated windows of large buckets, by rounds of digests; classes: (gram, f1, f2, off, text)."""
    size = 1 << max(0, (length - q).bit_length() - 1)
    first = [(lo, lo + size - 1) for lo in range(0, length - q + 1, size)]

    def judge(batches):
        for b in batches:
            out = []
            intervals = zip(b.column("from").to_pylist(), b.column("to").to_pylist()) if "from" in b.schema.names else ((None, None) for _ in range(b.num_rows))
            for gram, f1, f2, off, text, done, (lo, hi) in zip(*(b.column(c).to_pylist() for c in ("gram", "f1", "f2", "off", "text", "done")), intervals):
                middle = 0 if lo is None else (lo + hi) // 2
                for a, z, low, high, *digests in judged_intervals(text, off, first if lo is None else [(lo, middle), (middle + 1, hi)], length):
                    out.append((gram, f1, f2, off, a, z, text, done, low, high, *digests))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k == 6 else pa.int64()) for k in range(14)], names=ACTIVE.names)

    found, active = None, flat_map(classes.withColumn("done", F.lit(0).cast("long")), ACTIVE, judge)
    while True:
        active = materialize(active, "active")
        # written first, so that both sides of the joins are plain shuffles, whose large partitions Spark splits
        cores = materialize(active.groupBy("gram", "c1", "c2").agg(F.count(F.lit(1)).alias("__m")).filter("__m > 1").drop("__m"), "cores")
        covers = materialize(active.groupBy("gram", "d1", "d2").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "covers")
        state = materialize(active.join(cores, ["gram", "c1", "c2"], "left_semi").join(covers, ["gram", "d1", "d2"], "left").select(*ACTIVE.names, "__n"), "judged")
        whole = state.filter("done = 0 AND __n IS NOT NULL").select(*RANGE.names)
        found = whole if found is None else found.unionByName(whole)
        rest = state.filter("done = 0 AND __n IS NULL AND `from` < `to`")
        if rest.isEmpty():
            return found
        # one text of each settled cover stays, to be compared with, where its core meets one that is open
        settled = state.filter("(done = 1 OR __n IS NOT NULL) AND `from` < `to`").dropDuplicates(["gram", "d1", "d2"]).withColumn("done", F.lit(1).cast("long"))
        settled = settled.join(rest.select("gram", "c1", "c2").distinct(), ["gram", "c1", "c2"], "left_semi")
        names = ["gram", "f1", "f2", "off", "text", "done", "from", "to"]
        rest = rest.select(*names).unionByName(settled.select(*names))
        active = flat_map(rest, ACTIVE, judge)


def repeated_spans(keyed: DataFrame, text_col: str, length: int = LENGTH, q: int = GRAM, classes: int = CLASSES) -> DataFrame:
    """(__k1, __k2, spans) of rows that lose bytes; keyed: rows with __k1, __k2 and the text."""

    def emit(batches):
        for b in batches:
            k1, k2 = b.column("__k1").to_numpy(), b.column("__k2").to_numpy()
            for doc, *columns in anchors_of(texts(b.column(text_col)), length, q):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, np.int64)) for c in (k1[doc], k2[doc], *columns)], names=ANCHOR.names)

    ANCHOR = T.StructType(long("__k1", "__k2", "first", "n", "off", "gram", "f1", "f2"))
    anchors = materialize(flat_map(keyed.select("__k1", "__k2", text_col), ANCHOR, emit), "anchors")
    grams = anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("__n"), F.min("f1").alias("__a"), F.max("f1").alias("__b"), F.min("f2").alias("__c"), F.max("f2").alias("__d"))
    grams = grams.filter("__n > 1").select("gram", (F.expr("__a <> __b OR __c <> __d")).alias("mixed"))
    again = materialize(anchors.join(materialize(grams, "grams"), "gram"), "repeated_anchors")

    mixed = again.filter("mixed").groupBy("gram", "f1", "f2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("__k1", "__k2", "first", "n", "off")).alias("rep"))
    mixed = materialize(mixed, "classes")
    wanted = mixed.select("gram", "f1", "f2", F.col("rep.__k1").alias("__k1"), F.col("rep.__k2").alias("__k2"), F.col("rep.first").alias("first"), F.col("rep.n").alias("n"), F.col("rep.off").alias("off"))
    per_doc = wanted.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("gram", "f1", "f2", "first", "n", "off")).alias("wanted"))  # a document's own anchors bound it
    CONTEXT = T.StructType([*long("gram", "f1", "f2", "off"), T.StructField("text", T.BinaryType())])

    def fetch(batches):
        for b in batches:
            out = [(c["gram"], c["f1"], c["f2"], c["off"], t[c["first"] : c["first"] + c["n"] - 1 + length]) for t, want in zip(texts(b.column(0)), b.column(1).to_pylist()) for c in want]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k == 4 else pa.int64()) for k in range(5)], names=CONTEXT.names)

    fetched = flat_map(keyed.join(per_doc, ["__k1", "__k2"]).select(text_col, "wanted"), CONTEXT, fetch)
    contexts = materialize(fetched, "contexts")
    sizes = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("__n"))
    large = materialize(sizes.filter(F.col("__n") > classes).select("gram"), "large_buckets")
    hot = not large.isEmpty()
    small = contexts.join(large, "gram", "left_anti") if hot else contexts
    ranges = refine(small.groupBy("gram").agg(F.collect_set(F.struct("f1", "f2", "text")).alias("classes")), length)
    if hot:
        ranges = ranges.unionByName(halve(contexts.join(large, "gram", "left_semi").dropDuplicates(["gram", "f1", "f2"]), length, q))
    per_class = ranges.groupBy("gram", "f1", "f2").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    per_class = materialize(mixed.select("gram", "f1", "f2", "copies").join(per_class, ["gram", "f1", "f2"], "left"), "class_ranges")

    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), (F.col("n") - 1).alias("high")))
    judged = again.join(per_class, ["gram", "f1", "f2"], "left").withColumn("ranges", F.when(~F.col("mixed") | (F.col("copies") > 1), whole).otherwise(F.col("ranges")))
    span = F.transform("ranges", lambda r: F.struct((F.col("first") + r["low"]).alias("start"), (F.col("first") + r["high"] + length).alias("end")))
    return judged.filter("ranges IS NOT NULL").select("__k1", "__k2", span.alias("spans")).groupBy("__k1", "__k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def long_runs(keyed: DataFrame, spans: DataFrame, text_col: str, length: int) -> DataFrame:
    """(__k1, __k2, base, text) of the runs of at least `length` bytes that the rows' spans cover."""
    RUN = T.StructType([*long("__k1", "__k2", "base"), T.StructField("text", T.BinaryType())])

    def cut(batches):
        for b in batches:
            out = []
            for k1, k2, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist()):
                out += [(k1, k2, s, text[s:e]) for s, e in merged([(x["start"], x["end"]) for x in own]) if e - s >= length]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.binary() if k == 3 else pa.int64()) for k in range(4)], names=RUN.names)

    able = spans.filter(F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)") >= length)
    return flat_map(keyed.select("__k1", "__k2", F.col(text_col).alias("__text")).join(able, ["__k1", "__k2"]).select("__k1", "__k2", "__text", "spans"), RUN, cut)


def nested_spans(keyed: DataFrame, text_col: str, length: int, q: int, classes: int, passage: int, passage_q: int) -> DataFrame:
    """(__k1, __k2, passages, spans): spans for the length `passage`, and those for `length`, sought in the runs that the former cover."""
    short = materialize(repeated_spans(keyed, text_col, passage, passage_q, classes), "passages")
    runs_ = long_runs(keyed, short, text_col, length).select(F.col("__k1").alias("__d1"), F.col("__k2").alias("__d2"), "base", "text")
    runs_ = materialize(runs_.select("*", F.xxhash64("__d1", "__d2", "base").alias("__k1"), F.xxhash64("base", "__d2", "__d1").alias("__k2")), "runs")
    found = repeated_spans(runs_, "text", length, q, classes).join(runs_.select("__k1", "__k2", "__d1", "__d2", "base").distinct(), ["__k1", "__k2"])
    moved = F.transform("spans", lambda x: F.struct((x["start"] + F.col("base")).alias("start"), (x["end"] + F.col("base")).alias("end")))
    whole = found.select("__d1", "__d2", moved.alias("spans")).groupBy(F.col("__d1").alias("__k1"), F.col("__d2").alias("__k2")).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return short.withColumnRenamed("spans", "passages").join(whole, ["__k1", "__k2"], "left")


RESULT = T.StructType([*long("n_bytes", "n_removed", "n_spans"), T.StructField("kept", T.BinaryType())])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = GRAM, classes: int = CLASSES, digest: bool = False, passage: int | None = None, passage_q: int = PASSAGE_GRAM) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and the kept bytes (kept_sha256 with digest), and n_passage_bytes where passage is given."""
    keyed = docs.select("*", *row_key(id_col, text_col))
    if passage:
        spans = nested_spans(keyed, text_col, length, q, classes, passage, passage_q)
    else:
        spans = repeated_spans(keyed, text_col, length, q, classes)
    result = T.StructType([*long("n_bytes", "n_removed", "n_spans"), T.StructField("kept_sha256", T.StringType()) if digest else T.StructField("kept", T.BinaryType()), *(long("n_passage_bytes") if passage else [])])
    drop = ("__k1", "__k2", "__spans", "__passages")

    def cuts(b: pa.RecordBatch, name: str) -> list[list[tuple[int, int]]]:
        return [merged([(s["start"], s["end"]) for s in own or ()]) for own in b.column(name).to_pylist()]

    def make():
        def f(b: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text, cut in zip(texts(b.column(text_col)), cuts(b, "__spans")):
                kept, pos = [], 0
                for s, e in cut:
                    kept.append(text[pos:s])
                    pos = e
                kept.append(text[pos:])
                out = b"".join(kept)
                rows.append((len(text), len(text) - len(out), len(cut), hashlib.sha256(out).hexdigest() if digest else out))
            more = [pa.array([sum(e - s for s, e in cut) for cut in cuts(b, "__passages")], pa.int64())] if passage else []
            return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary()))] + more

        return f

    joined = keyed.join(spans.withColumnsRenamed({"spans": "__spans", "passages": "__passages"}), ["__k1", "__k2"], "left")
    return map_columns(joined, result, make, drop=drop)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, digest=True, passage=PASSAGE).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
