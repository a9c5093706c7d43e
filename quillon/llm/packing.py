"""Best-fit packing by minimum bin slack.

Documents become pieces of at most `capacity` tokens. There are at most `capacity` different lengths, so the corpus is planned by the number of
pieces a length: per bin, a bitset subset-sum dynamic program over the available lengths, seeded with the longest, finds the fullest
feasible combination, which is removed as often as the counts allow at once. The plan has a few thousand patterns whatever the corpus. Pieces find their
places by their rank among pieces of their length: a task numbers its own, and sums over tasks give the
offsets. Nothing but counts by length reaches the driver.

Token ids come from the tokenizer file; texts are cut before blanks that a non-blank follows, where the vocabulary's byte-level splitting always cuts,
and a distinct cut is put together from known ones or encoded, and remembered, up to CACHE cuts in a worker.

Defined cases: a null text is empty and gives the end token alone; rows with a null id are packed like others; repeated rows are packed each; an
empty table gives an empty result; very long texts are tokenised whole and cut into pieces; columns other than the id and the text are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table
from quillon.runtime import flat_map, materialize

CAPACITY = 2048
#: Cuts whose ids a worker remembers: some 140 MB.
CACHE = 600_000
_CUT = re.compile(r" (?=\S)")
#: A blank that no non-blank follows; without one, every blank is a cut.
_ODD = re.compile(r" (?:\s|\Z)")
#: The byte-level splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PROBE = "It's  a\n\n probe, naïve 123 <|endoftext|>\t… of_words \u3042!! "


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Remembered(dict):
    """Ids of cuts as bytes; a cut that is not there yet is encoded behind the blank, or none, that it was cut at.

    With lines, the cuts of line starts, a new cut is put together from known ones where the byte-level splitting always cuts: around a line feed
    between two characters that aren't white space, and between a letter and a mark that ends the cut.
    """

    def __init__(self, lead: str, encode, lines: Remembered | None = None, split: bool = False):
        super().__init__()
        self.lead, self.encode, self.split = lead, encode, split
        self.lines = self if lines is None else lines
        self.single = {x: array("I", encode(x)).tobytes() for x in "\n.,;:!?"}

    def __missing__(self, cut: str) -> bytes:
        if self.split and len(cut) > 1:
            if "\n" in cut:
                parts = cut.split("\n")
                if all(p and not p[0].isspace() and not p[-1].isspace() for p in parts):
                    feed, later = self.single["\n"], self.lines
                    return self[parts[0]] + b"".join([feed + later[p] for p in parts[1:]])  # seldom met again, so not remembered
            elif cut[-1] in self.single and cut[-2].isalpha():
                self[cut] = ids = self[cut[:-1]] + self.single[cut[-1]]
                return ids
        self[cut] = ids = array("I", self.encode(self.lead + cut)).tobytes()
        return ids


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit numbers.

    A cut that is not remembered is encoded by tiktoken with the ranks of the tokenizer file's vocabulary, which is three times faster
    there than the tokenizers library; a file whose ids the two do not agree on in a probe is left to the latter.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.fast = self._ranked()
        encode = self.fast.encode_ordinary if self.fast else lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.first = Remembered("", encode, split=bool(self.fast))
        self.later = Remembered(" ", encode, self.first, split=bool(self.fast))

    def _ranked(self):
        import tiktoken

        letters, special = byte_letters(), {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocab = {w: k for w, k in self.tokenizer.get_vocab(with_added_tokens=True).items() if w not in special}
        if any(c not in letters for w in vocab for c in w):
            return None
        fast = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in w): k for w, k in vocab.items()}, special_tokens={})
        return fast if fast.encode_ordinary(PROBE) == self.tokenizer.encode(PROBE, add_special_tokens=False).ids else None

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.first) + len(self.later) > CACHE:
            self.first.clear()
            self.later.clear()
        first, later, out = self.first, self.later.__getitem__, []
        for text in texts:
            own = _CUT.split(text) if _ODD.search(text) else text.split(" ")
            out.append(first[own[0]] + b"".join(map(later, own[1:])))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, but for the first."""
    first = n % capacity or capacity
    return [(0, min(n, first))] + [(s, capacity) for s in range(first, n, capacity)]


def fullest(counts: dict[int, int], seed: int, capacity: int) -> list[int]:
    """The seed and the available lengths that fill the rest best: subset sums as bits of a number, lengths from the longest down."""
    room = capacity - seed
    reach, steps = 1, []  # bit s: the sum s is feasible
    mask = (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        n = min(counts[length] - (length == seed), room // length)
        k = 1
        while n > 0:  # multiplicities by powers of two
            take = min(k, n)
            before = reach
            reach |= (reach << (length * take)) & mask
            if reach != before:
                steps.append((length, take, before))
            n -= take
            k *= 2
        if reach >> room & 1:
            break
    left, out = reach.bit_length() - 1, [seed]
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            out += [length] * take
            left -= length * take
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one bin, how often) that use every piece once."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while counts:
        pattern = fullest(counts, max(counts), capacity)
        need = {x: pattern.count(x) for x in set(pattern)}
        times = min(counts[x] // n for x, n in need.items())
        for x, n in need.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((pattern, times))
    return out


def slots_by_length(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset), ordered by rank; a row holds for `times` ranks."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.setdefault(x, []).append((used.get(x, 0), sequence, offset))
            used[x] = used.get(x, 0) + times
            offset += x
        sequence += times
    return {x: np.array(v, np.int64) for x, v in rows.items()}


def piece_schema(id_field: T.StructField, with_ids: bool) -> T.StructType:
    fields = [id_field, T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("__task", T.IntegerType()), T.StructField("__rank", T.LongType())]
    return T.StructType(fields + [T.StructField("ids", T.BinaryType())] * with_ids)


def tokenize(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row per piece, numbered within its task and length."""
    schema = piece_schema(docs.schema[id_col], with_ids)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path).encode
        task = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                owner, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
                for row, data in enumerate(encode([t or "" for t in b.column(1).to_pylist()])):
                    data += end
                    for k, (s, n) in enumerate(cut_points(len(data) // 4, capacity)):
                        part = data[4 * s : 4 * (s + n)]
                        owner.append(row)
                        piece.append(k)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        rank.append(ranks[n])
                        ranks[n] += 1
                        if with_ids:
                            ids.append(part)
                arrays = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(piece), pa.int32()), pa.array(rank, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * with_ids, names=names)

    return flat_map(docs.select(id_col, text_col), schema, run)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and its ids (little-endian 32 bits) if asked for."""
    spark = docs.sparkSession
    pieces = materialize(tokenize(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids), "pieces")
    counts = materialize(pieces.groupBy("__task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # a row a length, capacity at most
    shared = spark.sparkContext.broadcast(slots_by_length(plan(histogram, capacity)))
    before = F.sum("n").over(W.partitionBy("length").orderBy("__task").rowsBetween(W.unboundedPreceding, -1))
    bases = counts.select("__task", "length", F.coalesce(before, F.lit(0)).alias("__base"))  # a row a task and length
    ranked = pieces.join(bases.hint("merge"), ["__task", "length"])  # bases grow with the tasks, so they are never broadcast
    kept = [c for c in pieces.columns if not c.startswith("__")]
    schema = T.StructType([pieces.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = shared.value
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("__rank").to_numpy() + b.column("__base").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at, own = np.flatnonzero(length == x), slots[int(x)]
                k = np.searchsorted(own[:, 0], rank[at], "right") - 1
                sequence[at] = own[k, 1] + rank[at] - own[k, 0]
                offset[at] = own[k, 2]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)], names=schema.names)

    return flat_map(ranked, schema, place)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces packed with their ids; a sequence's pieces fill its capacity at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("__p")).select("sequence_id", F.aggregate("__p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), default_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
