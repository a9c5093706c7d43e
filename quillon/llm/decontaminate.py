"""Benchmark decontamination with a generalised suffix automaton.

The automaton is built over the words of the normalised test items. A document's words stream through it; at each word it gives the
length of the longest run ending there that occurs in an item, so every run of `window` words of an item is found, and an item
shorter than that where it occurs whole. Hit words are reported, and removed as spans or with their document.

Items travel as words in slices of bounded size (slice_words), read one after another, so the driver never holds the benchmark; each task builds a slice's automaton
once. A benchmark of one slice is a map over the documents, which are not shuffled. Of a larger one each slice is a scan of the texts that writes the spans of texts
with hits alone; they meet their documents in one join at the end.

Defined cases: null and empty texts have no words; items without words never match; repeated items count each; rows are documents, so
repeated rows give repeated results; an empty table gives an empty result, an empty benchmark no hits; very long texts are streamed whole; input columns named like a result column
are replaced by it, names that start with two underscores are reserved.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import row_key, table
from quillon.runtime import flat_map, map_columns, materialize

WINDOW = 10
#: Benchmark words in one broadcast.
SLICE_WORDS = 200_000
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(LOWER)


class SuffixAutomaton:
    """Of the word runs of several items; words are numbers. Runs never cross items."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for k, words in items if words]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        # what ends at a state: the items that have its run of `window` words, and short items that it spells whole
        self.window_items: dict[int, set[str]] = {}
        self.short_items: dict[int, list[tuple[int, str]]] = {}
        for key, words in coded:
            if len(words) >= window:
                for _, state in self.window_states(words):
                    self.window_items.setdefault(state, set()).add(key)
            else:
                state = 0
                for w in words:
                    state = self.next[state][w]
                self.short_items.setdefault(state, []).append((len(words), key))
        self.shortest = min((len(words) for _, words in coded if len(words) < window), default=window)
        self.short_up: list[int] = self._nearest_short()

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def _nearest_short(self) -> list[int]:
        """For each state, itself or its nearest suffix link that spells a short item; 0 for none."""
        up = [0] * len(self.next)
        if self.short_items:
            for s in sorted(range(1, len(up)), key=self.len.__getitem__):
                up[s] = s if s in self.short_items else up[self.link[s]]
        return up

    def stream(self, words):
        """State and longest matching length at the end of each word."""
        nxt, link, length = self.next, self.link, self.len
        state = n = 0
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            yield state, n

    def window_states(self, words):
        """(end, state of the run of `window` words that ends there)."""
        for end, (state, n) in enumerate(self.stream(words)):
            if n >= self.window:
                while self.len[self.link[state]] >= self.window:
                    state = self.link[state]
                yield end, state

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of word numbers [start, end), overlapping, and the items that have occurring windows."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):  # runs of words that items have; shorter ones can't hold a window
            if b - a < self.shortest:
                continue
            for end, (state, n) in enumerate(self.stream(ids[a:b].tolist()), a + 1):
                if n >= self.window:
                    s = state
                    while self.len[self.link[s]] >= self.window:
                        s = self.link[s]
                    if s in self.window_items:
                        found |= self.window_items[s]
                        spans.append((end - self.window, end))
                s = self.short_up[state] if self.short_items else 0
                while s:
                    for size, key in self.short_items[s]:
                        if size <= n:
                            found.add(key)
                            spans.append((end - size, end))
                    s = self.short_up[self.link[s]]
        return spans, found


_automata: dict[str, SuffixAutomaton] = {}


def automaton(key: str, items: list[tuple[str, list[str]]], window: int) -> SuffixAutomaton:
    """Built once in a worker for each slice, which the key names; the last slice only is kept."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = SuffixAutomaton(items, window)
    return _automata[key]


def union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
PA_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def item_slices(benchmark: DataFrame, id_col: str, text_col: str, slice_words: int) -> Iterator[list[tuple[str, list[str]]]]:
    """The items' words, read from the table in slices of at most slice_words words (or one item); at least one slice."""
    own, n, some = [], 0, False
    for key, text in benchmark.select(F.col(id_col).cast("string"), text_col).orderBy(id_col, text_col).toLocalIterator():
        words = WORD.findall(lower(text or ""))
        if own and n + len(words) > slice_words:
            yield own
            own, n, some = [], 0, True
        if words:
            own.append((key if key is not None else "", words))
            n += len(words)
    if own or not some:
        yield own


def as_spans(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": s, "end": e} for s, e in spans]


def slice_hits(keyed: DataFrame, text_col: str, shared, key: str, window: int) -> DataFrame:
    """(__k1, __k2, spans, items) of the rows' texts that a slice hits; the scan carries nothing else."""
    schema = T.StructType([T.StructField("__k1", T.LongType()), T.StructField("__k2", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        sam = automaton(key, shared.value, window)
        for b in batches:
            out = []
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                spans, found = sam.match(WORD.findall(lower(text or "")))
                if spans:
                    out.append((k1, k2, as_spans(union(spans)), sorted(found)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), PA_SPANS, pa.list_(pa.string())))], names=schema.names)

    hits = flat_map(keyed.select("__k1", "__k2", F.col(text_col)), schema, run)
    return materialize(hits.groupBy("__k1", "__k2").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), "hits")  # equal texts have equal hits


def slice_keys(slices: Iterator) -> Iterator[tuple[str, list]]:
    return ((uuid.uuid4().hex, x) for x in slices)


def joined_hits(docs: DataFrame, slices: Iterator, text_col: str, window: int) -> DataFrame:
    """docs with __spans and __items of all slices, found by scans of the texts and joined once."""
    keyed = docs.select("*", *row_key(text_col))
    hits = None
    for key, items in slice_keys(slices):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        own = slice_hits(keyed, text_col, shared, key, window)
        shared.unpersist()
        hits = own if hits is None else hits.unionByName(own)
    per = hits.groupBy("__k1", "__k2").agg(F.flatten(F.collect_list("spans")).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))  # a row a slice
    return keyed.join(per, ["__k1", "__k2"], "left")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (runs of hit words as word numbers, end exclusive), and the items found."""
    slices = item_slices(benchmark, item_id_col, item_text_col, slice_words)
    first, second = next(slices), next(slices, None)
    if second is not None:
        both = (x for own in ((first, second), slices) for x in own)
        rows = joined_hits(docs, both, text_col, window)

        def make():
            def f(b: pa.RecordBatch) -> list[pa.Array]:
                n = [len(WORD.findall(lower(t or ""))) for t in b.column(text_col).to_pylist()]
                spans = [as_spans(union([(x["start"], x["end"]) for x in own or ()])) for own in b.column("__spans").to_pylist()]
                return [pa.array(n, pa.int64()), pa.array(spans, PA_SPANS), pa.array([x or [] for x in b.column("__items").to_pylist()], pa.list_(pa.string()))]

            return f

        return map_columns(rows, FOUND, make, drop=("__k1", "__k2", "__spans", "__items"))
    shared, key = docs.sparkSession.sparkContext.broadcast(first), uuid.uuid4().hex

    def make_one():
        sam = automaton(key, shared.value, window)

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            n, spans, found = [], [], []
            for text in b.column(text_col).to_pylist():
                words = WORD.findall(lower(text or ""))
                s, k = sam.match(words)
                n.append(len(words))
                spans.append(as_spans(union(s)))
                found.append(sorted(k))
            return [pa.array(n, pa.int64()), pa.array(spans, PA_SPANS), pa.array(found, pa.list_(pa.string()))]

        return f

    return map_columns(docs, FOUND, make_one)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words, each from its first to its last word."""
    at = [m.span() for m in WORD.finditer(lower(text))]
    for s, e in reversed(spans):
        text = text[: at[s][0]] + text[at[e - 1][1] :]
    return text


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_coverage: float = 0.5, slice_words: int = SLICE_WORDS) -> DataFrame:
    """docs whose hit words cover at most max_coverage of their words, without the hit spans.

    A span is cut from its first to its last hit word; where the cut makes a new window meet, it is cut again. With several slices the rows that a round cuts, and they
    alone, go through another one.
    """
    names = docs.columns
    slices = item_slices(benchmark, item_id_col, item_text_col, slice_words)
    first, second = next(slices), next(slices, None)
    cut = T.StructType([docs.schema[text_col], *(T.StructField(x, T.LongType()) for x in ("__words", "__hit", "__round"))])
    if second is None:
        shared, key = docs.sparkSession.sparkContext.broadcast(first), uuid.uuid4().hex

        def make():
            sam = automaton(key, shared.value, window)

            def f(b: pa.RecordBatch) -> list[pa.Array]:
                new, words, hit = list(b.column(text_col).to_pylist()), [], []
                for k, t in enumerate(new):
                    own = WORD.findall(lower(t or ""))
                    words.append(len(own))
                    hit.append(0)
                    while spans := union(sam.match(own)[0]):
                        hit[-1] += sum(e - s for s, e in spans)
                        new[k] = cut_words(new[k], spans)
                        own = WORD.findall(lower(new[k]))
                return [pa.array(new, pa.string()), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array([0] * len(new), pa.int64())]

            return f

        out = map_columns(docs, cut, make)
    else:
        def make_round():
            def f(b: pa.RecordBatch) -> list[pa.Array]:
                new, words, hit, again = [], [], [], []
                for t, own, w, h in zip(b.column(text_col).to_pylist(), b.column("__spans").to_pylist(), b.column("__words").to_pylist(), b.column("__hit").to_pylist()):
                    spans = union([(x["start"], x["end"]) for x in own or ()])
                    words.append(len(WORD.findall(lower(t or ""))) if w is None else w)
                    hit.append((h or 0) + sum(e - s for s, e in spans))
                    new.append(cut_words(t, spans) if spans else t)
                    again.append(int(bool(spans)))
                return [pa.array(new, pa.string()), pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(again, pa.int64())]

            return f

        both = (x for own in ((first, second), slices) for x in own)
        empty = F.lit(None).cast("long")
        todo, out = docs.withColumns({"__words": empty, "__hit": empty}), None
        while True:
            rows = materialize(map_columns(joined_hits(todo, both, text_col, window), cut, make_round, drop=("__k1", "__k2", "__spans", "__items")), "cut")
            out = rows.filter("__round = 0") if out is None else out.unionByName(rows.filter("__round = 0"))
            todo = rows.filter("__round = 1").drop("__round")
            if todo.isEmpty():
                break
            both = item_slices(benchmark, item_id_col, item_text_col, slice_words)
    return out.filter((F.col("__hit") <= F.col("__words") * max_coverage) | (F.col("__words") == 0)).select(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS row_id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
  FROM item, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT row_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
  FROM (SELECT row_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT row_id, p, win.n AS n, item_id FROM dwin JOIN win ON dwin.n = win.n AND dwin.s = win.s),
words AS (SELECT row_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT row_id, p, n FROM hit), LATERAL (SELECT unnest(generate_series(p, p + n - 1)) AS q) GROUP BY row_id),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row_id, item_id FROM hit) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (row_id) LEFT JOIN items USING (row_id)
"""
