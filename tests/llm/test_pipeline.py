"""The pipeline's stages on hostile tables and against brute force on real documents."""

import itertools
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

SMALL = "/root/testdata/sf0.001"
PROSE = "the committee met in the old hall to discuss plans for the coming winter and the repair of the bridge over the river"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, __x string, fingerprint string, kept_text string, spans string, hit_spans string, items string, n_words string, length string"
ROWS = [(1, PROSE), (1, PROSE), (2, PROSE), (3, None), (4, ""), (None, "A line\nother"), (None, None), (5, PROSE + " again " * 30_000), (6, "\n\n"), (7, PROSE.upper()), (8, "日本語 ½ \u0000 x")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), *["x"] * 9) for i, t in rows], SCHEMA).withColumnRenamed("__x", "extra").repartition(3)


@pytest.mark.parametrize("number", range(5))
def test_stage_on_hostile_rows(spark, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = docs_of(spark, ROWS)
    out = stage(spark, docs, SMALL)
    rows = out.collect()
    last = number + 1 == len(corpus_pipeline.STAGES)
    if not last:
        assert out.columns == docs.columns
        passed = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert Counter(map(str, out.select(*passed).collect())) <= Counter(map(str, docs.select(*passed).collect()))
        if name in ("quality classifier", "near-dedup"):
            assert Counter(map(str, rows)) <= Counter(map(str, docs.collect()))
    if name == "near-dedup":
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 3), (False, 5), (False, 8), (True, 0)]  # one of equal and of wholly tied rows
    if name in ("line dedup", "decontamination"):
        assert len(rows) == len(ROWS)
    if last:
        assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}) == len(rows) >= len(ROWS)
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def brute_groups(texts, k=5, t=0.8):
    """Classes of texts that links of similarity t join, by an index of all shingles."""
    sets = []
    for x in texts:
        w = (x or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append({b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    index = {}
    for i, s in enumerate(sets):
        for x in s or {None}:
            index.setdefault(x, []).append(i)
    both = Counter(p for own in index.values() for p in itertools.combinations(own, 2))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for (i, j), n in both.items():
        if not sets[i] and not sets[j] or n / (len(sets[i]) + len(sets[j]) - n) >= t:
            pairs += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], pairs


def test_near_dedup_of_real_documents(spark):
    """End to end on the documents of sf0.01: groups by brute force over all pairs, and how many of them the stage finds."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    root, pairs = brute_groups([r.text for r in rows])
    want = {rows[k].doc_id for k in set(root)}
    got = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SMALL).select("doc_id").collect()}
    gone = {r.doc_id for r in rows} - want
    assert pairs > 50 and want <= got  # no document of another group goes
    assert len(gone - got) >= 0.9 * len(gone)


def test_line_and_decontamination_by_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    n = Counter(k for r in rows for k in {key(x) for x in (r.text or "").split("\n")} if k)
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if n[key(x)] < 10) for r in rows}
    assert {r.doc_id: r.text for r in corpus_pipeline.STAGES[1][1](spark, docs, SMALL).collect()} == want
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    held = {x for t in items for x in windows(t)}
    out = corpus_pipeline.STAGES[3][1](spark, docs, SMALL).collect()
    assert not any(held & set(windows(r.text)) for r in out)  # no window of an item is left
    clean = [r for r in rows if not held & set(windows(r.text))]
    assert {r.doc_id: r.text for r in out}.items() >= {r.doc_id: r.text for r in clean}.items()


def windows(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(w[i : i + 10]) for i in range(len(w) - 9)]


def test_quality_stage_follows_the_scores(spark):
    from quillon.llm import quality

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    scored = quality.query(spark, SMALL).filter(F.col("predicted") == 1).select("doc_id").collect()
    assert {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, SMALL).select("doc_id").collect()} == {r.doc_id for r in scored}
