"""Near-duplicate groups against brute-force similarity on small families of edited copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import similar


def brute(rows, k=5, t=0.8):
    sets = [set(similar.shingle_hashes((x or "").encode(), k).tolist()) for _, x in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (not sets[i] and not sets[j]) or (both and both / (len(sets[i]) + len(sets[j]) - both) >= t):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(rows))]


def test_families(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (6, 20, 80, 400, 1500):
        for _ in range(6):
            base = [word() for _ in range(size)]
            for _ in range(5):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 50))):
                    copy[rng.randrange(size)] = word()
                rows.append((len(rows), " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "one"), (5003, "One "), (None, "one"), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("group_id", F.lit("x")).repartition(3)
    got = similar.similar_groups(df).collect()
    order = [(r.doc_id, r.text) for r in got]
    root = brute(order)
    wrong = 0
    for k, r in enumerate(got):
        own = [order[j][0] for j in range(len(got)) if root[j] == root[k]]
        wrong += r.group_id != min((x for x in own if x is not None), default=None)
    assert wrong <= 0.01 * len(got)
    assert sum(r.representative for r in got) == len({r.group_id for r in got})
    assert similar.similar_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.9])
def test_recall_of_keys(similarity):
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(300):
        n = int(rng.integers(40, 3000))
        both = int(2 * similarity / (1 + similarity) * n)
        common = rng.integers(0, 2**64, both, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**64, n - both, dtype=np.uint64)])) for _ in range(2))
        met += len(np.intersect1d(similar.keys_of(a), similar.keys_of(b))) > 0
    assert met / 300 >= 0.93


def test_template(spark):
    """Copies among pages of one template, which a pivot of their keys seldom meets, and sizes that a first pivot rules out."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    head, rows = [word() for _ in range(174)], []
    for k in range(400):
        tail = [word() for _ in range(30)]
        rows.append((len(rows), " ".join(head + tail)))
        if k % 4 == 0:
            rows.append((len(rows), " ".join(head + tail[:12] + [word() for _ in range(18)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    root = brute(rows)
    assert len(set(root)) < len(rows) - 80
    assert {r.doc_id for r in similar.representatives(df).collect()} == {rows[k][0] for k in set(root)}


def test_rare_first():
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 5, similar.SLOTS).astype(np.int32)
    for _ in range(500):
        n = int(rng.integers(1, 60))
        both = rng.integers(0, 2**64, n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, int(rng.integers(0, 1 + n // 4)), dtype=np.uint64)])) for _ in range(2))
        if similar.jaccard(a, b) < 0.8:
            continue
        a, b = sorted((a, b), key=len, reverse=True)
        (x, u), (y, v) = (similar.rare_first(h, counts, 0.8) for h in (a, b))
        _, i, j = np.intersect1d(x, y, return_indices=True)
        assert ((u[i] >= len(b)) & (v[j] >= len(a))).any()


def test_keys_of_short_texts_miss_nothing():
    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for both in range(4, 60):
        for _ in range(40):
            own = int(rng.integers(0, both // 4 + 1))
            common, x = fresh(both), int(rng.integers(0, own + 1))
            a, b = np.unique(np.concatenate([common, fresh(x)])), np.unique(np.concatenate([common, fresh(own - x)]))
            if similar.jaccard(a, b) >= 0.8 and min(len(a), len(b)) <= similar.SHORT:
                assert len(np.intersect1d(similar.keys_of(a), similar.keys_of(b)))
