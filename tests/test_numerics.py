"""Kinetics, statistics and alignment against published values and second formulations."""

import math
import random

import numpy as np
import pytest

from quillon.operators import identity, kinetics, learning, stats
from quillon.operators.graph import connected_components

S = [2.0, 5.0, 10.0, 20.0, 40.0, 80.0, 160.0]
NOISE = [0.01, -0.03, 0.02, -0.04, 0.06, -0.02, 0.03]


def test_saturation_fit():
    fit = kinetics.michaelis_menten(S, [5 * s / (20 + s) for s in S])
    assert fit["km"] == pytest.approx(20, rel=1e-12) and fit["vmax"] == pytest.approx(5, rel=1e-12)
    fit = kinetics.profile_intervals(S, [5 * s / (20 + s) + n for s, n in zip(S, NOISE)])
    assert fit["km"] == pytest.approx(20.282195311, rel=1e-9) and fit["vmax"] == pytest.approx(5.0327506396, rel=1e-9)
    assert (fit["km_low"], fit["km_high"]) == pytest.approx((19.2121252683, 21.4111763123), rel=1e-9)
    assert (fit["vmax_low"], fit["vmax_high"]) == pytest.approx((4.94704477248, 5.12052316954), rel=1e-9)


def test_saturation_rejects():
    assert kinetics.michaelis_menten([1, 2, 3], [1, 2, 3]) is None
    assert kinetics.michaelis_menten([0.01 * s for s in S], [5 * 0.01 * s / (20000 + s) for s in S]) is None


def test_constant_series(spark):
    rows = [("a", float(t), 5.0) for t in range(5)] + [("b", float(t), 2.0 * t + 5) for t in range(5)] + [("c", 0.0, 1.0), ("c", 1.0, 2.0)]
    got = {r.k: r for r in kinetics.linear_rates(spark.createDataFrame(rows, "k string, t double, y double"), ["k"], "t", "y").collect()}
    assert got["a"].slope == 0 and got["a"].r_squared is None
    assert got["b"].slope == 2 and got["b"].slope_se == 0 and got["b"].r_squared == 1
    assert got["c"].slope is None


def test_draws_do_not_depend_on_partitions(spark):
    load = [[0.02, 0.01]] * 7
    one = kinetics.propagate(spark, S, [5 * s / (20 + s) for s in S], load, 0.02, 8)
    a = {r.draw: r.km for r in one.collect()}
    rng = np.random.Generator(np.random.PCG64(20261110))
    u = rng.random((8, 9)) * 2 - 1
    s, v = np.array(S), np.array([5 * x / (20 + x) for x in S])
    for k in range(8):
        own = v * (1 + np.array(load) @ u[k, :2]) + 0.02 * u[k, 2:]
        assert a[k] == pytest.approx(kinetics.michaelis_menten(s, own)["km"], rel=1e-12)


def test_tails_and_fdr(spark):
    assert stats.t_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    df = spark.createDataFrame([("a", 0.01), ("b", 0.02), ("c", 0.5), ("d", None)], "k string, p double")
    got = {r.k: r.q for r in stats.benjamini_hochberg(df, "p", [], "k").collect()}
    assert [got[k] for k in "abc"] == pytest.approx([0.03, 0.03, 0.5]) and got["d"] is None


def test_tau_against_pairs():
    rng = random.Random(2)
    pts = [(rng.randint(0, 6), rng.randint(0, 6)) for _ in range(60)]
    sign = lambda v: (v > 0) - (v < 0)
    c = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for i, a in enumerate(pts) for b in pts[:i])
    tx = sum(a[0] == b[0] for i, a in enumerate(pts) for b in pts[:i])
    ty = sum(a[1] == b[1] for i, a in enumerate(pts) for b in pts[:i])
    n = len(pts) * (len(pts) - 1) // 2
    cells = sorted((float(x), float(y), pts.count((x, y))) for x, y in set(pts))
    assert stats.tau_b(cells) == pytest.approx(c / math.sqrt((n - tx) * (n - ty)))


def test_identity():
    assert identity.global_identity("", "") == 1 and identity.global_identity("A", "") == 0
    assert identity.global_identity("AAAAAAAAAA", "AAAAAAAAAC") == 0.9
    assert identity.global_identity("ACDEFGHIK", "ACDEGHIK") == pytest.approx(8 / 9)


def test_components_and_articulation(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(200 + k, 201 + k) for k in range(40)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert identity.articulation_points([(1, 2), (2, 3), (3, 1), (3, 4)]) == {3}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 2)) * [1, 5]
    y = x @ [2, -1] + 3 + rng.normal(size=50)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    (_, w), = learning.ridge_grid(df, ["a", "b"], "y", [2.5])
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 2.5 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert w[1:] == pytest.approx(want.tolist()) and w[0] == pytest.approx(y.mean() - want @ x.mean(0))


def test_greedy_split(spark):
    rng = random.Random(4)
    comps = [(f"c{k:03}", rng.choice([1, 1, 1, 2, 5, 9])) for k in range(80)]
    df = spark.createDataFrame(comps, "component string, size bigint")
    got = {r.component: r.split for r in identity.greedy_split(df, "component", "size").collect()}
    total = sum(s for _, s in comps)
    have, target = [0, 0, 0], [0.6 * total, 0.2 * total, 0.2 * total]
    for c, s in sorted(comps, key=lambda x: (-x[1], x[0])):
        k = max(range(3), key=lambda i: (target[i] - have[i], -i))
        have[k] += s
        assert got[c] == ("TRAIN", "VALIDATION", "TEST")[k]


def test_bootstrap_resamples_rows(spark, tmp_path):
    import pandas as pd

    from quillon.plans import stat_queries

    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, 300)
    own = pd.DataFrame({"g": "a", "x": x.astype(float), "y": (x + rng.integers(0, 20, 300)).astype(float)})
    r = stats.bootstrap(spark.createDataFrame(own), ["g"], "x", "y").first()
    draws = [own.iloc[rng.integers(0, 300, 300)][["x", "y"]].rank().corr().iloc[0, 1] for _ in range(1000)]
    assert np.allclose([r.low, r.high], np.quantile(draws, [0.025, 0.975]), atol=0.02) and abs(r.rho - own.x.rank().corr(own.y.rank())) < 1e-9
    rows = [("a", int(30 * a), "z" * int(b)) for a, b in zip(own.x, own.y)]
    docs = spark.createDataFrame(rows, "lang string, n_chars bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same = stats.bootstrap(docs.selectExpr("lang", "CAST(n_chars AS DOUBLE) AS x", "CAST(length(text) AS DOUBLE) AS y"), ["lang"], "x", "y", resamples=2000).first()
    assert stat_queries.QUERIES["bootstrap_intervals"](spark, str(tmp_path)).first() == same and same.rho == r.rho


def test_split_turns_follow_the_greedy_rule():
    import random

    from quillon.operators.identity import split_turns

    rng = random.Random(3)
    for _ in range(200):
        shares = rng.choice([[0.6, 0.2, 0.2], [0.8, 0.1, 0.1], [0.5, 0.5], [0.34, 0.33, 0.33]])
        histogram = sorted(((rng.randint(1, 40), rng.randint(1, 300)) for _ in range(rng.randint(1, 6))), reverse=True)
        target = [w * sum(s * n for s, n in histogram) for w in shares]
        have, plain = [0] * len(shares), [0] * len(shares)
        for s, n in histogram:
            got = []
            for low, high, picks in split_turns(s, n, target, have):
                got += [picks[(r - low) % len(picks)] for r in range(low, high + 1)]
            want = []
            for _ in range(n):
                to = max(range(len(shares)), key=lambda i: (target[i] - plain[i], -i))
                plain[to] += s
                want.append(to)
            assert got == want


def test_hierarchy_of_any_depth(spark):
    from quillon.operators.store import hierarchy_walk

    chain = [(k, k - 1 if k else None) for k in range(150)]
    loop = [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 9999)]
    got = {r.id: (r.steps, r.cycle) for r in hierarchy_walk(spark.createDataFrame(chain + loop, "id bigint, parent bigint")).collect()}
    assert all(got[k] == (k + 1, False) for k in range(150))
    assert got[1000] == (4, True) and got[1003] == (5, True) and got[2000] == (1, False)


def test_running_sums_in_groups(spark):
    from pyspark.sql import functions as F

    from quillon.operators.aggregates import average_ranks
    from quillon.operators.stats import benjamini_hochberg

    df = spark.createDataFrame([(g, v) for g in ("a", None) for v in (2.0, 1.0, 2.0, 4.0)], "g string, v double")
    assert {(r.g, r.v): r.rank for r in average_ranks(df, ["g"], "v", "rank").collect()} == {(g, v): r for g in ("a", None) for v, r in ((1.0, 1.0), (2.0, 2.5), (4.0, 4.0))}
    p = spark.createDataFrame([("x", 0.01), ("y", 0.02), ("z", 0.5), ("n", None)], "id string, p double")
    q = {r.id: r.q for r in benjamini_hochberg(p, "p", []).collect()}
    assert [round(q[k], 9) for k in "xyz"] == [0.03, 0.03, 0.5] and q["n"] is None
    grouped = benjamini_hochberg(p.withColumn("g", F.lit(None).cast("string")), "p", ["g"])
    assert {r.id: r.q for r in grouped.collect()} == q


def test_covariance_issue():
    import numpy as np

    from quillon.operators.assays import covariance_issue

    load = np.diag([1.0, 1e-100, 0.0, 2.0, 3.0])
    good = load @ load.T / 3
    assert covariance_issue(load, good) is None
    for at, value, why in (((0, 0), -1.0, "NEGATIVE_VARIANCE"), ((2, 2), 1.0, "COVARIANCE_LOADING_MISMATCH"), ((0, 3), 0.1, "INVALID_COVARIANCE"), ((4, 4), 1.0, "COVARIANCE_LOADING_MISMATCH")):
        cov = good.copy()
        cov[at] = value
        assert covariance_issue(load, cov) == why
