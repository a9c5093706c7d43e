"""Alignment identity, graphs over similarity edges, greedy clustering and splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.aggregates import running
from quillon.operators.graph import connected_components

#: Match, mismatch, gap opening and gap extension scores.
MATCH, MISMATCH, OPEN, EXTEND = 2, -1, -2, -1


def global_identity(a: str, b: str) -> float:
    """Matches over columns, gaps included, of a best global alignment with affine gaps. Of equal alignments diagonals win, then gaps in b, then in a."""
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    low = -(10**9)
    x = np.frombuffer(a.encode("utf-32-le"), "<u4")
    y = np.frombuffer(b.encode("utf-32-le"), "<u4")
    # three layers: ends in a pair, in a gap in b (a's letter alone), in a gap in a; each cell keeps its score and best origin
    D, P, Q = (np.full((n + 1, m + 1), low, np.int64) for _ in range(3))
    D[0, 0] = 0
    P[1:, 0] = OPEN + EXTEND * np.arange(n)
    Q[0, 1:] = OPEN + EXTEND * np.arange(m)
    for i in range(1, n + 1):
        best = np.maximum(np.maximum(D[i - 1], P[i - 1]), Q[i - 1])
        D[i, 1:] = best[:-1] + np.where(y == x[i - 1], MATCH, MISMATCH)
        P[i, 1:] = np.maximum(np.maximum(D[i - 1, 1:], Q[i - 1, 1:]) + OPEN, P[i - 1, 1:] + EXTEND)
        opened = np.maximum(D[i], P[i]) + OPEN  # from the cell on the left
        run = np.maximum.accumulate(opened[:-1] - EXTEND * np.arange(m))
        Q[i, 1:] = run + EXTEND * np.arange(m)
    i, j, same, columns = n, m, 0, 0
    layer = int(np.argmax([D[n, m], P[n, m], Q[n, m]]))
    while i or j:
        columns += 1
        if layer == 0:
            same += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
            layer = int(np.argmax([D[i, j], P[i, j], Q[i, j]])) if i or j else 0
        elif layer == 1:
            i -= 1
            layer = int(np.argmax([D[i, j] + OPEN, P[i, j] + EXTEND, Q[i, j] + OPEN])) if i or j else 0
        else:
            j -= 1
            layer = int(np.argmax([D[i, j] + OPEN, P[i, j] + OPEN, Q[i, j] + EXTEND])) if i or j else 0
    return same / columns


@F.pandas_udf(T.DoubleType())
def identity(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    for key in zip(a, b):
        if key not in known:
            known[key] = global_identity(key[0] or "", key[1] or "")
    return pd.Series([known[key] for key in zip(a, b)], dtype="float64")


def paired_identity(pairs: DataFrame, sequences: DataFrame, chains: tuple[str, str] = ("VH", "VL"), id_col: str = "id") -> DataFrame:
    """Candidate pairs (left_id, right_id) with each chain's identity and the smaller of them."""
    h, l = chains
    left = sequences.select(F.col(id_col).alias("left_id"), F.col(h).alias("__ah"), F.col(l).alias("__al"))
    right = sequences.select(F.col(id_col).alias("right_id"), F.col(h).alias("__bh"), F.col(l).alias("__bl"))
    j = pairs.select("left_id", "right_id").join(left, "left_id").join(right, "right_id")
    out = j.select("left_id", "right_id", identity("__ah", "__bh").alias(f"{h}_identity"), identity("__al", "__bl").alias(f"{l}_identity"))
    return out.withColumn("paired_identity", F.least(f"{h}_identity", f"{l}_identity"))


def edge_category(vh: Column, vl: Column, t: float) -> Column:
    return F.when((vh >= t) & (vl >= t), "BOTH").when(vh >= t, "VH_ONLY").when(vl >= t, "VL_ONLY")


def policy_edges(identities: DataFrame, policy: str, t: float) -> DataFrame:
    vh, vl = F.col("VH_identity") >= t, F.col("VL_identity") >= t
    keep = {"SINGLE_CHAIN_OR": vh | vl, "PAIRED_AND": vh & vl, "PAIRED_MIN": F.col("paired_identity") >= t}[policy]
    return identities.filter(keep)


def components(nodes: DataFrame, id_col: str, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, component) of all nodes, isolated ones too; a component is named by its smallest member."""
    found = connected_components(edges, src, dst)
    return nodes.select(id_col).distinct().join(found, F.col(id_col) == F.col("node"), "left").select(id_col, F.coalesce("root", id_col).alias("component"))


def entity_components(rows: DataFrame, id_col: str, *keys: str) -> DataFrame:
    """Components of rows that share a value of any key. A key's rows are linked to its smallest row: edges are as many as rows, whatever the group."""
    edges = None
    for k in keys:
        low = rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(id_col).alias("__low"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
        e = rows.join(low, k).filter(F.col(id_col) != F.col("__low")).select(F.col("__low").alias("a"), F.col(id_col).alias("b"))
        edges = e if edges is None else edges.unionByName(e)
    return components(rows, id_col, edges, "a", "b")


def hashed_components(assigned: DataFrame, id_col: str) -> DataFrame:
    """(component, size, component_hash): sha-256 of the sorted members, joined by line feeds. Members of one component are gathered."""
    members = F.sort_array(F.collect_list(F.col(id_col).cast("string")))
    return assigned.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sha2(F.array_join(members, "\n"), 256).alias("component_hash"))


def split_turns(size: int, n: int, target: list[float], have: list[int]) -> list[tuple[int, int, list[int]]]:
    """(first rank, last rank, splits that take turns) of n components of one size, each to the split that lacks most; have is updated.

    Splits whose wants are within one size of the largest take turns, until their wants fall to those of the others: a few patterns, however many the components.
    """
    out, k = [], 1
    while n:
        now, picks = list(have), []
        while len(picks) < min(n, len(target)):
            to = max(range(len(target)), key=lambda i: (target[i] - now[i], -i))
            if to in picks:
                break
            picks.append(to)
            now[to] += size
        rest = [target[i] - have[i] for i in range(len(target)) if i not in picks]
        cycles = n // len(picks)
        if rest:
            cycles = min(cycles, max(1, int((min(target[i] - have[i] for i in picks) - max(rest)) / size) - 1))
        cycles = max(1, cycles)
        out.append((k, k + cycles * len(picks) - 1, picks))
        for i in picks:
            have[i] += size * cycles
        k += cycles * len(picks)
        n -= cycles * len(picks)
    return out


def greedy_split(sizes: DataFrame, component: str, size: str, shares=(("TRAIN", 0.6), ("VALIDATION", 0.2), ("TEST", 0.2))) -> DataFrame:
    """(component, size, split): whole components, the largest first, each to the split that lacks most; ties go by the splits' order.

    The driver sees the histogram of sizes and makes a few patterns of turns for each size; components find theirs by their rank among their size.
    """
    histogram = sorted(((r[0], r[1]) for r in sizes.groupBy(size).count().collect()), reverse=True)  # a row a size
    total = sum(s * n for s, n in histogram)
    target, have = [w * total for _, w in shares], [0] * len(shares)
    turns = [(s, low, high, [shares[i][0] for i in picks]) for s, n in histogram for low, high, picks in split_turns(s, n, target, have)]
    plan = sizes.sparkSession.createDataFrame(turns or [(0, 0, 0, ["TRAIN"])], "__s bigint, __low bigint, __high bigint, __turn array<string>")
    ranked = running(sizes.select(component, size, F.lit(1).alias("__one")), [size], component, ["__one"]).withColumn("__rank", F.col("before___one") + 1)
    turn = F.expr("__turn[int((__rank - __low) % size(__turn))]")
    return ranked.join(plan, (F.col(size) == F.col("__s")) & F.col("__rank").between(F.col("__low"), F.col("__high"))).select(component, size, turn.alias("split"))


def degrees(edges: DataFrame, src: str, dst: str) -> DataFrame:
    both = edges.select(F.col(src).alias("node"), F.col(dst).alias("other")).unionByName(edges.select(F.col(dst).alias("node"), F.col(src).alias("other")))
    return both.groupBy("node").agg(F.countDistinct("other").alias("degree"))


def articulation_points(edges: list[tuple]) -> set:
    """Nodes whose removal splits their component, by an iterative depth-first search."""
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    order: dict = {}
    low: dict = {}
    out = set()
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        children, stack = 0, [(root, None, iter(sorted(near[root])))]
        while stack:
            node, parent, rest = stack[-1]
            for x in rest:
                if x not in order:
                    order[x] = low[x] = len(order)
                    children += node == root
                    stack.append((x, node, iter(sorted(near[x]))))
                    break
                if x != parent:
                    low[node] = min(low[node], order[x])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if parent != root and low[node] >= order[parent]:
                        out.add(parent)
        if children > 1:
            out.add(root)
    return out


def component_articulation(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(component, node) of articulation points; the edges of one component are gathered."""
    roots = connected_components(edges, src, dst)
    keyed = edges.join(roots, F.col(src) == F.col("node")).select(F.col("root").alias("component"), F.col(src).alias("a"), F.col(dst).alias("b"))
    kind = keyed.schema["a"].dataType
    schema = T.StructType([T.StructField("component", kind), T.StructField("node", kind)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sorted(articulation_points(list(zip(pdf["a"], pdf["b"]))))
        return pd.DataFrame({"component": [pdf["component"].iloc[0]] * len(found), "node": found}, dtype=object)

    return keyed.groupBy("component").applyInPandas(run, schema)


def greedy_clusters(nodes: DataFrame, id_col: str, identities: DataFrame, t: float) -> DataFrame:
    """(id, representative): in id order, each joins the first earlier representative within t in both chains, or becomes one.

    Only nodes of one component of the accepted edges can meet, so the sequential fold runs per component.
    """
    edges = policy_edges(identities, "PAIRED_AND", t).select("left_id", "right_id")
    assigned = components(nodes, id_col, edges, "left_id", "right_id")
    per = edges.join(assigned, F.col("left_id") == F.col(id_col)).select("component", F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    kind = nodes.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("representative", kind)])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["a"], pdf["b"]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        reps: list = []
        out = []
        for x in sorted(near):
            rep = next((r for r in reps if r in near[x]), None)
            if rep is None:
                reps.append(x)
            out.append((x, rep if rep is not None else x))
        return pd.DataFrame(out, columns=schema.names)

    linked = per.groupBy("component").applyInPandas(run, schema)
    alone = nodes.select(id_col).distinct().join(linked.select(id_col), id_col, "left_anti")
    return linked.unionByName(alone.select(id_col, F.col(id_col).alias("representative")))
