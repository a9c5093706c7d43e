"""Quality classifier: naive Bayes support vectors.

N-gram indicators (characters, character classes, and repeated words) are scaled by the log ratio of their class counts; dual
coordinate descent fits a linear hinge-loss model to them, and a logistic curve fitted to margins of rows left out of that
turns margins into probabilities. The fit uses about fit_rows labelled rows, drawn by a hash of the id; scoring is one pass over
whole texts with the weights broadcast (a vector of fixed size).

Defined cases: a null text counts as empty and is scored like any other; rows with a null id are scored, not learned from and not held
out; of repeated labels the smallest counts; without both classes the score is the share of label 1, or 0.5 without labels; an empty
table gives an empty result; input columns named like a result column are replaced by it.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table, texts
from quillon.llm.language_id import remainder
from quillon.runtime import flat_map, map_columns

#: Expected labelled rows that the model is fitted on.
FIT_ROWS = 6000
BITS = 16
#: Two tables of hashed n-grams (characters, classes) and one of word-repetition indicators.
SIZE = (2 << BITS) + 64
RESULT = T.StructType([T.StructField("score", T.DoubleType())])
CLASSES = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def _hash(data: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    m = len(a) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    code = a[:m].astype(np.uint32)
    for k in range(1, n):
        code = (code << np.uint32(8)) | a[k : k + m]
    code = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
    code ^= code >> np.uint32(15)
    return (code * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _bucket(x: float) -> int:
    return min(15, int(x * 16))


def indicators(text: bytes, seen: np.ndarray) -> np.ndarray:
    """Sorted slots of the n-grams that a text has. seen: SIZE zeros, zero again afterwards."""
    for n in (1, 2, 3):
        seen[_hash(text, n)] = True
    shape = text.translate(CLASSES)
    for n in (2, 3, 4):
        seen[_hash(shape, n) + np.uint32(1 << BITS)] = True
    words = text.split()
    if words:
        base = 2 << BITS
        seen[base + _bucket(sum(map(eq, words, words[1:])) / len(words))] = True
        seen[base + 16 + _bucket(len(set(words)) / len(words) - 1e-9)] = True
        seen[base + 32 + _bucket(sum(map(bytes.isupper, words)) / len(words))] = True
    at = np.flatnonzero(seen)
    seen[at] = False
    return at


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log ratio of the smoothed shares that each indicator has of its class's documents."""
    p, q = np.full(SIZE, alpha), np.full(SIZE, alpha)
    for at, label in zip(rows, y):
        (p if label > 0 else q)[at] += 1
    n, m = (y > 0).sum(), (y <= 0).sum()
    return np.log(p / (n + 2 * alpha)) - np.log(q / (m + 2 * alpha))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 15) -> np.ndarray:
    """Weights (the last one is the bias) of the L1-loss linear SVM, rows in a fixed shuffled order an epoch."""
    w, alpha = np.zeros(SIZE + 1), np.zeros(len(y))
    square = np.array([v @ v + 1 for v in values])
    upper = np.where(y > 0, c, c * max(1.0, (y > 0).sum() / max(1, (y <= 0).sum())) ** 0.5)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            g = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), upper[i])
            if d := (new - alpha[i]) * y[i]:
                w[at] += d * v
                w[-1] += d
                moved = max(moved, abs(d))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def scaled(at: np.ndarray, r: np.ndarray) -> np.ndarray:
    v = r[at]
    return v / (np.sqrt(v @ v) or 1.0)


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve, by Newton steps on smoothed targets."""
    n, m = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n + 1) / (n + 2), 1 / (m + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - t) * margins).sum() + 1e-3 * a, (p - t).sum()])
        h = p * (1 - p) + 1e-12
        H = np.array([[(h * margins * margins).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(H + 1e-9 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_rows_model(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """Ratios, weights, curve slope and offset, and the constant score where a class is missing (else nan)."""
    y = np.where(labels > 0, 1.0, -1.0)
    if len(y) == 0 or abs(y.sum()) == len(y):
        return np.zeros(SIZE), np.zeros(SIZE + 1), 0.0, 0.0, float((y > 0).mean()) if len(y) else 0.5
    out = np.zeros(len(y), bool)  # left out for the curve: every fifth row of each class
    for label in (1.0, -1.0):
        at = np.flatnonzero(y == label)
        out[at[4::5]] = len(at) >= 10
    part = np.flatnonzero(~out)
    if out.any() and len(set(y[out])) == 2:
        r = log_count_ratios([rows[i] for i in part], y[part])
        w = dual_descent([rows[i] for i in part], [scaled(rows[i], r) for i in part], y[part])
        a, b = platt(np.array([w[rows[i]] @ scaled(rows[i], r) + w[-1] for i in np.flatnonzero(out)]), y[out])
    else:
        a, b = 4.0, 0.0
    r = log_count_ratios(rows, y)
    return r, dual_descent(rows, [scaled(x, r) for x in rows], y), a, b, float("nan")


def score_texts(batch: list[bytes], model, seen: np.ndarray) -> np.ndarray:
    r, w, a, b, constant = model
    if constant == constant:
        return np.full(len(batch), constant)
    margins = np.empty(len(batch))
    for k, text in enumerate(batch):
        at = indicators(text, seen)
        margins[k] = w[at] @ scaled(at, r) + w[-1]
    return 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS):
    """The model. labels: (id, label) training rows only."""
    labels = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).filter("__id IS NOT NULL AND __y IS NOT NULL")
    n = labels.count()
    if not n:
        return fit_rows_model([], np.zeros(0))
    share = F.pmod(F.xxhash64(F.lit("quality"), F.col("__id")), F.lit(1 << 30))
    drawn = labels.filter(share < int(min(1.0, fit_rows / n) * (1 << 30))).groupBy("__id").agg(F.min("__y").alias("__y"))
    joined = docs.select(F.col(id_col).alias("__id"), text_col).join(F.broadcast(drawn), "__id")  # fit_rows rows of 16 bytes

    def encode(batches):
        seen = np.zeros(SIZE, bool)
        for b in batches:
            found = [indicators(t, seen).astype("<u4").tobytes() for t in texts(b.column(text_col))]
            yield pa.RecordBatch.from_arrays([b.column("__id").cast(pa.string()), b.column("__y"), pa.array(found, pa.binary())], names=["k", "y", "x"])

    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.BinaryType())])
    rows = sorted((r[0], bytes(r[2]), r[1]) for r in flat_map(joined, schema, encode).toLocalIterator())
    return fit_rows_model([np.frombuffer(x, "<u4").astype(np.intp) for _, x, _ in rows], np.array([y for _, _, y in rows]))


def quality_scores(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """docs with score, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        seen = np.zeros(SIZE, bool)
        return lambda b: [pa.array(score_texts(texts(b.column(text_col)), shared.value, seen), pa.float64())]

    return map_columns(docs, RESULT, make)


def contract_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Fitted on the labelled rows whose crc32 leaves a remainder other than 0."""
    return fit(docs, table(spark, sf_dir, "labels").filter(remainder("doc_id", 5) != 0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    scored = quality_scores(docs.select("doc_id", "text", held), contract_model(spark, docs, sf_dir))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
