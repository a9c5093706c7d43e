"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams per language give a log-probability matrix, which is broadcast (its size is the
table of slots times the languages, whatever the corpus); batches are scored in numpy as sparse matrices of n-gram counts. Priors count all training rows; n-gram counts come from about
fit_docs rows a language, drawn by a hash of the id, all rows where a language has fewer.

Defined cases: a text that is null or has no letter (Unicode category L) is `und` with score 0; without training rows every text is; rows with a null id are
scored, not learned from and not held out; an empty table gives an empty result;
very long texts are scored whole, in parts; repeated rows agree; of languages that tie the first in the alphabet wins; input columns named like a result column are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import table
from quillon.runtime import flat_map, map_columns

#: Expected training documents a language.
FIT_DOCS = 3000
BITS = 16
GRAMS = (1, 2, 3)
LETTER = regex.compile(r"\p{L}")
#: N-grams that are scored at once.
PART = 1 << 18
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def slots(text: str, n: int) -> np.ndarray:
    """A slot of the hash table for each n-gram of the lower-cased characters."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    m = len(chars) - n + 1
    if m <= 0:
        return np.zeros(0, np.intp)
    h = np.full(m, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h = (h ^ chars[k : k + m]) * np.uint32(MULTIPLIERS[k])
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.intp)


def gram_counts(text: str) -> np.ndarray:
    return np.bincount(np.concatenate([slots(text, n) for n in GRAMS]), minlength=1 << BITS)


def log_matrix(counts: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    """counts: languages x slots. Log probabilities as slots x languages, float32."""
    smooth = counts + alpha
    return np.ascontiguousarray(np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32))


def gram_parts(batch: list[str | None], rows: list[int]):
    """Sparse counts of the rows' texts: (row, slot, count) arrays, some PART n-grams at once, rows ascending."""
    keys: list[np.ndarray] = []
    size = 0
    for row in rows:
        for n in GRAMS:
            own = slots(batch[row], n)
            for at in range(0, len(own), PART):
                keys.append((row << BITS) | own[at : at + PART])
                size += len(keys[-1])
                if size >= PART:
                    yield np.unique(np.concatenate(keys), return_counts=True)
                    keys, size = [], 0
    if keys:
        yield np.unique(np.concatenate(keys), return_counts=True)


def score_batch(batch: list[str | None], matrix: np.ndarray, prior: np.ndarray, names: list[str]) -> tuple[list[str], list[float]]:
    """The batch as a sparse matrix of n-gram counts, times the log matrix."""
    rows = [k for k, t in enumerate(batch) if t and names and LETTER.search(t)]
    total = np.tile(prior.astype(np.float64), (len(batch), 1))
    for key, count in gram_parts(batch, rows):
        row = key >> BITS
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.intp)
        weighted = matrix[key & ((1 << BITS) - 1)] * count[:, None].astype(np.float64)
        if len(first):
            total[row[first]] += np.add.reduceat(weighted, first, axis=0)
    pred, score = ["und"] * len(batch), [0.0] * len(batch)
    for k in rows:
        p = np.exp(total[k] - total[k].max())
        best = int(p.argmax())
        pred[k], score[k] = names[best], float(p[best] / p.sum())
    return pred, score


def remainder(id_col: str, modulus: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def fit(train: DataFrame, text_col: str, lang_col: str, key_col: str, fit_docs: int = FIT_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log matrix and log priors. train holds training rows only."""
    per_lang = {r[0]: r[1] for r in train.groupBy(lang_col).count().collect()}  # a row a language
    names = sorted(per_lang)
    if not names:
        return [], np.zeros((1 << BITS, 0), np.float32), np.zeros(0)
    share = F.pmod(F.xxhash64(F.lit("language"), F.col(key_col)), F.lit(1 << 30))
    limit = F.coalesce(*[F.when(F.col(lang_col) == n, F.lit(int(min(1.0, fit_docs / per_lang[n]) * (1 << 30)))) for n in names])
    sample = train.select(lang_col, text_col).filter(share < limit)

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in found:
                    found[lang] = np.zeros(1 << BITS, np.int64)
                found[lang] += gram_counts(text or "")
        keys = list(found)
        at = [np.flatnonzero(found[k]) for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([a.astype("<u4").tobytes() for a in at], pa.binary()), pa.array([found[k][a].astype("<i8").tobytes() for k, a in zip(keys, at)], pa.binary())], names=["lang", "slots", "counts"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("slots", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    counts = np.zeros((len(names), 1 << BITS))
    for lang, at, n in flat_map(sample.repartition(8), schema, count).toLocalIterator():  # eight tasks' sums a language
        counts[names.index(lang), np.frombuffer(at, "<u4")] += np.frombuffer(n, "<i8")
    prior = np.log(np.array([per_lang[n] for n in names], float))
    return names, log_matrix(counts), prior - np.log(np.exp(prior - prior.max()).sum()) - prior.max()


def language_id(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        names, matrix, prior = shared.value

        def f(b: pa.RecordBatch) -> list[pa.Array]:
            pred, score = score_batch(b.column(text_col).to_pylist(), matrix, prior, names)
            return [pa.array(pred, pa.string()), pa.array(score, pa.float64())]

        return f

    return map_columns(docs, RESULT, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", 3) != 1)), "text", "lang", "doc_id")
    return language_id(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
