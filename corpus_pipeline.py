"""Corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the
last return the columns of documents. A stage first deletes the scratch tables of the one before, whose result has been written by then; those of the
last stage stay for its result, until the session ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, line_dedup, packing, quality, similar
from quillon.llm.common import table
from quillon.runtime import materialize, owned_by, release_scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Documents of a lower probability of good quality go.
QUALITY = 0.3


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its further columns under names that no operator's result has, and those names."""
    names = {c: f"column {k} kept" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    return docs.withColumnsRenamed(names), names


def restored(out: DataFrame, docs: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    """The columns of docs, each under its own name again, or as changed."""
    return out.select(*[changed.get(c, F.col(f"`{names.get(c, c)}`")).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are scored like others; repeated rows share their fate."""
    own, names = shielded(docs)
    scored = quality.quality_scores(own, quality.contract_model(spark, docs.select("doc_id", "text"), sf_dir))
    return restored(scored.filter(F.col("score") >= QUALITY), docs, names)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more have; all rows stay. A null text stays null unless it loses a line."""
    own, names = shielded(docs)
    out = line_dedup.line_dedup(own)
    cut = F.col("n_dropped") > 0
    return restored(out, docs, names, text=F.when(cut, F.col("kept_text")).otherwise(F.col("text")), n_chars=F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group whose five-word shingles are similar to 0.8 or more; texts without words, null ones too, are one group."""
    return similar.representatives(docs, shingle=5, similarity=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that they share with the benchmark; those that mostly consist of such spans go. Texts without words stay."""
    own, names = shielded(docs)
    out = decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark"))
    return restored(out, docs, names, n_chars=F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, null and empty ones too, and their places in sequences of 2048 tokens; very long texts are cut into pieces."""
    packed = packing.pack(docs, packing.default_tokenizer())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tidy(stage: Stage, keep: bool = False) -> Stage:
    """The stage, which deletes the pipeline's scratch tables so far and, unless they are to be kept, leaves its own to the next one."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_scratch("pipeline")
        with owned_by("pipeline result" if keep else "pipeline"):
            return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality classifier", tidy(quality_stage)),
    ("line dedup", tidy(line_stage)),
    ("near-dedup", tidy(near_dedup_stage)),
    ("decontamination", tidy(decontamination_stage)),
    ("packing", tidy(packing_stage, keep=True)),
]
#: SQL can express neither the classifier, the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if number + 1 == len(STAGES):
            return out
        with owned_by("pipeline result"):  # read by the next stage only, deleted at exit
            docs = materialize(out, "stage")
