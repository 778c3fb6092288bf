"""A training corpus in five stages; each reads what its predecessor wrote. Part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tailspark.llm import exact_dedup, mixing, order_minhash, pieces
from tailspark.llm import toxicity as tox
from tailspark.llm.common import delete_path, fresh, save, small_batches, table, written

#: A document is rejected from this score on.
THRESHOLD = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below THRESHOLD; the model learns from labelled rows of the table documents."""
    model = tox.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    with small_batches(spark):
        return save(tox.score_toxicity(docs, model, score_col=score).filter(F.col(score) < THRESHOLD).drop(score), "clean")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return order_minhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated, kept or left out by the sources' target weights."""
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with piece ids and their n best segmentations in place of the text; a text that decoding doesn't give back raises."""
    out = pieces.encode(docs)
    whole = F.when(F.col("decoded_ok"), F.col("piece_ids")).otherwise(F.raise_error(F.lit("a text doesn't survive encoding")).cast("array<int>"))
    with small_batches(spark):
        return save(out.withColumn("piece_ids", whole).drop("text"), "pieces")


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("encoding", encoded)]

#: Scores, sketches and segmentations aren't SQL; the stages are tested against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written to the shared folder and read again. What a stage wrote
    besides its result, and its predecessor's result, is deleted when its own is written."""
    docs, before = table(spark, sf_dir, "documents"), set(written())
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        for path in [p for p in written()[:-1] if p not in before]:
            delete_path(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
