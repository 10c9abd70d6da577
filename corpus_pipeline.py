"""A corpus pipeline: raw documents to packed training windows, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import mixing, neardup, packing, quality, toxicity
from quire.llm.common import documents, labels, written

#: Bytes of pieces that a worker keeps while it packs; workers of earlier stages still live beside it, so it is less than for packing alone.
KEPT = 48 << 20


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns.

    Null and empty texts are judged by statistics of 0; null ids are judged like others; repeated rows stay or go together.
    """
    return quality.accepted(docs, labels(spark, sf_dir))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar doesn't call toxic, with all their columns.

    Null and empty texts say nothing and stay; null ids are judged like others; repeated rows stay or go together.
    """
    return toxicity.clean(docs, labels(spark, sf_dir))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, by shingles of five words.

    Documents without words, and rows with null ids, are no group and stay. Rows of the smallest id all stay.
    """
    return neardup.representatives(docs, neardup.STAGE_SHINGLE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents as the mix takes them, in its order; a document may come twice.

    Documents without words have nothing to take and go. Null ids are served first, null sources are one source of their own;
    repeated rows are served one by one.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their windows of 1024 tokens.

    A document without text is its end id alone; null ids are carried; repeated rows are packed one by one.
    """
    return packing.pack(docs, kept=KEPT)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("neardup", neardup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned models and a tokenizer are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
