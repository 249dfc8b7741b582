"""A training corpus from raw documents, in five stages.

Each stage takes the documents that the stage before it kept, reread from Parquet, and returns a
frame with the columns of documents; the last returns the pieces of packed windows. Every stage
depends on the whole of its input (models, classes, first places), so there is no SQL for the rows.

Null and empty texts, null doc_ids, repeated rows and further columns go through every stage as its
operator states it: a row without words is kept by the first stage if its one symbol is as likely as
the language's threshold asks, rows with equal texts are one class, of which the second stage keeps
the row of the least doc_id, and the last stage packs the end id alone for it. Empty documents,
labels or benchmark give an empty result, a classifier that keeps all, and no leaks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, packing, quality, substring
from .common import Scratch, shared_folder

ORACLE_SQL = None
_open: list[Scratch] = []


def _stage(function):
    """Run a stage; scratch tables of earlier stages go, as their results have been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _open:
            _open.pop().release()
        before = list(Scratch.live)
        out = function(spark, docs, sf_dir)
        _open.extend(s for s in Scratch.live if s not in before)
        return out

    run.__doc__ = function.__doc__
    return run


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.keep_one(docs)


@_stage
def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier one."""
    return substring.remove_passages(docs)


@_stage
def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one),
    ("substring_dedup", remove_passages),
    ("benchmark_decontamination", remove_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each result written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/lodegrain/pipeline-{uuid.uuid4().hex}"
    for k, (_, function) in enumerate(STAGES):
        out = function(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
