"""The corpus pipeline: filter by quality, drop exact and near copies, mix sources, pack sequences.

Each stage takes (spark, docs, folder of the given tables) and works on all that the stage before it
kept. All but the last return the columns of ``documents``; the last returns one row per packed piece.
A document that the mix takes twice is two rows from there on, with one id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm.common import table
from tallyloom.llm.exact_dedup import drop_exact_duplicates
from tallyloom.llm.mixing import apply_mix
from tallyloom.llm.packing import pack
from tallyloom.llm.quality import drop_low_quality
from tallyloom.llm.simhash import drop_near_duplicates
from tallyloom.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixing),
    ("best_fit_packing", packing),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests hold the run against
#: plain loops instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
