"""Corpus pipeline: documents in, token digests of the clean ones out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Defined results: null and empty texts pass the quality stage or not by the classifier's bias, count as one text in exact dedup, stand alone in
near dedup, are clean, and have no tokens; texts of any length are read whole; of repeated rows exact dedup keeps one; extra columns, whatever their
names, stay until the last stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from ledgerspark.llm.common import documents, materialize
from ledgerspark.llm.queries import labels, vocabulary_file


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, labels(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, *vocabulary_file(), ids=False)


STAGES = [("quality", good_quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("bpe", tokens)]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
