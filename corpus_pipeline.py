"""From raw documents to token digests: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm import bpe, langid, minhash, mixing, toxicity
from quillsift.llm.common import table
from quillsift.session import ensure_checkpoint_dir, ship_package


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network calls toxic; it learns from the labelled rows that are not held out."""
    ship_package(spark)
    scorer = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, scorer)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or too far from every centroid."""
    ship_package(spark)
    return langid.identified(docs, langid.train(table(spark, sf_dir, "documents")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near duplicates."""
    ship_package(spark)
    return minhash.first_of_groups(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that the words of each source come near its target."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count, digest of the ids and digest of the decoded bytes of every document."""
    ship_package(spark)
    return bpe.encoded_digests(docs)


STAGES = [("toxicity", toxicity_filter), ("language_id", language_filter), ("minhash_dedup", near_dedup),
          ("mixing", mix_sources), ("bpe", encode_tokens)]

#: Trained models and hash-driven choices are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
