"""Corpus pipeline over ``documents``: each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from minuteloom.llm import decontaminate, language_id, mixing, ngram_join, sharding
from minuteloom.llm.common import forget, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a known language with a calibrated score of 0.4 or more; null texts and texts without a letter go."""
    return language_id.keep_known_languages(docs, language_id.train(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a shingle similarity of 0.75 or more, that of the smallest id."""
    return ngram_join.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a test item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.take_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each document; one taken twice has two slots."""
    return sharding.assign_shards(docs, shards=8)


STAGES = [("language_id", known_language), ("ngram_join", one_of_each), ("decontaminate", without_benchmark), ("mixing", mixed), ("sharding", sharded)]
#: The stages train a model, align passages and draw by hash, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote is removed once the next one has written its own."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        forget(*before)
        before = [docs]
    return docs
