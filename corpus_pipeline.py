"""The training-data pipeline: from raw documents to sharded ones.

Each stage takes what its predecessor kept.  It is written as Parquet and read again as the
next one's input, so a lost executor repeats a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagedrift.llm import decontaminate, mixing, quality, sharding, simhash
from pagedrift.llm.common import prepare, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    prepare(spark)
    return quality.fit(docs, table(spark, sf_dir, "labels")).kept(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link: three-word shingles, three bits."""
    prepare(spark)
    return simhash.one_of_each(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    prepare(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources repeated towards the target weights."""
    prepare(spark)
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With the shard and the slot in it."""
    prepare(spark)
    return sharding.sharded(docs)


STAGES = [
    ("quality", classify),
    ("near_dedup", deduplicate),
    ("decontaminate", clean),
    ("mix", mix),
    ("shard", shard),
]

#: Fitted weights, connected components and label propagation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
