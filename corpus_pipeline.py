"""From raw documents to sharded training text, one operator per stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table, written
from tessera.llm.decontaminate import decontaminate
from tessera.llm.language import keep_identified
from tessera.llm.mixing import mix
from tessera.llm.sharding import assign_shards
from tessera.llm.simdedup import near_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents whose language is not identified go."""
    return keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return near_dedup(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark passage go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights; a document may come twice."""
    return mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of every document."""
    return assign_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_dedup", deduplicate),
    ("decontaminate", remove_leaks),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Stages that no SQL can state (see README); the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the result of each is written as Parquet and reread as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs)
    return docs
