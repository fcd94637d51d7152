"""From raw documents to shards of a mixed training corpus.

Stages, in order: language identification (texts without a language go), SimHash near-deduplication (one document of
each group stays), benchmark decontamination (documents that share a ten-word window with an item go), mixing of
sources (documents repeat, or go, as their source's share asks, in training order) and sharding. Each stage's rows
are written as Parquet to the shared folder and read again as the next one's documents. All but the last return the
columns of documents; the last returns each document's place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import common, decontaminate, langid, mixing, sharding, simhash


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, n_shards=16, keep=["source", "lang"])


STAGES = [
    ("language_id", identify),
    ("simhash_near_dedup", deduplicate),
    ("benchmark_decontamination", clean),
    ("source_mixing", mixed),
    ("kd_sharding", sharded),
]

# Viterbi paths, fingerprints by XXH64 bits and hash orders have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.saved(docs, name)
    return docs
