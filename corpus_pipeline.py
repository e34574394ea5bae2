"""A corpus pipeline: toxicity, near-duplicate groups, benchmark leaks, source mix, shards.

Each stage works on all rows its predecessor kept; its output is written to the shared folder and
read again. The first four return the columns of `documents` (mixing repeats a row it takes
twice); the last adds shard and slot.

A classifier and a template search are no SQL, so ORACLE_SQL is None; tests/llm holds the stages
against brute force.

Defined results of the stages, beside those that the operators state: rows repeated with one doc_id
are judged alike, and those that stay do so as often as they came (mixing takes each of them 0 to 2
times); rows of a null doc_id pass toxicity by their own text, are never near copies, count as one
document in decontamination, and are mixed alike; null and empty texts get the classifier's score of
an empty text and are neither near copies nor leaks; columns of
any name keep their values, but for shard and slot, which the last stage replaces; an empty table
stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaicell.llm import decontam, mixing, ngram_join, sharding, toxicity
from mosaicell.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text the classifier does not reject."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the rows of its smallest doc_id."""
    return ngram_join.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of documents without a benchmark item, as it stands or with other values."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target takes it."""
    return mixing.resample(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with shard and slot."""
    return sharding.external_shuffle(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
