"""Corpus pipeline: quality rules, quality classifier, n-gram join, decontamination, byte-level BPE.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over the documents that its predecessor kept. All but
the last return the columns of ``documents``; each result is written as Parquet to the shared folder and read again
as the next stage's input. Part of the removable training-data subpackage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import byte_bpe, cotraining, decontaminate, rule_cascade, trie_join
from codeloom.session import stored

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects."""
    return rule_cascade.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained views don't take for junk."""
    return cotraining.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest doc_id."""
    return trie_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the documents that are left, with digests of the ids and of the bytes they decode to."""
    coded = byte_bpe.digest_column(spark, F.col("text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True, pieces=40_000)
    return docs.select("doc_id", "lang", "source", coded.alias("c")).select("doc_id", "lang", "source", "c.n_tokens", "c.ids_sha256", "c.decoded_sha256", F.col("c.ids").alias("input_ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't fit the classifier or encode by merges; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
