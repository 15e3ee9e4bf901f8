"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

``STAGES`` are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. A stage works on what its
predecessor kept; all but the last return the columns of ``documents``. ``run`` writes each result to the shared checkpoint
folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.llm.decontamination import without_benchmark
from cohortlens.llm.jaccard_join import one_per_group
from cohortlens.llm.mixing import mixed_documents, quality_domains
from cohortlens.llm.quality_rules import clean_documents
from cohortlens.llm.sharding import kd_shards
from cohortlens.llm.tables import table, written

#: Shares of tokens by domain. Good text is kept whole; the shares of low-quality and toxic text are upper limits.
MIX = {"high": 0.92, "low": 0.05, "toxic": 0.03}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines are taken out of the others."""
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts stays."""
    return one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a test item go."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn at rates that bring low-quality and toxic text down to ``MIX``."""
    return mixed_documents(docs, quality_domains(table(spark, sf_dir, "labels")), MIX)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return kd_shards(docs)


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Tiling, the iterated mixing rates and the draws have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
