"""Queries over whole tables, one per operator, and their DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm.alignment import alignment
from cohortlens.llm.context_tree import context_tree_scores
from cohortlens.llm.cotraining import cotrained_scores
from cohortlens.llm.decontamination import contaminated
from cohortlens.llm.importance import importance_sample
from cohortlens.llm.jaccard_join import jaccard_components
from cohortlens.llm.license_scan import license_scan
from cohortlens.llm.mixing import mix_to_targets, quality_domains
from cohortlens.llm.quality_rules import quality_rules
from cohortlens.llm.sharding import kd_shards
from cohortlens.llm.suffix_dedup import suffix_dedup
from cohortlens.llm.tables import table
from cohortlens.llm.token_counts import token_counts
from cohortlens.llm.wrapper_induction import extract_pages


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by both views and together."""
    return cotrained_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every document."""
    return license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of linked texts of every document."""
    return jaccard_components(table(spark, sf_dir, "documents")).drop("class_size")


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that they cover."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_blocks", "n_template")


#: Target shares of tokens by domain.
TARGETS = {"high": 0.8, "low": 0.12, "toxic": 0.08}


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and rate of every document."""
    domains = quality_domains(table(spark, sf_dir, "labels"))
    return mix_to_targets(table(spark, sf_dir, "documents"), domains, TARGETS)


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes."""
    placed = kd_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and context-tree score of every document."""
    return context_tree_scores(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated strings of 200 bytes take from every document, and the hash of what stays."""
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, removed lines and verdict of every document."""
    rules = quality_rules(table(spark, sf_dir, "documents"))
    return rules.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_lines", "removed_words",
    )


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 2,048 tokens."""
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizations of every document, and how its links stand in the corpus."""
    paths = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment(table(spark, sf_dir, "documents"), *paths)


def op13_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark texts, its noisy score and, where it is drawn, its rank."""
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_cotraining": op1_cotraining,
    "op2_license_rules": op2_license_rules,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_string_tiling": op4_string_tiling,
    "op5_wrapper_induction": op5_wrapper_induction,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_context_tree": op8_context_tree,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_line_frequency": op10_line_frequency,
    "op11_token_counts": op11_token_counts,
    "op12_token_alignment": op12_token_alignment,
    "op13_importance_sampling": op13_importance_sampling,
}
