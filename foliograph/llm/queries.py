"""The registered query of each operator: its production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, line_quality, mixing, ngram_join, personal_data, quality_rules, secret_scan, sharding, substring_dedup, token_files
from .oracles import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_quality.line_quality(docs, line_quality.fit(docs, _table(spark, sf_dir, "labels")))


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.repetition_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat", "n_spans", "n_maximal")


def op3_prefix_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sharding.reshard(docs, sharding.by_source(docs)).select("doc_id", "_shard.*")


def op6_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(_table(spark, sf_dir, "documents"))


def op8_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "_mix.*")


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_crf_quality, op2_suffix_repetition, op3_prefix_tree_join, op4_qgram_decontamination, op5_flow_resharding,
    op6_bit_packed_ids, op7_anchor_pii, op8_count_min_substrings,
    op9_sainte_lague_mix, op10_markov_secrets,
)}

__all__ = ["ORACLE_SQL", "QUERIES"]
