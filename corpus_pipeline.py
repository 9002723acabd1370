"""The corpus pipeline: documents go through the stages in order, each written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import decontamination, mixing, ngram_join, quality_rules, sharding
from foliograph.llm.shared import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or repetition rules reject go."""
    return quality_rules.keep_unrepetitive(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least id."""
    return ngram_join.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their new shard and their slot in it."""
    return sharding.reshard(docs, sharding.by_source(docs)).select(*docs.columns, "_shard.old_shard", "_shard.shard", "_shard.slot")


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]
#: Suffix arrays, tries and alignments are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; every stage but the last is written to the shared folder and reread.

    A stage's rows are removed when the next one's are written; the result reads those of the last but one.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        made = Scratch(spark)
        docs = made.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.clear()
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)
