"""From raw documents to packed batches: rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on, columns unchanged; the last returns the
packed pieces.  ``run`` writes every stage's result to the shared folder and hands the written table to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import content_sort, mixing, packing, quality_rules, simhash
from winnow.llm.common import materialise


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no anomaly; the threshold comes from the labels table."""
    return quality_rules.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the largest doc_id."""
    return content_sort.drop_copies(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the smallest doc_id."""
    return simhash.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every copy that its source's quota takes; budget: the tokens there are."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in length buckets and batches."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]

ORACLE_SQL = None  # forests, similarity hashes and hashed permutations are beyond SQL; tests hold brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
