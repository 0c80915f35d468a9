"""A training-data pipeline over ``documents``: quality rules, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns the
columns of ``docs``, in few partitions; the last returns the packed pieces. ``run`` writes each stage's rows as Parquet
and reads them again for the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seriesloom.llm import near, packing, quality, substrings
from seriesloom.llm.graph import compact, shared_folder, tidy


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return compact(quality.kept_documents(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five words, similarity of 0.8 or more),
    that with the smallest doc_id."""
    return compact(near.kept_documents(docs, near.PIPELINE_THRESHOLD))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the word spans that an earlier one has."""
    return compact(substrings.deduplicated(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 2048 tokens."""
    return compact(packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality_rules", quality_stage), ("near_dedup", near_stage), ("substring_dedup", substring_stage), ("packing", packing_stage)]

#: SQL cannot express MinHash near-dedup's components or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            with tidy(spark):
                docs.write.mode("overwrite").parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
