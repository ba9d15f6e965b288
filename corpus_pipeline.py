"""A corpus through five stages: quality, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept,
and is written as Parquet and read again; all but the last return the columns of
``documents``, others that came with them included.

Defined results: a NULL or empty text fails the base rule of words and goes with the
first stage; repeated rows and copies are one group, of which the row with the
smallest ``doc_id`` stays; rows without a ``doc_id`` belong to no group and stay, packed under
NULL; texts are cleaned, judged, searched and packed whole, whatever their length; columns
named like a stage's results keep their own values; an empty table gives no pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from toolwarden.llm import neardup, packing, pii, quality, tokens, toxicity
from toolwarden.plans.workspace import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go; documents that lose too much, or fail a base rule, go."""
    return quality.keep_clean(docs)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences, with their ids."""
    return packing.pack(docs, tokens.public("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", civil),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed),
]

#: The trained, hashed and tokenized stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
