"""The corpus pipeline: classify, apply rules, drop near copies, mask personal data, pack.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read again
as the next stage's docs. All but the last return the columns of documents, in their order; columns that
documents has besides pass through the filters. Null and repeated doc_id are kept as rows of their own
until a stage's decision drops them; empty input gives empty output.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodequery.llm import jaccard_join, packing, pii, quality_model, quality_rules
from lodequery.llm.common import shared_dir, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; the classifier gives each row its verdict where the row is read."""
    return quality_model.kept(docs, table(spark, sf_dir, "labels"))


def adaptive_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fences."""
    return quality_rules.kept(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of least doc_id, and of equal rows of an id one."""
    return jaccard_join.kept(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data masked, n_chars brought up to date."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", adaptive_rules),
    ("n-gram Jaccard join", near_copies),
    ("PII", personal_data),
    ("packing", pack),
]

#: Trained and sampled stages have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
    return docs
