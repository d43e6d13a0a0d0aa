"""The queries over the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodequery.llm import byte_bpe, jaccard_join, metric_search, packing, pii, pitman_yor, quality_model, quality_rules, secrets, suffix_dedup, toxicity, vector_codes, whitening
from lodequery.llm.common import table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the language model learned from those outside the held-out fold; null texts are the end token alone."""
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document; null texts have no words and fail the base rules."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of secrets in every document; null texts have none."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned from labels outside the held-out fold; empty texts are scored too."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document; texts without words are classes of their own."""
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every document; null texts have none."""
    return pii.find(table(spark, sf_dir, "documents"))


def op7_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows for every row whose id is divisible by 20; vectors that are null or not finite take no part."""
    return metric_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document, learned from labels outside the held-out fold; empty texts are scored too."""
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and hashes of ids and decoded bytes of every document; null texts are empty."""
    return byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 ids; null texts are the end id alone."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that repeat, in strings of 50 bytes, from documents of smaller id; null texts are empty."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every whole vector, with the errors of its label and the hash of the codebooks."""
    return vector_codes.code(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector's first 16 whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the five stages of the corpus pipeline leave of the documents."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pitman_yor, op2_quality_rules, op3_secret_scan, op4_toxicity, op5_ngram_jaccard, op6_pii, op7_metric_search, op8_quality_classifier, op9_byte_bpe, op10_packing, op11_suffix_dedup, op12_vector_codes, op13_whitening, pipeline)
}
ORACLES: dict[str, str] = {"op7_metric_search": metric_search.ORACLE, "op11_suffix_dedup": suffix_dedup.ORACLE, "op12_vector_codes": vector_codes.ORACLE}
