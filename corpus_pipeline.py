"""Corpus pipeline: quality rules, near duplicates, repeated sentences, personal data, packing.

Every stage is (spark, docs, sf_dir) -> DataFrame and sees what the stage before it kept, written and read again.
All but the last return the columns of ``documents``. What each stage does with null or empty texts, ties, repeated
rows and clashing names is said in its operator's module.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, line_dedup, packing, pii, quality_rules
from tidemark.llm.common import DOCUMENT_COLUMNS, documents
from tidemark.plans.session import materialize


def _columns(df: DataFrame) -> DataFrame:
    """The columns of ``documents``; ``n_chars`` follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.filter_documents(docs).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates."""
    return jaccard_join.keep_one(docs).select(*DOCUMENT_COLUMNS)


def repeated_sentences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without sentences that an earlier one holds."""
    return _columns(line_dedup.dedup(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _columns(pii.mask(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of the documents and their places in sequences."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(docs, tokenizer, digest=F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_sentences),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

# Shingle joins, bootstrapped patterns and token packing have no SQL form: the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
