"""A corpus made ready for training: known language, no boilerplate lines, one of each group of near copies, no secrets, packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterspark.llm import language_id, line_dedup, ngram_join, packing, secrets
from rosterspark.llm.common import Scratch


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language profiles accept; those without a letter, or like no profile, go."""
    return language_id.accepted(language_id.identify(docs)).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without lines that stand on many sites."""
    cleaned = line_dedup.dedup_lines(docs).select(*docs.columns)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each secret replaced by the name of its kind."""
    masked = secrets.redact(secrets.find_secrets(docs)).select(*docs.columns)
    return masked.withColumn("n_chars", F.char_length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", known_language), ("line_dedup", without_boilerplate), ("ngram_join", one_of_each), ("secret_scans", without_secrets), ("packing", packed)]
#: Tokens and language profiles are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again by the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.keep_only(docs)
    return docs
