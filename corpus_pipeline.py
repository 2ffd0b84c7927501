"""A training corpus from documents: the stages in order, each on what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, language, packing, simhash, substrings
from ledgerlens.llm.rows import columns_of, whole_row
from ledgerlens.session import drop_path, new_table_path, temporary_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Clean documents in a learned language score 0.4 and more, texts in none of them far less.
LEAST_LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or like no learned language, go.

    Profiles are learned from the documents that have a lang. Where none has
    one, nothing can be told, and only documents without a letter go.
    """
    profiles = language.learn(docs.select("doc_id", "text", "lang"))
    if not profiles.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.select(whole_row(docs), language.identify(F.col("text"), profiles).alias("language"))
    known = (F.col("language.lang") != language.UNKNOWN) & (F.col("language.score") >= LEAST_LANGUAGE_SCORE)
    return found.filter(known).select(*columns_of(docs))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that documents with smaller ids hold; n_chars follows the text."""
    kept = substrings.dedup(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), "n_chars"))
    return kept


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Stages that train a model or tokenize cannot be put in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what each stage returns is written as Parquet and read by the next."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = new_table_path(spark, f"pipeline-{name}")
        with temporary_tables(spark):  # what a stage writes on its way goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(path)
        if read:
            drop_path(spark, read)
        docs, read = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
