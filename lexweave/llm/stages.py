"""Pipeline stages: (spark, docs, sf_dir) to a DataFrame, over all rows their predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import bpe
from lexweave.llm.bag_minhash import keep_one_of_each
from lexweave.llm.contamination import without_leaks
from lexweave.llm.line_templates import drop_recurring_lines
from lexweave.llm.positive_unlabelled import accepted
from lexweave.llm.support import read

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates; every document stays."""
    return drop_recurring_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return without_leaks(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text with its token ids, and the text decoded from them."""
    return bpe.encode(docs, VOCABULARY, decoded="decoded")
