"""The corpus pipeline: stages over the documents, each written and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexweave.llm import stages
from lexweave.session import ensure_checkpoint_dir

STAGES = [
    ("quality_classifier", stages.classify),
    ("line_dedup", stages.dedup_lines),
    ("minhash_near_dedup", stages.dedup_documents),
    ("benchmark_decontamination", stages.decontaminate),
    ("bpe_encoding", stages.encode),
]
#: The classifier and the alignment cannot be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order; each result goes to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{at}-{name}")
            docs = spark.read.parquet(f"{folder}/{at}-{name}")
    return docs
