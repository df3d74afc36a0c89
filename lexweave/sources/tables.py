"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Rows of a task where one row costs milliseconds: tasks of some ten seconds at any table size.
HEAVY_ROWS = 2_000


def read_table(
    spark: SparkSession, folder: str, name: str, *columns: str, rows: int | None = None
) -> DataFrame:
    """Read a table, only the named columns.

    A file smaller than one split per core would leave cores idle under heavy text expressions, so
    it is dealt out; larger tables keep their own splits and are not shuffled. With ``rows``, the
    table is dealt out in tasks of about so many rows, so that a task does not grow with the table.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // rows)) if rows else cores
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
