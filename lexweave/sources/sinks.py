"""Writers and table fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.quality import corpus_profile


def write_dataset(df: DataFrame, path: str) -> None:
    """Parquet by split, the test split also by region, ordered by id inside each bucket.

    Range partitioning splits a large bucket over many files instead of one task.
    """
    bucket = F.when(F.col("split") == "test", F.col("region")).otherwise(F.lit("all"))
    rows = df.withColumn("bucket", bucket)
    ordered = rows.repartitionByRange("split", "bucket", "id").sortWithinPartitions(
        "split", "bucket", "id"
    )
    ordered.write.mode("overwrite").partitionBy("split", "bucket").parquet(path)


def write_preprocessed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    """Lexicon entries in slot and value order across the files."""
    lexicon.repartitionByRange("slot", "value").sortWithinPartitions("slot", "value").write.mode(
        "overwrite"
    ).parquet(path)


def content_checksum(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: row count and the sum of 64-bit row hashes.

    A sum, not an exclusive or, so equal rows do not cancel. Text forms of the values are hashed,
    nulls marked.
    """
    columns = sorted(c for c in df.columns if c not in by)
    text = F.concat_ws(
        "\u0001",
        *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in columns],
    )
    hashed = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.sum(hashed).cast("string").alias("fingerprint")
    )


def manifest(df: DataFrame, report: DataFrame | None = None) -> DataFrame:
    """Long table ``(metric, value, n)``: total, per-label counts and, if given, filter steps."""
    labels = corpus_profile(
        df.withColumn("bucket", F.concat_ws("_", "split", F.when(F.col("split") == "test", F.col("region")))),
        ["bucket", "split", "intent", "region", "source", "annotation_quality"],
    )
    counts = labels.where("split is null").select(
        F.col("dimension").alias("metric"), "value", "n"
    )
    total = counts.where("metric = 'split'").agg(F.sum("n").alias("n"))
    out = counts.unionByName(total.select(F.lit("total").alias("metric"), F.lit("all").alias("value"), "n"))
    if report is not None:
        steps = F.concat_ws("/", "step", "source")
        out = out.unionByName(
            report.select(F.lit("dropped").alias("metric"), steps.alias("value"), F.col("dropped").alias("n"))
        )
    return out


def write_manifest(df: DataFrame, path: str, report: DataFrame | None = None) -> DataFrame:
    """Write the metrics table; it is small, so one file."""
    table = manifest(df, report)
    table.coalesce(1).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stale(df: DataFrame, recorded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recorded fingerprints that no longer hold."""
    now = content_checksum(df, by).withColumnsRenamed({"n_rows": "r_now", "fingerprint": "f_now"})
    joined = recorded.join(now, list(by), "full") if by else recorded.crossJoin(F.broadcast(now))
    same = F.col("n_rows").eqNullSafe(F.col("r_now")) & F.col("fingerprint").eqNullSafe(
        F.col("f_now")
    )
    return joined.where(~same)
