"""Session helpers: lineage cuts and small literal tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20
# Spark's switch for removing an action's shuffles when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "lexweave", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one on local masters only."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="lexweave-ckpt-")
    spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder so later steps never recompute it, even after
    executors are lost.

    A Parquet table, which is packed by columns; a checkpoint holds whole rows as they lie in memory.
    Once it is written, nothing reads the shuffles that led to it, so they are removed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLES_GO, before) if before is not None else spark.conf.unset(SHUFFLES_GO)
    return spark.read.schema(df.schema).parquet(path)


def is_small(held: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    size = held.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return size <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Write ``df`` once and mark it for broadcast only when its measured size allows; beyond that
    the caller's join shuffles as usual."""
    held = cut_lineage(df)
    return F.broadcast(held) if is_small(held, limit) else held


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table known in code. Its size is fixed by the rule set, so joins may broadcast it."""
    return F.broadcast(spark.createDataFrame(rows, schema))
