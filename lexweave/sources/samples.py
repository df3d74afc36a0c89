"""Readers for labelled samples, external rows, challenge sets and prepared corpora."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions.compose import compose

_LABELS = (
    "id string, group_id string, text string, region string, intent string, "
    "slots map<string,variant>, source string, source_ref string, variant_type string, "
    "annotation_quality string, _corrupt_record string"
)
_EXTERNAL = (
    "id string, partition string, intent string, utt string, annot_utt string, "
    "judgments array<struct<intent_score:int,slots_score:int,grammar_score:double,"
    "spelling_score:double,language_identification:string>>, _corrupt_record string"
)
CHALLENGES = {
    "normalization": "id string, region string, category string, input string, expected string",
    "safety": (
        "id string, text string, category string, should_execute boolean, expected_intent string"
    ),
    "boundary": "id string, text string, intent string",
    "gate": "id string, variant string, text string, intent string, region string",
}


def slot_lists(raw: Column) -> Column:
    """A slot value is a string or a list of strings; always make it a list."""
    return F.transform_values(
        raw,
        lambda k, v: F.coalesce(
            F.try_variant_get(v, "$", "array<string>"),
            F.array(F.try_variant_get(v, "$", "string")),
        ),
    )


def _read_json(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.withColumn("file", F.col("_metadata.file_name"))


def split_from_file(file: Column) -> Column:
    """``test_*`` files form the test split; any other file is named after its split."""
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    return F.when(F.startswith(file, F.lit("test_")), F.lit("test")).otherwise(stem)


def region_from_file(file: Column) -> Column:
    return F.nullif(F.regexp_extract(file, r"^test_([a-z]+)\.", 1), F.lit(""))


def read_samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Labelled rows with ``file``, ``split`` and composed text. Blank lines do not count;
    unreadable lines are left to ``bad_lines``."""
    rows = _read_json(spark, path, _LABELS).where("_corrupt_record is null").drop("_corrupt_record")
    typed = rows.withColumns(
        {"slots": slot_lists(F.col("slots")), "split": split_from_file(F.col("file"))}
    )
    return compose(typed, "text")


def numbered_lines(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Lines as (value, file, path, block, at), and blocks as (path, block, first, before).

    A large file is read in several blocks, each from its start by one task, so ``at - first`` counts
    lines inside a block and ``before`` the lines of all earlier blocks of the file.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    earlier = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        lines.groupBy("path", "block")
        .agg(F.min("at").alias("first"), F.count("*").alias("size"))
        .withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .drop("size")
    )
    return lines, blocks


def bad_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are no JSON object of the expected shape, with their file and line number (from 1;
    blank lines count)."""
    lines, blocks = numbered_lines(spark, path)
    parsed = F.from_json("value", _LABELS, {"columnNameOfCorruptRecord": "_corrupt_record"})
    bad = lines.where(F.trim("value") != "").withColumn("p", parsed)
    bad = bad.where(F.col("p").isNull() | F.col("p._corrupt_record").isNotNull())
    number = F.col("before") + F.col("at") - F.col("first") + 1
    return bad.join(blocks, ["path", "block"]).select(
        "file", number.alias("line_number"), F.col("value").alias("line")
    )


def read_external(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Crowd-annotated rows with their judgments."""
    rows = _read_json(spark, path, _EXTERNAL).where("_corrupt_record is null")
    return compose(rows.drop("_corrupt_record", "file"), "annot_utt")


def read_reviewed_seed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reviewed rows; the set is small, so all of it trains."""
    return read_samples(spark, path).withColumn("split", F.lit("train"))


def read_challenges(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A challenge set; it must not be empty and its ids must be unique."""
    rows = spark.read.schema(CHALLENGES[kind]).json(path)
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids")).first()
    if counts["n"] == 0:
        raise ValueError(f"challenge set is empty: {path}")
    if counts["n"] != counts["ids"]:
        raise ValueError(f"challenge ids repeat: {path}")
    return rows


def read_preprocessed(spark: SparkSession, path: str) -> DataFrame:
    """The prepared corpus; an empty one is an error."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        raise ValueError(f"no prepared corpus: {path}") from error
    if rows.isEmpty():
        raise ValueError(f"prepared corpus is empty: {path}")
    return rows
