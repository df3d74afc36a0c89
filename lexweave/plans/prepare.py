"""Prepare a corpus for training and evaluation: normalised text and slots, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.rewrite import normalize_corpus, normalize_slots
from lexweave.functions.stage import evaluate
from lexweave.operators.contracts import slot_traceability
from lexweave.operators.quality import text_key
from lexweave.operators.splits import first_seen_conflicts, first_seen_dedupe

TEXT_KEY = "normalized_text"


def normalized(df: DataFrame) -> DataFrame:
    """Add normalised text, region, trace and slots under each row's own region."""
    out = normalize_corpus(df, hint="region")
    return evaluate(
        out,
        normalized_slots=normalize_slots(F.col("slots"), F.col("region"), F.col(TEXT_KEY)),
    )


def preprocess(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Normalise and keep the first row per text in train and validation; test stays whole.

    With ``columns``, ``id`` and ``split`` among them, only these are carried to the choice, with the text's key.
    """
    rows = normalized(df)
    if not columns:
        return first_seen_dedupe(rows, F.col(TEXT_KEY), [F.col("id")])
    slim = rows.select(*columns, text_key(F.col(TEXT_KEY)).alias("__text"))
    return first_seen_dedupe(slim, F.col("__text"), [F.col("id")]).drop("__text")


def preprocess_violations(df: DataFrame) -> DataFrame:
    """What makes a preparation invalid: lost slots, blank texts, one text with two intents."""
    rows = normalized(df)
    lost = slot_traceability(rows, TEXT_KEY, "normalized_slots")
    blank = rows.where(F.col(TEXT_KEY).isNull()).select(
        "id", F.lit("blank_text").alias("rule"), F.lit("").alias("detail")
    )
    clash = first_seen_conflicts(rows, F.col(TEXT_KEY), "intent").select(
        F.col("text_key").alias("id"),
        F.lit("two_intents").alias("rule"),
        F.concat_ws(",", "first_label", "last_label").alias("detail"),
    )
    return lost.unionByName(blank).unionByName(clash)
