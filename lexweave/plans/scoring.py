"""Score a labelled corpus in one pass and cut every report from the scored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators import metrics as M
from lexweave.operators.tagging import Dictionaries, slots_by_intent
from lexweave.plans.commands import Scorer, parse_corpus
from lexweave.plans.prepare import normalized
from lexweave.rules import domains as D

_TAGS = tuple(f"tag_{s}" for s in D.SLOTS)
_OWN = ("id", "gold_region", "source", "variant_type", "annotation_quality", "expected", "expected_slots")


def score_table(
    df: DataFrame, scorer: Scorer, dictionaries: Dictionaries | None = None, **options
) -> DataFrame:
    """One row per sample: label, model output, runtime result, slots under the gold intent.

    The parse never sees the gold region. Oracle slots reuse the parse's tags, so nothing is joined.
    """
    gold = normalized(df).select(
        "id",
        "text",
        F.col("region").alias("gold_region"),
        "source",
        "variant_type",
        "annotation_quality",
        F.col("intent").alias("expected"),
        F.col("normalized_slots").alias("expected_slots"),
    )
    out = parse_corpus(
        gold, scorer, dictionaries=dictionaries, keep=_OWN,
        extra=("predicted", "probs", "gate_reason", *_TAGS), **options,
    )
    return out.select(
        *_OWN,
        "text",
        "normalized_text",
        F.col("region").alias("runtime_region"),
        F.col("intent").alias("runtime_intent"),
        "predicted",
        "confidence",
        "probs",
        F.col("slots").alias("runtime_slots"),
        slots_by_intent(F.col("expected")).alias("oracle_slots"),
        F.col("action")["status"].alias("action_status"),
        "gate_reason",
        "matched_features",
    )


def evaluate_all(scored: DataFrame, labels=D.INTENTS) -> dict[str, DataFrame]:
    """All reports as tables. Persist ``scored`` first; every report reads it."""
    flags = M.frame_flags()
    reason = M.failure_reasons(
        {
            "intent": flags["intent_accuracy"],
            "slots": flags["slot_exact"],
            "action": flags["action_rate"],
        }
    )
    regions = [*D.REGIONS, D.UNKNOWN]
    sliced = scored.withColumnsRenamed({"gold_region": "region", "expected": "intent"}).withColumn(
        "expected", F.col("intent")
    )
    dimensions = ["region", "intent", "source", "variant_type", "annotation_quality"]
    return {
        "raw_intent": M.classification_report(scored, labels),
        "raw_confusion": M.confusion_matrix(scored, labels),
        "runtime_intent": M.classification_report(scored, labels, predicted="runtime_intent"),
        "runtime_confusion": M.confusion_matrix(
            scored, [*labels, D.UNKNOWN], predicted="runtime_intent"
        ),
        "coverage": M.coverage_selective(scored, predicted="runtime_intent"),
        "region": M.classification_report(scored, D.REGIONS, "gold_region", "runtime_region"),
        "region_confusion": M.confusion_matrix(scored, regions, "gold_region", "runtime_region"),
        "log_loss": M.log_loss(scored),
        "brier": M.brier(scored, labels),
        "ece": M.ece(scored),
        "ranking": M.ranking_metrics(scored, labels),
        "oracle_slots": M.slot_prf(scored, "expected_slots", "oracle_slots"),
        "runtime_slots": M.slot_prf(scored, "expected_slots", "runtime_slots"),
        "oracle_exact": M.slot_exact(scored, "expected_slots", "oracle_slots"),
        "runtime_exact": M.slot_exact(scored, "expected_slots", "runtime_slots"),
        "overall": M.sliced_eval(scored.withColumn("all", F.lit("all")), ["all"], flags),
        "breakdown": M.sliced_eval(sliced, dimensions, flags),
        "action_statuses": M.reason_counts(scored, F.col("action_status")),
        "failure_reasons": M.reason_counts(scored, reason),
        "gate_reasons": M.reason_counts(scored, F.when(reason != "", F.col("gate_reason"))),
        "failures": M.failures(
            scored,
            reason,
            ["id", "text", "expected", "predicted", "runtime_intent", "confidence",
             "expected_slots", "runtime_slots", "matched_features"],
        ),
    }
