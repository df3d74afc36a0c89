"""Validate a corpus: every check as rows of one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import contracts as C
from lexweave.operators import quality as Q
from lexweave.operators.similar import near_dup_pairs
from lexweave.plans.build import normalized_mask
from lexweave.rules import domains as D
from lexweave.session import cut_lineage


def _rows(df: DataFrame, rule: str, subject: str, *detail: str) -> DataFrame:
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in detail]) if detail else F.lit("")
    return df.select(
        F.lit(rule).alias("rule"), F.col(subject).cast("string").alias("subject"), text.alias("detail")
    )


def validate(
    df: DataFrame,
    manifest: DataFrame | None = None,
    enforce_minimums: bool = True,
    expected_files=D.EXPECTED_FILES,
) -> DataFrame:
    """``(level, rule, subject, detail)`` for a corpus with ``file`` and ``split`` columns.

    Errors and warnings are rows; nothing stops at the first one.
    """
    rows = cut_lineage(normalized_mask(df))
    exact, plain = T.canonical_text(F.col("text")), T.folded_canonical(F.col("text"))
    order = ["file", "id"]
    near = near_dup_pairs(rows, "mask")
    pair = F.concat_ws("/", "left_split", "left_id")
    found = [
        _rows(C.row_contract(rows).withColumn("rule_", F.col("rule")), "contract", "id", "rule_", "detail"),
        _rows(C.region_file_check(rows), "region_file", "id", "detail"),
        _rows(C.slot_traceability(rows), "slot_not_in_text", "id", "detail"),
        _rows(Q.id_dups(rows), "duplicate_id", "id", "n"),
        _rows(Q.prev_duplicate(rows, exact, order), "same_text_other_group", "id", "prev_id"),
        _rows(Q.prev_duplicate(rows, plain, order), "same_plain_text_other_group", "id", "prev_id"),
        _rows(Q.same_split_dups(rows, F.col("normalized_text")), "same_split_duplicate", "text_key", "split", "n"),
        _rows(Q.source_ref_conflict(rows), "source_ref_groups", "source_ref", "first_group", "last_group"),
        _rows(Q.group_leakage(rows), "group_leakage", "group_id", "splits"),
        _rows(near.withColumn("pair", pair), "near_similar", "pair", "right_split", "right_id", "score"),
    ]
    if enforce_minimums:
        found += [
            _rows(Q.minimums(rows), "minimum", "rule", "cell", "n"),
            _rows(Q.spread_check(rows), "split_share", "split", "share", "target"),
            _rows(Q.missing_files(rows, expected_files), "missing_file", "file"),
        ]
    if manifest is not None:
        from lexweave.sources.sinks import manifest as counted

        found.append(
            _rows(Q.reconcile(manifest, counted(rows)), "manifest", "metric", "value", "recorded", "actual")
        )
    errors = found[0]
    for part in found[1:]:
        errors = errors.unionByName(part)
    reviewed = rows.agg(
        F.count_if(F.startswith(F.coalesce("source_ref", F.lit("")), F.lit("native_review:"))).alias("n")
    )
    warning = _rows(reviewed.where("n = 0"), "no_native_review", "n")
    return errors.select(F.lit("error").alias("level"), "*").unionByName(
        warning.select(F.lit("warning").alias("level"), "*")
    )
