"""Deduplication, quotas and splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators.ordering import first_n_per_key, first_per_key, hash_rank
from lexweave.operators.quality import drop_label_conflicts, keyed_rows, label_conflict, text_key
from lexweave.rules import domains as D
from lexweave.session import literal_table

_PARTITION_PRIORITY = {"test": 0, "validation": 1, "train": 2}


def rank_of(column: str, order: Sequence[str]) -> Column:
    """Position in a short ordered domain; unknown values come last."""
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == value, i).otherwise(out)
    return out


def dedupe_priority(
    df: DataFrame, key: Column, seed: int = 42, id_col: str = "id", split: str = "split"
) -> DataFrame:
    """One row per key: test before validation before train, then hash order."""
    priority = sorted(_PARTITION_PRIORITY, key=_PARTITION_PRIORITY.get)
    keyed = df.withColumns(
        {
            "__key": text_key(key),
            "__priority": rank_of(split, priority),
            "__order": T.stable_order_key(F.col(id_col), seed),
        }
    )
    kept = first_per_key(keyed, ["__key"], [F.col("__priority"), F.col("__order")])
    return kept.drop("__key", "__priority", "__order")


def quota_topk(
    df: DataFrame,
    limits: Mapping[str, int] = D.EXTERNAL_LIMITS,
    shares: Mapping[str, float] = D.SPLIT_SHARES,
    label: str = "intent",
    split: str = "split",
    id_col: str = "id",
    seed: int = 42,
) -> DataFrame:
    """Keep the first ``limit * share`` rows per label and split in hash order.

    Quotas round half to even. The hash order makes the choice the same on every run.
    """
    cells = [(i, s, float(n * share)) for i, n in limits.items() for s, share in shares.items()]
    quotas = literal_table(
        df.sparkSession, cells, f"{label} string, {split} string, __share double"
    ).withColumn("__quota", F.bround(F.col("__share"), 0).cast("int"))
    keyed = df.withColumn("__order", T.stable_order_key(F.col(id_col), seed))
    joined = keyed.join(F.broadcast(quotas), [label, split])
    highest = int(max(c[2] for c in cells)) + 1
    kept = first_n_per_key(joined, [label, split], "__order", F.col("__quota"), highest)
    return kept.drop("__order", "__share", "__quota")


def group_split(
    df: DataFrame,
    group: str = "group_id",
    seed: int = 42,
    train: float = 0.70,
    validation: float = 0.15,
    split: str = "split",
) -> DataFrame:
    """Add a split so that all rows of a group share one.

    Distinct groups are ranked by hash; the first ``train`` share trains, the next validates, the
    rest tests. Shares round half to even.
    """
    groups = df.select(group).distinct()
    keyed = groups.withColumn("__order", T.stable_order_key(F.col(group), seed))
    ranked = hash_rank(keyed, "__order")
    train_end = F.bround(F.col("total") * F.lit(train), 0)
    validation_end = train_end + F.bround(F.col("total") * F.lit(validation), 0)
    assigned = ranked.select(
        group,
        F.when(F.col("rank") <= train_end, "train")
        .when(F.col("rank") <= validation_end, "validation")
        .otherwise("test")
        .alias(split),
    )
    return df.join(assigned, group)


def first_seen_dedupe(
    df: DataFrame,
    key: Column,
    order: Sequence[Column],
    splits: Sequence[str] = ("train", "validation"),
) -> DataFrame:
    """Keep the first row per key inside the named splits; other splits pass untouched."""
    inside = F.col("split").isin(*splits)
    keyed = df.where(inside).withColumn("__key", text_key(key))
    kept = first_per_key(keyed, ["split", "__key"], order).drop("__key")
    return kept.unionByName(df.where(~inside))


def first_seen_conflicts(
    df: DataFrame, key: Column, label: str, splits: Sequence[str] = ("train", "validation")
) -> DataFrame:
    """Keys with two labels inside a deduplicated split, which the caller treats as an error."""
    rows = df.where(F.col("split").isin(*splits))
    return label_conflict(rows, F.concat_ws("\u0001", F.col("split"), key), label)


def group_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Representative row per group."""
    return first_per_key(df, keys, order)


def same_split_pick(
    df: DataFrame,
    key: Column,
    cell: Sequence[str] = ("region", "intent"),
    quality: str = "annotation_quality",
    id_col: str = "id",
    seed: int = 42,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per split and key: best quality, then the cell with the fewest unique rows, then
    hash order, then id.

    The cell counts are those of rows whose key is unique. They are fixed before any choice, which
    keeps the choice parallel. ``columns`` of the chosen rows are kept, or all; they are written once with
    the key.
    """
    own = df.columns if columns is None else list(columns)
    used = dict.fromkeys([*own, "split", *cell, quality, id_col])
    rows = keyed_rows(df, key, *used).withColumnRenamed("text_key", "__key")
    sizes = rows.groupBy("split", "__key").agg(
        F.count("*").alias("__n"), *[F.min(c).alias(f"__{c}") for c in cell]
    )
    singles = (
        sizes.where("__n = 1")
        .groupBy("split", *[F.col(f"__{c}").alias(c) for c in cell])
        .agg(F.count("*").alias("__kept"))
    )
    ranked = rows.join(singles, ["split", *cell], "left").withColumns(
        {
            "__kept": F.coalesce("__kept", F.lit(0)),
            "__quality": rank_of(quality, D.QUALITY_ORDER),
            "__order": T.stable_order_key(F.col(id_col), seed),
        }
    )
    kept = first_per_key(
        ranked,
        ["split", "__key"],
        [F.col("__quality"), F.col("__kept"), F.col("__order"), F.col(id_col)],
    )
    return kept.select(*own)


def external_candidates(df: DataFrame, key: Column, seed: int = 42) -> DataFrame:
    """Mapped external rows without label conflicts, one per fingerprint."""
    return dedupe_priority(drop_label_conflicts(df, key, "intent"), key, seed)
