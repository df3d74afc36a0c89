"""Ranks and running totals that never put a whole group into one task.

Rows are cut into slices whose order is known; totals per slice are a small table, so a running
total is the total of the earlier slices plus a window inside one slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Three hexadecimal digits of a hash: 4096 even slices.
HASH_SLICE_DIGITS = 3
# Slices of a group in the order of a value.
SLICES = 128
# Up to this many rows per key Spark limits ranks before the shuffle (its own default bound).
RANK_LIMIT = 1000


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    slice_col: str,
    order: Sequence[Column],
    sums: Sequence[str],
    descending_slices: bool = False,
) -> DataFrame:
    """Add ``cum_<c>`` (up to and including the row) and ``all_<c>`` (group total) columns.

    ``slice_col`` must grow (or fall, if ``descending_slices``) with ``order``.
    """
    keys = [*by, slice_col]
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    group = W.partitionBy(*(by or [F.lit(0)]))
    slice_order = F.col(slice_col).desc() if descending_slices else F.col(slice_col).asc()
    before = group.orderBy(slice_order).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
        *[F.sum(f"__{c}").over(group).alias(f"all_{c}") for c in sums],
    )
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({f"__local_{c}": F.sum(c).over(inside) for c in sums})
    joined = local.join(offsets, keys)
    return joined.withColumns(
        {f"cum_{c}": F.col(f"__local_{c}") + F.col(f"__before_{c}") for c in sums}
    ).drop(*[f"__local_{c}" for c in sums], *[f"__before_{c}" for c in sums])


def even_slices(df: DataFrame, by: Sequence[str], value: str, slice_col: str) -> DataFrame:
    """Add ``slice_col``, which grows with ``value`` and splits each group's rows evenly.

    The bounds are approximate percentiles of the rows themselves, so an outlier or a crowd of close
    values does not fill one slice; a value has one slice, whatever the bounds' error.
    """
    steps = F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)])
    bounds = df.groupBy(*by).agg(F.percentile_approx(value, steps, 100 * SLICES).alias("__bounds"))
    joined = df.join(bounds, list(by)) if by else df.crossJoin(F.broadcast(bounds))
    below = F.filter("__bounds", lambda b: b < F.col(value))
    return joined.withColumn(slice_col, F.size(below)).drop("__bounds")


def hash_rank(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``rank`` (from 1) in order of a unique hexadecimal hash column, and ``total``."""
    sliced = df.withColumns(
        {"__slice": F.substring(F.col(key), 1, HASH_SLICE_DIGITS), "one": F.lit(1)}
    )
    ranked = running_totals(sliced, by, "__slice", [F.col(key)], ["one"])
    return ranked.withColumnsRenamed({"cum_one": "rank", "all_one": "total"}).drop(
        "__slice", "one"
    )


def row_numbers(df: DataFrame, by: Sequence[str], order: Sequence[str], output: str) -> DataFrame:
    """Add the row's number (from 1) in the order of the columns ``order`` within ``by``.

    Range partitioning cuts a large group into slices; they are written once because the totals and the rows
    must see the same cut.
    """
    from lexweave.session import cut_lineage

    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(slices, *by, *order)
    cut = cut_lineage(ranged.withColumns({"__slice": F.spark_partition_id(), "__one": F.lit(1)}))
    numbered = running_totals(cut, by, "__slice", [F.col(c) for c in order], ["__one"])
    return numbered.withColumnRenamed("cum___one", output).drop("__slice", "__one", "all___one")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key. ``row_number() = 1`` is limited map-side, so a hot key never gathers."""
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rn") == 1).drop("__rn")


def first_n_per_key(
    df: DataFrame, keys: Sequence[str], key_hash: str, limit: Column, max_limit: int
) -> DataFrame:
    """Rows whose hash rank inside the key is at most ``limit`` (a column, at most ``max_limit``).

    Small limits use a rank that Spark cuts before the shuffle; large ones the sliced rank.
    """
    if max_limit < RANK_LIMIT:
        window = W.partitionBy(*keys).orderBy(key_hash)
        ranked = df.withColumn("__rn", F.row_number().over(window))
        kept = ranked.where(F.col("__rn") <= max_limit)
        return kept.where(F.col("__rn") <= limit).drop("__rn")
    return hash_rank(df, key_hash, by=keys).where(F.col("rank") <= limit).drop("rank", "total")


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """Add ``prev_<c>`` from the row before in ``order`` within ``keys``.

    Range partitioning spreads a hot key over many slices; the last row of each slice is handed to
    the next one. The slices are written once because both steps must see the same cut.
    """
    from lexweave.session import cut_lineage

    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = cut_lineage(
        df.repartitionByRange(slices, *keys, *order).withColumn(
            "__slice", F.spark_partition_id()
        )
    )
    in_slice = W.partitionBy(*keys, "__slice").orderBy(*order)
    last = F.max(
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *carry)
    ).alias("__last")
    across = W.partitionBy(*keys).orderBy("__slice")
    heads = (
        cut.groupBy(*keys, "__slice")
        .agg(last)
        .select(*keys, "__slice", F.lag("__last").over(across).alias("__carried"))
        .where("__carried is not null")
    )
    local = cut.withColumns(
        {
            "__rn": F.row_number().over(in_slice),
            **{f"__lag_{c}": F.lag(c).over(in_slice) for c in carry},
        }
    )
    joined = local.join(heads, [*keys, "__slice"], "left")
    return joined.withColumns(
        {
            f"prev_{c}": F.when(F.col("__rn") == 1, F.col("__carried")[c]).otherwise(
                F.col(f"__lag_{c}")
            )
            for c in carry
        }
    ).drop("__slice", "__rn", "__carried", *[f"__lag_{c}" for c in carry])


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Linearly interpolated percentiles per group, one column per fraction.

    Equal values collapse first; ranks come from sliced running totals, so no task holds a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    sliced = even_slices(counts, by, value, "__slice")
    ranked = running_totals(sliced, by, "__slice", [F.col(value)], ["n"])

    def held(rank: Column) -> Column:
        covers = (rank >= F.col("cum_n") - F.col("n")) & (rank < F.col("cum_n"))
        return F.max(F.when(covers, F.col(value)))

    aggregates = []
    for name, fraction in fractions.items():
        target = (F.col("all_n") - 1) * F.lit(float(fraction))
        aggregates += [
            held(F.floor(target)).alias(f"__{name}_lo"),
            held(F.ceil(target)).alias(f"__{name}_hi"),
            F.first(target - F.floor(target)).alias(f"__{name}_w"),
        ]
    found = ranked.groupBy(*by).agg(*aggregates)
    return found.select(
        *by,
        *[
            (
                F.col(f"__{n}_lo") + (F.col(f"__{n}_hi") - F.col(f"__{n}_lo")) * F.col(f"__{n}_w")
            ).alias(n)
            for n in fractions
        ],
    )
