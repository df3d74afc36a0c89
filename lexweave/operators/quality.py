"""Corpus checks: profiles, duplicates, leakage, minimum counts.

Group-wide facts ("all of this text's rows share a group") come from ``min``/``max`` pairs, which
combine before the shuffle; no member list is ever gathered. Long texts are grouped by hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.ordering import with_previous
from lexweave.rules import domains as D
from lexweave.session import cut_lineage, literal_table


def text_key(x: Column) -> Column:
    return F.sha2(x, 256)


def keyed_rows(df: DataFrame, key: Column, *columns: str | Column) -> DataFrame:
    """The named columns with ``text_key``, written once: what reads the rows again, a join, a sort's sample or
    a second count, reads keys and no texts."""
    return cut_lineage(df.select(text_key(key).alias("text_key"), *columns))


def differs(column: str) -> Column:
    """Does the group hold more than one value?"""
    return F.min(column) < F.max(column)


def corpus_profile(df: DataFrame, dimensions: Sequence[str], slots: str | None = None) -> DataFrame:
    """Counts ``(dimension, value, split, n)`` for every dimension, over all splits (null) and per
    split.

    One pass over the corpus: rows collapse to distinct label combinations first, and the slices
    are cut from that small table.
    """
    keys = [*dict.fromkeys(["split", *dimensions])]
    base = df.select(
        *keys, *([F.array_sort(F.map_keys(slots)).alias("__slots")] if slots else [])
    )
    cells = base.groupBy(*base.columns).agg(F.count("*").alias("n"))
    labels = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
    )
    if slots:
        tagged = F.transform(
            "__slots", lambda s: F.struct(F.lit("slot").alias("dimension"), s.alias("value"))
        )
        labels = F.concat(labels, F.coalesce(tagged, F.array().cast(_LABELS)))
    per_split = (
        cells.select("split", "n", F.inline(labels))
        .groupBy("dimension", "value", "split")
        .agg(F.sum("n").alias("n"))
    )
    overall = F.array(F.col("split"), F.lit(None).cast("string"))
    return (
        per_split.select("dimension", "value", "n", F.explode(overall).alias("split"))
        .groupBy("dimension", "value", "split")
        .agg(F.sum("n").alias("n"))
    )


_LABELS = "array<struct<dimension:string,value:string>>"


def dup_groups(df: DataFrame, key: Column, group: str = "group_id") -> DataFrame:
    """Equal keys in more than one group: ``(text_key, n, n_surplus, first_group, last_group)``."""
    return (
        df.select(text_key(key).alias("text_key"), F.col(group).alias("g"))
        .groupBy("text_key")
        .agg(
            F.count("*").alias("n"), F.min("g").alias("first_group"), F.max("g").alias("last_group")
        )
        .where("first_group < last_group")
    )


def prev_duplicate(
    df: DataFrame, key: Column, order: Sequence[str], group: str = "group_id", id_col: str = "id"
) -> DataFrame:
    """Rows whose predecessor with the same key sits in another group."""
    columns = dict.fromkeys([*order, group, id_col])
    rows = keyed_rows(df, key, *columns)
    linked = with_previous(rows, ["text_key"], list(order), [group, id_col])
    return linked.where(F.col(f"prev_{group}") != F.col(group)).select(
        "text_key",
        F.col(id_col).alias("id"),
        F.col(f"prev_{id_col}").alias("prev_id"),
        F.col(group).alias("group_id"),
        F.col(f"prev_{group}").alias("prev_group"),
    )


def id_dups(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1")


def group_leakage(df: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups present in several splits. The split list is as short as the split domain."""
    return (
        df.groupBy(F.col(group).alias("group_id"))
        .agg(F.array_sort(F.collect_set("split")).alias("s"), F.count("*").alias("n"))
        .where(F.size("s") > 1)
        .select("group_id", "n", F.array_join("s", ",").alias("splits"))
    )


def source_ref_conflict(
    df: DataFrame, external: Sequence[str] = D.EXTERNAL_SOURCES
) -> DataFrame:
    """External references shared by several groups."""
    rows = df.where(F.col("source").isin(*external) & (F.coalesce("source_ref", F.lit("")) != ""))
    return (
        rows.groupBy("source_ref")
        .agg(
            F.min("group_id").alias("first_group"),
            F.max("group_id").alias("last_group"),
            F.count("*").alias("n"),
        )
        .where("first_group < last_group")
    )


def same_split_dups(df: DataFrame, key: Column) -> DataFrame:
    """Equal keys more than once inside one split."""
    return (
        df.select("split", text_key(key).alias("text_key"))
        .groupBy("split", "text_key")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )


def label_conflict(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Keys that carry more than one label."""
    return _two_labels(df.select(text_key(key).alias("text_key"), F.col(label).alias("l")))


def _two_labels(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("text_key")
        .agg(
            F.count("*").alias("n"), F.min("l").alias("first_label"), F.max("l").alias("last_label")
        )
        .where("first_label < last_label")
    )


def drop_label_conflicts(
    df: DataFrame, key: Column, label: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Remove every row of a key whose labels disagree. Of the other rows ``columns`` are kept, or all; these are
    written once with the key."""
    kept = df.columns if columns is None else list(columns)
    rows = keyed_rows(df, key, *dict.fromkeys([*kept, label]))
    bad = _two_labels(rows.select("text_key", F.col(label).alias("l"))).select("text_key")
    return rows.join(bad, "text_key", "left_anti").select(*kept)


def reconcile(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded against actual ``(metric, value, n)``; only what disagrees."""
    joined = recorded.select("metric", "value", F.col("n").alias("recorded")).join(
        actual.select("metric", "value", F.col("n").alias("actual")), ["metric", "value"], "full"
    )
    return joined.where(~F.col("recorded").eqNullSafe(F.col("actual")))


def missing_files(df: DataFrame, expected: Sequence[str] = D.EXPECTED_FILES) -> DataFrame:
    wanted = literal_table(df.sparkSession, [(f,) for f in expected], "file string")
    return wanted.exceptAll(df.select("file").distinct())


def normalization_collisions(df: DataFrame, normalized: str = "normalized_text") -> DataFrame:
    """Normalised texts seen under several ids, and whether they cross splits."""
    return _collisions(df.select(text_key(F.col(normalized)).alias("text_key"), "split", "id"))


def _collisions(rows: DataFrame) -> DataFrame:
    return (
        rows.groupBy("text_key")
        .agg(
            F.count("*").alias("n"),
            F.min("split").alias("first_split"),
            F.max("split").alias("last_split"),
            differs("id").alias("many_ids"),
        )
        .where((F.col("first_split") < F.col("last_split")) | F.col("many_ids"))
        .select("text_key", "n", (F.col("first_split") < F.col("last_split")).alias("cross_split"))
    )


def normalization_audit(
    df: DataFrame, raw_folded: Column, normalized: str = "normalized_text"
) -> DataFrame:
    """Long table ``(metric, value, n)``: changed, unchanged, detected regions, collisions."""
    change = F.when(F.col(normalized) != raw_folded, "changed").otherwise("unchanged")
    region = F.col("normalizer_region").alias("region")
    rows = keyed_rows(df, F.col(normalized), "split", "id", change.alias("change"), region)
    cells = rows.groupBy("change", "region").agg(F.count("*").alias("n"))
    labels = F.array(
        F.struct(F.lit("change").alias("metric"), F.col("change").alias("value")),
        F.struct(F.lit("region").alias("metric"), F.col("region").alias("value")),
    )
    counts = cells.select("n", F.inline(labels))
    hits = _collisions(rows).select(
        F.lit(1).cast("bigint").alias("n"),
        F.lit("collision").alias("metric"),
        F.when(F.col("cross_split"), "cross_split").otherwise("same_split").alias("value"),
    )
    return counts.unionByName(hits).groupBy("metric", "value").agg(F.sum("n").alias("n"))


def split_shares(df: DataFrame, targets: dict[str, float] = D.SPLIT_SHARES) -> DataFrame:
    """Share per split next to its target; splits without rows show share 0."""
    wanted = literal_table(df.sparkSession, list(targets.items()), "split string, target double")
    counts = df.groupBy("split").agg(F.count("*").alias("c"))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"))
    n = F.coalesce("c", F.lit(0)).cast("bigint")
    return (
        wanted.join(counts, "split", "left")
        .crossJoin(F.broadcast(total))
        .select(
            "split",
            "target",
            n.alias("n"),
            F.when(F.col("total") > 0, n / F.col("total")).otherwise(0.0).alias("share"),
        )
    )


def spread_check(df: DataFrame, tolerance: float = D.SHARE_TOLERANCE) -> DataFrame:
    return split_shares(df).where(F.abs(F.col("share") - F.col("target")) > tolerance)


def below_minimum(
    counts: DataFrame, domain: list[tuple], keys: Sequence[str], minimum: int
) -> DataFrame:
    """Domain cells with fewer than ``minimum`` rows, cells without any row included."""
    ddl = ", ".join(f"{k} string" for k in keys)
    cells = literal_table(counts.sparkSession, domain, ddl)
    return (
        cells.join(counts, list(keys), "left")
        .select(*keys, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
        .where(F.col("n") < minimum)
    )


def minimums(df: DataFrame) -> DataFrame:
    """Every size floor that is not met: ``(rule, cell, n)``."""
    cells = (
        df.groupBy("split", "intent", "region", F.array_sort(F.map_keys("slots")).alias("s"))
        .agg(F.count("*").alias("n"))
        .transform(_cache_small)
    )

    def summed(*keys: str) -> DataFrame:
        return cells.groupBy(*keys).agg(F.sum("n").alias("n"))

    def cell_name(found: DataFrame, rule: str, *keys: str) -> DataFrame:
        return found.select(F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("cell"), "n")

    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    test = cells.where("split = 'test'").groupBy("region", "intent").agg(F.sum("n").alias("n"))
    by_slot = (
        cells.select("split", "n", F.explode("s").alias("slot"))
        .groupBy("split", "slot")
        .agg(F.sum("n").alias("n"))
    )
    parts = [
        total.where(F.col("n") < D.MIN_TOTAL).select(
            F.lit("total").alias("rule"), F.lit("all").alias("cell"), "n"
        ),
        cell_name(
            below_minimum(summed("intent"), [(i,) for i in D.INTENTS], ["intent"], D.MIN_PER_INTENT),
            "intent",
            "intent",
        ),
        cell_name(
            below_minimum(
                summed("region"), [(r,) for r in D.DIALECTS], ["region"], D.MIN_PER_REGION
            ),
            "region",
            "region",
        ),
        cell_name(
            below_minimum(
                test,
                [(r, i) for r in D.DIALECTS for i in D.INTENTS],
                ["region", "intent"],
                D.MIN_PER_CELL,
            ),
            "test_region_intent",
            "region",
            "intent",
        ),
        cell_name(
            below_minimum(
                by_slot,
                [(s, k) for s in ("validation", "test") for k in D.SLOTS],
                ["split", "slot"],
                D.MIN_PER_CELL,
            ),
            "split_slot",
            "split",
            "slot",
        ),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _cache_small(df: DataFrame) -> DataFrame:
    """Label combinations: bounded by the label domains, read several times."""
    return df.persist()


def filter_report(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows before and after each step, in total and per source.

    ``steps`` names the corpus after each step, first the unfiltered one. The counts of all steps
    form one small table.
    """
    counts = None
    for position, (name, df) in enumerate(steps):
        part = df.groupBy("source").agg(F.count("*").alias("n")).select(
            F.lit(position).alias("position"), F.lit(name).alias("step"), "source", "n"
        )
        counts = part if counts is None else counts.unionByName(part)
    both = F.array(F.col("source"), F.lit("all"))
    by_step = (
        counts.select("position", "n", F.explode(both).alias("source"))
        .groupBy("source")
        .pivot("position", list(range(len(steps))))
        .agg(F.sum("n"))
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(steps[i][0]).alias("step"),
                F.coalesce(F.col(str(i - 1)), F.lit(0)).alias("before"),
                F.coalesce(F.col(str(i)), F.lit(0)).alias("after"),
            )
            for i in range(1, len(steps))
        ]
    )
    return by_step.select("source", F.inline(rows)).select(
        "step", "source", "before", "after", (F.col("before") - F.col("after")).alias("dropped")
    )


def preprocess_counts(before: DataFrame, after: DataFrame, key: str = "split") -> DataFrame:
    """Input, output and dropped rows per key and in total."""
    sides = before.select(key, F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(
        after.select(key, F.lit(0).alias("i"), F.lit(1).alias("o"))
    )
    return sides.rollup(key).agg(
        F.sum("i").alias("input"),
        F.sum("o").alias("output"),
        (F.sum("i") - F.sum("o")).alias("dropped"),
    )


def required_coverage(df: DataFrame, splits: Sequence[str] = D.SPLITS) -> DataFrame:
    """Slots a split's templates never mention although some split does; the lists are as short
    as the slot domain."""
    seen = df.select("split", "intent", F.explode("slot_names").alias("slot")).distinct()
    needed = seen.select("intent", "slot").distinct()
    wanted = literal_table(df.sparkSession, [(s,) for s in splits], "split string")
    return needed.crossJoin(wanted).join(seen, ["split", "intent", "slot"], "left_anti")
