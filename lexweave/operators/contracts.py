"""Row contracts: what a labelled row or a parse request must satisfy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.stage import let, literal
from lexweave.rules import domains as D

VIOLATIONS = "id string, rule string, detail string"


def _blank(x: Column) -> Column:
    return x.isNull() | (F.regexp_replace(x, r"(?U)\s+", "") == "")


def request_ok(text: Column, max_chars: int = 500) -> Column:
    """A parse request holds 1 to ``max_chars`` characters and is not blank."""
    return F.coalesce(F.char_length(text).between(1, max_chars) & ~_blank(text), F.lit(False))


def _lookup(table: Mapping[str, Sequence], key: Column, value_type: str) -> Column:
    return F.try_element_at(literal(dict(table), f"map<string,{value_type}>"), key)


def missing_groups(
    intent: Column,
    slot_names: Column,
    required: Mapping[str, Sequence[Sequence[str]]] = D.REQUIRED_GROUPS,
) -> Column:
    """Labels of the slot groups that could complete the row; empty when one is complete."""
    groups = _lookup(
        {k: [list(g) for g in v] for k, v in required.items()}, intent, "array<array<string>>"
    )
    complete = F.exists(groups, lambda g: F.size(F.array_except(g, slot_names)) == 0)
    labels = F.transform(groups, lambda g: F.array_join(F.array_sort(g), "/"))
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(complete, F.lit(True)), empty).otherwise(labels)


def row_contract(
    df: DataFrame,
    allowed: Mapping[str, Sequence[str]] = D.ALLOWED_SLOTS,
    required: Mapping[str, Sequence[Sequence[str]]] = D.REQUIRED_GROUPS,
    regions: Sequence[str] = D.REGIONS,
    external: Sequence[str] = D.EXTERNAL_SOURCES,
) -> DataFrame:
    """One row per broken rule: ``(id, rule, detail)``. A single narrow pass."""
    slots = F.coalesce(F.col("slots"), F.map_from_arrays(F.array(), F.array()).cast(SLOTS_TYPE))
    names = F.map_keys(slots)
    all_slots = sorted({s for group in allowed.values() for s in group})
    unknown = F.array_except(names, F.array(*map(F.lit, all_slots)))
    permitted = F.coalesce(
        _lookup({k: list(v) for k, v in allowed.items()}, F.col("intent"), "array<string>"),
        F.array().cast("array<string>"),
    )
    misplaced = F.array_except(F.array_except(names, unknown), permitted)
    empty = F.map_keys(
        F.map_filter(slots, lambda k, vs: (F.size(vs) <= 0) | F.exists(vs, _blank))
    )
    missing = missing_groups(F.col("intent"), names, required)
    needs_ref = F.col("source").isin(*external)

    def rule(name: str, broken: Column, detail: Column) -> Column:
        return F.when(
            F.coalesce(broken, F.lit(True)),
            F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")),
        )

    def listed(x: Column) -> Column:
        return F.array_join(F.array_sort(x), ",")

    rules = F.array(
        *[rule(f"blank_{c}", _blank(F.col(c)), F.lit("")) for c in ("id", "group_id", "text")],
        rule("unknown_intent", ~F.col("intent").isin(*allowed), F.col("intent")),
        rule("unknown_region", ~F.col("region").isin(*regions), F.col("region")),
        rule("unknown_slot", F.size(unknown) > 0, listed(unknown)),
        rule("empty_slot", F.size(empty) > 0, listed(empty)),
        rule("slot_not_allowed", F.size(misplaced) > 0, listed(misplaced)),
        rule("missing_slot_group", F.size(missing) > 0, F.array_join(missing, "|")),
        rule(
            "missing_source_ref",
            F.coalesce(needs_ref, F.lit(False)) & (F.coalesce("source_ref", F.lit("")) == ""),
            F.col("source"),
        ),
        rule(
            "external_region",
            F.coalesce(F.col("source") == "massive", F.lit(False))
            & (F.col("region") != "standard"),
            F.col("region"),
        ),
    )
    return df.select(
        "id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("v")
    ).select("id", "v.rule", "v.detail")


SLOTS_TYPE = "map<string,array<string>>"


def region_file_check(df: DataFrame) -> DataFrame:
    """Regional test files may hold only their own region."""
    own = F.regexp_extract("file", r"^test_([a-z]+)\.", 1)
    return df.where((own != "") & own.isin(*D.REGIONS) & (F.col("region") != own)).select(
        "id", F.lit("region_file").alias("rule"), F.col("region").alias("detail")
    )


def slot_traceability(df: DataFrame, text: str = "text", slots: str = "slots") -> DataFrame:
    """Slot values that cannot be found in the row's text. A text is folded once, and only for values that it
    does not show as they are; rows without slots are not read."""
    t = F.col(text)
    pairs = F.flatten(
        F.transform(
            F.map_entries(slots),
            lambda e: F.transform(
                F.coalesce(e["value"], F.array().cast("array<string>")),
                lambda v: F.struct(e["key"].alias("slot"), v.alias("value")),
            ),
        )
    )

    def lost(found: Column) -> Column:
        hidden = F.exists(
            found, lambda p: (p["slot"] != "phone_number") & (p["value"] != "") & ~F.contains(t, p["value"])
        )
        numbers = F.exists(found, lambda p: p["slot"] == "phone_number")
        whole = F.when(F.coalesce(hidden, F.lit(True)), T.folded_canonical(t)).otherwise(t)
        digits = F.when(F.coalesce(numbers, F.lit(False)), T.digits_of(t))
        return let(
            whole,
            lambda w: let(
                digits,
                lambda d: F.filter(found, lambda p: ~T.slot_in_text(p["slot"], p["value"], t, w, d)),
            ),
        )

    rows = df.where(F.size(F.col(slots)) > 0).select("id", F.inline(let(pairs, lost)))
    return rows.select(
        "id",
        F.lit("slot_not_in_text").alias("rule"),
        F.concat_ws("=", "slot", "value").alias("detail"),
    )


def assert_clean(violations: DataFrame) -> None:
    """Fail a job on the first few violations; listing is for people, not for processing."""
    sample = violations.limit(20).collect()
    if sample:
        lines = "; ".join(" ".join(str(v) for v in row) for row in sample)
        raise ValueError(f"rows break the contract: {lines}")
