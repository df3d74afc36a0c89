"""Quality metrics over a scored table.

Scored rows collapse to small count tables in one combining pass; ratios, sweeps and slices are
cut from those. A zero denominator gives 0.0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.stage import evaluate, let
from lexweave.operators.ordering import even_slices, exact_quantiles, running_totals
from lexweave.rules import domains as D
from lexweave.session import literal_table

_EPS = 2.220446049250313e-16


def ratio(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def confusion_counts(
    df: DataFrame, expected: str = "expected", predicted: str = "predicted"
) -> DataFrame:
    return df.groupBy(
        F.col(expected).alias("expected"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n"))


def confusion_matrix(
    df: DataFrame,
    labels: Sequence[str],
    expected: str = "expected",
    predicted: str = "predicted",
) -> DataFrame:
    """One row per expected label, one count column per predicted label, zero cells included."""
    names = literal_table(
        df.sparkSession, [(i, x) for i, x in enumerate(labels)], "position int, expected string"
    )
    cells = confusion_counts(df, expected, predicted).where(F.col("predicted").isin(*labels))
    wide = cells.groupBy("expected").pivot("predicted", list(labels)).agg(F.sum("n"))
    joined = names.join(wide, "expected", "left")
    return joined.select(
        "expected", *[F.coalesce(F.col(f"`{x}`"), F.lit(0)).alias(x) for x in labels]
    )


def classification_report(
    df: DataFrame,
    labels: Sequence[str],
    expected: str = "expected",
    predicted: str = "predicted",
) -> DataFrame:
    """``(label, precision, recall, f1, support)`` per label plus ``accuracy``, ``macro avg`` and
    ``weighted avg`` rows. Predictions outside the labels only lower recall."""
    cells = confusion_counts(df, expected, predicted)
    hit = F.col("expected") == F.col("predicted")
    marks = F.array(
        F.struct(
            F.col("expected").alias("label"),
            F.when(hit, F.col("n")).otherwise(0).alias("tp"),
            F.lit(0).cast("bigint").alias("fp"),
            F.when(hit, 0).otherwise(F.col("n")).alias("fn"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("bigint").alias("tp"),
            F.when(hit, 0).otherwise(F.col("n")).alias("fp"),
            F.lit(0).cast("bigint").alias("fn"),
        ),
    )
    counts = cells.select(F.inline(marks)).groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]
    )
    names = literal_table(df.sparkSession, [(x,) for x in labels], "label string")
    filled = names.join(counts, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    scored = filled.select(
        "label",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        (F.col("tp") + F.col("fn")).alias("support"),
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    measures = ("precision", "recall", "f1")
    weight = F.col("support")

    def averaged(name: str, value) -> DataFrame:
        return scored.agg(
            *[value(F.col(m)).alias(m) for m in measures], F.sum("support").alias("support")
        ).select(F.lit(name).alias("label"), *measures, "support")

    accuracy = cells.agg(
        ratio(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("a"),
        F.sum("n").alias("support"),
    ).select(F.lit("accuracy").alias("label"), *[F.col("a").alias(m) for m in measures], "support")
    return (
        scored.select("label", *measures, "support")
        .unionByName(accuracy)
        .unionByName(averaged("macro avg", F.avg))
        .unionByName(
            averaged("weighted avg", lambda m: ratio(F.sum(m * weight), F.sum(weight)))
        )
    )


def _distinct_values(values: Column) -> Column:
    """A slot's distinct surface values. Values that are in surface form already are told together: joined by
    single spaces they make a text in surface form."""
    joined = F.array_join(values, " ")
    tidy = let(joined, lambda j: T.normalize_surface(j) == j)
    return F.array_distinct(F.when(tidy, values).otherwise(F.transform(values, T.normalize_surface)))


def _told(slots: str) -> Column:
    """A slot map's distinct pairs as strings, which array functions hash; structs they compare one
    by one."""
    nested = F.transform(
        F.map_entries(slots),
        lambda e: F.transform(
            e["value"],
            lambda v: F.concat(
                F.char_length(e["key"]).cast("string"), F.lit(":"), e["key"], T.normalize_surface(v)
            ),
        ),
    )
    return F.array_distinct(F.flatten(nested))


def _lists(slots: str) -> Column:
    """Are all value lists of the map there?"""
    return F.forall(F.map_values(slots), lambda v: v.isNotNull())


def _alone(a: str, b: str) -> Column:
    """Has ``a`` values in a slot where ``b`` has none?"""
    return F.exists(
        F.map_entries(a),
        lambda e: F.get(e["value"], F.lit(0)).isNotNull()
        & (F.coalesce(F.size(F.try_element_at(F.col(b), e["key"])), F.lit(0)) <= 0),
    )


def slots_equal(a: str, b: str) -> Column:
    """Do two slot maps hold the same pairs? Equal maps, and a slot that only one of them fills, are told
    before any value is normalised."""

    def same(x: Column, y: Column) -> Column:
        return (F.size(x) == F.size(y)) & (F.size(F.array_except(x, y)) == 0)

    whole = _lists(a) & _lists(b)
    alike = whole & (F.map_entries(a) == F.map_entries(b))
    apart = whole & (_alone(a, b) | _alone(b, a))
    told = let(_told(a), lambda x: let(_told(b), lambda y: same(x, y)))
    return F.when(alike, True).when(apart, False).otherwise(told)


def _compared(expected: str, predicted: str) -> Column:
    """Per slot its name and the values ``tp``, ``fp`` and ``fn``; equal lists are normalised once."""
    none = F.array().cast("array<string>")

    def held(slots: str, key: Column) -> Column:
        return F.when(F.map_contains_key(F.col(slots), key), F.try_element_at(F.col(slots), key)).otherwise(none)

    def parted(slot: Column, tp: Column, fp: Column, fn: Column) -> Column:
        return F.struct(slot.alias("slot"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    def of(slot: Column, x: Column, y: Column) -> Column:
        return parted(slot, F.array_intersect(x, y), F.array_except(y, x), F.array_except(x, y))

    def compared(slot: Column, x: Column, y: Column) -> Column:
        both = let(_distinct_values(x), lambda v: let(_distinct_values(y), lambda w: of(slot, v, w)))
        return F.when(x == y, parted(slot, _distinct_values(x), none, none)).otherwise(both)

    rows = F.transform(
        F.array_union(F.map_keys(expected), F.map_keys(predicted)),
        lambda k: let(held(expected, k), lambda x: let(held(predicted, k), lambda y: compared(k, x, y))),
    )
    return F.when(_lists(expected) & _lists(predicted), rows)


def pair_diff(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """``(id, kind, slot, value)`` with kind ``tp``, ``fp`` or ``fn``. One narrow pass."""

    def marked(slot: Column, kind: str, values: Column) -> Column:
        return F.transform(
            values, lambda v: F.struct(F.lit(kind).alias("kind"), slot.alias("slot"), v.alias("value"))
        )

    rows = df.select("id", F.inline(_compared(expected, predicted)))
    parts = F.concat(*[marked(F.col("slot"), kind, F.col(kind)) for kind in ("tp", "fp", "fn")])
    return rows.select("id", F.inline(parts))


def slot_prf(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Counts and scores per slot; the null slot is the micro average. Pairs are counted in their row."""
    counts = (
        df.select(F.inline(_compared(expected, predicted)))
        .select("slot", *[F.size(k).cast("bigint").alias(k) for k in ("tp", "fp", "fn")])
        .where("tp + fp + fn > 0")
        .rollup("slot")
        .agg(*[F.sum(k).alias(k) for k in ("tp", "fp", "fn")])
    )
    return counts.na.fill(0, ["tp", "fp", "fn"]).select(
        "slot",
        (F.col("tp") + F.col("fn")).alias("support"),
        "tp",
        "fp",
        "fn",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    ).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def slot_exact(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("n"),
        ratio(F.count_if(slots_equal(expected, predicted)), F.count("*")).alias("exact_match"),
    )


def sliced_eval(
    df: DataFrame, dimensions: Sequence[str], flags: dict[str, Column]
) -> DataFrame:
    """``(dimension, value, n, <flag rates>)`` for every value of every dimension."""
    counted = df.groupBy(*dimensions).agg(
        F.count("*").alias("n"), *[F.count_if(c).alias(f"__{k}") for k, c in flags.items()]
    )
    labels = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dimensions
        ]
    )
    sums = [f"__{k}" for k in flags]
    sliced = (
        counted.select("n", *sums, F.inline(labels))
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums])
    )
    return sliced.select(
        "dimension", "value", "n", *[ratio(f"__{k}", "n").alias(k) for k in flags]
    )


def frame_flags() -> dict[str, Column]:
    """The success flags of a command, from a scored table."""
    intent = F.col("runtime_intent") == F.col("expected")
    slots = slots_equal("runtime_slots", "expected_slots")
    action = F.col("action_status").isNotNull()
    return {
        "intent_accuracy": intent,
        "oracle_slot_exact": slots_equal("oracle_slots", "expected_slots"),
        "slot_exact": slots,
        "frame_exact": intent & slots,
        "action_rate": action,
        "full_success": intent & slots & action,
    }


def coverage_selective(
    df: DataFrame, expected: str = "expected", predicted: str = "predicted"
) -> DataFrame:
    accepted = F.col(predicted) != D.UNKNOWN
    correct = accepted & (F.col(predicted) == F.col(expected))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(accepted).alias("accepted"),
        ratio(F.count_if(accepted), F.count("*")).alias("coverage"),
        ratio(F.count_if(correct), F.count_if(accepted)).alias("selective_accuracy"),
    )


def threshold_sweep(
    df: DataFrame,
    thresholds: Sequence[float],
    expected: str = "expected",
    predicted: str = "predicted",
    confidence: str = "confidence",
) -> DataFrame:
    """Accepted and rejected rows per threshold, overall (null intent) and per expected intent.

    Rows collapse to (intent, correct, thresholds reached); no row is copied per threshold.
    """
    ordered = sorted(set(thresholds))
    if any(not 0.0 <= t <= 1.0 for t in ordered):
        raise ValueError("thresholds lie in [0, 1]")
    reached = sum((F.when(F.col(confidence) >= t, 1).otherwise(0) for t in ordered), F.lit(0))
    cells = df.groupBy(
        F.col(expected).alias("intent"),
        (F.col(expected) == F.col(predicted)).alias("correct"),
        reached.alias("reached"),
    ).agg(F.count("*").alias("n"))
    steps = literal_table(
        df.sparkSession, list(enumerate(ordered)), "step int, threshold double"
    )
    accepted = F.col("reached") > F.col("step")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    per_intent = cells.crossJoin(steps).groupBy("threshold", "intent").agg(
        F.sum("n").alias("total"),
        total(accepted).alias("accepted"),
        total(accepted & ~F.col("correct")).alias("accepted_errors"),
        total(~accepted & F.col("correct")).alias("correct_rejected"),
    )
    counts = ("total", "accepted", "accepted_errors", "correct_rejected")
    overall = per_intent.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in counts])
    both = per_intent.unionByName(overall.withColumn("intent", F.lit(None).cast("string")))
    return both.select(
        "threshold",
        "intent",
        "total",
        "accepted",
        (F.col("total") - F.col("accepted")).alias("rejected"),
        ratio("accepted", "total").alias("coverage"),
        "accepted_errors",
        "correct_rejected",
        ratio(F.col("accepted") - F.col("accepted_errors"), F.col("accepted")).alias(
            "selective_accuracy"
        ),
    )


def operating_point(
    sweep: DataFrame, threshold: float = D.CONFIDENCE_THRESHOLD, floor: float = D.MIN_INTENT_COVERAGE
) -> DataFrame:
    """Lowest per-intent coverage at a threshold, next to its floor."""
    rows = sweep.where((F.col("threshold") == threshold) & F.col("intent").isNotNull())
    return rows.agg(F.min("coverage").alias("min_coverage")).select(
        F.lit(threshold).alias("threshold"),
        "min_coverage",
        F.lit(floor).alias("target"),
        (F.col("min_coverage") >= floor).alias("met"),
    )


def log_loss(df: DataFrame, expected: str = "expected", probs: str = "probs") -> DataFrame:
    p = F.coalesce(F.try_element_at(F.col(probs), F.col(expected)), F.lit(0.0))
    clipped = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1.0 - _EPS))
    return df.agg(F.avg(-F.log(clipped)).alias("log_loss"))


def brier(
    df: DataFrame, labels: Sequence[str], expected: str = "expected", probs: str = "probs"
) -> DataFrame:
    terms = [
        F.pow(
            F.coalesce(F.try_element_at(F.col(probs), F.lit(x)), F.lit(0.0))
            - F.when(F.col(expected) == x, 1.0).otherwise(0.0),
            F.lit(2),
        )
        for x in labels
    ]
    return df.agg(F.avg(sum(terms, F.lit(0.0))).alias("brier"))


def calibration_bins(
    df: DataFrame, expected: str = "expected", predicted: str = "predicted",
    confidence: str = "confidence", bins: int = 10,
) -> DataFrame:
    """Equal bins, closed below, the last closed above too: rows, accuracy, mean confidence."""
    edges = [round(i / bins, 12) for i in range(1, bins)]
    b = sum((F.when(F.col(confidence) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    inside = F.col(confidence).between(0.0, 1.0)
    return (
        df.where(inside)
        .groupBy(b.alias("bin"))
        .agg(
            F.count("*").alias("n"),
            F.avg((F.col(expected) == F.col(predicted)).cast("double")).alias("accuracy"),
            F.avg(confidence).alias("mean_confidence"),
        )
    )


def ece(df: DataFrame, **columns: str) -> DataFrame:
    bins = calibration_bins(df, **columns)
    gap = F.abs(F.col("accuracy") - F.col("mean_confidence")) * F.col("n")
    return bins.agg(ratio(F.sum(gap), F.sum("n")).alias("ece"))


def _ranked_scores(
    df: DataFrame, labels: Sequence[str], expected: str, probs: str
) -> DataFrame:
    """Distinct scores per class, falling, with positives and negatives so far."""
    classes = F.array(
        *[
            F.struct(
                F.lit(x).alias("label"),
                F.coalesce(F.try_element_at(F.col(probs), F.lit(x)), F.lit(0.0)).alias("score"),
                (F.col(expected) == x).alias("hit"),
            )
            for x in labels
        ]
    )
    scores = (
        df.select(F.inline(classes))
        .groupBy("label", "score")
        .agg(F.count_if("hit").alias("pos"), F.count_if(~F.col("hit")).alias("neg"))
    )
    sliced = even_slices(scores, ["label"], "score", "slice")
    return running_totals(
        sliced, ["label"], "slice", [F.desc("score")], ["pos", "neg"], descending_slices=True
    ).drop("slice")


def curve_points(
    df: DataFrame, labels: Sequence[str], expected: str = "expected", probs: str = "probs"
) -> DataFrame:
    """ROC and precision-recall points at every distinct score of every class."""
    return _ranked_scores(df, labels, expected, probs).select(
        "label",
        "score",
        ratio("cum_neg", "all_neg").alias("fpr"),
        ratio("cum_pos", "all_pos").alias("tpr"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
    )


def ranking_metrics(
    df: DataFrame, labels: Sequence[str], expected: str = "expected", probs: str = "probs"
) -> DataFrame:
    """One-vs-rest area under ROC and average precision per class, and their ``macro`` mean."""
    points = _ranked_scores(df, labels, expected, probs)
    area = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)
    gain = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    per_class = points.groupBy("label").agg(
        F.try_divide(F.sum(area), F.max("all_pos") * F.max("all_neg")).alias("roc_auc"),
        ratio(F.sum(gain), F.max("all_pos")).alias("average_precision"),
    )
    macro = per_class.agg(
        F.avg("roc_auc").alias("roc_auc"), F.avg("average_precision").alias("average_precision")
    ).select(F.lit("macro").alias("label"), "roc_auc", "average_precision")
    return per_class.unionByName(macro)


def measure_summary(
    df: DataFrame, value: str, order: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """First, mean, median, p95, p99, maximum, median without the first row, rows per second.

    ``value`` is in milliseconds; ``order`` names the columns that tell which row came first.
    """
    by = list(by)
    first = F.min_by(value, F.struct(*order))
    base = df.groupBy(*by).agg(
        F.count(value).alias("n"),
        first.alias("first"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        ratio(F.count(value), F.sum(value) / 1000.0).alias("rows_per_second"),
    )
    quantiles = exact_quantiles(df, by, value, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    heads = df.groupBy(*by).agg(
        F.min(F.struct(*order)).alias("__first"), F.count(value).alias("__n")
    )
    marked = df.join(heads, by) if by else df.crossJoin(F.broadcast(heads))
    later = (F.struct(*order) > F.col("__first")) | (F.col("__n") == 1)
    steady = exact_quantiles(marked.where(later), by, value, {"steady_median": 0.5})
    if by:
        return base.join(quantiles, by).join(steady, by)
    return base.crossJoin(F.broadcast(quantiles)).crossJoin(F.broadcast(steady))


def action_safety(df: DataFrame) -> DataFrame:
    """False-action rate on negatives; recall (executed with the right intent) on positives."""
    should, ran = F.col("should_execute"), F.col("executed")
    right = F.col("expected_intent").isNull() | (F.col("intent") == F.col("expected_intent"))
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(~should).alias("negative_total"),
        F.count_if(~should & ran).alias("false_actions"),
        ratio(F.count_if(~should & ran), F.count_if(~should)).alias("false_action_rate"),
        F.count_if(should).alias("positive_total"),
        F.count_if(should & ran & right).alias("positive_actions"),
        ratio(F.count_if(should & ran & right), F.count_if(should)).alias("positive_recall"),
    )


def normalizer_accuracy(df: DataFrame) -> DataFrame:
    """Exact text and region accuracy against ``expected`` and ``region``."""
    return df.agg(
        F.count("*").alias("total"),
        ratio(F.count_if(F.col("normalized_text") == F.col("expected")), F.count("*")).alias(
            "text_accuracy"
        ),
        ratio(F.count_if(F.col("normalizer_region") == F.col("region")), F.count("*")).alias(
            "region_accuracy"
        ),
    )


def failure_reasons(flags: dict[str, Column]) -> Column:
    """Names of the flags that are false, joined by ``+``; empty when all hold."""
    parts = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in flags.items()]
    return F.concat_ws("+", *parts)


def reason_counts(df: DataFrame, reason: Column) -> DataFrame:
    """Reasons by falling frequency."""
    return (
        df.select(reason.alias("reason"))
        .where("reason is not null and reason <> ''")
        .groupBy("reason")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "reason")
    )


def failures(df: DataFrame, reason: Column, columns: Sequence[str]) -> DataFrame:
    """Failing rows with their reasons, in id order."""
    return (
        df.select(*columns, reason.alias("reasons")).where("reasons <> ''").orderBy("id")
    )


def rule_baseline(
    df: DataFrame, expected: str = "expected", predicted: str = "predicted"
) -> DataFrame:
    right = F.col(expected) == F.col(predicted)
    return df.agg(
        F.count("*").alias("total"),
        ratio(F.count_if(right), F.count("*")).alias("accuracy"),
        F.count_if(~right & (F.col(predicted) == D.UNKNOWN)).alias("unknown"),
    )
