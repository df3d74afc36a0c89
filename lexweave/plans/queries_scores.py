"""Evaluation queries over a scored view of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.stage import evaluate
from lexweave.operators import gates as G
from lexweave.operators import metrics as M
from lexweave.plans.queries_text import SQL_GATED, SQL_RULE_CLASSIFY, gated, rule_classified
from lexweave.plans.registry import documents, query, r6, sql_key, sql_surface
from lexweave.rules.domains import SWEEP_THRESHOLDS
from lexweave.session import cut_lineage
from lexweave.sources.tables import read_table

LABELS = ("de", "en", "es", "fr")


def _rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


def scored(spark, d):
    """Every document with probabilities drawn from its hash, tilted towards its language."""
    x = documents(spark, d, "doc_id", "lang", "source")
    key = T.stable_order_key(F.col("doc_id"))
    weights = [
        F.conv(F.substring(key, 2 * i + 1, 2), 16, 10).cast("double")
        + F.when(F.col("lang") == k, 129.0).otherwise(1.0)
        for i, k in enumerate(LABELS)
    ]
    named = x.withColumns({f"w{i}": w for i, w in enumerate(weights)})
    total = F.col("w0") + F.col("w1") + F.col("w2") + F.col("w3")
    named = named.withColumns({f"p{i}": F.col(f"w{i}") / total for i in range(4)})
    best = F.array_max(
        F.array(
            *[
                F.struct(F.col(f"p{i}").alias("p"), F.lit(-i).alias("o"), F.lit(k).alias("k"))
                for i, k in enumerate(LABELS)
            ]
        )
    )
    return named.select(
        F.col("doc_id").alias("id"),
        "source",
        F.col("lang").alias("expected"),
        best["k"].alias("predicted"),
        best["p"].alias("confidence"),
        F.map_from_arrays(
            F.array(*map(F.lit, LABELS)), F.array(*[F.col(f"p{i}") for i in range(4)])
        ).alias("probs"),
    ).withColumn(
        "runtime", F.when(F.col("confidence") < 0.35, "unknown").otherwise(F.col("predicted"))
    )


def _sql_weight(i: int, k: str) -> str:
    return (
        f"('0x' || substr({sql_key('doc_id')}, {2 * i + 1}, 2))::INT::DOUBLE"
        f" + CASE WHEN lang = '{k}' THEN 129.0::DOUBLE ELSE 1.0::DOUBLE END AS w{i}"
    )


SQL_SCORED = f"""w AS (SELECT doc_id AS id, source, lang AS expected,
        {", ".join(_sql_weight(i, k) for i, k in enumerate(LABELS))} FROM documents),
    pr AS (SELECT id, source, expected, w0 / (w0 + w1 + w2 + w3) AS p0, w1 / (w0 + w1 + w2 + w3) AS p1,
        w2 / (w0 + w1 + w2 + w3) AS p2, w3 / (w0 + w1 + w2 + w3) AS p3 FROM w),
    b AS (SELECT *, greatest(p0, p1, p2, p3) AS confidence FROM pr),
    sc AS (SELECT *, CASE WHEN p0 = confidence THEN 'de' WHEN p1 = confidence THEN 'en'
        WHEN p2 = confidence THEN 'es' ELSE 'fr' END AS predicted,
        CASE WHEN confidence < 0.35 THEN 'unknown' ELSE predicted END AS runtime FROM b),
    lb AS (SELECT unnest(['de', 'en', 'es', 'fr']) AS label)"""


def _prob(label: str) -> str:
    return f"CASE {label} WHEN 'de' THEN p0 WHEN 'en' THEN p1 WHEN 'es' THEN p2 ELSE p3 END"


@query(
    "q_score_table",
    f"""WITH {SQL_SCORED} SELECT id, expected, predicted, runtime, round(confidence, 6) AS confidence
    FROM sc""",
)
def q_score_table(spark, d):
    x = scored(spark, d).select("id", "expected", "predicted", "runtime", "confidence")
    return _rounded(x, "confidence")


@query(
    "q_confusion",
    f"""WITH {SQL_SCORED}, l AS (SELECT unnest(['de', 'en', 'es', 'fr', 'unknown']) AS expected)
    SELECT l.expected, {", ".join(f"count(*) FILTER (runtime = '{k}') AS {k}" for k in (*LABELS, "unknown"))}
    FROM l LEFT JOIN sc ON sc.expected = l.expected GROUP BY l.expected""",
)
def q_confusion(spark, d):
    return M.confusion_matrix(scored(spark, d), [*LABELS, "unknown"], predicted="runtime")


_REPORT = f"""c AS (SELECT label, count(*) FILTER (expected = label AND runtime = label) AS tp,
      count(*) FILTER (expected <> label AND runtime = label) AS fp,
      count(*) FILTER (expected = label AND runtime <> label) AS fn FROM sc, lb GROUP BY label),
    s AS (SELECT label, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
      CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall, tp + fn AS support FROM c),
    f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0
      ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s),
    a AS (SELECT count(*) FILTER (expected = runtime)::DOUBLE / count(*) AS v, count(*) AS n FROM sc),
    u AS (SELECT label, precision, recall, f1, support FROM f
      UNION ALL SELECT 'accuracy', v, v, v, n FROM a
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
        sum(recall * support) / sum(support), sum(f1 * support) / sum(support),
        sum(support)::BIGINT FROM f)"""


@query(
    "q_class_report",
    f"""WITH {SQL_SCORED}, {_REPORT} SELECT label, round(precision, 6) AS precision,
      round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM u""",
)
def q_class_report(spark, d):
    out = M.classification_report(scored(spark, d), LABELS, predicted="runtime")
    return _rounded(out, "precision", "recall", "f1")


def slotted(spark, d):
    """A text's first word and all its other words as expected and predicted slots that agree on part of
    the rows."""
    x = documents(spark, d, "doc_id", "text", "lang", "source")
    w = F.split(T.normalize_surface(F.col("text")), " ", -1)
    words = evaluate(x, w=F.array_distinct(w))

    def slots(first, rest):
        return F.map_from_arrays(F.array(F.lit("head"), F.lit("tail")), F.array(first, rest))

    none = F.array().cast("array<string>")
    even = F.col("doc_id") % 2 == 0
    tail = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    return words.select(
        F.col("doc_id").alias("id"),
        "lang",
        "source",
        slots(F.slice("w", 1, 1), tail).alias("want"),
        slots(
            F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("x"))).otherwise(F.slice("w", 1, 1)),
            F.when(even, tail).otherwise(none),
        ).alias("got"),
    )


SQL_SLOTTED = f"""ws AS (SELECT doc_id AS id, lang, source,
        string_split({sql_surface('text')}, ' ') AS w FROM documents),
    sl AS (SELECT id, lang, source, w[1] AS h,
      list_distinct(list_filter(w[2:], lambda q: q <> w[1])) AS t FROM ws),
    ex AS (SELECT id, 'head' AS slot, h AS value FROM sl
      UNION ALL SELECT id, 'tail', unnest(t) FROM sl),
    gt AS (SELECT id, 'head' AS slot, CASE WHEN id % 5 = 0 THEN 'x' ELSE h END AS value FROM sl
      UNION ALL SELECT id, 'tail', unnest(t) FROM sl WHERE id % 2 = 0),
    pd AS (SELECT coalesce(e.id, g.id) AS id, coalesce(e.slot, g.slot) AS slot,
      coalesce(e.value, g.value) AS value,
      CASE WHEN e.id IS NOT NULL AND g.id IS NOT NULL THEN 'tp' WHEN g.id IS NOT NULL THEN 'fp'
        ELSE 'fn' END AS kind
      FROM ex e FULL JOIN gt g ON e.id = g.id AND e.slot = g.slot AND e.value = g.value)"""


@query("q_pair_diff", f"WITH {SQL_SLOTTED} SELECT id, kind, slot, value FROM pd")
def q_pair_diff(spark, d):
    return M.pair_diff(slotted(spark, d), "want", "got")


@query(
    "q_slot_prf",
    f"""WITH {SQL_SLOTTED}, c AS (SELECT slot, count(*) FILTER (kind = 'tp') AS tp,
      count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn FROM pd
      GROUP BY ROLLUP (slot)),
    s AS (SELECT slot, tp + fn AS support, tp, fp, fn, tp::DOUBLE / (tp + fp) AS p,
      tp::DOUBLE / (tp + fn) AS r FROM c)
    SELECT slot, support, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall,
      round(2 * p * r / (p + r), 6) AS f1 FROM s""",
)
def q_slot_prf(spark, d):
    return _rounded(M.slot_prf(slotted(spark, d), "want", "got"), "precision", "recall", "f1")


@query(
    "q_slot_exact",
    f"""WITH {SQL_SLOTTED}, e AS (SELECT id, bool_and(kind = 'tp') AS ok FROM pd GROUP BY id)
    SELECT count(*) AS n, round(count(*) FILTER (ok)::DOUBLE / count(*), 6) AS exact_match FROM e""",
)
def q_slot_exact(spark, d):
    return _rounded(M.slot_exact(slotted(spark, d), "want", "got"), "exact_match")


def _judged(spark, d):
    """Scored rows with ``slots_ok``: do the slots of all rows of their id agree? The texts are read once,
    and only the answers are written and joined."""
    ok = F.coalesce(M.slots_equal("want", "got"), F.lit(False))
    rows = cut_lineage(slotted(spark, d).select("id", ok.alias("ok")))
    return scored(spark, d).join(rows.groupBy("id").agg(F.bool_and("ok").alias("slots_ok")), "id")


@query(
    "q_sliced_eval",
    f"""WITH {SQL_SCORED}, {SQL_SLOTTED},
    e AS (SELECT id, bool_and(kind = 'tp') AS ok FROM pd GROUP BY id),
    x AS (SELECT sc.source, sc.expected, sc.expected = sc.runtime AS i, e.ok AS s FROM sc JOIN e USING (id)),
    y AS (SELECT 'source' AS dimension, source AS value, i, s FROM x
      UNION ALL SELECT 'expected', expected, i, s FROM x)
    SELECT dimension, value, count(*) AS n,
      round(count(*) FILTER (i)::DOUBLE / count(*), 6) AS intent_accuracy,
      round(count(*) FILTER (s)::DOUBLE / count(*), 6) AS slot_exact,
      round(count(*) FILTER (i AND s)::DOUBLE / count(*), 6) AS frame_exact FROM y GROUP BY ALL""",
)
def q_sliced_eval(spark, d):
    both = _judged(spark, d)
    intent, slots = F.col("expected") == F.col("runtime"), F.col("slots_ok")
    flags = {"intent_accuracy": intent, "slot_exact": slots, "frame_exact": intent & slots}
    return _rounded(M.sliced_eval(both, ["source", "expected"], flags), *flags)


@query(
    "q_coverage",
    f"""WITH {SQL_SCORED} SELECT count(*) AS total, count(*) FILTER (runtime <> 'unknown') AS accepted,
      round(count(*) FILTER (runtime <> 'unknown')::DOUBLE / count(*), 6) AS coverage,
      round(count(*) FILTER (runtime = expected)::DOUBLE / count(*) FILTER (runtime <> 'unknown'), 6)
        AS selective_accuracy FROM sc""",
)
def q_coverage(spark, d):
    out = M.coverage_selective(scored(spark, d), predicted="runtime")
    return _rounded(out, "coverage", "selective_accuracy")


_SWEEP = f"""t AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in SWEEP_THRESHOLDS)}]) AS threshold),
    sw AS (SELECT threshold, expected AS intent, count(*) AS total,
      count(*) FILTER (confidence >= threshold) AS accepted,
      count(*) FILTER (confidence >= threshold AND expected <> predicted) AS accepted_errors,
      count(*) FILTER (confidence < threshold AND expected = predicted) AS correct_rejected
      FROM sc, t GROUP BY GROUPING SETS ((threshold), (threshold, expected)))"""


@query(
    "q_threshold_sweep",
    f"""WITH {SQL_SCORED}, {_SWEEP}
    SELECT threshold, intent, total, accepted, total - accepted AS rejected,
      round(accepted::DOUBLE / total, 6) AS coverage, accepted_errors, correct_rejected,
      round(CASE WHEN accepted = 0 THEN 0 ELSE (accepted - accepted_errors)::DOUBLE / accepted END, 6)
        AS selective_accuracy FROM sw""",
)
def q_threshold_sweep(spark, d):
    out = M.threshold_sweep(scored(spark, d), SWEEP_THRESHOLDS)
    return _rounded(out, "coverage", "selective_accuracy")


@query(
    "q_operating_point",
    f"""WITH {SQL_SCORED}, {_SWEEP}, m AS (SELECT min(accepted::DOUBLE / total) AS v FROM sw
      WHERE threshold = 0.35 AND intent IS NOT NULL)
    SELECT 0.35::DOUBLE AS threshold, round(v, 6) AS min_coverage, 0.95::DOUBLE AS target,
      v >= 0.95 AS met FROM m""",
)
def q_operating_point(spark, d):
    out = M.operating_point(M.threshold_sweep(scored(spark, d), SWEEP_THRESHOLDS))
    return _rounded(out, "min_coverage")


@query(
    "q_log_loss",
    f"WITH {SQL_SCORED} SELECT round(avg(-ln({_prob('expected')})), 6) AS log_loss FROM sc",
)
def q_log_loss(spark, d):
    return _rounded(M.log_loss(scored(spark, d)), "log_loss")


@query(
    "q_brier",
    f"""WITH {SQL_SCORED} SELECT round(avg({" + ".join(
        f"power(p{i} - (expected = '{k}')::INT, 2)" for i, k in enumerate(LABELS))}), 6) AS brier
    FROM sc""",
)
def q_brier(spark, d):
    return _rounded(M.brier(scored(spark, d), LABELS), "brier")


_BINS = """bn AS (SELECT (confidence >= 0.1)::INT + (confidence >= 0.2)::INT + (confidence >= 0.3)::INT
      + (confidence >= 0.4)::INT + (confidence >= 0.5)::INT + (confidence >= 0.6)::INT
      + (confidence >= 0.7)::INT + (confidence >= 0.8)::INT + (confidence >= 0.9)::INT AS bin,
      count(*) AS n, avg((expected = predicted)::INT) AS accuracy, avg(confidence) AS mean_confidence
      FROM sc GROUP BY 1)"""


@query(
    "q_reliability",
    f"""WITH {SQL_SCORED}, {_BINS} SELECT bin, n, round(accuracy, 6) AS accuracy,
      round(mean_confidence, 6) AS mean_confidence FROM bn""",
)
def q_reliability(spark, d):
    return _rounded(M.calibration_bins(scored(spark, d)), "accuracy", "mean_confidence")


@query(
    "q_ece",
    f"""WITH {SQL_SCORED}, {_BINS}
    SELECT round(sum(abs(accuracy - mean_confidence) * n) / sum(n), 6) AS ece FROM bn""",
)
def q_ece(spark, d):
    return _rounded(M.ece(scored(spark, d)), "ece")


_RANKED = f"""cl AS (SELECT label, {_prob('label')} AS score, expected = label AS hit FROM sc, lb),
    pt AS (SELECT label, score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg
      FROM cl GROUP BY label, score),
    rk AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
      sum(pos) OVER (PARTITION BY label) AS ap, sum(neg) OVER (PARTITION BY label) AS an FROM pt
      WINDOW w AS (PARTITION BY label ORDER BY score DESC))"""


@query(
    "q_ranking",
    f"""WITH {SQL_SCORED}, {_RANKED},
    m AS (SELECT label, sum(neg * (cp - pos / 2.0::DOUBLE)) / (max(ap)::DOUBLE * max(an)) AS roc_auc,
      sum(pos * cp::DOUBLE / (cp + cn)) / max(ap) AS average_precision FROM rk GROUP BY label)
    SELECT label, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM m
    UNION ALL SELECT 'macro', round(avg(roc_auc), 6), round(avg(average_precision), 6) FROM m""",
)
def q_ranking(spark, d):
    out = M.ranking_metrics(scored(spark, d), LABELS)
    return _rounded(out, "roc_auc", "average_precision")


@query(
    "q_curve",
    f"""WITH {SQL_SCORED}, {_RANKED} SELECT label, round(score, 6) AS score,
      round(cn::DOUBLE / an, 6) AS fpr, round(cp::DOUBLE / ap, 6) AS tpr,
      round(cp::DOUBLE / (cp + cn), 6) AS precision FROM rk""",
)
def q_curve(spark, d):
    return _rounded(M.curve_points(scored(spark, d), LABELS), "score", "fpr", "tpr", "precision")


@query(
    "q_measure_summary",
    """WITH f AS (SELECT event_type, min((ts, event_id)) AS first_key, count(*) AS n FROM events
      GROUP BY event_type),
    s AS (SELECT event_type, quantile_cont(value, 0.5) AS steady FROM events JOIN f USING (event_type)
      WHERE (ts, event_id) > first_key OR n = 1 GROUP BY event_type)
    SELECT e.event_type, count(*) AS n, arg_min(value, (ts, event_id)) AS first,
      round(avg(value), 6) AS mean, max(value) AS max,
      round(count(*) / (sum(value) / 1000.0), 6) AS rows_per_second,
      round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95,
      round(quantile_cont(value, 0.99), 6) AS p99, round(any_value(steady), 6) AS steady_median
    FROM events e JOIN s ON e.event_type = s.event_type GROUP BY e.event_type""",
)
def q_measure_summary(spark, d):
    x = read_table(spark, d, "events", "event_id", "ts", "event_type", "value")
    out = M.measure_summary(x, "value", ["ts", "event_id"], ["event_type"])
    return _rounded(out, "mean", "rows_per_second", "median", "p95", "p99", "steady_median")


@query(
    "q_action_safety",
    f"""WITH {SQL_GATED}, x AS (SELECT doc_id % 4 <> 0 AS should, gate_reason = 'cue' AS ran,
      doc_id % 5 = 0 OR lang <> 'es' AS right_intent FROM g)
    SELECT count(*) AS total, count(*) FILTER (NOT should) AS negative_total,
      count(*) FILTER (NOT should AND ran) AS false_actions,
      round(count(*) FILTER (NOT should AND ran)::DOUBLE / count(*) FILTER (NOT should), 6)
        AS false_action_rate,
      count(*) FILTER (should) AS positive_total,
      count(*) FILTER (should AND ran AND right_intent) AS positive_actions,
      round(count(*) FILTER (should AND ran AND right_intent)::DOUBLE / count(*) FILTER (should), 6)
        AS positive_recall FROM x""",
)
def q_action_safety(spark, d):
    x = gated(spark, d).select(
        (F.col("doc_id") % 4 != 0).alias("should_execute"),
        F.col("gate_allowed").alias("executed"),
        F.col("lang").alias("intent"),
        F.when(F.col("doc_id") % 5 != 0, F.when(F.col("lang") == "es", "en").otherwise(F.col("lang"))).alias(
            "expected_intent"
        ),
    )
    return _rounded(M.action_safety(x), "false_action_rate", "positive_recall")


@query(
    "q_normalizer_accuracy",
    f"""WITH x AS (SELECT lang, source, {sql_surface('text')} AS t, trim(text) AS e FROM documents)
    SELECT count(*) AS total, round(count(*) FILTER (t = lower(e))::DOUBLE / count(*), 6) AS text_accuracy,
      round(count(*) FILTER (lang = 'en')::DOUBLE / count(*), 6) AS region_accuracy FROM x""",
)
def q_normalizer_accuracy(spark, d):
    x = documents(spark, d, "text", "lang").select(
        T.normalize_surface(F.col("text")).alias("normalized_text"),
        F.lower(F.trim("text")).alias("expected"),
        F.lit("en").alias("normalizer_region"),
        F.col("lang").alias("region"),
    )
    return _rounded(M.normalizer_accuracy(x), "text_accuracy", "region_accuracy")


_REASONS = f"""{SQL_SCORED}, {SQL_SLOTTED},
    e AS (SELECT id, bool_and(kind = 'tp') AS ok FROM pd GROUP BY id),
    fr AS (SELECT id, expected, predicted, confidence, array_to_string(list_filter([
      CASE WHEN expected <> runtime THEN 'intent' END, CASE WHEN NOT ok THEN 'slots' END,
      CASE WHEN runtime = 'unknown' THEN 'action' END], lambda x: x IS NOT NULL), '+') AS reasons
      FROM sc JOIN e USING (id))"""


def _failing(spark, d):
    both = _judged(spark, d)
    flags = {
        "intent": F.col("expected") == F.col("runtime"),
        "slots": F.col("slots_ok"),
        "action": F.col("runtime") != "unknown",
    }
    return both, M.failure_reasons(flags)


@query(
    "q_reason_counts",
    f"WITH {_REASONS} SELECT reasons AS reason, count(*) AS n FROM fr WHERE reasons <> '' GROUP BY 1",
)
def q_reason_counts(spark, d):
    both, reason = _failing(spark, d)
    return M.reason_counts(both, reason)


@query(
    "q_failures",
    f"""WITH {_REASONS} SELECT id, expected, predicted, round(confidence, 6) AS confidence, reasons
    FROM fr WHERE reasons <> ''""",
)
def q_failures(spark, d):
    both, reason = _failing(spark, d)
    return _rounded(
        M.failures(both, reason, ["id", "expected", "predicted", "confidence"]), "confidence"
    )


@query(
    "q_gate_reasons",
    f"WITH {SQL_GATED} SELECT gate_reason AS reason, count(*) AS n FROM g GROUP BY 1",
)
def q_gate_reasons(spark, d):
    return M.reason_counts(gated(spark, d), F.col("gate_reason"))


@query(
    "q_rule_baseline",
    f"""WITH {SQL_RULE_CLASSIFY} SELECT count(*) AS total,
      round(count(*) FILTER (predicted = lang)::DOUBLE / count(*), 6) AS accuracy,
      count(*) FILTER (predicted = 'unknown') AS unknown FROM p""",
)
def q_rule_baseline(spark, d):
    out = M.rule_baseline(rule_classified(spark, d), expected="lang")
    return _rounded(out, "accuracy")


@query(
    "q_accepted_failures",
    f"""WITH {SQL_SCORED} SELECT id, expected, predicted, round(confidence, 6) AS confidence FROM sc
    WHERE confidence >= 0.35 AND expected <> predicted""",
)
def q_accepted_failures(spark, d):
    x = scored(spark, d)
    passed = G.confidence_gate(F.col("confidence"), F.lit(False)) == "pass"
    rows = x.where(passed & (F.col("expected") != F.col("predicted")))
    return _rounded(rows.select("id", "expected", "predicted", "confidence"), "confidence")
