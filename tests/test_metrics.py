import math
import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import metrics as M

LABELS = ["a", "b", "c"]


def test_sweep_golden(spark):
    df = spark.createDataFrame(
        [("a", "a", 0.9), ("b", "x", 0.4), ("c", "c", 0.3)],
        "expected string, predicted string, confidence double",
    )
    rows = {
        r["threshold"]: r for r in M.threshold_sweep(df, [0.0, 0.5]).where("intent is null").collect()
    }
    assert (rows[0.0]["coverage"], rows[0.0]["accepted_errors"]) == (1.0, 1)
    assert rows[0.5]["coverage"] == pytest.approx(1 / 3)
    assert (rows[0.5]["accepted_errors"], rows[0.5]["correct_rejected"]) == (0, 1)
    assert rows[0.5]["selective_accuracy"] == 1.0
    point = M.operating_point(M.threshold_sweep(df, [0.35]), 0.35).first()
    assert (point["min_coverage"], point["met"]) == (0.0, False)
    with pytest.raises(ValueError):
        M.threshold_sweep(df, [1.5])


def test_slot_golden(spark):
    kind = "id int, x map<string,array<string>>, y map<string,array<string>>"
    df = spark.createDataFrame(
        [
            (1, {"contact_name": ["mẹ"]}, {"contact_name": ["Mẹ "]}),
            (2, {"song": ["lạc trôi"]}, {"artist": ["sơn tùng"]}),
        ],
        kind,
    )
    micro = M.slot_prf(df, "x", "y").where("slot is null").first()
    assert (micro["tp"], micro["fp"], micro["fn"], micro["f1"]) == (1, 1, 1, 0.5)
    assert M.slot_exact(df, "x", "y").first()["exact_match"] == 0.5


def scored(rng, n=400):
    rows = []
    for i in range(n):
        raw = [round(rng.random(), 1) + 0.01 for _ in LABELS]
        probs = {k: v / sum(raw) for k, v in zip(LABELS, raw)}
        guess = max(LABELS, key=lambda k: probs[k])
        rows.append((i, rng.choice(LABELS), guess, probs[guess], probs))
    return rows


def test_report_identities_and_ranking(spark):
    rows = scored(random.Random(1))
    df = spark.createDataFrame(
        rows, "id int, expected string, predicted string, confidence double, probs map<string,double>"
    )
    report = {r["label"]: r for r in M.classification_report(df, LABELS).collect()}
    for label in LABELS:
        tp = sum(e == p == label for _, e, p, _, _ in rows)
        support = sum(e == label for _, e, *_ in rows)
        guessed = sum(p == label for _, _, p, *_ in rows)
        assert report[label]["support"] == support
        assert report[label]["recall"] == pytest.approx(tp / support)
        assert report[label]["precision"] == pytest.approx(tp / guessed)
    assert report["macro avg"]["f1"] == pytest.approx(
        sum(report[x]["f1"] for x in LABELS) / len(LABELS)
    )
    assert report["accuracy"]["recall"] == pytest.approx(
        sum(e == p for _, e, p, *_ in rows) / len(rows)
    )
    matrix = {r["expected"]: r for r in M.confusion_matrix(df, [*LABELS, "unknown"]).collect()}
    assert matrix["a"]["b"] == sum(e == "a" and p == "b" for _, e, p, *_ in rows)
    assert matrix["unknown"]["a"] == 0
    ranked = {r["label"]: r for r in M.ranking_metrics(df, LABELS).collect()}
    for label in LABELS:
        pos = [pr[label] for _, e, _, _, pr in rows if e == label]
        neg = [pr[label] for _, e, _, _, pr in rows if e != label]
        wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
        assert ranked[label]["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
        ap, last = 0.0, 0.0
        for t in sorted({*pos, *neg}, reverse=True):
            tp, fp = sum(p >= t for p in pos), sum(q >= t for q in neg)
            ap += (tp / len(pos) - last) * tp / (tp + fp)
            last = tp / len(pos)
        assert ranked[label]["average_precision"] == pytest.approx(ap)
    loss = -sum(math.log(pr[e]) for _, e, _, _, pr in rows) / len(rows)
    assert M.log_loss(df).first()[0] == pytest.approx(loss)
    brier = sum(sum((pr[k] - (k == e)) ** 2 for k in LABELS) for _, e, _, _, pr in rows) / len(rows)
    assert M.brier(df, LABELS).first()[0] == pytest.approx(brier)
    total = 0.0
    for b in range(10):
        inside = [r for r in rows if min(int(r[3] * 10 + 1e-12), 9) == b]
        if inside:
            acc = sum(r[1] == r[2] for r in inside) / len(inside)
            total += abs(acc - sum(r[3] for r in inside) / len(inside)) * len(inside)
    assert M.ece(df).first()[0] == pytest.approx(total / len(rows))


def test_measure_summary(spark):
    rng = random.Random(3)
    rows = [(g, i, round(rng.expovariate(0.1), 1)) for g in "xy" for i in range(101)]
    rows.append(("z", 0, 5.0))
    df = spark.createDataFrame(rows, "g string, i int, v double")
    out = {r["g"]: r for r in M.measure_summary(df, "v", ["i"], ["g"]).collect()}
    for g in "xyz":
        values = [v for h, _, v in rows if h == g]
        exact = df.where(F.col("g") == g).select(
            *[F.percentile("v", p) for p in (0.5, 0.95, 0.99)]
        ).first()
        assert [out[g]["median"], out[g]["p95"], out[g]["p99"]] == pytest.approx(list(exact))
        assert out[g]["first"] == values[0] and out[g]["max"] == max(values)
    steady = sorted(v for h, i, v in rows if h == "x" and i)
    assert out["x"]["steady_median"] == pytest.approx((steady[49] + steady[50]) / 2)
    assert out["z"]["steady_median"] == 5.0


def test_five_rows_one_rejected(spark):
    slots = {"contact_name": ["mẹ"]}
    rows = [
        (str(i), x, x if i else "unknown", slots, slots, slots if i else {}, "mocked" if i else None)
        for i, x in enumerate(["a", "b", "c", "d", "e"])
    ]
    m = "map<string,array<string>>"
    df = spark.createDataFrame(
        rows,
        f"id string, expected string, runtime_intent string, expected_slots {m}, oracle_slots {m},"
        f" runtime_slots {m}, action_status string",
    ).withColumn("all", F.lit("x"))
    row = M.sliced_eval(df, ["all"], M.frame_flags()).first()
    assert (row["intent_accuracy"], row["oracle_slot_exact"], row["slot_exact"]) == (0.8, 1.0, 0.8)
    assert row["full_success"] == 0.8
    picked = M.coverage_selective(df, "expected", "runtime_intent").first()
    assert (picked["coverage"], picked["selective_accuracy"]) == (0.8, 1.0)
    flags = M.frame_flags()
    reason = M.failure_reasons(
        {"intent": flags["intent_accuracy"], "slots": flags["slot_exact"], "action": flags["action_rate"]}
    )
    assert [tuple(r) for r in M.reason_counts(df, reason).collect()] == [("intent+slots+action", 1)]
    assert [r["id"] for r in M.failures(df, reason, ["id"]).collect()] == ["0"]


def test_outliers_do_not_fill_a_slice(spark):
    from lexweave.operators.ordering import even_slices

    df = spark.range(20_000).selectExpr("id", "IF(id = 7, 1e9, pow(id / 20000, 9)) AS v", "id % 2 AS g")
    sizes = even_slices(df, ["g"], "v", "s").groupBy("g", "s").count().collect()
    assert max(r["count"] for r in sizes) <= 0.011 * 10_000
