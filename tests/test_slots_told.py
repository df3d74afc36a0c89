"""Slot maps compared before their values are normalised, pairs counted in their row."""

import random

from pyspark.sql import functions as F

from lexweave.operators import metrics as M
from lexweave.plans import queries_scores as S

_MAPS = "id int, x map<string,array<string>>, y map<string,array<string>>"


def _brute(slots):
    return {(k, " ".join(v.casefold().split())) for k, values in slots.items() for v in values}


def _maps(rng, n=300):
    words = ["a", "A", " a", "b c", "B  c", "ς", "Σ", "straße", "STRASSE", ""]
    draw = lambda: {
        k: [rng.choice(words) for _ in range(rng.randrange(3))] for k in "klm" if rng.random() < 0.7
    }
    out = []
    for i in range(n):
        x = draw()
        out.append((i, x, dict(x) if i % 3 == 0 else draw()))
    return out


def test_maps_are_compared_as_sets_of_pairs(spark):
    rows = _maps(random.Random(3))
    df = spark.createDataFrame(rows, _MAPS)
    same = {r.id: r.same for r in df.select("id", M.slots_equal("x", "y").alias("same")).collect()}
    assert same == {i: _brute(x) == _brute(y) for i, x, y in rows}
    want = {
        (i, kind, *pair)
        for i, x, y in rows
        for kind, pairs in (
            ("tp", _brute(x) & _brute(y)), ("fp", _brute(y) - _brute(x)), ("fn", _brute(x) - _brute(y))
        )
        for pair in pairs
    }
    found = [tuple(r) for r in M.pair_diff(df, "x", "y").collect()]
    assert set(found) == want and len(found) == len(want)
    counts = {r.slot: (r.tp, r.fp, r.fn) for r in M.slot_prf(df, "x", "y").collect()}
    for slot in (*"klm", None):
        mine = [kind for _, kind, k, _ in want if slot in (None, k)]
        assert counts[slot] == tuple(mine.count(kind) for kind in ("tp", "fp", "fn"))


def test_pairs_are_counted_in_their_row(spark):
    df = spark.createDataFrame([(1, {"k": ["a"]}, {"k": ["a", "b"]})], _MAPS)
    plan = M.slot_prf(df, "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "kind" not in plan


def test_an_id_that_stands_twice_is_judged_once_and_no_text_is_joined(spark, tmp_path):
    # An odd id's slots agree only where its text is one word.
    rows = [(1, "one", "en", "s"), (1, "one two", "en", "s"), (3, "one", "de", "s")]
    schema = "doc_id long, text string, lang string, source string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    judged = S._judged(spark, str(tmp_path))
    assert sorted((r.id, r.slots_ok) for r in judged.collect()) == [(1, False), (1, False), (3, True)]
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "want" not in plan and "Generate" not in plan
    assert S.q_sliced_eval(spark, str(tmp_path)).where("dimension = 'source'").first().n == 3
    assert judged.where(F.col("id") == 1).count() == 2
