"""A lexicon's order is found slice by slice, not in one task per slot."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.operators import lexicon as L
from lexweave.operators.ordering import row_numbers


def test_numbers_are_those_of_one_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randrange(5), i) for i in range(500)] + [("c", 1, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x int, y int")
    whole = df.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("x", "y")).cast("bigint"))
    assert sorted(row_numbers(df, ["k"], ["x", "y"], "n").collect()) == sorted(whole.collect())
    assert row_numbers(df.where("false"), ["k"], ["x", "y"], "n").isEmpty()


def test_no_slot_is_ordered_by_one_task(spark):
    configured = spark.createDataFrame(
        [("s", 2, "bb"), ("s", 1, "AA"), ("s", 0, "aa"), ("t", 0, "x")], "slot string, position int, value string"
    )
    learned = spark.createDataFrame([("s", "zz"), ("s", "long"), ("t", "x"), ("s", "𝄞")], "slot string, value string")
    out = L.union_distinct_lexicon(configured, learned)
    want = [("s", "long", 1), ("s", "aa", 2), ("s", "bb", 3), ("s", "zz", 4), ("s", "𝄞", 5), ("t", "x", 1)]
    assert sorted(map(tuple, out.select("slot", "value", "ord").collect())) == sorted(want)
    # Windows that number rows stay within a slice.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_number()" in line]
    assert not [line for line in windows if "__slice" not in line]
