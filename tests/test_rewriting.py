import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions.rewrite import rewrite_phrases
from lexweave.operators.rewriting import rewrite_by_table


def both_ways(spark, texts, rules):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    table = spark.createDataFrame([*rules.items()], "src string, dst string")
    found = rewrite_by_table(df, table).select("id", "rewritten", "trace").collect()
    folded = df.withColumn("r", rewrite_phrases(F.col("text"), rules)).select("id", "r.text", "r.trace")
    return sorted(map(tuple, found)), sorted(map(tuple, folded.collect()))


def test_rules_that_enable_each_other(spark):
    rules = {
        "bữa ni": "hôm nay", "mô rứa": "đâu thế", "mô": "đâu", "hôm nay": "nay", "a b": "c", "c d": "e f",
        "f g": "h", "$x": "\\1$2", "c++": "cpp", "nay": "now", "h": "a b", "đau": "x",
    }
    texts = [
        "bữa ni đi mô", "a b d g", "mô rứa mô", "học c++ và $x", "c++a", "không có gì", "", "đâu", "a b a b d",
        "bữa ni đi mô", "h h", "(mô)!",
    ]
    table, literal = both_ways(spark, texts, rules)
    assert table == literal
    assert dict((i, t) for i, t, _ in table)[1] == "e a b"


def test_random_rules_equal_the_fold(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcd" for b in "xyz"]

    def phrase(most):
        return " ".join(rng.choices(words, k=rng.randint(1, most)))

    rules = {phrase(3): phrase(3) for _ in range(60)}
    texts = [phrase(12) for _ in range(80)]
    table, literal = both_ways(spark, texts, rules)
    assert table == literal


def test_nulls_conflicts_and_many_rules(spark):
    many = spark.range(50_000).select(
        F.concat(F.lit("từ"), F.col("id")).alias("src"), F.concat(F.lit("word "), F.col("id") + 1).alias("dst")
    )
    df = spark.createDataFrame([("từ7 từ49999 x",), (None,), ("y",)], "text string")
    got = {r["text"]: (r["rewritten"], r["trace"]) for r in rewrite_by_table(df, many).collect()}
    assert got == {
        "từ7 từ49999 x": ("word 8 word 50000 x", ["từ49999 -> word 50000", "từ7 -> word 8"]),
        None: (None, []),
        "y": ("y", []),
    }
    two = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    with pytest.raises(ValueError):
        rewrite_by_table(df, two)
    assert rewrite_by_table(df.limit(0), many).collect() == []


def test_long_chains_between_words_need_few_rounds(spark):
    # Sixty words that each become the next: a round per link was an error beyond fifty.
    names = [f"w{i:02d}" for i in range(61)]
    rules = dict(zip(names, names[1:]))
    rules |= {"zz": "w00", "đau": "đầu", "đầu": "x_1", "same": "same"}
    texts = ["w00 w00, w58 w60!", "zz w59-w59", "đau đầu đau_ same", "W00 w00x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    table = spark.createDataFrame([*rules.items()], "src string, dst string")
    got = {r.id: (r.rewritten, r.trace) for r in rewrite_by_table(df, table).collect()}
    assert got[0][0] == "w60 w60, w60 w60!" and len(got[0][1]) == 122
    assert got[0][1][:4] == ["w00 -> w01", "w00 -> w01", "w01 -> w02", "w01 -> w02"]
    # "zz" has its turn after all of them.
    assert got[1] == ("w00 w60-w60", ["w59 -> w60", "w59 -> w60", "zz -> w00"])
    assert got[2][0] == "x_1 x_1 đau_ same" and got[3] == ("W00 w00x", [])


def test_random_word_rules_equal_the_fold(spark):
    rng = random.Random(9)
    words = [a + b for a in ("a", "b", "đ", "é", "cc") for b in ("", "x", "1", "_", "zz")]
    rules = {w: rng.choice(words) for w in rng.sample(words, 20)}
    texts = [rng.choice([" ", "-", ", "]).join(rng.choices([*words, "q", "(a)"], k=9)) for _ in range(60)]
    table, literal = both_ways(spark, texts, rules)
    assert table == literal
