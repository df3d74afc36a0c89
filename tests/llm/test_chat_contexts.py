"""Every example carries its whole context."""

import pytest
from pyspark.sql import functions as F

from lexweave.llm import chat


def test_examples_carry_their_contexts(spark, monkeypatch):
    monkeypatch.setattr(chat, "ROWS", 5)
    roles = ["system", "user", "assistant", "user", "assistant", "assistant", "tool", "assistant"]
    turns = [(c, i, r, f"{r} {c} \\ # <{i}>" * (i + 1)) for c in (1, 2, None) for i, r in enumerate(roles)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(df)
    rows = chat.expanded(formatted)
    wholes = {}
    for r in formatted.orderBy("start").collect():
        wholes[r.conv_id] = wholes.get(r.conv_id, "") + r.segment
    examples = rows.where("example").collect()
    assert len(examples) == 12
    for r in examples:
        assert r.context == wholes[r.conv_id][: r.loss_start] and r.context.endswith(chat.HEAD)
        assert r.context + r.text == wholes[r.conv_id][: r.loss_end]
    assert chat.read_back(formatted).count() == 3
    assert sorted(map(str, chat.read_examples(rows).collect())) == sorted(map(str, chat.read_back(formatted).collect()))
    cut = F.when(F.col("loss_start") > 100, F.expr("replace(context, 'user 1', 'user 2')")).otherwise(F.col("context"))
    with pytest.raises(Exception, match="no prefix and target"):
        chat.read_examples(rows.withColumn("context", cut)).collect()
    with pytest.raises(Exception, match="no prefix and target"):
        chat.read_examples(rows.withColumn("context", F.lit(None).cast("string"))).collect()


def test_contexts_are_made_in_the_query_and_not_shuffled(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.format_turns(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("RepartitionByExpression") > plan.rindex("MapInArrow")
