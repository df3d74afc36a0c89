"""Replies are read from the examples."""

import pytest
from pyspark.sql import functions as F

from lexweave.llm import chat


def test_replies_are_read_from_examples(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 2, "user", "x"), (1, 3, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows = chat.expanded(chat.format_turns(df))
    examples = rows.where("example").orderBy("start").collect()
    assert [chat.unescape(r.text) for r in examples] == [said, ""]
    assert chat.read_examples(rows).first().loss_chars == len(said)
    assert chat.read_examples(rows.where("not example")).first().loss_chars == 0
    with pytest.raises(Exception, match="no prefix and target"):
        chat.read_examples(rows.withColumn("text", F.when(F.col("example"), "y").otherwise(F.col("text")))).collect()
