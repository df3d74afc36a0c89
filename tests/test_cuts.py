"""Lineage cuts are packed tables."""

import glob
import os

from pyspark.sql import functions as F

from lexweave.session import cut_lineage


def test_cuts_are_packed_tables(spark):
    df = cut_lineage(spark.range(5).withColumn("a", F.array(F.struct("id"))))
    assert df.count() == 5 and df.inputFiles()[0].endswith(".parquet")
    assert glob.glob(os.path.join(spark.sparkContext.getCheckpointDir().removeprefix("file:"), "cut-*"))
