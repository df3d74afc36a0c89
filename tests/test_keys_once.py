"""Operators that read their rows several times compute a text's key once."""

from pyspark.sql import functions as F

from lexweave.operators import quality as Q
from lexweave.operators import splits as S

_ROWS = [
    (1, "a", "s1", "train", "north", "x", "reviewed"),
    (2, "a", "s2", "train", "north", "x", "reviewed"),
    (3, "b", "s1", "train", "south", "x", "reviewed"),
    (4, "b", "s1", "test", "south", "y", "auto_mapped"),
    (5, "c", "s2", "train", "south", "y", "auto_mapped"),
    (6, "c", "s2", "train", "south", "x", "reviewed"),
]
_SCHEMA = (
    "id long, text string, source string, split string, region string, intent string, annotation_quality string"
)


def _counted(spark):
    """The rows, and a key that counts how often it is asked."""
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(x):
        asked.add(1)
        return x

    return spark.createDataFrame(_ROWS, _SCHEMA), key.asNondeterministic()(F.col("text")), asked


def test_conflicting_keys_are_dropped_by_one_reading(spark):
    df, key, asked = _counted(spark)
    kept = Q.drop_label_conflicts(df, key, "source")
    assert kept.columns == df.columns and sorted(r.id for r in kept.collect()) == [3, 4, 5, 6]
    assert asked.value == len(_ROWS)
    ids = Q.drop_label_conflicts(df, F.col("text"), "source", ["id"])
    assert ids.columns == ["id"] and sorted(r.id for r in ids.collect()) == [3, 4, 5, 6]


def test_the_row_before_is_found_by_one_reading(spark):
    df, key, asked = _counted(spark)
    found = Q.prev_duplicate(df, key, ["source", "id"], "source").collect()
    assert [(r.id, r.prev_id, r.group_id, r.prev_group) for r in found] == [(2, 1, "s2", "s1")]
    assert asked.value == len(_ROWS)


def test_a_row_per_split_and_key_is_picked_by_one_reading(spark):
    df, key, asked = _counted(spark)
    kept = S.same_split_pick(df, key)
    ids = sorted(r.id for r in kept.collect())
    assert kept.columns == df.columns and len(ids) == 4 and {3, 4, 6} < set(ids)
    assert asked.value == len(_ROWS)
    assert sorted(r.id for r in S.same_split_pick(df, F.col("text"), columns=["id"]).collect()) == ids


def test_normal_forms_are_audited_by_one_reading(spark):
    df, key, asked = _counted(spark)
    rows = df.select("id", "split", "text", key.alias("normalized_text"), F.lit("r").alias("normalizer_region"))
    out = {(r.metric, r.value): r.n for r in Q.normalization_audit(rows, F.lit("b")).collect()}
    assert out == {
        ("change", "changed"): 4, ("change", "unchanged"): 2, ("region", "r"): 6,
        ("collision", "cross_split"): 1, ("collision", "same_split"): 2,
    }
    assert asked.value == len(_ROWS)
