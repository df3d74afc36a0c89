"""First words read from a text's head, values traced without folding, corpora prepared by their digests."""

import random

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import contracts as K
from lexweave.plans.prepare import preprocess

_BITS = ["a", "B", " ", "  ", "\t", " ", "　", "-", "¨", "ß", "İ", "Σ", "ς", "ﬁ", "é", "é", "Ｃ", "đ", ".", "𝄞", "1"]


def _drawn(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(_BITS, k=rng.randrange(most))) for _ in range(n)]


def test_the_first_word_is_that_of_the_whole_text(spark):
    df = spark.createDataFrame([(x,) for x in [*_drawn(500, 9, 1), None, "", " \n"]], "t string")
    whole = F.get(F.split(T.normalize_surface(F.col("t")), " ", -1), F.lit(0))
    assert df.where(~T.first_word(F.col("t")).eqNullSafe(whole)).isEmpty()
    # Only the head meets the long chain: it is cut off first.
    plan = df.select(T.first_word(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "regexp_extract(t#" in plan and "lower(t#" not in plan


def test_a_text_that_shows_a_value_shows_its_folded_form(spark):
    rng = random.Random(2)
    rows = []
    for text in _drawn(800, 14, 3):
        at = sorted(rng.choices(range(len(text) + 1), k=2))
        rows += [(text, text[at[0] : at[1]]), (text, rng.choice(_BITS))]
    df = spark.createDataFrame([*rows, (None, "a"), ("a", None)], "t string, v string")
    plain = T.folded_canonical(F.col("v"))
    plainly = (plain != "") & F.contains(T.folded_canonical(F.col("t")), plain)
    traced = T.slot_in_text(F.lit("song"), F.col("v"), F.col("t"))
    assert df.where(~traced.eqNullSafe(plainly)).isEmpty()


def test_a_row_is_traced_without_copies_of_its_text(spark):
    rows = [
        (1, "Gọi MẸ 090 123", {"contact_name": ["mẹ", "bố"], "phone_number": ["090-123", "091"], "song": [""]}),
        (2, "gọi mẹ", {"contact_name": ["mẹ"]}),
        (3, None, {"contact_name": ["mẹ", " "]}),
        (4, "x", None),
        (5, "x", {"song": None, "artist": ["y"]}),
    ]
    df = spark.createDataFrame(rows, "id int, text string, slots map<string,array<string>>")
    out = K.slot_traceability(df)
    want = {(1, "contact_name=bố"), (1, "phone_number=091"), (1, "song="), (3, "contact_name= "), (5, "artist=y")}
    assert {(r.id, r.detail) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_a_corpus_is_prepared_by_digests(spark):
    texts = ["Bữa ni mô rồi", "hôm nay đâu rồi", "the cat", "The  cat", "răng đau", "đau răng hỉ", "giời ơi nhá"]
    rows = [(i, x, s, r, {"song": [x.split()[0]]}) for i, x in enumerate(texts)
            for s, r in (("train", "central"), ("train", "standard"), ("test", "north"))]
    rows = [(10 * n, *row[1:]) for n, row in enumerate(rows)]
    df = spark.createDataFrame(
        rows, "id int, text string, split string, region string, slots map<string,array<string>>"
    )
    slim = preprocess(df, "id", "split", "normalizer_region", F.sha2("normalized_text", 256).alias("k"))
    full = preprocess(df).select("id", "split", "normalizer_region", F.sha2("normalized_text", 256).alias("k"))
    assert slim.columns == full.columns and sorted(slim.collect()) == sorted(full.collect())
    window = slim._jdf.queryExecution().optimizedPlan().toString().split("Window ")[1].splitlines()[1]
    assert "normalized_text#" not in window
