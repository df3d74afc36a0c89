"""Region detection without rewriting, and masks over a text that is folded already."""

from pyspark.sql import functions as F

from lexweave.functions import rewrite as R
from lexweave.functions import text as T
from lexweave.operators import tagging as G
from lexweave.sources.tables import read_table


def test_detection_alone_finds_the_region_of_the_rewriting(spark):
    words = {"a": {"mo": "dau", "te": "kia"}, "b": {"nuoc": "ngoai", "te": "kia"}}
    rows = ["mo mo te", "nuoc te x", "nuoc nuoc", "", "te", "mơ mo_ moo"]
    df = spark.createDataFrame([(x,) for x in rows], "text string")
    none = {"a": {}, "b": {}}
    full = R.normalize_corpus(df, words=words, particles=none, fixes={})
    alone = R.with_detected_region(df, words=words, particles=none, fixes={})
    want = {r.text: r.normalizer_region for r in full.collect()}
    assert {r.text: r.normalizer_region for r in alone.collect()} == want and want["mo mo te"] == "a"
    # A target that is another rule's source counts again, as in the rewriting.
    chain = {"long": "te", "te": "kia"}
    n = df.select(R.count_rewrites(F.lit("long te"), chain).alias("n")).first().n
    assert n == 3


def test_a_text_folded_once_is_masked_as_the_text(spark):
    df = spark.createDataFrame([("Là CAFÉ 12 34, la",)], "text string")
    slots = F.create_map(F.lit("x"), F.array(F.lit("CAFÉ")))
    text = F.col("text")
    row = df.select(
        T.mask_slots(text, slots).alias("a"), T.mask_slots(text, slots, T.folded_canonical(text)).alias("b")
    ).first()
    assert row.a == row.b == "la <x> <number> la"


def _analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_tag_reads_its_text_once(spark):
    df = spark.createDataFrame([("gọi cho lan nhé",), ("nhắc tôi mua sữa nhé",)], "t string")
    none, t = G.Dictionaries({}), F.col("t")
    none.best = lambda *_: F.lit(None).cast("string")
    tags = {
        "contact": (G.tag_contact(t, t, none), G.R.CONTACT_CUE[0]),
        "reminder": (G.tag_reminder(t, t, F.lit(None).cast("string"), none), G.R.REMINDER_PEEL[1]),
        "song": (G.tag_song(t, t, none), G.R.SONG_CUE),
        "artist": (G.tag_artist(t, t, none), G.R.ARTIST_CUES[1]),
        "location": (G.tag_location(t, t, none), G.R.LOCATION_CUE),
    }
    for name, (tag, pattern) in tags.items():
        assert _analyzed(df.select(tag.alias("x"))).count(T.java(pattern)) == 1, name
    assert [r.x for r in df.select(tags["contact"][0].alias("x")).collect()][0] == "lan"
    assert [r.x for r in df.select(tags["reminder"][0].alias("x")).collect()][1] == "mua sữa"


def test_heavy_rows_are_dealt_out_by_their_number(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    dealt = read_table(spark, str(tmp_path), "t", "id", rows=50)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.count() == 1000
