import pytest
from pyspark.sql import functions as F

from lexweave.operators import lexicon as L
from lexweave.operators import tagging as G

# Seven published tagging cases.
PUBLISHED = [
    ("6h gọi mẹ", "set_reminder", {"datetime": "6h", "reminder_text": "gọi mẹ"}),
    ("báo thức lúc 7 giờ kém 15", "set_alarm", {"datetime": "7 giờ kém 15"}),
    ("gọi số không chín không một hai ba bốn năm sáu bảy", "call_contact", {"phone_number": "0901234567"}),
    ("thời tiết ở nam định ngày mai", "ask_weather", {"datetime": "ngày mai", "location": "nam định"}),
    ("phát bài con đường mưa của cao thái sơn", "play_music", {"song": "con đường mưa", "artist": "cao thái sơn"}),
    ("mở danh sách phát của tôi", "play_music", {}),
    ("goi dien cho chi linh", "call_contact", {"contact_name": "chị linh"}),
]
CASES = [
    *PUBLISHED,
    ("nhắc tôi nộp báo cáo lúc 9 giờ", "set_reminder", {"datetime": "9 giờ", "reminder_text": "nộp báo cáo"}),
    ("nhắc mình trả sách thư viện vào chủ nhật", "set_reminder", {"datetime": "chủ nhật", "reminder_text": "trả sách thư viện"}),
    ("nhắc mình lúc 10 giờ nhé", "set_reminder", {"datetime": "10 giờ"}),
    ("nhắc mình", "set_reminder", {}),
    ("đặt báo thức 5 giờ sáng mai", "set_alarm", {"datetime": "5 giờ sáng mai"}),
    ("đặt báo thức 25 giờ", "set_alarm", {}),
    ("đặt báo thức 8 giờ 99", "set_alarm", {}),
    ("dự báo ở đà nẵng hôm nay thế nào", "ask_weather", {"datetime": "hôm nay", "location": "đà nẵng"}),
    ("thời tiết chỗ nào đẹp", "ask_weather", {}),
    ("hôm nay trời ra sao", "ask_weather", {"datetime": "hôm nay"}),
    ("bật nhạc", "play_music", {}),
    ("gọi cho bác sĩ lan", "call_contact", {"contact_name": "bác sĩ lan"}),
    ("gọi điện cho anh tuấn đi", "call_contact", {"contact_name": "anh tuấn"}),
    ("gọi ngay cho bố", "call_contact", {"contact_name": "bố"}),
    ("gọi +84 912 345 678", "call_contact", {"phone_number": "+84 912 345 678"}),
    ("gọi 0987 654 321", "call_contact", {"phone_number": "0987 654 321"}),
    ("gọi số 12", "call_contact", {}),
    ("gọi người nào đó", "call_contact", {}),
]


@pytest.fixture(scope="module")
def tagged(spark):
    rows = [(t, i) for t, i, _ in CASES]
    df = spark.createDataFrame(rows, "text string, intent string")
    out = G.extract_by_intent(df, text="text").select("text", "intent", "slots").collect()
    return {(r["text"], r["intent"]): {k: v[0] for k, v in r["slots"].items()} for r in out}


def test_slots_by_intent(tagged):
    assert {(t, i): tagged[t, i] for t, i, _ in CASES} == {(t, i): s for t, i, s in CASES}


def test_table_join_and_inline_choice_agree(spark):
    nine = "một hai ba bốn năm sáu bảy tám chín"
    values = [
        "mai", "chị mai", "chi mai", "sáng mai", "hà nội", "bà rịa - vũng tàu", "ma", "c++",
        "(live)", nine,
    ]
    texts = [
        "gọi chị mai sáng mai", "goi chi mai", "ở bà rịa - vũng tàu", "ba ria - vung tau, ha noi",
        "không có gì", "mai-mai", "má", "ma", "chị maix", "học c++ đi", "c++a xc++", "bài hát (live)",
        f"đếm {nine} mười", "a(live)", "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    inline = L.InlineLexicon(values)
    lexicon = spark.createDataFrame(
        [("s", v, i) for i, v in enumerate(inline.values)], "slot string, value string, ord int"
    )
    joined = L.longest_match(L.lexicon_hits(df, lexicon)).select("id", "value")
    narrow = df.select(
        "id", inline.best(F.col("text"), L.T.strip_diacritics(F.col("text"))).alias("value")
    ).where("value is not null")
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, narrow.collect()))
    assert narrow.count() == 10


def places(spark, text, values):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    lexicon = spark.createDataFrame([("s", v, i) for i, v in enumerate(values)], "slot string, value string, ord int")
    return sorted((r["at"], r["value"], r["exact"]) for r in L.lexicon_places(df, lexicon).collect())


def test_places_of_entries(spark):
    values = ["a", "b c", "c!", "!", "b", "á b", ""]
    assert places(spark, "a, b c! á b", values) == [
        (0, "a", True), (3, "b", True), (3, "b c", True), (5, "c!", True), (8, "a", False),
        (8, "á b", True), (10, "b", True),
    ]
    assert places(spark, "", values) == [] and places(spark, "a b", []) == []


def both_ways(spark, texts, configured, learned):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = [(slot, v) for slot, values in learned.items() for v in values]
    table = G.TableDictionaries.of(spark, configured, spark.createDataFrame(rows, "slot string, value string"))
    tags = [f"tag_{s}" for s in (*configured, "phone_number")]
    out = []
    for dictionaries in (G.Dictionaries(configured, learned), table):
        found = G.tag_columns(df, "text", dictionaries).select("id", "text", *tags)
        out.append(sorted(map(tuple, found.collect())))
    return out


def test_table_and_inline_dictionaries_tag_alike(spark):
    learned = {"song": ["bài của gió", "gio"], "location": ["bà rịa - vũng tàu"], "datetime": ["giờ tý"]}
    texts = [t for t, _, _ in CASES] + [
        "phát bài của gió", "thời tiết ba ria - vung tau giờ tý", "nhắc tôi giờ tý trả sách", "", None,
        "phát bài của gió", "mở gio của sơn tùng",
    ]
    inline, table = both_ways(spark, texts, G.DEFAULT_ENTRIES, learned)
    assert table == inline and len(table) == len(texts)
    assert any("bài của gió" in map(str, r[2:]) for r in table)


def test_a_hundred_thousand_entries_tag(spark):
    entries = spark.range(100_000).select(
        F.lit("location").alias("slot"),
        F.concat(F.lit("làng số "), F.col("id").cast("string")).alias("value"),
        F.col("id").cast("int").alias("ord"),
    )
    texts = ["thời tiết ở làng số 99999 mai", "lang so 7 và làng số 77", "ở làng số 100000", "gọi mẹ"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = G.tag_columns(df, "text", G.TableDictionaries(entries)).select("text", "tag_location").collect()
    assert [dict(map(tuple, found))[t] for t in texts] == ["làng số 99999", "làng số 77", "làng số 100000", None]


def test_lexicon_mining(spark):
    df = spark.createDataFrame(
        [({"song": ["Lạc  Trôi"], "datetime": ["mai"]},), ({"song": ["lạc trôi", "x"]},)],
        "slots map<string,array<string>>",
    )
    assert sorted(map(tuple, L.lexicon_build(df).collect())) == [("song", "lạc trôi"), ("song", "x")]
