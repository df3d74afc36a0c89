import json
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lexweave.functions.rewrite import conflicting_rules, normalize_corpus, normalize_slots
from lexweave.functions.text import mask_slots
from lexweave.operators import gates as G
from lexweave.operators.metrics import action_safety, normalizer_accuracy
from lexweave.plans import commands as C

FIXTURES = Path(__file__).parent / "fixtures"


def rows(name):
    return [json.loads(line) for line in (FIXTURES / name).read_text("utf-8").splitlines() if line]


def given(df):
    """The row's own label as a certain prediction."""
    return df.withColumns(
        {
            "predicted": F.col("label"),
            "confidence": F.lit(0.9),
            "probs": F.lit(None).cast("map<string,double>"),
        }
    )


@pytest.fixture(scope="module")
def parsed(spark):
    cases = [
        ("6h gọi mẹ", "call_contact"),
        ("gọi cho mẹ lúc 6 giờ", "call_contact"),
        ("lúc 6 giờ gọi cho hoàng", "call_contact"),
        ("gọi số 0901234567 lúc 6 giờ", "call_contact"),
        ("Bữa ni ở Huế trời răng rồi hỉ", "ask_weather"),
        ("đặt báo thức giúp tôi", "set_alarm"),
        ("nhắc tôi", "set_reminder"),
        ("gọi tôi dậy", "call_contact"),
        ("kêu tôi dậy lúc 6 giờ", "set_reminder"),
        ("gọi lại cho khách hàng", "set_reminder"),
        ("gọi số không chín không một hai ba bốn năm sáu bảy", "set_alarm"),
        ("0901234567 gọi đi", "set_reminder"),
        ("gọi mẹ bây giờ", "set_reminder"),
        ("nối máy với chị mai giúp tớ", "set_reminder"),
        ("đừng quên gọi mẹ lúc 6 giờ", "call_contact"),
        ("thời tiết ở đâu", "ask_weather"),
        ("đừng gọi cho mẹ", "call_contact"),
        ("mở bài lạc trôi của sơn tùng", "play_music"),
    ]
    df = spark.createDataFrame(
        [(str(i), t, x) for i, (t, x) in enumerate(cases)], "id string, text string, label string"
    )
    out = C.parse_corpus(df, given, keep=("id", "label"))
    return {r["text"]: r for r in out.collect()}


def short(row):
    return row["intent"], {k: v[0] for k, v in row["slots"].items()}


def test_boundaries_and_slots(parsed):
    reminder = {"datetime": "6 giờ"}
    expected = {
        "6h gọi mẹ": ("set_reminder", {"datetime": "6h", "reminder_text": "gọi mẹ"}),
        "gọi cho mẹ lúc 6 giờ": ("set_reminder", reminder | {"reminder_text": "gọi cho mẹ"}),
        "lúc 6 giờ gọi cho hoàng": ("set_reminder", reminder | {"reminder_text": "gọi cho hoàng"}),
        "gọi số 0901234567 lúc 6 giờ": (
            "set_reminder",
            reminder | {"reminder_text": "gọi số 0901234567"},
        ),
        "gọi tôi dậy": ("set_alarm", {}),
        "kêu tôi dậy lúc 6 giờ": ("set_alarm", reminder),
        "gọi lại cho khách hàng": ("call_contact", {"contact_name": "khách hàng"}),
        "gọi số không chín không một hai ba bốn năm sáu bảy": (
            "call_contact",
            {"phone_number": "0901234567"},
        ),
        "0901234567 gọi đi": ("call_contact", {"phone_number": "0901234567"}),
        "gọi mẹ bây giờ": ("call_contact", {"contact_name": "mẹ"}),
        "nối máy với chị mai giúp tớ": ("call_contact", {"contact_name": "chị mai"}),
        "đừng quên gọi mẹ lúc 6 giờ": ("set_reminder", reminder | {"reminder_text": "gọi mẹ"}),
        "đừng gọi cho mẹ": ("unknown", {}),
    }
    assert {t: short(parsed[t]) for t in expected} == expected


def test_answers_and_traces(parsed):
    hue = parsed["Bữa ni ở Huế trời răng rồi hỉ"]
    assert hue["normalized_text"] == "hôm nay ở huế trời sao rồi nhỉ"
    assert hue["region"] == "central" and hue["slots"]["location"] == ["huế"]
    assert "bữa ni -> hôm nay" in hue["matched_features"]
    alarm = parsed["đặt báo thức giúp tôi"]
    assert alarm["response"] == "Bạn muốn đặt báo thức lúc nào?" and alarm["action"] is None
    assert "missing_required_slots:datetime" in alarm["matched_features"]
    assert parsed["nhắc tôi"]["response"] == "Bạn muốn mình nhắc việc gì?"
    assert "intent_boundary:call_contact->set_alarm" in parsed["gọi tôi dậy"]["matched_features"]
    assert "location_clarification:placeholder" in parsed["thời tiết ở đâu"]["matched_features"]
    assert "action_gate:negated_command" in parsed["đừng gọi cho mẹ"]["matched_features"]
    call = parsed["gọi mẹ bây giờ"]["action"]
    assert (call["type"], call["status"]) == ("call", "mocked")
    assert call["payload"] == {"contact_name": "mẹ", "phone_number": None, "target": "mẹ"}
    music = parsed["mở bài lạc trôi của sơn tùng"]
    assert music["response"] == "Đã giả lập phát lạc trôi của sơn tùng."
    assert music["matched_features"] == [
        "intent_model:play_music",
        "song:lạc trôi",
        "artist:sơn tùng",
    ]


def test_low_confidence_is_rejected_first(spark):
    df = spark.createDataFrame([("1", "làm cái đó đi"), ("2", "  ")], "id string, text string")
    out = C.parse_corpus(df, C.constant_scorer("ask_weather", 0.3), threshold=0.45).collect()
    low, refused = sorted(out, key=lambda r: r["id"])
    assert low["intent"] == refused["intent"] == "unknown"
    assert low["action"] is refused["action"] is None
    assert low["matched_features"] == ["intent_rejected:ask_weather", "confidence_threshold:0.45"]
    assert refused["matched_features"] == ["invalid_request"] and refused["confidence"] == 0
    assert C.invalid_requests(df).count() == 1


def test_normalization_challenge(spark):
    data = [(r["id"], r["region"], r["input"], r["expected"]) for r in rows("normalization.jsonl")]
    df = spark.createDataFrame(data, "id string, region string, text string, expected string")
    row = normalizer_accuracy(normalize_corpus(df)).first()
    assert (row["total"], row["text_accuracy"], row["region_accuracy"]) == (35, 1.0, 1.0)


def test_normalizer_edges(spark):
    data = [
        ("câu này hỉ", None, "câu này hỉ", "standard"),
        ("tớ cần gọi mẹ dùm", None, "tôi cần gọi mẹ giúp", "unknown"),
        ("Bữa ni nhắc tui uống thuốc hỉ", "central", "hôm nay nhắc tôi uống thuốc nhé", "central"),
        ("gọi số 090 000 0000 lúc 6 giờ", "south", "gọi số 090 000 0000 lúc 6 giờ", "south"),
        ("tớ cần gọi má", "north", "tôi cần gọi má", "north"),
        ("tớ cần gọi má", "standard", "tôi cần gọi mẹ", "unknown"),
        ("mở nhạc  TỚ", None, "mở nhạc tôi", "north"),
        ("   ", None, None, "standard"),
    ]
    df = spark.createDataFrame(data, "text string, hint string, want string, region string")
    out = normalize_corpus(df, hint="hint").collect()
    assert [(r["normalized_text"], r["normalizer_region"]) for r in out] == [
        (want, region) for _, _, want, region in data
    ]


def test_slot_values_follow_the_text(spark):
    df = spark.createDataFrame(
        [("gọi má dùm tui", "south", {"contact_name": ["má"], "song": ["tía"]})],
        "text string, region string, slots map<string,array<string>>",
    )
    out = normalize_corpus(df, hint="region")
    slots = out.select(
        normalize_slots(F.col("slots"), F.col("region"), F.col("normalized_text"))
    ).first()[0]
    assert slots == {"contact_name": ["mẹ"], "song": ["tía"]}


def test_masking(spark):
    df = spark.createDataFrame(
        [("Gọi cho MẸ giúp, số 090 000 1111!", {"contact_name": ["mẹ"], "x": ["gọi cho mẹ"]})],
        "text string, slots map<string,array<string>>",
    )
    assert df.select(mask_slots(F.col("text"), F.col("slots"))).first()[0] == "<x> giup so <number>"


def test_rule_conflicts(spark):
    df = spark.createDataFrame([("n", "a", "b"), ("s", "a", "c")], "region string, src string, dst string")
    assert conflicting_rules(df).first()["src"] == "a"


SCHEMA = "id string, text string, should_execute boolean, expected_intent string, label string"
KEEP = ("id", "should_execute", "expected_intent")


def test_safety_challenge(spark):
    data = [
        (r["id"], r["text"], r["should_execute"], r.get("expected_intent"), r.get("expected_intent"))
        for r in rows("safety.jsonl")
    ]
    df = spark.createDataFrame(data, SCHEMA)
    run = F.col("action").isNotNull()
    wanted = C.parse_corpus(df.where("should_execute"), given, keep=(*KEEP, "label"))
    refused = C.parse_corpus(
        df.where("not should_execute"), lambda d: G.rule_classify(d), keep=(*KEEP, "label")
    )
    row = action_safety(wanted.unionByName(refused).withColumn("executed", run)).first()
    assert (row["positive_total"], row["positive_recall"]) == (17, 1.0)
    assert (row["negative_total"], row["false_action_rate"]) == (82, 0.0)


def test_refusals_hold_for_every_intent(spark):
    kinds = ("non_action_statement", "negated", "unsupported")
    data = [
        (f"{r['id']}/{x}", r["text"], False, None, x)
        for r in rows("safety.jsonl")
        if r["category"] in kinds
        for x in G.INTENT_PATTERNS
    ]
    out = C.parse_corpus(spark.createDataFrame(data, SCHEMA), given, keep=("id", "label"))
    assert [r["text"] for r in out.where("action is not null").collect()] == []


def test_rule_classifier(spark):
    data = [
        ("nhắc tôi uống thuốc", "set_reminder", 1.0),
        ("đặt báo thức lúc 6 giờ", "set_alarm", 1.0),
        ("thời tiết ở huế có mưa không", "ask_weather", 1.0),
        ("gọi cho mẹ và mở nhạc", "unknown", 0.0),
        ("xin chào", "unknown", 0.0),
        ("nhắc tôi thời tiết có mưa", "ask_weather", 2 / 3),
    ]
    df = spark.createDataFrame(data, "normalized_text string, want string, conf double")
    out = G.rule_classify(df).collect()
    assert [(r["predicted"], r["confidence"]) for r in out] == [(w, c) for _, w, c in data]


def test_enrichment(spark, parsed):
    schema = C.parse_corpus(
        spark.createDataFrame([("0", "gọi mẹ", "call_contact")], "id string, text string, label string"),
        given,
        keep=("id", "label"),
    ).schema
    picked = ["gọi mẹ bây giờ", "mở bài lạc trôi của sơn tùng", "nhắc tôi"]
    df = spark.createDataFrame(
        [tuple(parsed[t][c] for c in schema.names) for t in picked], schema
    )
    contacts = spark.createDataFrame(
        [("mẹ", ["má", "mạ"], "000 000 0001")], "name string, aliases array<string>, phone_number string"
    )
    catalog = spark.createDataFrame(
        [(0, "lạc trôi", "sơn tùng"), (1, "có chắc yêu là đây", "sơn tùng")],
        "position int, song string, artist string",
    )
    out = {r["text"]: r for r in C.enrich_actions(df, contacts, catalog).collect()}
    call = out["gọi mẹ bây giờ"]["action"]["payload"]
    assert call["resolved_phone_number"] == "000 000 0001"
    assert "chưa thực hiện cuộc gọi thật" in out["gọi mẹ bây giờ"]["response"]
    assert out["mở bài lạc trôi của sơn tùng"]["action"]["payload"]["n_matches"] == "1"
    assert out["nhắc tôi"]["action"] is None


def test_compatibility_forms_are_one_text(spark):
    from lexweave.functions import text as T

    same = [("ＡＢＣ １２", "abc 12"), ("ﬁle №5", "file no5"), ("ｇọi　mẹ", "gọi mẹ"), ("a\u00a0b", "a b"),
            ("½ㅤ㎞", None), ("Straße", "strasse"), ("ị", "ị")]
    df = spark.createDataFrame([(a,) for a, _ in same], "text string")
    out = df.select("text", T.normalize_surface(df["text"]).alias("s"), T.canonical_text(df["text"]).alias("c"))
    for row, (text, plain) in zip(out.collect(), same):
        whole = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
        assert row.s == whole
        assert plain is None or row.s == row.c == plain
