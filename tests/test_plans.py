import json

import pytest
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import gates as G
from lexweave.operators import quality as Q
from lexweave.operators import splits as S
from lexweave.plans import build as B
from lexweave.plans.checks import validate
from lexweave.plans.commands import parse_corpus
from lexweave.plans.prepare import preprocess, preprocess_violations
from lexweave.plans.scoring import evaluate_all, score_table
from lexweave.rules import tagging
from lexweave.sources import samples as R
from lexweave.sources import sinks as K
from lexweave.streaming.commands import parse_stream, read_requests

SLOTS = "map<string,array<string>>"
SAMPLE = (
    "id string, group_id string, text string, region string, intent string, "
    f"slots {SLOTS}, source string, source_ref string, variant_type string, "
    "annotation_quality string, split string, file string"
)


def sample(id, text, split="train", intent="call_contact", slots=None, **other):
    base = {
        "id": id, "group_id": id, "text": text, "region": "standard", "intent": intent,
        "slots": slots or {}, "source": "manual", "source_ref": None, "variant_type": "casual",
        "annotation_quality": "reviewed", "split": split, "file": f"{split}.jsonl",
    }
    return {**base, **other}


def frame(spark, rows):
    return spark.createDataFrame(rows, SAMPLE)


GOOD = {
    "intent_score": 1, "slots_score": 1, "grammar_score": 4.0, "spelling_score": 2.0,
    "language_identification": "target",
}


def external(id, intent, annot, partition="train", judgments=None):
    return {"id": id, "partition": partition, "intent": intent, "utt": "", "annot_utt": annot,
            "judgments": [GOOD] * 3 if judgments is None else judgments}


def test_external_mapping(spark, tmp_path):
    rows = [
        external("42", "alarm_set", "olly, cài báo thức [date : ngày mai] lúc [time : sáu giờ sáng]"),
        external("43", "alarm_set", "cài báo thức giúp tôi"),
        external("44", "calendar_set", "[timeofday : tối nay] nhắc tôi [event_name : cuộc hẹn] [date : ngày mai]"),
        external("45", "calendar_set", "đặt thông báo về [event_name : thời tiết xấu]"),
        external("46", "calendar_set", "nhắc tôi [event_name : cuộc hẹn] [date : ngày mai]", "test"),
        external("47", "weather_query", "thời tiết ở [place_name : huế] thế nào", "dev"),
        external("48", "play_music", "mở nhạc"),
        external("49", "play_music", "mở nhạc giúp tôi", judgments=[GOOD]),
        external("50", "cooking", "nấu phở bò giúp tôi"),
        external("51", "play_music", "mở nhạc giúp tôi", judgments=[GOOD, {**GOOD, "grammar_score": 2.0}]),
    ]
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), "utf-8")
    out = {r["id"]: r for r in B.map_external(R.read_external(spark, str(path))).collect()}
    assert sorted(out) == [
        "massive_vi_alarm_set_42",
        "massive_vi_calendar_set_46",
        "massive_vi_weather_query_47",
    ]
    alarm = out["massive_vi_alarm_set_42"]
    assert alarm["text"] == "cài báo thức ngày mai lúc sáu giờ sáng"
    assert alarm["slots"] == {"datetime": ["ngày mai lúc sáu giờ sáng"]}
    assert (alarm["region"], alarm["split"]) == ("standard", "train")
    assert alarm["source_ref"] == "massive:1.0:vi-VN:42"
    assert out["massive_vi_weather_query_47"]["slots"] == {"location": ["huế"]}
    chosen = B.external_rows(B.map_external(R.read_external(spark, str(path))))
    assert chosen.count() == 3


TEMPLATES = [
    (region, "call_contact", i, t)
    for region in ("north", "south")
    for i, t in enumerate(
        ["gọi cho {contact_name} nhé", "bấm số {phone_number}", "quay số {phone_number} giúp tôi",
         "liên lạc với {contact_name}", "nối máy với {contact_name} giúp"]
    )
]


def test_templates_and_build(spark):
    templates = spark.createDataFrame(
        TEMPLATES, "region string, intent string, family int, template string"
    )
    values = {"contact_name": tagging.CONTACTS, "phone_number": tagging.PHONES}
    make = lambda: B.template_rows(spark, templates, values, tagging.TRACKS, {"call_contact": 10})
    rows = make()
    got = rows.collect()
    assert sorted(map(str, got)) == sorted(map(str, make().collect()))
    assert len(got) == 2 * 2 * 10
    plain = [r for r in got if r["variant_type"] == "regional"]
    assert len({T_fold(r["text"]) for r in plain}) == len(plain)
    for r in plain:
        (value,) = next(iter(r["slots"].values()))
        assert value in r["text"] and "{" not in r["text"]
    families = {}
    for r in plain:
        families.setdefault(r["source_ref"].split(":")[-1], set()).add(r["split"])
    assert all(len(s) == 1 for s in families.values())
    reviewed = frame(spark, [sample("m1", "gọi cho mẹ ngay", slots={"contact_name": ["mẹ"]})])
    corpus, report = B.build_corpus(rows, reviewed)
    kept = corpus.collect()
    assert {r["split"] for r in kept} <= {"train", "validation", "test"}
    steps = {(r["step"], r["source"]): r for r in report.collect()}
    total = steps["cross_split_near_similarity", "all"]
    last = steps["same_split_exact_after_normalization", "all"]
    assert total["before"] == 41 and last["after"] == len(kept) and total["after"] == last["before"]
    coverage = Q.required_coverage(
        templates.join(B.template_splits(templates), ["intent", "family"]).withColumn(
            "slot_names", B.M.template_slots(F.col("template"))
        )
    )
    assert {(r["split"], r["slot"]) for r in coverage.collect()} <= {
        (s, x) for s in ("validation", "test") for x in values
    }


def test_templates_give_every_filling_once_or_an_error(spark):
    templates = spark.createDataFrame(
        [
            ("north", "call_contact", f, f"mẫu {f} {{contact_name}} và {{phone_number}}")
            for f in range(3)
        ]
        + [("south", "call_contact", f, f"kiểu {f} {{contact_name}}") for f in range(3)],
        "region string, intent string, family int, template string",
    )
    values = {"contact_name": [f"an{i}" for i in range(20)], "phone_number": [f"09{i}" for i in range(7)]}

    def make(n):
        return B.template_rows(spark, templates, values, tagging.TRACKS, {"call_contact": n})

    # 28 of 40 train and 6 each test and validate; a southern template has 20 fillings.
    with pytest.raises(ValueError, match="south/call_contact/train"):
        make(40)
    rows = [r for r in make(28).collect() if r["variant_type"] == "regional"]
    assert len(rows) == 2 * 28 and len({r["text"] for r in rows}) == 2 * 28
    # 20 of 28 train: all that the southern template can give.
    south = {r["text"].split()[-1] for r in rows if (r["region"], r["split"]) == ("south", "train")}
    assert south == set(values["contact_name"])


@pytest.mark.parametrize("side", [1, 2, 7, 30])
def test_permutation_hits_every_number_once(spark, side):
    at = spark.range(side * side)
    out = at.select(B.permuted(F.col("id"), F.lit(side).cast("long"), F.lit(5), F.lit("x")).alias("to"))
    got = [r["to"] for r in out.collect()]
    assert sorted(got) == list(range(side * side))
    assert side < 7 or got != sorted(got)


def test_line_numbers_of_a_file_in_many_splits(spark, tmp_path):
    good = json.dumps({"id": "x", "text": "gọi cho mẹ"}, ensure_ascii=False)
    want = set()
    for name in ("train.jsonl", "test_north.jsonl"):
        lines = [good if i % 3 else "" for i in range(4000)]
        for at in (0, 1, 777, 2500, 3999):
            lines[at] = f"{{broken {at}"
            want.add((name, at + 1, lines[at]))
        (tmp_path / name).write_text("\n".join(lines), "utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        bad = R.bad_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert {tuple(r) for r in bad.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def T_fold(text):
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def test_preprocess(spark):
    slots = {"contact_name": ["má"]}
    rows = [
        sample("a", "gọi má dùm tui", region="south", slots=slots),
        sample("b", "gọi mẹ giúp tôi", region="south", slots={"contact_name": ["mẹ"]}),
        sample("c", "gọi má dùm tui", "test", region="south", slots=slots),
        sample("d", "gọi mẹ giúp tôi", "test", region="south", slots={"contact_name": ["mẹ"]}),
        sample("e", "gọi mẹ giúp tôi", intent="play_music", region="south"),
    ]
    df = frame(spark, rows)
    out = {r["id"]: r for r in preprocess(df.where("id <> 'e'")).collect()}
    assert sorted(out) == ["a", "c", "d"]
    assert out["a"]["normalized_text"] == "gọi mẹ giúp tôi"
    assert out["a"]["normalized_slots"] == {"contact_name": ["mẹ"]}
    counts = {r["split"]: r for r in Q.preprocess_counts(df, preprocess(df)).collect()}
    assert (counts["train"]["input"], counts["train"]["output"], counts["train"]["dropped"]) == (3, 1, 2)
    assert counts["test"]["dropped"] == 0
    assert [r["rule"] for r in preprocess_violations(df).collect()] == ["two_intents"]


def test_validation_finds_each_fault(spark):
    mother, father = {"contact_name": ["mẹ"]}, {"contact_name": ["bố"]}
    rows = [
        sample("a", "gọi cho mẹ giúp tôi", slots=mother, group_id="g1"),
        sample("b", "gọi cho bố giúp tôi", "test", slots=father, group_id="g2", file="test_south.jsonl"),
        sample("c", "liên lạc mẹ", slots=mother, group_id="g3"),
        sample("d", "lien lac mẹ", slots=mother, group_id="g3"),
        sample("e", "bấm số cho bố đi", slots=mother, group_id="g4"),
        sample("f", "quay số cho mẹ", slots=mother, group_id="g5"),
        sample("f", "Quay số cho mẹ!", slots=mother, group_id="g6"),
        sample("h", "nối máy tới mẹ", "validation", slots=mother, group_id="g1"),
        sample("i", "liên hệ mẹ nhé bạn", slots=mother, source="massive", source_ref="r", region="north"),
        sample("j", "gọi điện mẹ lúc này đây", slots=mother, source="massive", source_ref="r"),
        sample("k", "gọi thử xem sao nhỉ"),
    ]
    found = validate(frame(spark, rows), enforce_minimums=False).collect()
    by_rule = {}
    for r in found:
        by_rule.setdefault(r["rule"], []).append((r["subject"], r["detail"]))
    assert by_rule["region_file"] == [("b", "standard")]
    assert [s for s, _ in by_rule["slot_not_in_text"]] == ["e"]
    assert by_rule["duplicate_id"] == [("f", "2")]
    assert len(by_rule["same_text_other_group"]) == 1
    assert len(by_rule["same_plain_text_other_group"]) == 1
    assert by_rule["group_leakage"] == [("g1", "train,validation")]
    assert by_rule["source_ref_groups"] == [("r", "i j")]
    assert [s for s, _ in by_rule["near_similar"]] == ["train/a"]
    assert sorted(by_rule["contract"]) == [
        ("i", "external_region north"),
        ("k", "missing_slot_group contact_name|phone_number"),
    ]
    assert by_rule["no_native_review"] == [("0", "")]
    floors = Q.minimums(frame(spark, rows)).collect()
    assert ("total", "all", 11) in map(tuple, floors)
    assert ("test_region_intent", "north/play_music", 0) in map(tuple, floors)
    shares = {r["split"] for r in Q.spread_check(frame(spark, rows)).collect()}
    assert shares == {"train"}


def test_reader_and_writers(spark, tmp_path):
    rows = [
        sample("b", "gọi cho mẹ", slots={"contact_name": "mẹ"}),
        sample("a", "nhắc tôi", intent="set_reminder", slots={"datetime": ["mai", "tối nay"]}),
    ]
    lines = [json.dumps({k: v for k, v in r.items() if k not in ("split", "file")}) for r in rows]
    (tmp_path / "in").mkdir()
    train, north = tmp_path / "in" / "train.jsonl", tmp_path / "in" / "test_north.jsonl"
    train.write_text("\n".join([*lines, "", "{broken"]), "utf-8")
    north.write_text(lines[0].replace('"b"', '"n"'), "utf-8")
    df = R.read_samples(spark, str(tmp_path / "in"))
    got = {r["id"]: r for r in df.collect()}
    assert got["b"]["slots"] == {"contact_name": ["mẹ"]}
    assert got["a"]["slots"] == {"datetime": ["mai", "tối nay"]}
    assert (got["n"]["split"], got["a"]["split"]) == ("test", "train")
    bad = R.bad_lines(spark, str(tmp_path / "in")).collect()
    assert [(r["file"], r["line_number"], r["line"]) for r in bad] == [("train.jsonl", 4, "{broken")]
    assert R.read_reviewed_seed(spark, str(north)).first()["split"] == "train"
    out = str(tmp_path / "out")
    K.write_dataset(df, out)
    back = spark.read.parquet(out)
    assert {(r["split"], r["bucket"]) for r in back.select("split", "bucket").collect()} == {
        ("train", "all"),
        ("test", "standard"),
    }
    mark = K.content_checksum(df.select("id", "text", "split"), ["split"])
    assert K.stale(back.select("id", "text", "split"), mark, ["split"]).count() == 0
    changed = df.withColumn("text", F.upper("text")).select("id", "text", "split")
    assert K.stale(changed, mark, ["split"]).count() == 2
    counts = {(r["metric"], r["value"]): r["n"] for r in K.write_manifest(df, out + "_m").collect()}
    assert counts["total", "all"] == 3 and counts["bucket", "test_standard"] == 1
    K.write_preprocessed(df, out + "_p")
    assert R.read_preprocessed(spark, out + "_p").count() == 3
    with pytest.raises(ValueError):
        K.write_preprocessed(df.limit(0), out + "_e")
        R.read_preprocessed(spark, out + "_e")
    twice = tmp_path / "twice.jsonl"
    twice.write_text('{"id":"x","text":"t","intent":"i"}\n' * 2, "utf-8")
    with pytest.raises(ValueError, match="repeat"):
        R.read_challenges(spark, str(twice), "boundary")


def test_score_and_reports(spark):
    rows = [
        sample("1", "gọi cho mẹ", slots={"contact_name": ["mẹ"]}),
        sample("2", "nhắc tôi uống thuốc lúc 8 giờ", intent="set_reminder",
               slots={"reminder_text": ["uống thuốc"], "datetime": ["8 giờ"]}),
        sample("3", "thời tiết huế hôm nay", intent="ask_weather", region="central",
               slots={"location": ["huế"], "datetime": ["hôm nay"]}),
        sample("4", "không gọi cho bố", slots={"contact_name": ["bố"]}),
    ]
    scored = score_table(frame(spark, rows), G.rule_classify).persist()
    reports = evaluate_all(scored)
    overall = reports["overall"].first()
    assert (overall["n"], overall["full_success"], overall["oracle_slot_exact"]) == (4, 0.75, 1.0)
    assert reports["coverage"].first()["coverage"] == 0.75
    assert [tuple(r) for r in reports["gate_reasons"].collect()] == [("negated_command", 1)]
    assert [r["id"] for r in reports["failures"].collect()] == ["4"]
    for name in set(reports) - {"failures"}:
        assert reports[name].collect() is not None, name


def test_stream_equals_batch(spark, tmp_path):
    rows = [("1", "gọi cho mẹ"), ("2", "mở nhạc sơn tùng"), ("3", " "), ("4", "đừng gọi cho mẹ")]
    (tmp_path / "in").mkdir()
    for i, (k, t) in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"id": k, "text": t}), "utf-8")
    schema = "id string, text string"
    batch = parse_corpus(spark.createDataFrame(rows, schema), G.rule_classify)
    expected = sorted(map(str, batch.collect()))
    for narrow in (True, False):
        out = str(tmp_path / f"out{narrow}")
        requests = read_requests(spark, str(tmp_path / "in"), schema)
        run = parse_stream(requests, G.rule_classify, out, out + "_ckpt", narrow=narrow)
        run.awaitTermination()
        got = spark.read.parquet(out).select(*batch.columns)
        assert sorted(map(str, got.collect())) == expected


def test_ranks_hold_for_large_quotas(spark):
    df = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("intent"),
        F.lit("train").alias("split"),
    )
    small = S.quota_topk(df, {"a": 100, "b": 100}, {"train": 0.225})
    assert {r["intent"]: r["count"] for r in small.groupBy("intent").count().collect()} == {
        "a": 22,
        "b": 22,
    }
    large = S.quota_topk(df, {"a": 900, "b": 1900}, {"train": 1.0})
    sizes = {r["intent"]: r["count"] for r in large.groupBy("intent").count().collect()}
    assert sizes == {"a": 900, "b": 1900}
    keys = df.where("intent = 'b'").withColumn("k", T.stable_order_key(F.col("id")))
    first = {r["id"] for r in keys.orderBy("k").limit(1900).collect()}
    assert {r["id"] for r in large.where("intent = 'b'").collect()} == first


def test_group_split_keeps_groups_whole(spark):
    df = spark.range(1000).select((F.col("id") % 200).alias("group_id"))
    out = S.group_split(df)
    sizes = {
        r["split"]: r["n"]
        for r in out.groupBy("split").agg(F.count_distinct("group_id").alias("n")).collect()
    }
    assert sizes == {"train": 140, "validation": 30, "test": 30}
    assert Q.group_leakage(out).count() == 0
