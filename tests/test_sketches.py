"""Candidates of long texts come from sketches."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.operators import similar as S
from lexweave.operators import sketches


def direct(a, b, rule):
    if min(len(a), len(b)) / max(len(a), len(b)) < rule.length:
        return False
    x, y = set(a.split()), set(b.split())
    if len(x & y) / len(x | y) < rule.jaccard:
        return False
    return rule.sequence is None or S.SequenceMatcher(None, a, b).ratio() >= rule.sequence


@pytest.fixture(scope="module")
def rows():
    """Long texts about the limit of short ones, some with more or fewer changed words."""
    rng = random.Random(5)
    words = [f"{'abcdefgh'[i % 8] * (1 + i % 5)}{i}" for i in range(400)]
    texts = []
    for i in range(70):
        own = rng.choices(words, k=rng.choice([30, 45, 60, 200, 900]))
        texts.append(" ".join(own))
        for share in rng.sample([0.02, 0.05, 0.2, 0.3, 0.35, 0.5], 2):
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in own))
    texts = list(dict.fromkeys(texts))
    splits = [rng.choice(["train", "train", "validation", "test"]) for _ in texts]
    return [(f"r{i:03d}", s, t) for i, (s, t) in enumerate(zip(splits, texts))]


@pytest.mark.parametrize("rule", [S.Similarity(), S.Similarity(sequence=None)])
@pytest.mark.parametrize("limit", [None, 3])
def test_long_texts_equal_brute_force(spark, rows, rule, limit):
    rank = {"train": 0, "validation": 1, "test": 2}
    expected = sorted(
        (rank[ls], rank[rs], li, ri)
        for li, ls, lt in rows
        for ri, rs, rt in rows
        if rank[ls] < rank[rs] and direct(lt, rt, rule)
    )
    assert len(expected) > 4
    df = spark.createDataFrame(rows, "id string, split string, text string")
    got = S.near_dup_pairs(df, "text", rule=rule, limit=limit).collect()
    assert [(rank[r[0]], rank[r[2]], r[1], r[3]) for r in got] == expected[:limit]


def test_texts_that_first_partners_do_not_settle(spark, monkeypatch):
    """The best partners by token overlap fail the sequence ratio, a weaker one passes it; cells are small."""
    monkeypatch.setattr(sketches, "CHUNK", (2, 2))
    rng = random.Random(2)
    # Letters that stand once each, so that none counts as junk.
    own = ["".join(chr(0x4E00 + 3 * i + j) for j in range(3)) for i in range(80)]
    shuffled = [" ".join(rng.sample(own, 80)) for _ in range(9)]
    edited = " ".join(["other1", "other2", *own[2:]])
    rows = [("a", "train", " ".join(own)), ("z", "test", edited)]
    rows += [(f"s{i}", "test", t) for i, t in enumerate(shuffled)]
    rows += [(f"t{i}", "train", " ".join(f"x{i}{j}" for j in range(80))) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, split string, text string")
    got = S.near_dup_pairs(df, "text", limit=50).collect()
    assert [(r["left_id"], r["right_id"]) for r in got] == [("a", "z")]
    kept = S.cross_split_anti(df, "text", group="id")
    assert sorted(r["id"] for r in kept.select("id").collect()) == sorted({r[0] for r in rows} - {"a"})


def test_ratio_is_that_of_all_blocks():
    rng = random.Random(4)
    told = set()
    for i in range(200):
        a = "".join(rng.choices("abcdefghij"[: 2 + i % 9], k=rng.randint(1, 300)))
        b = "".join(c if rng.random() < 0.95 else rng.choice("xyz") for c in a)
        b = b if i % 3 else b[len(b) // 2 :] + b[: len(b) // 2]
        whole = S.SequenceMatcher(None, a, b).ratio()
        assert S.ratio_from(a, b, 0.8) == (whole if whole >= 0.8 else None)
        told.add(whole >= 0.8)
    assert told == {True, False}


def test_long_texts_leave_no_postings(spark, rows):
    """Postings of long texts, hundreds a text, were what filled the disk."""
    df = spark.createDataFrame(rows, "id string, split string, text string")
    texts = S.templates(df.where(F.length("text") >= 300), "text")
    near, far = S._short_and_long(texts.where("part < 2"), texts.where("part > 0"), S.Similarity())
    assert all(side.isEmpty() for side in near) and far[0].count() == texts.where("part < 2").count()
