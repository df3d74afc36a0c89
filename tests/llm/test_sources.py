"""Decontamination, classifier, chat, archives, URL trust and the pipeline on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import chat, contamination, positive_unlabelled, url_trust, warc
from lexweave.session import ensure_checkpoint_dir

from .conftest import DOCS, documents
from .test_documents import VOCABULARY, edited, prose

ITEMS = "item_id bigint, text string"


def best_local(text, item):
    """Smith-Waterman by cells: the most matches among the alignments with the best score."""
    rows, best = [[(0, 0)] * (len(text) + 1)], (0, 0)
    for w in item:
        row = [(0, 0)]
        for j, t in enumerate(text):
            step = (1, 1) if t == w else (-1, 0)
            sides = [
                (rows[-1][j][0] + step[0], rows[-1][j][1] + step[1]),
                (rows[-1][j + 1][0] - 1, rows[-1][j + 1][1]),
                (row[j][0] - 1, row[j][1]),
                (0, 0),
            ]
            row.append(max(sides))
        rows.append(row)
        best = max(best, *row)
    return best[1]


def test_alignment_matches_the_cells():
    rng = np.random.default_rng(1)
    for _ in range(200):
        text, item = rng.integers(0, 4, rng.integers(0, 25)), rng.integers(0, 4, rng.integers(1, 15))
        matched, start, end = contamination.align(text, item)
        assert matched == best_local(text.tolist(), item.tolist())
        if matched:
            assert best_local(text[start:end].tolist(), item.tolist()) == matched


def test_leaks_of_all_kinds(table):
    rng = random.Random(3)
    items = [prose(rng.randint(20, 60), rng) for _ in range(12)] + [None, "", "too short"]
    texts = [prose(200, rng) for _ in range(30)]
    want = set()
    for i, item in enumerate(items[:12]):
        for n in (0, 1, 2):
            want.add((len(texts), i))
            leak = edited(item, n, rng).upper().replace(" ", ", ")
            texts.append(f"{prose(50, rng)} {leak} {prose(50, rng)}")
        half = " ".join(item.split()[: len(item.split()) // 2])
        texts.append(f"{prose(50, rng)} {half} {prose(50, rng)}")
    texts += [None, "", "word", " ".join(["again"] * 2000)]
    # An item that is in a third of all texts is found in each of them.
    for _ in range(60):
        want.add((len(texts), 0))
        texts.append(f"{prose(30, rng)} {items[0]}")
    docs = table([(*r, 1) for r in documents(texts)], DOCS + ", item bigint")
    bench = table(list(enumerate(items)), ITEMS)
    found = contamination.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want
    assert all(r.similarity >= 0.8 for r in found)
    clean = contamination.without_leaks(docs, bench)
    assert clean.columns == docs.columns
    gone = {d for d, _ in want}
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in range(len(texts)) if i not in gone]
    assert contamination.leaks(docs, bench.where("false")).count() == 0
    assert contamination.leaks(docs.where("false"), bench).count() == 0


@pytest.mark.parametrize("crowd", [2, 400])
def test_a_stock_phrase_hides_no_edited_copy(table, crowd):
    rng = random.Random(6)
    stock = "which of these answers is the best"
    items = [f"{stock} {prose(3, rng)}" for _ in range(5)] + [f"{stock} {prose(9, rng)}", f"{stock} {prose(1, rng)}"]
    texts, want = [], set()
    for i, item in enumerate(items):
        words = item.split()
        leaks = [words[:7] + ["altered"] + words[8:]] + ([words[:8] + words[9:]] if i < 5 else [])
        for leak in leaks:
            want.add((len(texts), i))
            texts.append(f"{prose(30, rng)} {' '.join(leak)} {prose(30, rng)}")
    texts += [f"{prose(20, rng)} {stock} {prose(20, rng)}" for _ in range(crowd)]
    texts.append(" ".join(f"{stock} {prose(20, rng)}" for _ in range(30)))
    # All texts share the phrase with all items, so every pair is told by its cells. The last item is
    # the phrase and one more word, so the phrase alone is 7/8 of it.
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            if best_local(text.split(), item.split()) >= 0.8 * len(item.split()):
                want.add((d, i))
    assert {(d, len(items) - 1) for d in range(len(texts))} <= want
    found = contamination.leaks(table(documents(texts), DOCS), table(list(enumerate(items)), ITEMS))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_very_long_passages_are_aligned_in_pieces():
    rng = np.random.default_rng(7)
    item = np.arange(10)
    for at in (5, contamination.PIECE - 4, contamination.PIECE, 1_099_985):
        text = rng.integers(100, 200, 1_100_000)
        text[at : at + 10] = item
        text[at + 3] = 99
        assert contamination.align(text, item) == (9, at, at + 10)


def test_classifier_separates_held_out_documents(table):
    rng = random.Random(8)
    good = [prose(rng.randint(30, 150), rng) + "." for _ in range(500)]
    bad = [" | ".join(prose(60, rng).split()) for _ in range(60)]
    bad += [(rng.choice(VOCABULARY) + " ") * 90 for _ in range(60)]
    texts = good + bad
    docs = table([(*r, 0.0) for r in documents(texts)], DOCS + ", quality_score double")
    labels = [(i, int(i < 500)) for i in range(0, 620, 2)] + [(None, 1), (3, None)]
    labels = table(labels, "doc_id bigint, quality int")
    scorer = positive_unlabelled.train(docs, labels)
    out = positive_unlabelled.score(docs, scorer).withColumn(
        "out", positive_unlabelled.is_held_out(docs["doc_id"])
    )
    held = [r for r in out.collect() if r.out]
    right = np.mean([(r.score >= 0.5) == (r.doc_id < 500) for r in held])
    assert len(held) > 150 and right >= 0.97
    kept = positive_unlabelled.accepted(docs, labels)
    assert kept.columns == docs.columns and 480 <= kept.count() <= 520
    # Without labels, and without texts.
    none = positive_unlabelled.train(docs, labels.where("false"))
    odd = table([(None, None, None, None, None), (1, "", "en", "s", 0)], DOCS)
    scores = [r.score for r in positive_unlabelled.score(odd, none).collect()]
    assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)
    assert positive_unlabelled.accepted(odd.where("false"), labels).count() == 0


def test_risk_is_not_taken_below_zero():
    rng = np.random.default_rng(0)
    positive, mixed = rng.normal(2, 1, (300, 3)), rng.normal(2, 1, (300, 3))
    mixed[:90] -= 4
    scorer = positive_unlabelled.fit(positive, mixed, 0.7)
    scores = scorer.scores(rng.normal(2, 1, (200, 3))), scorer.scores(rng.normal(-2, 1, (200, 3)))
    assert (scores[0] > 0.5).mean() > 0.9 and (scores[1] < 0.5).mean() > 0.9


TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_chat_reads_back(table):
    said = r"\### Assistant: </turn> ok"
    rows = [
        (1, 0, "system", "be # kind"), (1, 1, "user", "a\\nb\n<b>"), (1, 2, "assistant", said),
        (1, 3, "user", None), (1, 4, "assistant", "é😀 \\h"), (2, 0, "user", "only"),
        (3, 1, "assistant", ""), (3, 0, "us:er\nx", "</turn>\n### assistant: no"),
        (None, 0, "user", "x"), (None, None, None, "y"), (4, 0, "user", "same"), (4, 0, "user", "same"),
    ]
    rows += [(9, t, ("user", "assistant")[t % 2], f"turn {t}") for t in range(3000)]
    df = table([(*r, "z", 1) for r in rows], TURNS + ", segment string, start int")
    formatted = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert got.keys() == by_conv.keys()
    for conv, turns in by_conv.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        row = got[conv]
        assert row.n_turns == len(turns) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    few = chat.spelled_out(formatted.where("conv_id < 9")).collect()
    few = {(r.conv_id, r.turn): r for r in few}
    assert few.keys() == {(1, 2), (1, 4), (3, 1)}
    assert chat.unescape(few[1, 2].reply) == said
    assert few[1, 4].context.count(chat.END) == 4 and few[1, 4].context.endswith("### assistant: ")
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


PAGES = "page_id bigint, url string, html string"


def test_archive_round_trip(spark, table):
    long = "é😀\r\n\r\nWARC/1.1\r\n" * 4000
    texts = {1: "x" * 100, 2: "x" * 100, 3: "y" * 99, 4: "y" * 99, 5: None, 6: "", 7: long, 8: long,
             9: "\r\n\r\n" * 60, 10: "end\r\n\r\n"}
    rows = [(i, f"http://h/{i}\r\nX: 1", t, 1) for i, t in texts.items()] + [(1, None, "x" * 100, 2)]
    df = table(rows, PAGES + ", digest int")
    out = warc.round_trip(df).collect()
    assert len(out) == len(rows)
    for r in out:
        data = (texts[r.page_id] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        first = {2: 1, 8: 7}.get(r.page_id)
        assert (r.record_type, r.refers_to) == ("revisit" if first else "response", first)
    assert warc.round_trip(df.where("false")).count() == 0


def test_archive_s_damage_is_found(spark, table):
    folder = f"{ensure_checkpoint_dir(spark)}/damaged"
    boundary = warc.write_archive(table([(1, "http://h/", "some text")], PAGES), folder + "/a")
    lines = spark.read.option("lineSep", warc.END).text(folder + "/a")
    lines.selectExpr("replace(value, 'some', 'same') AS value").coalesce(1).write.option(
        "lineSep", warc.END
    ).text(folder + "/b")
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(spark, folder + "/b", boundary).collect()


def test_rules_and_spread(table):
    def page(i, url, *links):
        return i, url, "".join(f'<a href="{x}">x</a>' for x in links)

    rows = [
        page(0, "http://Good.com/a?x", "https://mid.org/"),
        page(1, "http://mid.org/", "//far.org/x", "/local"),
        page(2, "http://bad.net/fr/"),
        page(3, "http://farm.org/", "http://BAD.net/fr/1", "http://bad.net/"),
        page(4, "http://near.org/", "http://farm.org", "http://good.com/"),
        page(5, "http://x.www.example.com/en/1"), page(6, "http://example.com/en"),
        page(7, "http://example.com/en/"), page(8, None), page(9, "no-scheme"), page(10, "http://com"),
        (11, "http://other.org/", None), page(3, "http://farm.org/", "http://BAD.net/fr/1"),
    ]
    out = url_trust.verdicts(table([(*r, "h") for r in rows], PAGES + ", host string"))
    got = {r.page_id: r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[0].host == "good.com" and got[0].path == "/a" and got[0].rule == "com/"
    verdict = {i: r.verdict for i, r in got.items()}
    assert verdict == {
        0: "allow", 1: "allow", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow",
        7: "block", 8: "allow", 9: "allow", 10: "allow", 11: "allow",
    }
    assert got[5].rule == "www.example.com/en/" and got[6].rule == "com/" and got[10].rule is None
    assert got[8].host == got[8].path == "" and got[1].trust > 0 and got[3].distrust > 0
    assert url_trust.verdicts(table([], PAGES)).count() == 0


def test_spread_is_power_iteration(table):
    rng = np.random.default_rng(7)
    edges = {(int(a), int(b)): int(n) for a, b, n in rng.integers(0, 12, (50, 3)) + [0, 0, 1] if a != b}
    seeds = {0: 0.5, 3: 0.3, 20: 0.2}
    out = url_trust.spread(
        table([("t", str(a), str(b), n) for (a, b), n in edges.items()], "kind string, src string, dst string, links long"),
        table([("t", str(h), s) for h, s in seeds.items()], "kind string, host string, seed double"),
        rounds=5,
    )
    rank = np.zeros(21)
    own = np.zeros(21)
    own[list(seeds)] = list(seeds.values())
    flow = np.zeros((21, 21))
    for (a, b), n in edges.items():
        flow[b, a] = n
    flow = flow / np.maximum(flow.sum(0), 1)
    rank = own.copy()
    for _ in range(5):
        passed = url_trust.DAMPING * flow @ rank
        rank = own * (1 - passed.sum()) + passed
    got = {int(r.host): r["rank"] for r in out.collect()}
    assert all(abs(got.get(i, 0) - rank[i]) < 1e-12 for i in range(21))


def test_a_host_with_few_blocked_pages_seeds_distrust(table):
    rows = [(i, f"http://bad.net/{lang}/{i}", "") for i, lang in enumerate(["es", "fr", "en", "de", "it"])]
    rows += [(5, "http://friend.org/", '<a href="http://bad.net/en/">'), (6, "http://quiet.org/", "")]
    got = {r.page_id: r for r in url_trust.verdicts(table(rows, PAGES)).collect()}
    assert [got[i].verdict for i in range(7)] == ["block"] * 6 + ["allow"]
    assert got[2].distrust > got[5].distrust > 0 == got[6].distrust


def test_ranks_reach_the_end_of_a_long_chain(table):
    edges = [("t", f"{i:02}", f"{i + 1:02}", 1) for i in range(15)]
    out = url_trust.spread(
        table(edges, "kind string, src string, dst string, links long"),
        table([("t", "00", 1.0)], "kind string, host string, seed double"),
    )
    want = np.array([url_trust.DAMPING**i for i in range(16)])
    want /= want.sum()  # what the last host can't pass on starts again
    got = {r.host: r["rank"] for r in out.collect()}
    assert all(abs(got[f"{i:02}"] - want[i]) < 0.01 / 16 for i in range(16))


def test_pipeline_over_clashing_columns(spark, table, tmp_path):
    rng = random.Random(11)
    item = prose(30, rng)
    texts = [prose(rng.randint(40, 120), rng) for _ in range(60)]
    texts += [texts[0], edited(texts[1], 1, rng), f"{prose(30, rng)} {item}", None, ""]
    names = ("key", "ids_", "n", "text_key", "root", "drop", "quality_score", "Class")
    rows = [(*r, *range(len(names))) for r in documents(texts)]
    schema = DOCS + ", " + ", ".join(f"{n} int" for n in names)
    table(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    table([(0, item)], ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = table([(i, 1) for i in range(60)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == out.count() and 62 not in got
    assert len({0, 60} & got.keys()) <= 1 and len({1, 61} & got.keys()) <= 1
    assert set(out.columns) == {*(c.split()[0] for c in schema.split(", ")), "ids", "decoded"}
    assert all(r.decoded == (r.text or "") and r.text_key == 3 for r in got.values())


def test_repeated_ids_are_drawn_once(table, monkeypatch):
    """Rows and labels of an id may repeat; the sample has one row an id, and all rows are scored."""
    texts = [f"word{i} and some more text {i * i}" for i in range(60)] + ["same id, other words " * 9] * 600
    rows = [(i if i < 60 else 60 + i % 3, t) for i, t in enumerate(texts)]
    docs = table(rows, "doc_id bigint, text string")
    labels = table([(i % 63, 1) for i in range(400)], "doc_id bigint, quality int")
    sizes = []
    real = positive_unlabelled.fit

    def fit(positive, unlabelled, prior):
        sizes.append((len(positive), len(unlabelled)))
        return real(positive, unlabelled, prior)

    monkeypatch.setattr(positive_unlabelled, "fit", fit)
    scorer = positive_unlabelled.train(docs, labels)
    learnt = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(63))
    assert sizes == [(learnt, learnt)]
    assert positive_unlabelled.score(docs, scorer).where("score between 0 and 1").count() == len(rows)
