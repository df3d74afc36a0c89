"""Filter overlaps, vector codes and token counts against plain versions of the same definitions."""

import itertools
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from lexweave.llm import equal_average, filter_audit, token_counts
from lexweave.llm.support import looked_up

WORDS = "[^\x20\x09-\x0d]+"
LABELS = "doc_id bigint, quality int, toxic int"


def plain_failures(rows):
    """{row number: failed letters} by the definitions."""
    out = []
    for doc_id, text in rows:
        t = text or ""
        words = re.findall(WORDS, t)
        failed = set()
        if len(words) < 200:
            failed.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            failed.add("C")
        if re.search("[#$%&*|]", t):
            failed.add("D")
        if doc_id is not None and any(d is not None and d < doc_id and (u or "") == t for d, u in rows):
            failed.add("E")
        out.append(failed)
    return out


def plain_audit(docs, labels):
    failed = plain_failures([(d, t) for d, t, _ in docs])
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = {}
    for part in {s or "" for _, _, s in docs}:
        own = [(d, f) for (d, _, s), f in zip(docs, failed) if (s or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                rows[part, "".join(order), step] = (
                    len(left),
                    len(gone),
                    sum(name in f for _, f in own) - len(gone),
                    sum(f == {name} for _, f in own),
                    sum(d in good for d, _ in gone),
                    sum(d in toxic for d, _ in gone),
                )
    sums = {}
    for (part, order, step), row in rows.items():
        key = part, order[step - 1]
        sums[key] = sums.get(key, 0) + row[1]
    return {k: (*row, sums[k[0], k[1][k[2] - 1]]) for k, row in rows.items()}


def long_text(seed, n=240, distinct=200):
    return " ".join(f"w{seed}x{i % distinct}" for i in range(n))


DOCS = [
    (1, long_text(1), "a"),
    (2, long_text(1), "a"),
    (3, long_text(1), None),
    (3, long_text(1), None),
    (None, long_text(1), "a"),
    (4, None, "a"),
    (5, "", "b"),
    (6, " \t\n\x0b", "b"),
    (7, long_text(2, distinct=20), "b"),
    (8, long_text(3).upper() + " #", ""),
    (9, long_text(4) + " A" * 9, "b"),
    (10, "Ä" * 3000 + " x|y", "b"),
    (11, long_text(5, 40000, 30000), "b"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (3, 0, 1), (3, 1, 0), (8, None, 1), (9, 1, None), (None, 1, 1), (77, 1, 1)]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(spark, docs, labels):
    docs = docs.withColumns({"failed": F.lit(9), "key": F.lit("x"), "A": F.lit(True), "all": F.lit(0)})
    found = filter_audit.audit(docs, labels.withColumn("id", F.lit(5)))
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in found.collect()}


def test_audit_equals_a_plain_walk_through_all_orders(spark, table):
    docs = table(DOCS, "doc_id bigint, text string, source string")
    assert audited(spark, docs, table(MARKS, LABELS)) == plain_audit(DOCS, MARKS)


def test_audit_of_a_hot_text_and_of_nothing(spark, table):
    many = [(i % 40, long_text(i % 3 if i % 2 else 0), "hot" if i % 3 else "cold") for i in range(300)]
    docs = table(many, "doc_id bigint, text string, source string")
    assert audited(spark, docs, table([], LABELS)) == plain_audit(many, [])
    assert audited(spark, table([], "doc_id bigint, text string, source string"), table(MARKS, LABELS)) == {}


def test_positional_counts_by_carry_save():
    rng = np.random.default_rng(1)
    adder, seen = filter_audit.PositionalCounts(), []
    for n in (0, 1, 2, 3, 7, 1000, 1, 4097):
        words = rng.integers(0, 2**32, n, dtype="u4")
        adder.add(words)
        seen.append(words)
    words = np.concatenate(seen)
    want = [int((words >> np.uint32(i) & np.uint32(1)).sum()) for i in range(32)]
    assert adder.counts().tolist() == want
    assert all(len(h) <= 2 for h in adder.held)


def test_survival_words_name_the_subsets_without_a_failed_filter():
    for failed, word in enumerate(filter_audit.survival_words(5).tolist()):
        assert word == sum(1 << s for s in range(32) if s & failed == 0)


def test_audit_of_own_filters(spark, table):
    rows = table([("x", 1), ("x", 5), ("y", None), (None, 9)], "p string, n int")
    found = filter_audit.survivors(rows, [F.col("n") > 4, F.col("n") > 8], F.col("p"))
    assert {r["part"]: r["all"] for r in found.collect()} == {
        "x": [2, 1, 2, 1], "y": [1, 1, 1, 1], "": [1, 0, 0, 0]
    }
    out = filter_audit.orders(found, "LH").where("part = '' and filter_order = 'HL'").orderBy("step")
    assert [(r["kept"], r["removed"], r["redundant"]) for r in out.collect()] == [(0, 1, 0), (0, 0, 1)]
    with pytest.raises(ValueError):
        filter_audit.survivors(rows, [F.lit(True)] * 6, F.col("p"))


def test_looked_up_keeps_every_row_of_hot_and_null_keys(table):
    rows = table([("h", i) for i in range(400)] + [("c", 1), (None, 2), (None, 3), ("z", 4)], "k string, v int")
    values = table([("h", 1.5), ("c", 2.5), ("other", 3.5)], "k string, w double")
    got = sorted((r["k"] or "", r["v"], r["w"]) for r in looked_up(rows, values, "k").collect())
    want = [("", 2, None), ("", 3, None), ("c", 1, 2.5), *[("h", i, 1.5) for i in range(400)], ("z", 4, None)]
    assert got == want


def brute_nearest(parts, entries):
    d = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("entries, width, spread", [(1, 1, 5), (7, 3, 2), (256, 16, 300), (100, 4, 3), (300, 2, 1 << 27)])
def test_search_finds_the_nearest_entry_with_the_lowest_index(entries, width, spread):
    rng = np.random.default_rng(entries)
    book = rng.integers(-spread, spread + 1, (entries, width))
    parts = np.concatenate([rng.integers(-spread, spread + 1, (500, width)), book])
    index, distance = equal_average.Searcher(book).nearest(parts)
    want_index, want_distance = brute_nearest(parts, book)
    assert index.tolist() == want_index.tolist() and distance.tolist() == want_distance.tolist()


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [int(np.floor(1024 * x)) for x in v], g) for i, v, g in rows
            if v and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = next(len(v) for _, v, _ in order if len(v) % parts == 0)
    kept = [r for r in kept if len(r[1]) == width]
    order = [r for r in order if len(r[1]) == width][:entries]
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = np.array([v for _, v, _ in order]).reshape(len(order), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        books = books.copy()
        for p in range(parts):
            index, _ = brute_nearest(x[:, p], books[p])
            for e in set(index.tolist()):
                books[p, e] = x[index == e, p].sum(0) // (index == e).sum()
    found = [brute_nearest(x[:, p], books[p]) for p in range(parts)]
    errors = sum(d for _, d in found)
    by_label = {}
    for (_, _, g), e in zip(kept, errors.tolist()):
        by_label[g] = by_label.get(g, 0) + e
    return sorted(
        (repr(i), [int(f[0][at]) for f in found], int(errors[at]), by_label[g])
        for at, (i, _, g) in enumerate(kept)
    ), equal_average.digest(books)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def coded(df):
    rows = equal_average.compressed(df.withColumns({"id": F.lit("x"), "codes": F.lit(1), "vector": F.lit(0)}))
    rows = rows.collect()
    return sorted((repr(r["id"]), r["codes"], r["error"], r["label_error"]) for r in rows), {
        r["codebooks"] for r in rows
    }


def test_codes_equal_plain_rounds(table):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 50], [None, 1, 2][i % 3]) for i in range(400)]
    rows += [rows[5], rows[5], (5, rows[6][1], 1), (None, rows[7][1], None), (900, None, 1), (901, [0.5, None] * 4, 1)]
    rows += [(902, [float("nan")] * 8, 1), (903, [float("-inf")] * 8, 1), (904, [], 1), (905, [1.0] * 4, 2), (-9, [1.0] * 3, 2)]
    want, digest = plain_codes(rows)
    assert coded(table(rows, VECTORS)) == (want, {digest})


def test_codes_of_few_equal_and_no_vectors(table):
    rows = [(i, [0.25, -0.25, 0.0, 0.5], 1) for i in range(6)]
    want, digest = plain_codes(rows)
    assert coded(table(rows, VECTORS)) == (want, {digest})
    assert coded(table([(1, None, 2)], VECTORS)) == ([], set())
    assert coded(table([], VECTORS)) == ([], set())


TEXTS = [
    (1, "a plain text, twice said"), (2, "a plain text, twice said"), (2, "a plain text, twice said"),
    (3, None), (4, ""), (None, "no id"), (5, "ends <|endoftext|> early"), (6, "Größe 漢字  　 x\n\n  y"),
    (7, "word " * 300_000 + "x" * 70_000), (8, "A PLAIN TEXT, TWICE SAID"), (9, "a  plain\ttext, twice said"),
]


def library_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(own.encode(t)) for t in texts]
    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    return [len(own.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(table, tmp_path, name):
    rows = [(i, t if not t or len(t) < 10_000 or name.startswith("byte") else t[:10_000]) for i, t in TEXTS]
    docs = table(rows, "doc_id bigint, text string").withColumns({"digest": F.lit(1), "n_tokens": F.lit(0)})
    found = token_counts.token_counts(docs, public_tokenizers.path(name), str(tmp_path / "cache"))
    texts = [t or "" for _, t in rows]
    want = [(i, len(t.encode()), n) for (i, _), t, n in zip(rows, texts, library_counts(name, texts))]
    assert sorted(found.collect(), key=repr) == sorted(want, key=repr)


def test_the_cache_is_read_filled_once_and_kept_apart_by_version(spark, table, tmp_path, monkeypatch):
    cache, path = str(tmp_path / "cache"), public_tokenizers.path("byte_bpe_50k.json")
    docs = table([(1, "one"), (2, "one"), (3, "two words")], "doc_id bigint, text string")
    first = sorted(token_counts.token_counts(docs, path, cache).collect())
    version = token_counts.Tokenizer(spark, path).version
    assert token_counts.stored(spark, cache, version).count() == 2
    stored = spark.read.parquet(f"{cache}/version={version}")
    assert stored.count() == 2
    more = docs.unionByName(table([(4, "three"), (5, "three")], "doc_id bigint, text string"))
    again = sorted(token_counts.token_counts(more, path, cache).collect())
    assert again[:3] == first and spark.read.parquet(f"{cache}/version={version}").count() == 3
    # A stored count is believed: that is how one sees that it was not encoded again.
    marked = token_counts.content_digests(
        table([(1, "known text")], "doc_id bigint, text string"), token_counts.Tokenizer(spark, path), F.col("text")
    ).select("digest", F.lit(77).cast("long").alias("n_tokens"))
    marked.write.mode("append").parquet(f"{cache}/version={version}")
    marked.write.mode("append").parquet(f"{cache}/version={version}")
    known = table([(1, "known text"), (2, "new text")], "doc_id bigint, text string")
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(known, path, cache).collect()) == [2, 77]
    other = public_tokenizers.path("word_bpe_49k.json")
    assert sorted(r["n_tokens"] for r in token_counts.token_counts(known, other, cache).collect())[-1] < 77


def test_texts_that_the_tokenizer_normalises_alike_share_a_digest(spark, table):
    own = token_counts.Tokenizer(spark, public_tokenizers.path("word_bpe_49k.json"))
    texts = ["A  b", "a b", "a\nB", "c <|ENDOFTEXT|>", "c <|endoftext|>"]
    rows = table([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    keyed = token_counts.content_digests(rows, own, F.col("text"), F.col("doc_id")).orderBy("doc_id").collect()
    assert [len({r["digest"] for r in keyed[a:b]}) for a, b in ((0, 3), (3, 5), (2, 4))] == [1, 2, 2]


def test_counts_of_no_documents(table, tmp_path):
    docs = table([], "doc_id bigint, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counts(docs, path, str(tmp_path / "c")).collect() == []
