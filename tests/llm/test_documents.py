"""Line dedup, near duplicates, repeats and outliers against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import bag_minhash, line_templates, robust_outliers, suffix_repeats
from lexweave.llm.support import components

from .conftest import DOCS, documents

VOCABULARY = [f"w{c}{d}" for c in "abcdefghijklmnopqrstuvwxyz" for d in "xyzuv"]


def prose(n, rng):
    return " ".join(rng.choices(VOCABULARY, k=n))


def edited(text, n, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = "edit" + str(rng.random())
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    texts = [None, "", "one", "one two", " \n ", "a " * 3000]
    for _ in range(6):
        base = prose(rng.randint(60, 300), rng)
        texts += [base, base] + [edited(base, k, rng) for k in (1, 1, 2, 4, 8)]
    passage = prose(60, rng)
    texts += [prose(40, rng) + " " + passage + " " + prose(40, rng) for _ in range(30)]
    texts += [prose(80, rng) for _ in range(40)]
    return texts


def runs(text):
    words = (text or "").lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def test_classes_are_those_of_all_pairs(table, corpus):
    root = list(range(len(corpus)))
    bags = [runs(t) for t in corpus]
    for i in range(len(corpus)):
        for j in range(i):
            union = sum((bags[i] | bags[j]).values())
            alike = union and sum((bags[i] & bags[j]).values()) / union >= 0.8
            if alike or (corpus[i] or "") == (corpus[j] or ""):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = table([(*r, "x", 1) for r in documents(corpus)], DOCS + ", key string, class int")
    got = {r.doc_id: r for r in bag_minhash.duplicate_classes(df).collect()}
    assert [got[i].class_id for i in range(len(corpus))] == root
    sizes = Counter(root)
    assert all(got[i].class_size == sizes[root[i]] for i in range(len(corpus)))
    kept = bag_minhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(root[i] for i in ids) == sorted(sizes)


def test_registers_agree_as_often_as_multisets_overlap():
    hashes = bag_minhash.WordHashes()
    words = " ".join(f"p q r s t u{i % 7} v{i}" for i in range(60))
    a, b = (bag_minhash.runs_of(t, hashes) for t in (words, words[: len(words) * 3 // 4] + " p q" * 40))
    found = bag_minhash.signatures([a, b], registers=4000)
    assert abs((found[0] == found[1]).mean() - bag_minhash.overlap(a, b)) < 0.04
    weights = np.array([7] * 300 + [9] * 20, "u8"), np.array([7] * 100 + [9] * 60, "u8")
    found = bag_minhash.signatures(list(weights), registers=4000)
    assert abs((found[0] == found[1]).mean() - 120 / 360) < 0.04


def test_components_of_paths_stars_and_loops(table):
    pairs = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(5, 5), (131, 130)]
    got = components(table(pairs, "a int, b int")).collect()
    assert {r.node: r.root for r in got} == {
        **{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}, 130: 130, 131: 130,
    }
    assert components(table([], "a int, b int")).count() == 0


def test_spans_are_those_of_all_windows(table, corpus):
    owners = defaultdict(set)
    for text in corpus:
        words = (text or "").split()
        for i in range(len(words) - 49):
            owners[tuple(words[i : i + 50])].add(text)
    copies = Counter(corpus)
    df = table(documents(corpus), DOCS)
    got = {r.doc_id: r for r in suffix_repeats.repeats(df).collect()}
    for i, text in enumerate(corpus):
        words, want = (text or "").split(), set()
        for at in range(len(words) - 49):
            if len(owners[tuple(words[at : at + 50])]) > 1 or copies[text] > 1:
                want.update(range(at, at + 50))
        own = {w for s in got[i].spans for w in range(s.start, s.stop)} if i in got else set()
        assert own == want, i
        assert not want or got[i].repeated_words == len(want)
    assert suffix_repeats.repeats(df.where("false")).count() == 0


@pytest.mark.parametrize("space", ["\xa0", "\u3000", "\x85", " \n\t "])
def test_copies_are_found_with_white_space_of_any_kind(table, space):
    rng = random.Random(12)
    text = space + space.join(prose(60, rng).split()) + space
    short = space.join(prose(49, rng).split())
    df = table([(*r, b"x", 0) for r in documents([text, text, short, short, "a" * 200, "a" * 200])],
               DOCS + ", key binary, stop int")
    got = {r.doc_id: r for r in suffix_repeats.repeats(df).collect()}
    assert sorted(got) == [0, 1] and all(r.repeated_words == 60 for r in got.values())
    assert [(s.start, s.stop) for s in got[0].spans] == [(0, 60)]


def test_recurring_templates_go(table):
    rng = random.Random(9)
    texts = []
    for i in range(40):
        lines = [prose(12, rng) for _ in range(4)] + [prose(30, rng)]
        lines.insert(rng.randint(0, 5), f"Posted on day {i} by {rng.choice(VOCABULARY)} in this list of all news")
        lines.insert(rng.randint(0, 6), "All rights are reserved here")
        texts.append("\n".join([*lines, ""]))
    copied = "\n".join(prose(15, rng) for _ in range(6))
    near = [copied.replace("\n", f"\nnew{i} ", 1) for i in range(30)]
    texts += near + [copied] * 20 + [None, "", "\n\n", "All rights are reserved here"]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    df = table(rows, "doc_id bigint, text string, line_key int")
    out = {r.doc_id: r for r in line_templates.drop_recurring_lines(df).collect()}
    assert len(out) == len(texts) and out[3].line_key == 3
    for i, text in enumerate(texts):
        if i < 40:
            want = [x for x in text.split("\n") if not x.startswith(("Posted on", "All rights"))]
            assert out[i].text == "\n".join(want)
        else:
            assert out[i].text == ("" if i == len(texts) - 1 else text)
    report = line_templates.line_report(df).collect()
    assert {r.doc_id: r.n_dropped for r in report}[0] == 2
    assert line_templates.drop_recurring_lines(df.where("false")).count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered, seen, again = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, again, len(covered)


def test_base_statistics(table, corpus):
    texts = [*corpus, "é\xa0é\x0bx\ty \x1c z\n\nl\nl\n \nl", "a b c d e f g h " * 5, "x " * 7 + "x"]
    out = robust_outliers.text_statistics(table(documents(texts), DOCS)).collect()
    assert len(out) == len(texts)
    for r in out:
        n, chars, symbols, again, repeated = base(texts[r.doc_id])
        got = r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words
        assert got == (n, chars, symbols, again, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)


def test_outliers_are_those_of_the_exact_estimate(table):
    rng = random.Random(2)
    texts = [prose(rng.randint(40, 200), rng) for _ in range(300)]
    texts += [" | ".join(prose(60, rng).split()) for _ in range(20)]
    texts += [prose(60, rng).replace(" ", "&&& ") for _ in range(15)]
    rows = [(i, t, "en", "a" if i % 3 else None, 0) for i, t in enumerate(texts)]
    rows += [(900 + i, t, None, f"rare{i}", 0) for i, t in enumerate([None, "", *texts[:9]])]
    out = robust_outliers.with_verdicts(table(rows, DOCS)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    clean = [by_id[i].kept for i in range(300)]
    assert sum(clean) >= 297
    assert not any(by_id[i].kept for i in range(300, 335))
    assert not by_id[900].kept and not by_id[901].kept and by_id[902].kept
    # The same distances from whole arrays: the nearest three quarters, concentrated.
    p = robust_outliers.P
    own = [r for r in out if r.source == "a" and not r.base_failed]

    def vector(r):
        n = r.n_words
        values = [np.log(r.word_chars / n), np.sqrt(r.n_symbols / r.word_chars),
                  np.sqrt(r.n_dup_lines / n), np.sqrt(r.n_repeat_words / n), np.log(n)]
        return np.round(np.array(values), 3)

    x = np.array([vector(r) for r in own])
    floor = np.diag(np.square(robust_outliers.FLOORS))
    inverse, centre = np.linalg.inv(floor), np.median(x, axis=0)

    def distances():
        return np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)

    for step in range(robust_outliers.STEPS + 1):
        d = distances()
        last = step == robust_outliers.STEPS
        near = d <= (robust_outliers.chi2_quantile(0.975, p) if last else np.quantile(d, 0.75))
        share = 0.975 if last else 0.75
        centre = x[near].mean(0)
        inverse = np.linalg.inv(
            robust_outliers.consistency(share) * np.cov(x[near].T, bias=True) + floor
        )
    limit = robust_outliers.chi2_quantile(0.9999, p)
    assert [bool(a) for a in distances() <= limit] == [r.kept for r in own]


def test_quantiles_of_chi_square():
    # Tabulated values.
    assert abs(robust_outliers.chi2_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(robust_outliers.chi2_quantile(0.975, 5) - 12.8325) < 1e-3
    assert abs(robust_outliers.chi2_cdf(14.0671, 7) - 0.95) < 1e-4


def test_empty_tables(table):
    df = table([], DOCS)
    assert robust_outliers.with_verdicts(df).count() == 0
    assert bag_minhash.duplicate_classes(df).count() == 0
    assert bag_minhash.keep_one_of_each(df).count() == 0


def test_repeated_rows_and_null_ids(table):
    text = " ".join(VOCABULARY[:60])
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (3, None, None, None, None)]
    df = table(rows, DOCS)
    assert bag_minhash.duplicate_classes(df).count() == 3
    assert bag_minhash.keep_one_of_each(df).count() == 2
    assert suffix_repeats.repeats(df).count() == 2
    assert robust_outliers.with_verdicts(df).count() == 3


def test_a_large_bucket_is_compared_completely(table, monkeypatch):
    rng = random.Random(21)
    sign = bag_minhash._sign

    def one_bucket(batches):
        for batch in sign(batches):
            at = batch.schema.get_field_index("bands")
            bands = pa.array([[7] * bag_minhash.BANDS] * batch.num_rows, pa.list_(pa.int64()))
            yield batch.set_column(at, batch.schema.field(at), bands)

    monkeypatch.setattr(bag_minhash, "_sign", one_bucket)
    texts = sorted((prose(80, rng) for _ in range(11)), key=lambda t: hashlib.md5(t.encode()).digest())
    # All meet equally many, so the greatest digests are central: the last two, which link to nobody.
    while True:
        copy = edited(texts[0], 1, rng)
        if hashlib.md5(copy.encode()).digest() < hashlib.md5(texts[-2].encode()).digest():
            break
    got = bag_minhash.duplicate_classes(table(documents([*texts, copy]), DOCS)).collect()
    assert {r.doc_id: r.class_id for r in got} == {**{i: i for i in range(11)}, 11: 0}


def test_parity_bits_differ_in_at_most_the_runs_that_differ():
    rng = random.Random(22)
    hashes = bag_minhash.WordHashes()
    for n in (5, 60, 400):
        text = prose(n, rng)
        a, b = (bag_minhash.runs_of(t, hashes) for t in (text, edited(text, n // 10 + 1, rng)))
        odd = (bag_minhash.parity_bits(a) ^ bag_minhash.parity_bits(b)).view("u1")
        bits = int(np.unpackbits(odd).sum())
        values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts = [np.bincount(x, minlength=len(values)) for x in (at[: len(a)], at[len(a) :])]
        assert 0 < bits <= np.abs(counts[0] - counts[1]).sum()


def test_frequent_runs_hide_no_partner(table):
    rng = random.Random(31)
    stock = prose(12, rng)
    start, end = prose(60, rng), prose(60, rng)

    def around(before, after):
        """The stock run with so many words of the passage on either side."""
        left = (prose(60, rng) + " " + " ".join(start.split()[60 - before :])).split()[-60:]
        right = (" ".join(end.split()[:after]) + " " + prose(60, rng)).split()[:60]
        return " ".join(left + stock.split() + right)

    pair = [around(25, 20), around(25, 20)]
    crowd = [around(2, 30) for _ in range(12)] + [around(34, 2) for _ in range(12)]
    inside = prose(50, rng)
    texts = [*pair, *crowd, " ".join(f"{inside} {prose(5, rng)}" for _ in range(12)), prose(9, rng) + " " + inside]
    got = {r.doc_id: r for r in suffix_repeats.repeats(table(documents(texts), DOCS)).collect()}
    owners = defaultdict(set)
    for i, text in enumerate(texts):
        for at in range(len(text.split()) - 49):
            owners[tuple(text.split()[at : at + 50])].add(i)
    for i, text in enumerate(texts):
        words = text.split()
        want = set()
        for at in range(len(words) - 49):
            if len(owners[tuple(words[at : at + 50])]) > 1:
                want.update(range(at, at + 50))
        own = {w for s in got[i].spans for w in range(s.start, s.stop)} if i in got else set()
        assert own == want, i
    assert got[0].repeated_words == 57 and got[26].repeated_words == 600
