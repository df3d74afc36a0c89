"""Near duplicates by BagMinHash signatures, bands, and verified multiset overlap.

A text is the multiset of its runs of five lower-cased words (a shorter text has one run). Each
run's count is cut at powers of two: [0,1), [1,2), [2,4), ... Every such block has a Poisson process
of its own, whose rate is the block's length; a point has a time, a register and a place in the
block, and counts for a text if the place lies below the run's count there. A register keeps its
earliest point. Two texts agree in a register with the probability of their weighted Jaccard
similarity, since blocks and points do not depend on the text, and a run that occurs w times costs
log w processes. Points later than every register's are never drawn.

Texts that agree in a band of five registers are candidates. Equal texts collapse beforehand, so
work is on distinct texts, named by a digest. Candidates are not paired out. First, a bucket's members
are compared with its most central text, the one that meets most others over all its buckets - for the
edited copies of one text that is the text itself. These links, in proportion to the members, join nearly
all that has many of them, and the classes they make are told exactly. Then all pairs of a bucket that still lie
in different classes are compared,
unless a bound rules them out: a text carries the parity of its runs' hashes in 2048
bits, the bits in which two texts differ are at most the runs in which they differ, and a similarity of
0.8 allows a ninth of all runs. A link needs a similarity of at least 0.8, and linked texts form classes,
so every pair of candidates is either compared, ruled out by the bound or in one class already. Members of
a large bucket are dealt to several tasks, and no table outlives the steps that read it.

Cases: null and empty texts are equal to each other and form a class; a text without words is like
its equals only; repeated rows and null ids are kept apart by content. Other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.support import Scratch, components, fresh, may_be_among, once_a_task, text_key, written

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
GROUP_CHARS = 1 << 19
#: 64-bit words of a text's parity bits.
PARITY = 32
#: Members of a bucket that one task holds against all of the bucket.
SHARE = 2048


class WordHashes(dict):
    """Hashes by word; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        made = self[word] = xxhash.xxh3_64_intdigest(word)
        return made


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The hash of every run of five words, in order."""
    words = (text or "").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = np.fromiter(map(hashes.__getitem__, words), "u8", len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    run = np.full(n, size, "u8")
    for i in range(size):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(run)


def signatures(texts: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash registers of several multisets; texts without runs get no finite register."""
    sizes = np.array([len(t) for t in texts])
    times = np.full((len(texts), registers), np.inf)
    if not sizes.sum():
        return times
    owner = np.repeat(np.arange(len(texts)), sizes)
    runs = np.concatenate(texts)
    # One number for a run in a text, to count the multiset of all texts with one sort.
    both = mix(runs + mix(owner.astype("u8") + np.uint64(1)))
    _, first, weight = np.unique(both, return_index=True, return_counts=True)
    runs, owner = runs[first], owner[first]
    # The blocks that each run's count reaches into.
    blocks = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))).astype(int) + 1, 1)
    at = np.repeat(np.arange(len(runs)), blocks)
    block = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.where(block > 0, low, 1)
    owner, room = owner[at], (weight[at] - low) / length
    state = mix(runs[at] + mix(block.astype("u8") + np.uint64(1 << 32)))
    clock, rate = np.zeros(len(at)), length.astype(float)
    flat = times.reshape(-1)
    while len(at):
        state = mix(state + np.uint64(0x9E3779B97F4A7C15))
        other = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
        clock = clock - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / 2.0**53) / rate
        register = ((other & np.uint64(0xFFFFFFFF)) % np.uint64(registers)).astype(int)
        place = (other >> np.uint64(32)).astype(float) / 2.0**32
        inside = place < room
        np.minimum.at(flat, owner[inside] * registers + register[inside], clock[inside])
        alive = clock < times.max(1)[owner]
        if not alive.all():
            state, clock, rate = state[alive], clock[alive], rate[alive]
            owner, room, at = owner[alive], room[alive], at[alive]
    return times


def band_hashes(times: np.ndarray) -> np.ndarray:
    """One number per band; the last bits of a time may differ between processors and are dropped."""
    bits = times.view("u8") >> np.uint64(12)
    out = np.zeros((len(times), BANDS), "u8")
    for i in range(ROWS):
        out = mix(out + bits[:, i::ROWS][:, :BANDS] + np.uint64(i + 1))
    return out.view("i8")


def parity_bits(runs: np.ndarray) -> np.ndarray:
    """One bit per value of the runs' top eleven bits: whether their number is odd."""
    odd = np.bincount((runs >> np.uint64(53)).astype(int), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype("u1"), bitorder="little").view("i8")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        seen, keys, runs, chars = set(), [], [], 0
        for key, text in zip(batch.column(0), batch.column(1)):
            key = key.as_py()
            if key not in seen:
                seen.add(key)
                text = text.as_py() or ""
                if len(run := runs_of(text, hashes)):
                    keys.append(key)
                    runs.append(run)
                    chars += len(text)
            if chars > GROUP_CHARS:
                yield _signed(keys, runs)
                keys, runs, chars = [], [], 0
        if keys:
            yield _signed(keys, runs)


def _signed(keys: list[bytes], runs: list[np.ndarray]) -> pa.RecordBatch:
    bands = band_hashes(signatures(runs))
    offsets = np.arange(0, bands.size + 1, BANDS, "i4")
    odd = np.concatenate([parity_bits(r) for r in runs])
    words = np.arange(0, odd.size + 1, PARITY, "i4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.binary()),
            pa.array([len(r) for r in runs], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1))),
            pa.ListArray.from_arrays(pa.array(words), pa.array(odd)),
        ],
        ["key", "n", "bands", "odd"],
    )


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left = np.bincount(at[: len(a)], minlength=len(values))
    right = np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(left, right).sum() / max(1, np.maximum(left, right).sum()))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, last, known = WordHashes(), None, None
    for batch in batches:
        keep = []
        for pivot, a, b in zip(*(batch.column(c) for c in ("b", "text_a", "text_b"))):
            if pivot.as_py() != last:  # rows of one pivot come together
                last, known = pivot.as_py(), runs_of(b.as_py(), hashes)
            keep.append(overlap(runs_of(a.as_py(), hashes), known))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b"), pa.array(keep, pa.float64())],
            ["a", "b", "similarity"],
        )


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The similarity of every pair; ``texts`` has one row per key."""
    left = pairs.join(texts.withColumnsRenamed({"key": "a", "text": "text_a"}), "a")
    both = left.join(texts.withColumnsRenamed({"key": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(
        _compare, "a binary, b binary, similarity double"
    )


def _both_ways(links: DataFrame) -> DataFrame:
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return links.select("a", "b").unionByName(turned)


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``class``: the least text that they are linked to in any number of links."""
    known = components(links.where(F.col("similarity") >= SIMILARITY).select("a", "b"))
    named = known.select(F.col("node").alias("key"), F.col("root").alias("class"))
    return members.join(named, "key", "left").withColumn("class", F.coalesce("class", "key"))


def _apart(rows: DataFrame, odd: DataFrame) -> DataFrame:
    """(a, b): members of a bucket in different classes that the bound does not rule out.

    ``a`` is outside the class of the bucket's central text. A large bucket's ``a`` are dealt to several tasks by
    their key, each with all ``b``.
    """
    ends = rows.groupBy("bucket").agg(
        F.min("class").alias("x"),
        F.max("class").alias("y"),
        F.max_by("class", F.struct("met", "key")).alias("main"),
        F.ceil(F.count("*") / SHARE).cast("int").alias("shares"),
    )
    mixed = rows.join(ends.where("x <> y").select("bucket", "main", "shares"), "bucket")
    left = mixed.where("class <> main").select(
        "bucket",
        F.pmod(F.xxhash64("key"), "shares").cast("int").alias("share"),
        F.col("key").alias("a"),
        F.col("class").alias("own"),
        F.col("n").alias("m"),
    )
    right = mixed.select(
        "bucket",
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.col("key").alias("b"),
        "class",
        "n",
    )
    left = left.join(odd.withColumnsRenamed({"key": "a", "odd": "odd_a"}), "a")
    right = right.join(odd.withColumnsRenamed({"key": "b"}), "b")
    differ = sum((F.bit_count(F.col("odd_a")[i].bitwiseXOR(F.col("odd")[i])) for i in range(PARITY)), F.lit(0))
    bound = _near("n", "m") & (9 * differ <= F.col("n") + F.col("m"))
    joined = left.hint("merge").join(right, ["bucket", "share"]).where((F.col("own") != F.col("class")) & bound)
    return joined.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _near(n: str, m: str):
    return F.least(n, m) >= SIMILARITY * F.greatest(n, m)


def similar_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, root): the class of every distinct text that has a link to another one."""
    scratch = Scratch(docs.sparkSession)
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = keyed.mapInArrow(_sign, "key binary, n bigint, bands array<bigint>, odd array<bigint>")
    signed = scratch.keep(signed.dropDuplicates(["key"]))
    band = F.posexplode("bands").alias("band", "value")
    spread = signed.select("key", "n", band).select("key", "n", F.xxhash64("band", "value").alias("bucket"))
    sizes = scratch.keep(spread.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    maybe = may_be_among(spread, F.col("bucket"), sizes.select("bucket"), "maybe").where("maybe")
    # At most one row per band meets in a text, so the lists are short.
    met = maybe.join(sizes, "bucket").groupBy("key", "n").agg(
        F.sum("members").alias("met"), F.collect_list("bucket").alias("buckets")
    )
    members = scratch.keep(met)
    buckets = members.select("key", "n", "met", F.explode("buckets").alias("bucket"))
    # The texts of all candidates, once.
    some = may_be_among(keyed, F.xxhash64("key"), members.select(F.xxhash64("key").alias("h")), "maybe")
    some = once_a_task(some.where("maybe").select("key", "text"), "key")
    texts = some.join(members.select("key"), "key", "left_semi").dropDuplicates(["key"])
    texts = scratch.keep(texts)

    first = buckets.groupBy("bucket").agg(F.max(F.struct("met", "key", "n")).alias("pivot"))
    with_pivot = buckets.join(first, "bucket").withColumn("m", F.col("pivot.n"))
    with_pivot = with_pivot.where((F.col("key") != F.col("pivot.key")) & _near("n", "m"))
    pairs = with_pivot.select(F.col("key").alias("a"), F.col("pivot.key").alias("b")).distinct()
    central = scratch.keep(_verified(pairs, texts))
    labelled = scratch.keep(_labelled(members, central))
    rows = labelled.select("key", "n", "met", "class", F.explode("buckets").alias("bucket"))
    pairs = _apart(rows, signed.select("key", "odd")).join(_both_ways(central), ["a", "b"], "left_anti")
    links = central.unionByName(_verified(pairs, texts))
    linked = written(links.where(F.col("similarity") >= SIMILARITY).select("a", "b"))
    scratch.clear()
    return components(linked).select(F.col("node").alias("key"), "root")


def duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, the least id of its class, and the class's number of documents."""
    roots = similar_texts(docs, doc_id, text)
    rows = docs.select(doc_id, text_key(F.col(text)).alias("key"))
    named = rows.join(roots, "key", "left").withColumn("class", F.coalesce("root", "key"))
    sizes = named.groupBy("class").agg(
        F.min(doc_id).alias("class_id"), F.count("*").alias("class_size")
    )
    return named.join(sizes, "class").select(doc_id, "class_id", "class_size")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class: a row with the least id of the class's root text."""
    taken = docs.columns
    key, rank = fresh("text_key", taken), fresh("text_rank", taken)
    roots = similar_texts(docs, doc_id, text)
    gone = roots.where("key <> root").select(F.col("key").alias(key))
    by_id = Window.partitionBy(key).orderBy(F.col(doc_id).asc_nulls_last())
    return (
        docs.withColumn(key, text_key(F.col(text)))
        .withColumn(rank, F.row_number().over(by_id))
        .where(F.col(rank) == 1)
        .join(gone, key, "left_anti")
        .drop(key, rank)
    )
