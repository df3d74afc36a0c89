"""Benchmark decontamination: rare seeds of five words, then Smith-Waterman alignment of words.

Words are lower-cased, without signs, and without tokens that have only signs. A fixed-size bitmap
of the items' seeds (8 MB, whatever the benchmark's size) lets tasks skip the seeds that no item
has; what is left joins the items' seeds exactly. Around the seeds of a text a passage is cut that
reaches as far to both sides as the longest item. Texts are counted by seed before items join. A seed
is rare for an item if it occurs in at most ten times as many texts as the median one of that item;
every text with a rare seed of an item is a candidate. A frequent seed, such as a stock phrase inside
an item, makes a candidate only with one of the item's least frequent words near it: if e of n words
may fail to match, one of any e + 1 must be there, so no link is lost. Every candidate whose words can
reach the threshold is aligned: match 1, other word or gap -1. A text is contaminated by an item if the
best alignment matches at least 0.8 of the item's words.

Cases: null and empty texts and items, and items of fewer than five words, give no candidates.
Texts are worked on by content, so repeated rows and null ids share their result; an item_id may
repeat, with several texts, and is then reported with its best one. Ties take the later start. Passages
of any length are aligned in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.bag_minhash import mix
from lexweave.llm.support import fresh, text_key
from lexweave.session import cut_lineage

WORDS, SIMILARITY, COMMON = 5, 0.8, 10
BITS = 26
SCORE, MATCH = 1 << 40, 1 << 20
#: Words of a passage that are aligned at once, beside twice the item's.
PIECE = 1 << 18


class PlainWords(dict):
    """(hash, plain word) by token; a token without letters or digits has hash 0."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        plain = plain_word(token)
        made = self[token] = (xxhash.xxh3_64_intdigest(plain) | 1) if plain else 0
        return made


def plain_word(token: str) -> str:
    return token if token.isalnum() else "".join(c for c in token if c.isalnum())


def seeds_of(tokens: list[str], known: PlainWords) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of five words, and the places of the words among the tokens."""
    h = np.fromiter(map(known.__getitem__, tokens), "u8", len(tokens))
    places = np.nonzero(h)[0]
    h = h[places]
    n = max(0, len(h) - WORDS + 1)
    seed = np.full(n, WORDS, "u8")
    for i in range(WORDS):
        seed = seed * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(seed), places


def item_seeds(items: DataFrame) -> DataFrame:
    """(item, n, words, at, seed) per run of five words of every distinct item text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = PlainWords()
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                tokens = (text.as_py() or "").lower().split()
                seeds, places = seeds_of(tokens, known)
                n = len(seeds)
                if n:
                    words = " ".join(plain_word(tokens[i]) for i in places)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key.as_py()] * n, pa.binary()),
                            pa.array([len(places)] * n, pa.int32()),
                            pa.array([words] + [None] * (n - 1), pa.string()),
                            pa.array(np.arange(n, dtype="i4")),
                            pa.array(seeds.view("i8")),
                        ],
                        ["item", "n", "words", "at", "seed"],
                    )

    return items.mapInArrow(run, "item binary, n int, words string, at int, seed bigint")


def _bitmap(seeds: DataFrame) -> bytes:
    """One bit per value of the seeds' leading bits, put together by Spark as 64-bit words."""
    place = F.shiftrightunsigned("seed", 64 - BITS)
    words = (
        seeds.select(
            F.shiftrightunsigned(place, 6).alias("word"),
            F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - BITS}) & 63 as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    bitmap = np.zeros(1 << BITS - 6, "i8")
    bitmap[words["word"].to_numpy("i8")] = words["bits"].to_numpy("i8")
    return bitmap.tobytes()


def passages(texts: DataFrame, seeds: DataFrame, reach: int) -> DataFrame:
    """(key, start, words, hits): the parts of texts around tokens that may be seeds of items."""
    bitmap = texts.sparkSession.sparkContext.broadcast(_bitmap(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = PlainWords(), np.frombuffer(bitmap.value, "u8")
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                tokens = (text.as_py() or "").lower().split()
                seeds, places = seeds_of(tokens, known)
                place = seeds >> np.uint64(64 - BITS)
                hit = (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
                at = np.nonzero(hit)[0]
                if not len(at):
                    continue
                # Passages that would overlap are one.
                cuts = np.nonzero(np.diff(at) > 2 * reach)[0] + 1
                for part in np.split(at, cuts):
                    start = max(0, int(part[0]) - reach)
                    end = min(len(places), int(part[-1]) + WORDS + reach)
                    words = " ".join(plain_word(tokens[i]) for i in places[start:end])
                    hits = [
                        {"seed": s, "place": p}
                        for s, p in zip(seeds[part].view("i8").tolist(), (part - start).tolist())
                    ]
                    rows.append((key.as_py(), start, words, hits))
            if rows:
                keys, starts, words, hits = zip(*rows)
                kind = pa.list_(pa.struct([("seed", pa.int64()), ("place", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()),
                        pa.array(starts, pa.int32()),
                        pa.array(words, pa.string()),
                        pa.array(hits, kind),
                    ],
                    ["key", "start", "words", "hits"],
                )

    return texts.mapInArrow(
        run,
        "key binary, start int, words string, hits array<struct<seed: bigint, place: int>>",
    )


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Matched words, start and end in ``text`` of the best local alignment.

    An alignment above zero has fewer gaps than matches, so it spans less than twice the item's words
    and lies whole in one of the pieces, which overlap by as many.
    """
    best = (0, 0, 0, 0)
    for first in range(0, max(1, len(text)), PIECE):
        score, matched, start, end = _align_piece(text[first : first + PIECE + 2 * len(item)], item)
        best = max(best, (score, matched, first + start, first + end))
    return best[1:]


def _align_piece(text: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Score, matched words, start and end of the best local alignment.

    A cell holds score, matches and start in one number, so the three move together through the
    maxima and only one row is kept. Items so long that 64 bits can't hold it use Python's numbers.
    """
    kind = "i8" if len(text) + len(item) < MATCH else object
    columns = np.arange(len(text) + 1).astype(kind)
    row, slope, best, end = columns.copy(), columns * SCORE, 0, 0
    for word in item:
        step = np.where(text == word, SCORE + MATCH, -SCORE).astype(kind)
        new = np.maximum(row, columns)
        new[1:] = np.maximum(row[:-1] + step, np.maximum(row[1:] - SCORE, columns[1:]))
        row = np.maximum(np.maximum.accumulate(new + slope) - slope, columns)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best // SCORE, best % SCORE // MATCH, best % MATCH, end


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, rows = [], []
        columns = ("words", "item_words", "low", "high")
        for row, (words, item, low, high) in enumerate(
            zip(*(batch.column(c).to_pylist() for c in columns))
        ):
            ids: dict[str, int] = {}
            other = np.array([ids.setdefault(w, len(ids)) for w in item.split(" ")])
            slack = len(other) // 4 + WORDS
            first = max(0, low - slack)
            text = words.split(" ")[first : high + len(other) + slack]
            text = np.array([ids.get(w, -1) for w in text], "i8")
            there = np.bincount(text[text >= 0], minlength=len(ids))
            if np.minimum(there, np.bincount(other)).sum() / len(other) < SIMILARITY:
                continue
            matched, start, end = align(text, other)
            rows.append(row)
            found.append((matched / len(other), first + start, end - start))
        share, start, size = zip(*found) if found else ((), (), ())
        batch = batch.take(pa.array(rows, pa.int32()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("key"),
                batch.column("item"),
                batch.column("start"),
                pa.array(share, pa.float64()),
                pa.array(start, pa.int32()),
                pa.array(size, pa.int32()),
            ],
            ["key", "item", "start", "similarity", "place", "n_words"],
        )


def words_near(found: DataFrame, hits: DataFrame, span: int) -> DataFrame:
    """(key, start, seed, place, word): the different words up to ``span`` words from each hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, words, own in zip(*(c.to_pylist() for c in batch.columns)):
                words = words.split(" ")
                for hit in own:
                    at = hit["place"]
                    near = sorted(set(words[max(0, at - span) : at + span]))
                    n = len(near)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * n, pa.binary()),
                            pa.array([start] * n, pa.int32()),
                            pa.array([hit["seed"]] * n, pa.int64()),
                            pa.array([at] * n, pa.int32()),
                            pa.array(near, pa.string()),
                        ],
                        ["key", "start", "seed", "place", "word"],
                    )

    own = hits.groupBy("key", "start").agg(F.collect_list(F.struct("seed", "place")).alias("own"))
    passages_of = found.select("key", "start", "words").join(own, ["key", "start"])
    return passages_of.mapInArrow(run, "key binary, start int, seed bigint, place int, word string")


def frequent_hits(
    found: DataFrame, hits: DataFrame, frequent: DataFrame, words: DataFrame, span: int
) -> DataFrame:
    """(key, start, place, item, at) of frequent seeds that have one of the item's least frequent
    words near them, as many words as must hold one that matches.

    ``frequent`` has seed, item, n and at; ``words`` has item and item_words.
    """
    common = hits.join(frequent.select("seed").distinct(), "seed", "left_semi")
    near = cut_lineage(words_near(found, common, span))
    often = near.groupBy("word").agg(F.count("*").alias("times"))
    own = (
        frequent.select("item", "n")
        .distinct()
        .join(words, "item")
        .select("item", "n", F.explode(F.split("item_words", " ")).alias("word"))
        .groupBy("item", "n", "word")
        .agg(F.count("*").alias("places"))
        .join(often, "word", "left")
    )
    order = Window.partitionBy("item").orderBy(F.coalesce("times", F.lit(0)), "word")
    earlier = F.sum("places").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # The same rounding as the threshold's: matched / n >= SIMILARITY.
    may_fail = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9)
    telling = own.withColumn("earlier", F.coalesce(earlier, F.lit(0))).where(F.col("earlier") <= may_fail)
    keys = frequent.select("seed", "item").distinct().join(telling.select("item", "word"), "item")
    return (
        near.join(keys, ["seed", "word"])
        .select("key", "start", "place", "seed", "item")
        .distinct()
        .join(frequent.select("seed", "item", "at"), ["seed", "item"])
        .select("key", "start", "place", "item", "at")
    )


def contaminated_texts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item, similarity, start_word, n_words) of every text and item above the threshold.

    ``texts`` has key and text; ``items`` has item, the key of an item's text, and text.
    """
    seeds = cut_lineage(item_seeds(items.distinct()).distinct())
    reach = int(seeds.agg(F.max("n")).first()[0] or 0)
    found = cut_lineage(passages(texts, seeds, reach).distinct())
    hits = found.select("key", "start", F.explode("hits").alias("hit")).select(
        "key", "start", "hit.seed", "hit.place"
    )
    counted = hits.select("seed", "key").distinct().groupBy("seed").agg(F.count("*").alias("texts"))
    told = seeds.select("seed", "item", "n", "at").join(counted, "seed")
    usual = (
        told.select("seed", "item", "texts")
        .distinct()
        .groupBy("item")
        .agg((F.percentile_approx("texts", 0.5) * COMMON).alias("most"))
    )
    told = cut_lineage(told.join(usual, "item"))
    words = seeds.where("words is not null").select("item", F.col("words").alias("item_words"))
    rare = hits.join(told.where("texts <= most").select("seed", "item", "at"), "seed")
    second = frequent_hits(
        found, hits, told.where("texts > most").drop("texts", "most"), words, 2 * reach + 2 * WORDS
    )
    diagonal = F.col("place") - F.col("at")
    pairs = (
        rare.select("key", "start", "place", "item", "at")
        .unionByName(second)
        .groupBy("key", "start", "item")
        .agg(F.min(diagonal).alias("low"), F.max(diagonal).alias("high"))
    )
    ready = pairs.join(words, "item").join(found.select("key", "start", "words"), ["key", "start"])
    aligned = ready.select(
        "key", "item", "start", "low", "high", "words", "item_words"
    ).mapInArrow(
        _align,
        "key binary, item binary, start int, similarity double, place int, n_words int",
    )
    best = F.max(
        F.struct("similarity", (F.col("start") + F.col("place")).alias("start_word"), "n_words")
    ).alias("best")
    return (
        aligned.where(F.col("similarity") >= SIMILARITY)
        .groupBy("key", "item")
        .agg(best)
        .select("key", "item", "best.*")
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and benchmark item found in it: doc_id, item_id, similarity and place."""
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    items = benchmark.select("item_id", text_key(F.col("text")).alias("item"), "text")
    found = contaminated_texts(rows.select("key", "text"), items.select("item", "text"))
    best = F.max(F.struct("similarity", "start_word", "n_words")).alias("best")
    return (
        rows.select("doc_id", "key")
        .join(found, "key")
        .join(items.select("item_id", "item").distinct(), "item")
        .groupBy("doc_id", "key", "item_id")
        .agg(best)
        .select("doc_id", "item_id", "best.*")
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that a benchmark item leaked into."""
    items = benchmark.select(text_key(F.col("text")).alias("item"), "text")
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    key = fresh("text_key", docs.columns)
    gone = contaminated_texts(texts, items).select(F.col("key").alias(key)).distinct()
    keyed = docs.withColumn(key, text_key(F.col("text")))
    return keyed.join(gone, key, "left_anti").drop(key)
