"""Which filters overlap: truth-table survival words and their positional popcounts.

With up to five filters there are 32 subsets of them, one per bit of a 32-bit word. A document's
word has a bit for every subset that it survives, that is, of which it fails no filter. The number of
documents that survive each subset is then the number of words with that bit: the positional popcount
of the words, kept by carry-save adders, which hold at most two words of each power of two however
many words they have seen. From the survivors of all subsets follow, without another look at
the documents, every order's kept and removed documents, overlaps, unique failures and Shapley sums.

Tasks send one row of counts per part and label, so a part with a third of all documents is
merely one more row of each task. Cases: a null failure counts as passed; a null part is the empty
string; a null label is none; repeated rows count as often as they occur; a table without rows gives
no rows; columns that are not named don't matter, whatever they are called.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.stage import literal
from lexweave.llm.support import looked_up, text_key, written

#: Groups of a task whose adders are kept at once; beyond, their counts are handed on.
GROUPS = 1 << 12
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that go on with a code point.
FOLLOWING = bytes(range(0x80, 0xC0))
SIGNS = re.compile(rb"[#$%&*|]")


def survival_words(filters: int) -> np.ndarray:
    """The survival word of every set of failed filters, both as bits of a number."""
    subsets = np.arange(1 << filters)
    survives = (subsets[:, None] & subsets) == 0
    return (survives.astype("u8") << subsets.astype("u8")).sum(1).astype("u4")


class PositionalCounts:
    """How many of the words seen have each bit, by carry-save adders.

    Three words of one weight become their sum without carries, of the same weight, and the carries,
    of twice the weight; this goes on for whole arrays until at most two words of a weight are left.
    """

    def __init__(self):
        self.held: list[np.ndarray] = []

    def add(self, words: np.ndarray) -> None:
        for weight in itertools.count():
            if weight == len(self.held):
                self.held.append(np.empty(0, "u4"))
            words = np.concatenate([self.held[weight], words])
            carries = []
            while third := len(words) // 3:
                a, b, c = words[: 3 * third].reshape(3, third)
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                words = np.concatenate([odd ^ c, words[3 * third :]])
            self.held[weight] = words
            if not carries:
                return
            words = np.concatenate(carries)

    def counts(self) -> np.ndarray:
        total = np.zeros(32, "i8")
        for weight, words in enumerate(self.held):
            bits = words[:, None] >> np.arange(32, dtype="u4") & np.uint32(1)
            total += bits.sum(0, dtype="i8") << weight
        return total


def survivors(
    df: DataFrame, failures: list[Column], part: Column, labels: dict[str, Column] | None = None
) -> DataFrame:
    """Per part: ``part``, and per label and in ``all`` the survivors of each subset of filters.

    The arrays have one count per subset, whose number has bit ``i`` set if it holds the filter of
    ``failures[i]``.
    """
    labels = labels or {}
    if not 1 <= len(failures) <= 5 or "all" in labels or "part" in labels:
        raise ValueError("one to five filters, and labels not called all or part")

    def bits(columns: list[Column]) -> Column:
        set_bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(columns)]
        return sum(set_bits, F.lit(0)).cast("int")

    rows = df.select(
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        bits([*labels.values()]).alias("label"),
        bits(failures).alias("failed"),
    )
    words = survival_words(len(failures))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, int], PositionalCounts] = {}

        def handed_on() -> pa.RecordBatch:
            names, marks = zip(*groups) if groups else ((), ())
            found = [g.counts() for g in groups.values()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array(marks, pa.int32()),
                    pa.array([f.tolist() for f in found], pa.list_(pa.int64())),
                ],
                ["part", "label", "counts"],
            )

        for batch in batches:
            parts = batch.column("part").dictionary_encode()
            group = parts.indices.to_numpy().astype("i8") << 32 | batch.column("label").to_numpy()
            order = np.argsort(group, kind="stable")
            own, starts = np.unique(group[order], return_index=True)
            word = words[batch.column("failed").to_numpy()[order]]
            for name, found in zip(own.tolist(), np.split(word, starts[1:])):
                key = parts.dictionary[name >> 32].as_py(), name & 0xFFFFFFFF
                groups.setdefault(key, PositionalCounts()).add(found)
            if len(groups) > GROUPS:
                yield handed_on()
                groups.clear()
        yield handed_on()

    counted = rows.mapInArrow(tally, "part string, label int, counts array<bigint>")
    size = 1 << len(failures)

    def total(name: str, bit: int | None) -> Column:
        def one(i: int) -> Column:
            count = F.col("counts")[i]
            return F.sum(count if bit is None else F.when(F.col("label").bitwiseAND(1 << bit) > 0, count).otherwise(0))

        return F.array(*[one(i) for i in range(size)]).alias(name)

    totals = [total("all", None), *[total(name, i) for i, name in enumerate(labels)]]
    return counted.groupBy("part").agg(*totals)


def orders(counts: DataFrame, names: str, labels: dict[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters and step, from :func:`survivors`.

    ``names`` has a letter per filter; ``labels`` names the columns of documents lost per label.
    """
    k = len(names)
    full = (1 << k) - 1
    steps = []
    for order in itertools.permutations(range(k)):
        before = 0
        for step, at in enumerate(order, 1):
            after = before | 1 << at
            steps.append(
                {"o": "".join(names[i] for i in order), "s": step, "f": at, "b": before, "a": after}
            )
            before = after
    kept = F.col("all")

    def removed_in_all_orders(at: int) -> Column:
        """Orders that put exactly the filters of a subset first, times what the filter then removes."""
        terms = []
        for subset in range(full + 1):
            if not subset >> at & 1:
                n = subset.bit_count()
                weight = math.factorial(n) * math.factorial(k - 1 - n)
                terms.append(weight * (kept[subset] - kept[subset | 1 << at]))
        return sum(terms[1:], terms[0])

    prepared = counts.withColumn("sums", F.array(*[removed_in_all_orders(i) for i in range(k)]))
    table = literal(steps, "array<struct<o: string, s: int, f: int, b: int, a: int>>")
    rows = prepared.select("*", F.explode(table).alias("at"))
    before, after, own = F.col("at.b"), F.col("at.a"), F.col("at.f")
    alone = F.lit(1) * F.pow(F.lit(2), own).cast("int")
    removed = kept[before] - kept[after]
    lost = [
        (F.col(label)[before] - F.col(label)[after]).alias(name)
        for label, name in (labels or {}).items()
    ]
    return rows.select(
        "part",
        F.col("at.o").alias("filter_order"),
        F.col("at.s").alias("step"),
        kept[after].alias("kept"),
        removed.alias("removed"),
        (kept[F.lit(0)] - kept[alone] - removed).alias("redundant"),
        (kept[F.lit(full) - alone] - kept[F.lit(full)]).alias("unique_fails"),
        *lost,
        F.col("sums")[own].alias("shapley"),
    )


def _text_rules(text: bytes) -> int:
    """The failed rules of a text as bits: short, repetitive, capitals, signs.

    Splitting bytes cuts exactly at the space and at tab to carriage return.
    """
    words = text.split()
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, FOLLOWING))
    return (
        (len(words) < 200)
        | (100 * len(set(words)) < 50 * len(words)) << 1
        | (100 * capitals > 2 * points) << 2
        | (SIGNS.search(text) is not None) << 3
    )


def text_failures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, A to E) per document: under 200 words; less than half of the words distinct; more than
    a fiftieth of the characters capitals; any of the signs ``#$%&*|``; a copy of a text with a
    smaller id. A null id is no copy and makes none."""
    rows = docs.select(
        F.col(doc_id).alias("id"),
        F.col(part).alias("part"),
        text_key(F.col(text)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    kind = f"id {rows.schema['id'].dataType.simpleString()}, part {rows.schema['part'].dataType.simpleString()}, key binary, rules int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            rules = pa.array([_text_rules(t.as_py()) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), batch.column("key"), rules],
                ["id", "part", "key", "rules"],
            )

    judged = written(rows.mapInArrow(judge, kind))
    first = judged.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    copied = looked_up(judged, first.where("n > 1").select("key", "first"), "key")
    rule = [F.col("rules").bitwiseAND(1 << i) > 0 for i in range(4)]
    failed = [*rule, F.coalesce(F.col("id") > F.col("first"), F.lit(False))]
    return copied.select("id", "part", *[f.alias(n) for f, n in zip(failed, "ABCDE")])


def audit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """Every order of the five text rules, per part, with the good and toxic documents it loses.

    A document that several rows of ``labels`` name is good (toxic) if one of them says so.
    """
    marked = labels.where("quality = 1 or toxic = 1").groupBy(F.col("doc_id").alias("id"))
    marks = marked.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
    )
    failures = written(text_failures(docs, doc_id, text, part))
    rows = looked_up(failures, marks, "id")
    found = survivors(
        rows,
        [F.col(n) for n in "ABCDE"],
        F.col("part"),
        {"good": F.col("good"), "toxic": F.col("toxic")},
    )
    return orders(found, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})
