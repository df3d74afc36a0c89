"""Vector codes by equal-average search: whole-number vectors, a codebook per part of the vector.

Components are scaled and rounded down to whole numbers, so every sum and distance is exact and does
not depend on how rows are dealt to tasks. By Cauchy and Schwarz the squared difference of two
component sums, over the dimension, is at most the squared distance. Entries are therefore sorted by
sum, and a search starts at the part's own sum and goes outward, both ways, until that bound strictly
exceeds the best distance found; ties still count there and take the lower index. Many parts
that start at the same place are compared with a few neighbouring entries at a time.

Only codebooks and their sums, whose sizes are set by the parameters, meet on the driver; every round
is one pass over the rows with one row per part and entry from each task.

Cases: a vector that is null, or holds a null or a component that is not finite, is dropped, as is one
whose length is not that of the first vector, by id, whose length the number of parts divides. Ids may repeat or be
null; equal ids enter the first codebook in the order of their vectors, nulls last. With fewer rows than entries
the codebook is smaller. A table without vectors gives no rows. Components too large for exact
64-bit distances raise an error. Other columns don't matter, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.support import looked_up, written

#: Entries with neighbouring sums that are compared at a time.
BLOCK = 8


class Searcher:
    """The nearest entry of one codebook for many parts at a time."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.size = entries, entries.shape[1]
        sums = entries.sum(1)
        order = np.argsort(sums, kind="stable")
        self.first_sums = sums[order]
        # Within a block the order is by index, so the least of equal distances is found first.
        self.blocks = [np.sort(order[i : i + BLOCK]) for i in range(0, len(order), BLOCK)]
        self.low = np.array([sums[b].min() for b in self.blocks])
        self.high = np.array([sums[b].max() for b in self.blocks])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of every row of ``parts``."""
        widest = max(int(np.abs(parts).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        bound = 4 * self.size * widest**2 * max(1, self.size)
        if bound >= 2**63:
            raise ValueError("components are too large for exact distances")
        # Products of whole numbers are exact in either kind; the first one multiplies faster.
        kind = "f8" if bound < 2**53 else "i8"
        entries, parts = self.entries.astype(kind), parts.astype(kind)
        lengths = (entries * entries).sum(1)
        sums, own = parts.sum(1), (parts * parts).sum(1)
        best, index = np.full(len(parts), np.iinfo("i8").max, kind), np.zeros(len(parts), "i8")

        def compare(rows: np.ndarray, block: int) -> None:
            members = self.blocks[block]
            distance = lengths[members] - 2 * (parts[rows] @ entries[members].T)
            at = distance.argmin(1)
            found = distance[np.arange(len(rows)), at] + own[rows]
            which = members[at]
            better = (found < best[rows]) | ((found == best[rows]) & (which < index[rows]))
            best[rows[better]], index[rows[better]] = found[better], which[better]

        def within(rows: np.ndarray, gap: np.ndarray) -> np.ndarray:
            """Rows whose bound does not exceed what they have: gap squared over the dimension."""
            return rows[gap * gap <= self.size * best[rows]]

        start = np.minimum(np.searchsorted(self.first_sums, sums), len(entries) - 1) // BLOCK
        order = np.argsort(start, kind="stable")
        places, cuts = np.unique(start[order], return_index=True)
        for place, rows in zip(places.tolist(), np.split(order, cuts[1:])):
            compare(rows, place)
            up, down, above, below = place + 1, place - 1, rows, rows
            while len(above) or len(below):
                above = above if up < len(self.blocks) else above[:0]
                if len(above):
                    above = within(above, np.maximum(self.low[up] - sums[above], 0))
                if len(above):
                    compare(above, up)
                below = below if down >= 0 else below[:0]
                if len(below):
                    below = within(below, np.maximum(sums[below] - self.high[down], 0))
                if len(below):
                    compare(below, down)
                up, down = up + 1, down - 1
        return index, best.astype("i8")


def whole_vectors(df: DataFrame, vec_id: str, vector: str, label: str, parts: int) -> tuple[DataFrame, int]:
    """(id, label, vector) of the rows that are kept, and the length of their vectors."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(vector).isNotNull()).where(finite)
    rows = rows.select(
        F.col(vec_id).alias("id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )
    fit = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = fit.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    size = first[0] if first else 0
    return rows.where(F.size("vector") == size), size


def _numbers(batch: pa.RecordBatch, size: int, scale: int) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    numbers = np.floor(flat * scale)
    if np.abs(numbers).max(initial=0) >= 2**31:
        raise ValueError("components are too large for exact distances")
    return numbers.astype("i8").reshape(-1, size)


def _split(numbers: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(numbers, parts, 1)


def train(rows: DataFrame, size: int, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> np.ndarray:
    """The codebooks as (part, entry, component), from the rows of :func:`whole_vectors`."""
    firsts = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector")
    batches = firsts.toArrow().combine_chunks().to_batches()
    books = np.stack(_split(np.concatenate([_numbers(b, size, scale) for b in batches]), parts))
    width = size // parts
    names = [f"s{i}" for i in range(width)]
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)

        def summed(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            books = shared.value
            searchers = [Searcher(b) for b in books]
            sums, counts = np.zeros(books.shape, "i8"), np.zeros(books.shape[:2], "i8")
            for batch in batches:
                for p, own in enumerate(_split(_numbers(batch, size, scale), parts)):
                    index, _ = searchers[p].nearest(own)
                    np.add.at(sums[p], index, own)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
            part, entry = np.nonzero(counts)
            found = [part, entry, counts[part, entry], *sums[part, entry].T]
            yield pa.RecordBatch.from_arrays(
                [pa.array(f, pa.int64()) for f in found], ["part", "entry", "n", *names]
            )

        kind = ", ".join(f"{n} bigint" for n in ["part", "entry", "n", *names])
        totals = rows.select("vector").mapInArrow(summed, kind).groupBy("part", "entry")
        table = totals.agg(*[F.sum(n).alias(n) for n in ["n", *names]]).toArrow()
        part, entry, n = (table[c].to_numpy() for c in ("part", "entry", "n"))
        means = np.stack([table[c].to_numpy() // n for c in names], 1) if len(n) else books[:0, 0]
        books = books.copy()
        books[part, entry] = means
        shared.unpersist()
    return books


def encode(rows: DataFrame, books: np.ndarray, scale: int = 1024) -> DataFrame:
    """(id, label, codes, error): entry indices in the order of the parts, and the squared distance."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.shape
    label = rows.schema["label"].dataType.simpleString()
    kind = f"id {rows.schema['id'].dataType.simpleString()}, label {label}, codes array<int>, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [Searcher(b) for b in shared.value]
        for batch in batches:
            own = _split(_numbers(batch, parts * width, scale), parts)
            index, distance = zip(*[s.nearest(o) for s, o in zip(searchers, own)])
            codes = np.stack(index, 1).astype("i4")
            offsets = np.arange(0, codes.size + 1, parts, "i4")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.reshape(-1))),
                    pa.array(np.sum(distance, 0), pa.int64()),
                ],
                ["id", "label", "codes", "error"],
            )

    return rows.mapInArrow(run, kind)


def digest(books: np.ndarray) -> str:
    """Names the codebooks: all components as decimals, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compressed(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
) -> DataFrame:
    """(id, codes, error, label_error, codebooks): codes of all kept vectors, with their codebooks' digest."""
    rows, size = whole_vectors(df, vec_id, vector, label, parts)
    if not size:
        empty = rows.select("id", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return empty.limit(0).select("*", F.col("error").alias("label_error"), F.lit("").alias("codebooks"))
    books = train(rows, size, parts, entries, rounds, scale)
    group = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    coded = written(encode(rows, books, scale).select("id", "codes", "error", group.alias("group")))
    sums = coded.groupBy("group").agg(F.sum("error").alias("label_error"))
    found = looked_up(coded, sums, "group")
    return found.select("id", "codes", "error", "label_error", F.lit(digest(books)).alias("codebooks"))
