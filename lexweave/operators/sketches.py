"""Candidate pairs of long texts: bit sketches of token sets, compared within length bands.

A text's tokens set bits of a sketch whose width goes by the band, so a sketch is a small share of its
text. A bit that only one of two sketches has is a token that only one of the texts has, which bounds what
they can share; no pair that reaches the Jaccard floor is lost. Bands are cut into cells of a left and a right
chunk. A task holds the sketches of one right chunk and takes the left ones as a stream, so its memory does
not grow with the table; comparing costs nanoseconds a pair, and only sketches are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexweave.functions.stage import literal

# Texts of a chunk, at least and at most; between them cells are so large that each task has a few.
CHUNK = (256, 1 << 16)
CELLS_A_TASK = 4
# Bits of a sketch, at least and at most; between them one for every four characters.
WIDTHS = (64, 1 << 15)
# Tokens whose places a task remembers, and rows it hands on at a time.
REMEMBERED = 1 << 18
HELD = 1 << 12


def _band(length: float) -> Column:
    """Texts that reach the length floor are in the same band or in neighbouring ones."""
    chars = F.char_length("text").cast("double")
    return F.floor(F.log(chars) / -math.log(length - 1e-9)).cast("int")


def _width(band: int, length: float) -> int:
    chars = math.exp((band + 1) * -math.log(length - 1e-9))
    return min(max(1 << math.ceil(math.log2(max(chars / 4, 1))), WIDTHS[0]), WIDTHS[1])


def _cells(left: DataFrame, right: DataFrame, length: float) -> tuple[dict, int]:
    """Per target and band the sketch's width and the numbers of chunks, for bands that both sides have, and
    the tasks to deal them to. At most some hundred bands are counted."""

    def counted(side: DataFrame, bands: Column) -> dict:
        rows = side.select("target", F.explode(bands).alias("band")).groupBy("target", "band").count()
        return {(r["target"], r["band"]): r["count"] for r in rows.collect()}

    band = _band(length)
    lefts = counted(left, F.array(band))
    rights = counted(right, F.array(band - 1, band, band + 1))
    shared = lefts.keys() & rights.keys()
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    pairs = sum(lefts[k] * rights[k] for k in shared)
    chunk = min(max(math.isqrt(pairs // (CELLS_A_TASK * tasks)), CHUNK[0]), CHUNK[1])
    return {
        f"{t}:{b}": {
            "width": _width(b, length), "nl": -(-lefts[t, b] // chunk), "nr": -(-rights[t, b] // chunk),
        }
        for t, b in shared
    }, tasks


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each cell of a text, with its sketch of the cell's width."""
    places: dict[str, int] = {}
    for batch in batches:
        texts, cells = batch.column("text"), batch.column("cells")
        rows, cell, width, counts, bits = [], [], [], [], []

        def flush(batch=batch) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            own = [batch.column(c).take(at) for c in ("key", "target", "side", "chars")]
            made = [pa.array(cell, pa.int64()), pa.array(counts, pa.int32()), pa.array(bits, pa.binary())]
            out = pa.RecordBatch.from_arrays(own + made, ["key", "target", "side", "chars", "cell", "n", "bits"])
            for held in (rows, cell, width, counts, bits):
                held.clear()
            return out

        for row in range(batch.num_rows):
            tokens = set(texts[row].as_py().split(" "))
            tokens.discard("")
            if not tokens:
                continue
            if len(places) > REMEMBERED:
                places.clear()
            own = []
            for token in tokens:
                place = places.get(token)
                if place is None:
                    place = places[token] = zlib.crc32(token.encode())
                own.append(place)
            at = np.array(own, dtype=np.uint32)
            made: dict[int, bytes] = {}
            for one in cells[row].as_py():
                size = one["width"]
                if size not in made:
                    marks = np.zeros(size, dtype=bool)
                    marks[at & np.uint32(size - 1)] = True
                    made[size] = np.packbits(marks).tobytes()
                rows.append(row)
                cell.append(one["cell"])
                counts.append(len(tokens))
                bits.append(made[size])
            if len(rows) >= HELD:
                yield flush()
        if rows:
            yield flush()


def _bits(column: pa.Array) -> np.ndarray:
    """Sketches of one width as rows of 64-bit words."""
    held = column.to_pylist()
    return np.frombuffer(b"".join(held), dtype=np.uint64).reshape(len(held), -1)


class _Right:
    """The right chunk of a cell in the order of length, words of sketches side by side."""

    def __init__(self, parts: list[pa.RecordBatch]):
        chars = np.concatenate([p.column("chars").to_numpy() for p in parts])
        order = np.argsort(chars, kind="stable")
        self.chars = chars[order]
        self.n = np.concatenate([p.column("n").to_numpy() for p in parts])[order].astype(np.int64)
        words = np.concatenate([_bits(p.column("bits")) for p in parts])[order]
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        self.words = np.ascontiguousarray(words.T)
        self.keys = pa.concat_arrays([p.column("key") for p in parts]).take(pa.array(order))

    def partners(self, chars: int, n: int, words: np.ndarray, length: float, jaccard: float):
        """Places of texts that may be similar, and a bound on their Jaccard."""
        low = np.searchsorted(self.chars, chars * (length - 1e-9) - 1e-6)
        high = np.searchsorted(self.chars, chars / (length - 1e-9) + 1e-6, side="right")
        both = np.bitwise_count(self.words[:, low:high] & words[:, None]).sum(axis=0, dtype=np.int64)
        ones = int(np.bitwise_count(words).sum(dtype=np.int64))
        other = self.n[low:high]
        shared = np.minimum(n - (ones - both), other - (self.ones[low:high] - both))
        at = np.flatnonzero(shared >= (n + other) * (jaccard / (1 + jaccard)) - 1e-6)
        return at + low, shared[at] / (n + other[at] - shared[at])


def _compared(schema: pa.Schema, length: float, jaccard: float, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, right, turn = None, [], None, 0
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                run_ = batch.slice(start, end - start)
                if cells[start] != cell:
                    cell, parts, right = cells[start], [], None
                if sides[start] == 0:
                    parts.append(run_)
                    continue
                if not parts:
                    continue
                right = right or _Right(parts)
                chars, n, words = run_.column("chars").to_numpy(), run_.column("n").to_numpy(), _bits(run_.column("bits"))
                lefts, rights, more, held = [], [], [], 0

                def flush(run_=run_, right=right) -> pa.RecordBatch:
                    own = np.repeat([x for x, _ in lefts], [k for _, k in lefts])
                    made = [run_.column("key").take(pa.array(own)), right.keys.take(pa.array(np.concatenate(rights)))]
                    made += [run_.column("target").take(pa.array(own)), pa.array(np.repeat(more, [k for _, k in lefts]))]
                    lefts.clear(), rights.clear(), more.clear()
                    made = [c.cast(f.type) for c, f in zip(made, schema)]
                    return pa.RecordBatch.from_arrays(made, schema=schema)

                for i in range(run_.num_rows):
                    at, bound = right.partners(int(chars[i]), int(n[i]), words[i], length, jaccard)
                    if not len(at):
                        continue
                    more.append(most is not None and len(at) > most)
                    if more[-1]:
                        # Equal bounds are taken in turn, lest all choose the same text.
                        turn += 1
                        at = np.roll(at, turn)[np.argsort(-np.roll(bound, turn), kind="stable")[:most]]
                    lefts.append((i, len(at)))
                    rights.append(at)
                    held += len(at)
                    if held >= HELD:
                        yield flush()
                        held = 0
                if lefts:
                    yield flush()

    return run


def candidates(
    left: DataFrame, right: DataFrame, length: float, jaccard: float, most: int | None = None
) -> DataFrame:
    """Pairs ``(left, right, target, more)`` that may reach both floors.

    Sides have key, target and text. With ``most`` a left text keeps so many of the best partners of each
    cell, and ``more`` tells that there were others.
    """
    cells, tasks = _cells(left, right, length)
    table = literal(cells, "map<string,struct<width:int,nl:int,nr:int>>")
    own = F.pmod(F.xxhash64("key"), F.lit(1 << 30))

    def rows(side: DataFrame, bands: Column, number: int) -> DataFrame:
        mine, others = ("nr", "nl") if number == 0 else ("nl", "nr")

        def of(band: Column) -> Column:
            name = F.concat_ws(":", F.col("target").cast("string"), band.cast("string"))
            at = F.try_element_at(table, name)
            chunk = F.pmod(own, at[mine].cast("long"))

            def cell(other: Column) -> Column:
                # Target, band, left and right chunk in one number.
                a, b = (other, chunk) if number == 0 else (chunk, other)
                head = (F.col("target").cast("long") * 1024 + band + 1) * (1 << 20)
                return F.struct(
                    ((head + a.cast("long")) * (1 << 20) + b.cast("long")).alias("cell"), at["width"].alias("width")
                )

            none = F.array().cast("array<struct<cell:bigint,width:int>>")
            return F.when(at.isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), at[others] - 1), cell))

        placed = side.select(
            "key", F.col("target").cast("int").alias("target"), F.lit(number).alias("side"),
            F.char_length("text").alias("chars"), "text", F.flatten(F.transform(bands, of)).alias("cells"),
        ).where(F.size("cells") > 0)
        kinds = f"key {side.schema['key'].dataType.simpleString()}, target int, side int, chars int"
        return placed.mapInArrow(_sketched, f"{kinds}, cell bigint, n int, bits binary")

    band = _band(length)
    both = rows(right, F.array(band - 1, band, band + 1), 0).unionByName(rows(left, F.array(band), 1))
    dealt = both.repartition(tasks, "cell").sortWithinPartitions("cell", "side")
    kind = left.schema["key"].dataType.simpleString()
    schema = left.sparkSession.createDataFrame([], f"left {kind}, right {kind}, target int, more boolean").schema
    return dealt.mapInArrow(_compared(to_arrow_schema(schema), length, jaccard, most), schema)
