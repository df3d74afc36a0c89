"""Repeated passages: every window of 50 words that two texts share.

A window holds 39 runs of 12 words, and the least of their hashes is the same wherever the window
stands. Only about one run in twenty is the least of some window, so these are counted first; a
bitmap of fixed size (16 MB) then tells which windows can have a partner. Hashes of these windows are
counted by distinct texts in one combinable sum, so frequent runs and repeats inside a text cost no
comparisons and hide no partner. A second bitmap tells which places are worth writing out; a join on
the window's hash decides. The windows of a text are merged to spans.

Cases: null, empty and shorter texts have no repeats of their own. Equal texts are one text here
and, with at least 50 words, repeated as a whole. Words are cut at white space of any
kind (U+00A0 and U+3000 too) and compared as they are. Repeats inside one text are not reported. Repeated rows are copies; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.bag_minhash import WordHashes, mix
from lexweave.llm.support import text_key
from lexweave.session import cut_lineage

LEAST, RUN = 50, 12
WINDOW = LEAST - RUN + 1
BITS = 27
#: Windows after which a task hands on what it has.
CHUNK = 1 << 18


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every window: the running picks from both ends of
    blocks of the window's size meet in one more pick."""
    n = len(values) - size + 1
    fill = np.uint64(2**64 - 1) if pick is np.minimum else np.uint64(0)
    padded = np.full(-(-len(values) // size) * size, fill)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = pick.accumulate(blocks, 1).reshape(-1)
    back = pick.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return pick(back[:n], ahead[size - 1 : size - 1 + n])


def powers(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` words in order."""
    n = len(words) - size + 1
    out = np.full(n, size, "u8")
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(out)


def least_runs(words: np.ndarray) -> np.ndarray:
    """The least hash of a run in every window of a text."""
    if len(words) < LEAST:
        return np.empty(0, "u8")
    return sliding(powers(words, RUN), WINDOW, np.minimum)


def hashed(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = (text or "").split()
    return np.fromiter(map(hashes.__getitem__, words), "u8", len(words))


def run_counts(texts: DataFrame) -> DataFrame:
    """The hashes of runs that are the least of windows of at least two different texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            runs, owners, size = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                found = np.unique(least_runs(hashed(text.as_py(), hashes)))
                runs.append(found)
                owners.append(np.full(len(found), int.from_bytes(key.as_py()[:8], "little"), "u8"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.empty(0, "u8"), *runs]).view("i8")),
                    pa.array(np.concatenate([np.empty(0, "u8"), *owners]).view("i8")),
                ],
                ["run", "owner"],
            )

    found = texts.mapInArrow(run, "run bigint, owner bigint")
    ends = found.groupBy("run").agg(F.min("owner").alias("x"), F.max("owner").alias("y"))
    return ends.where("x <> y").select("run")


def _bitmap(found: DataFrame) -> np.ndarray:
    """One bit per value of the leading bits: at most 2**21 numbers come to the driver."""
    place = F.shiftrightunsigned(found.columns[0], 64 - BITS)
    words = (
        found.select(place.alias("place"))
        .select(
            F.shiftrightunsigned("place", 6).cast("int").alias("word"),
            F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    bitmap = np.zeros(1 << BITS - 6, "i8")
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap


def _among(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values >> np.uint64(64 - BITS)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def windows(texts: DataFrame, runs: np.ndarray, repeated: np.ndarray | None = None) -> DataFrame:
    """(window, key, at) of every window whose least run is in the bitmap ``runs`` and whose hash is in
    the bitmap ``repeated``; without the latter (window, owner), each window once a text.

    With ``repeated``, every text of at least ``LEAST`` words also gives a row whose window is the number
    of its key (:func:`key_number`) and whose at is the count of its words, negative.
    """
    context = texts.sparkSession.sparkContext
    first, second = context.broadcast(runs), None if repeated is None else context.broadcast(repeated)

    def batch_of(found: list[np.ndarray], keys: list[bytes], at: list[np.ndarray]) -> pa.RecordBatch:
        sizes = [len(f) for f in found]
        ids = np.repeat(np.frombuffer(b"".join(keys), "u8").reshape(-1, 2), sizes, 0)
        window = pa.array(np.concatenate(found).view("i8"))
        if second is None:
            owner = pa.array(np.ascontiguousarray(ids[:, 0]).view("i8"))
            return pa.RecordBatch.from_arrays([window, owner], ["window", "owner"])
        places = pa.array(np.concatenate(at).astype("i4"))
        return pa.RecordBatch.from_arrays(
            [window, _fixed(ids, pa.binary(16)), places], ["window", "key", "at"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            seen, found, keys, places, size = set(), [], [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                key = key.as_py()
                if key in seen:
                    continue
                seen.add(key)
                words = hashed(text.as_py(), hashes)
                if len(words) < LEAST:
                    continue
                at = np.nonzero(_among(first.value.view("u8"), least_runs(words)))[0]
                if second is None and not len(at):
                    continue
                window = powers(words, LEAST)[at] if len(at) else np.empty(0, "u8")
                if second is None:
                    window = np.unique(window)
                else:
                    hit = _among(second.value.view("u8"), window)
                    own = np.array([int.from_bytes(key[:8], "big")], "u8")
                    window = np.concatenate([own, window[hit]])
                    at = np.concatenate([[-len(words)], at[hit]])
                found.append(window)
                keys.append(key)
                places.append(at)
                size += len(window)
                if size > CHUNK:
                    yield batch_of(found, keys, places)
                    found, keys, places, size = [], [], [], 0
            if size:
                yield batch_of(found, keys, places)

    kind = "window bigint, owner bigint" if repeated is None else "window bigint, key binary, at int"
    return texts.mapInArrow(run, kind)


def _fixed(values: np.ndarray, width: pa.DataType) -> pa.Array:
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return pa.FixedSizeBinaryArray.from_buffers(width, len(values), [None, data]).cast(pa.binary())


def key_number(key: Column) -> Column:
    """The first eight bytes of a key as a signed number."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, start, stop): windows of words that a text shares with another one, which may overlap, and
    the whole of texts that occur more than once."""
    texts = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    runs = _bitmap(run_counts(texts))
    ends = windows(texts, runs).groupBy("window").agg(F.min("owner").alias("x"), F.max("owner").alias("y"))
    repeated = cut_lineage(ends.where("x <> y").select("window"))
    copied = texts.groupBy("key").count().where("count > 1").select(key_number(F.col("key")).alias("window"))
    wanted = repeated.withColumn("whole", F.lit(False)).unionByName(
        copied.withColumn("whole", F.lit(True))
    )
    places = windows(texts, runs, _bitmap(repeated)).withColumn("whole", F.col("at") < 0)
    at = F.col("at")
    spans = places.join(wanted, ["window", "whole"], "left_semi").select(
        "key",
        F.when(at < 0, 0).otherwise(at).alias("start"),
        F.when(at < 0, -at).otherwise(at + LEAST).alias("stop"),
    )
    return spans.distinct()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            own: list[dict] = []
            for span in sorted(spans, key=lambda s: (s["start"], s["stop"])):
                if own and span["start"] <= own[-1]["stop"]:
                    own[-1]["stop"] = max(own[-1]["stop"], span["stop"])
                else:
                    own.append(dict(span))
            merged.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), pa.array(merged, kind)], ["key", "spans"]
        )


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with repeats: doc_id, words in repeated passages, and the passages' word spans."""
    spans = repeated_spans(docs, text)
    pair = F.struct("start", "stop")
    merged = (
        spans.groupBy("key")
        .agg(F.collect_set(pair).alias("spans"))
        .mapInArrow(_merge, "key binary, spans array<struct<start: int, stop: int>>")
    )
    covered = F.aggregate(
        F.transform("spans", lambda s: (s["stop"] - s["start"]).cast("long")),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    return (
        docs.select(doc_id, text_key(F.col(text)).alias("key"))
        .join(merged, "key")
        .select(doc_id, covered.alias("repeated_words"), "spans")
    )
