r"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: its context is all that the conversation says before
it, and only its text is trainable. The formatted conversation is one string, ``### role: text``
and ``</turn>`` for each turn. :func:`expanded` makes an example of every reply, with its whole context, a
prefix of that string, and its target as texts, besides a segment for each turn. Reading back takes replies
from the examples alone, each context checked against the prefix read so far.

Spelled-out contexts grow with the square of a conversation, which is what this format asks for. They
are made one after the other where a conversation's segments lie in order, are handed on by bounded
bytes, and are read in the same task: segments are shuffled and contexts are not. A task holds one
conversation's string and one context beside it; a string beyond what an Arrow text holds (2 GB) is an error.

In texts and roles ``\`` is written ``\\``, ``#`` ``\h``, ``<`` ``\l``, and in roles also a colon
``\c`` and a line end ``\n``, so the marks occur only as marks.

Cases: null texts and roles count as empty; a null conv_id is one conversation. Turns with equal
numbers are ordered by role and text, repeated rows stay. A conversation without assistant turns
has no examples and an empty loss text. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.operators.ordering import running_totals

END = "</turn>\n"
CODES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
ROLE_CODES = ((":", "\\c"), ("\n", "\\n"))
PLAIN = {"\\\\": "\\", "\\h": "#", "\\l": "<", "\\c": ":", "\\n": "\n"}
SLICE = 1024
SEGMENTS = ["conv_id", "start", "segment", "loss_start", "loss_end"]
EXPANDED = ["conv_id", "start", "example", "text", "context", "loss_start", "loss_end"]
EXAMPLES = (
    "conv_id bigint, start bigint, example boolean, text string, context string, "
    "loss_start bigint, loss_end bigint"
)
# Characters and rows that are handed on at a time.
HELD, ROWS = 1 << 23, 1 << 12


def escape(value: Column, codes=CODES) -> Column:
    for sign, code in codes:
        value = F.replace(value, F.lit(sign), F.lit(code))
    return value


def unescape(text: str) -> str:
    return re.sub(r"\\.", lambda m: PLAIN[m.group()], text)


def format_turns(turns: DataFrame) -> DataFrame:
    """One segment per turn, with its place in the conversation's string.

    Returns conv_id, turn, role, text, segment, start, and for assistant turns the example's
    loss_start and loss_end. Starts are running totals over slices of 1,024 turn numbers, so a very
    long conversation is not gathered in one task.
    """
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    head = F.concat(F.lit("### "), escape(F.col("role"), CODES + ROLE_CODES), F.lit(": "))
    body = escape(F.col("text"))
    rows = rows.withColumn("segment", F.concat(head, body, F.lit(END)))
    rows = (
        rows.withColumn("size", F.length("segment").cast("long"))
        .withColumn("slice", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(2**53))))
        # Equal for a null id too, which the slices' join would lose.
        .withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = running_totals(rows, ["conv"], "slice", order, ["size"])
    start = F.col("cum_size") - F.col("size")
    reply = F.col("role") == "assistant"
    return placed.select(
        "conv_id",
        "turn",
        "role",
        "text",
        "segment",
        start.alias("start"),
        F.when(reply, start + F.length(head)).alias("loss_start"),
        F.when(reply, F.col("cum_size") - len(END)).alias("loss_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: the context is the string before loss_start."""
    return formatted.where("loss_start is not null").select(
        "conv_id", "turn", "loss_start", "loss_end"
    )


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments as they come, in order, and after the segment of a reply its example."""
    conv, open_, said, size = None, False, io.StringIO(), 0
    done: list[tuple] = []
    held = 0

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done))
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], EXPANDED)

    for batch in batches:
        for own, start, segment, a, b in zip(*(batch.column(c).to_pylist() for c in SEGMENTS)):
            if not open_ or own != conv:
                conv, open_, said, size = own, True, io.StringIO(), 0
            if start != size:
                raise ValueError("a segment does not follow the one before")
            said.write(segment)
            size += len(segment)
            done.append((own, start, False, segment, None, None, None))
            held += len(segment)
            if a is not None:
                whole = said.getvalue()
                done.append((own, start, True, whole[a:b], whole[:a], a, b))
                held += b
            if held >= HELD or len(done) >= ROWS:
                yield flush()
                done, held = [], 0
    if done:
        yield flush()


def expanded(formatted: DataFrame) -> DataFrame:
    """The string's segments and, after the segment of its turn, each example with its context and target.

    Returns conv_id, start, example (false for segments), text, context, loss_start, loss_end; the context of
    an example ends at loss_start and its target is its text. The rows of a conversation lie in order in one
    partition.
    """
    return (
        formatted.select(F.col("conv_id").cast("long").alias("conv_id"), *SEGMENTS[1:])
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "start")
        .mapInArrow(_expand, EXAMPLES)
    )


def spelled_out(formatted: DataFrame) -> DataFrame:
    """The examples with context and reply as texts, for conversations of ordinary length."""
    part = formatted.select(F.col("conv_id").alias("of"), F.col("start").alias("at"), "segment")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("at") < F.col("loss_start"))
    whole = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "segment"))), lambda x: x["segment"]), ""
    )
    groups = examples(formatted).join(part, same).groupBy(
        "conv_id", "turn", "loss_start", "loss_end"
    )
    first, size = "cast(loss_start as int)", "cast(loss_end - loss_start as int)"
    return groups.agg(whole.alias("said")).select(
        "conv_id",
        "turn",
        F.expr(f"substr(said, 1, {first})").alias("context"),
        F.expr(f"substr(said, {first} + 1, {size})").alias("reply"),
    )


TURN = re.compile(r"### ((?:[^:\\]|\\.)*): (.*)" + re.escape(END), re.S)


HEAD = "### assistant: "


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests per conversation from its segments and examples in order; the digests and the string are
    kept, against which each context is compared in full."""
    conv, open_, segment, so_far, whole = None, False, "", io.StringIO(), None
    n = chars = loss_chars = 0
    turns, loss = hashlib.sha256(), hashlib.sha256()
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done))
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], RESULT_NAMES
        )

    for batch in batches:
        for own, start, example, text, context, a, b in zip(*(batch.column(c).to_pylist() for c in EXPANDED)):
            if not open_ or own != conv:
                if open_:
                    done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, open_, segment, n, chars, loss_chars = own, True, "", 0, 0, 0
                so_far, whole = io.StringIO(), None
                turns, loss = hashlib.sha256(), hashlib.sha256()
            if example:
                # The context is all that was read, with the head of the last turn; the target is the rest.
                if whole is None:
                    whole = so_far.getvalue()
                fits = context is not None and len(context) == a and whole.startswith(context)
                fits = fits and context.endswith(HEAD) and a == chars - len(segment) + len(HEAD)
                if not fits or b != a + len(text) or whole[a:] != text + END:
                    raise ValueError("an example is no prefix and target of its conversation")
                reply = unescape(text)
                loss.update(reply.encode())
                loss_chars += len(reply)
                continue
            segment, whole = text, None
            so_far.write(segment)
            role, said = TURN.fullmatch(segment).groups()
            turns.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            n += 1
            chars += len(segment)
        if done:
            yield flush()
            done = []
    if open_:
        done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        yield flush()


RESULT_NAMES = [
    "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
]
RESULT = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
    "loss_sha256 string, formatted_chars bigint"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted string says, turns and length, and its examples' targets.

    A digest needs its text in order, so a conversation passes through one task, as a stream.
    """
    return expanded(formatted).mapInArrow(_read, RESULT)


def read_examples(rows: DataFrame) -> DataFrame:
    """:func:`read_back` from rows of :func:`expanded` in any order; an example that does not fit is an error."""
    return (
        rows.select(*EXPANDED)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "start", "example")
        .mapInArrow(_read, RESULT)
    )
