"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Which tokens a prefix gets can change when more bytes follow, but only so far back: two
continuations first differ at the end of the bytes read, and the difference moves left only when a
merge joins the last common token to a token that starts at the frontier. Such merges have
increasing ranks, and the left part of one starts the right part of the next. The longest such
chain in the merge list, in bytes, is its sufficient lookahead: tokens that end earlier than that
before the end of the bytes read are stable and can be emitted.

Cases: null text counts as empty and gives no tokens; an id outside the vocabulary decodes to
nothing; bytes that are no UTF-8 decode to U+FFFD as they do in the usual lossy decoding. Every
other column passes unchanged; a column named like the result is replaced.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: How a text is cut before the merges; fixed by the vocabulary's published format.
PATTERN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPACES = regex.compile(r"\s*")
RUNS = (regex.compile(r"\p{L}*"), regex.compile(r"\p{N}*"), regex.compile(r"[^\s\p{L}\p{N}]*"))
#: A space that does not start a piece. Python's own class holds all white space of the pattern.
LOOSE = re.compile(r" (?=\s|$)")
START = re.compile(r" (?=\S)")
#: Memory of a :class:`Memo`, and the longest piece it keeps.
MEMO_BYTES, MEMO_CHARS = 80 << 20, 64
#: Characters of texts that a task works on before it hands on what it has.
SLICE_CHARS = 1 << 21
EMPTY, NONE = np.uint64(2**64 - 1), np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """Ranks of token pairs, looked up for whole arrays: open addressing, a probe a round."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        keys = np.array([a << 32 | b for a, b, _ in merges], "u8")
        self.shift = 64 - max(4, (8 * len(merges)).bit_length())
        size = 1 << 64 - self.shift
        self.keys, self.rank = np.full(size, EMPTY), np.full(size, NONE, "i4")
        for r, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.keys[at] != EMPTY:
                at = (at + 1) % size
            self.keys[at], self.rank[at] = key, r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype("i8")

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` where no merge fits or a side is -1."""
        keys = left.astype("u8") << np.uint64(32) | right.astype("u4").astype("u8")
        at = self._slot(keys)
        found, rank = self.keys[at], self.rank[at]
        rank = np.where(found == keys, rank, NONE)
        more = np.nonzero((found != keys) & (found != EMPTY))
        while len(more[0]):
            slot = (at[more] + 1) % len(self.keys)
            at[more], found = slot, self.keys[slot]
            same = found == keys[more]
            hit = tuple(m[same] for m in more)
            rank[hit] = self.rank[slot[same]]
            left_over = ~same & (found != EMPTY)
            more = tuple(m[left_over] for m in more)
        return rank


class Vocabulary:
    """Merge ranks, token bytes and sufficient lookahead of one vocabulary file."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * self.size
        for word, i in ids.items():
            if word not in self.special:
                self.bytes[i] = bytes(letters[c] for c in word)
        for word, i in self.special.items():
            self.bytes[i] = word.encode()
        self.of_byte = [0] * 256
        for i, b in enumerate(self.bytes):
            if len(b) == 1:
                self.of_byte[b[0]] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(self.merges)}
        self.table = PairTable(self.merges)
        self.whole = np.array([m[2] for m in self.merges], "i4")
        self.byte_ids = np.array(self.of_byte, "i4")
        self.lookahead = self._sufficient_lookahead()

    def _sufficient_lookahead(self) -> int:
        left: dict[int, int] = {}
        reach: dict[int, int] = {}
        for a, b, whole in self.merges:
            longest, start = 0, b
            while True:
                longest = max(longest, reach.get(start, 0))
                if start not in left:
                    break
                start = left[start]
            reach[a] = max(reach.get(a, 0), longest + len(self.bytes[a]))
            if whole in left:
                raise ValueError("two merges make the same token")
            left[whole] = a
        for r, (a, b, _) in enumerate(self.merges):
            if any(len(self.bytes[x]) > 1 and x not in left for x in (a, b)):
                raise ValueError(f"merge {r} uses a token that no merge makes")
        return max([1, *reach.values()])

    def merge(self, data: bytes) -> list[int]:
        """The merges applied to ``data`` until none fits, least rank first, then leftmost."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 64:
            return self._merge_long(ids)
        rank = self.rank
        while len(ids) > 1:
            fits = ((rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in rank)
            best = min(fits, default=None)
            if best is None:
                break
            (_, whole), at = best
            ids[at : at + 2] = [whole]
        return ids

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many words: words of like length are merged together, a merge a round."""
        out: list[bytes] = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(max(8, 1 << (len(w) - 1).bit_length()) if w else 8, []).append(i)
        for width, members in by_width.items():
            if width > 64 or len(members) < 4:
                for i in members:
                    out[i] = packed(self.merge(words[i]))
                continue
            sizes = np.array([len(words[i]) for i in members])
            joined = b"".join([words[i].ljust(width, b"\0") for i in members])
            ids = self.byte_ids[np.frombuffer(joined, "u1")].reshape(len(members), width)
            columns = np.arange(width)
            ids[columns >= sizes[:, None]] = -1
            rows, part = np.arange(len(members)), ids
            while len(rows):
                ranks = self.table.ranks(part[:, :-1], part[:, 1:])
                at = ranks.argmin(1)
                best = ranks[np.arange(len(rows)), at]
                fits = best < NONE
                ids[rows[~fits]] = part[~fits]
                rows, part, at, best = rows[fits], part[fits], at[fits], best[fits]
                moved = np.concatenate([part[:, 1:], np.full((len(rows), 1), -1, "i4")], 1)
                part = np.where(columns > at[:, None], moved, part)
                part[np.arange(len(rows)), at] = self.whole[best]
            kept = ids >= 0
            flat = ids[kept].astype("<i4").tobytes()
            ends = (np.cumsum(kept.sum(1)) * 4).tolist()
            for i, a, b in zip(members, [0, *ends], ends):
                out[i] = flat[a:b]
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rank = len(ids), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [
            (rank[p][0], i, rank[p][1]) for i, p in enumerate(zip(ids, ids[1:])) if p in rank
        ]
        heapq.heapify(heap)
        while heap:
            r, i, whole = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or rank.get((ids[i], ids[j])) != (r, whole):
                continue
            ids[i], ids[j] = whole, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := rank.get((whole, ids[after[i]])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if before[i] >= 0 and (found := rank.get((ids[before[i]], whole))):
                heapq.heappush(heap, (found[0], before[i], found[1]))
        return [i for i in ids if i >= 0]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


class Memo(dict):
    """Token ids by word, learnt many at a time; long pieces are made anew each time.

    Emptied when the bytes of its words, ids and entries reach ``MEMO_BYTES``.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.size = make, 0

    def of(self, words: list[str]) -> bytes:
        """The ids of ``words`` in their order."""
        try:
            return b"".join(map(self.__getitem__, words))
        except KeyError:
            new = [w for w in {*words} if w not in self]
        if new:
            if any(len(w) > MEMO_CHARS for w in new):
                return b"".join([self.make([w])[0] if len(w) > MEMO_CHARS else self.of([w]) for w in words])
            if self.size > MEMO_BYTES:
                self.clear()
                self.size, new = 0, list({*words})
            made = self.make(new)
            self.update(zip(new, made))
            # An entry, a string and a byte string take about 200 bytes besides their content.
            self.size += sum(map(len, made)) + 2 * sum(map(len, new)) + 200 * len(new)
        return b"".join(map(self.__getitem__, words))


class Encoder:
    """Text in any pieces to token ids, emitted as soon as no later text can change them.

    Holds at most ``window`` characters that no boundary ends yet, and of a longer run of letters,
    digits, signs or spaces only the bytes within the lookahead.
    """

    def __init__(self, vocabulary: Vocabulary, window: int = 1 << 16):
        self.vocabulary, self.window = vocabulary, window
        self.word = Memo(lambda words: vocabulary.merge_many([w.encode() for w in words]))
        self.spaced = Memo(self._spaced)
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.reset()

    def learn(self, texts: list[str]) -> None:
        """Put the words of ``texts`` in the memory together, which costs far less than singly."""
        words = set().union(*[t.split(" ") for t in texts])
        self.spaced.of([w for w in words if w and not w[0].isspace() and len(w) <= 64])

    def reset(self) -> None:
        self.tail, self.run, self.pending = "", None, b""

    def feed(self, text: str) -> Iterator[bytes]:
        text = self.tail + text
        done = 0
        for m in self.special.finditer(text):
            yield from self._segment(text[done : m.start()], True)
            yield packed([self.vocabulary.special[m.group()]])
            done = m.end()
        text = text[done:]
        held = max(
            (k for s in self.vocabulary.special for k in range(1, len(s)) if text.endswith(s[:k])),
            default=0,
        )
        body = text[: len(text) - held]
        yield from self._segment(body, False)
        self.tail += text[len(body) :]

    def finish(self) -> Iterator[bytes]:
        tail, self.tail = self.tail, ""
        yield from self._segment(tail, True)
        self.reset()

    def _segment(self, text: str, final: bool) -> Iterator[bytes]:
        """Emit what is certain of ``text``; the rest becomes the tail."""
        if self.run:
            out, text = self._continue(text, final)
            yield from out
        if self.run is None:
            cut = len(text)
            if not final:
                cut = text.rfind(" ", 0, max(0, len(text) - 1))
                while cut >= 0 and not START.match(text, cut):
                    cut = text.rfind(" ", 0, cut)
                cut = max(cut, 0)
            yield self._closed(text[:cut])
            text = text[cut:]
            if len(text) > self.window:
                out, text = self._open(text)
                yield from out
        self.tail = text

    def _closed(self, text: str) -> bytes:
        if not text or LOOSE.search(text):
            return self.word.of(PATTERN.findall(text))
        first, *rest = text.split(" ")
        return self.word.of(PATTERN.findall(first)) + self.spaced.of(rest)

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words that each follow a space, cut in one go: a piece starts at each space."""
        cut = PATTERN.findall(" " + " ".join(words))
        starts = [i for i, piece in enumerate(cut) if piece[0] == " "]
        if any(len(w) >= MEMO_CHARS for w in words):
            return [self.word.of(cut[a:b]) for a, b in zip(starts, [*starts[1:], len(cut)])]
        self.word.of(cut)
        known = self.word
        if len(starts) == len(cut):
            return [known[w] for w in cut]
        return [
            known[cut[a]] if b == a + 1 else b"".join([known[w] for w in cut[a:b]])
            for a, b in zip(starts, [*starts[1:], len(cut)])
        ]

    def _open(self, text: str) -> tuple[list[bytes], str]:
        """A text without a boundary: emit its closed words; a long last one becomes a run."""
        out, at = [], 0
        for m in PATTERN.finditer(text):
            if m.end() > len(text) - 3:
                break
            out.append(self.word.of([m.group()]))
            at = m.end()
        text = text[at:]
        if len(text) * 2 > self.window and PATTERN.match(text).end() == len(text):
            last = text[-1]
            self.run = next((r for r in (*RUNS, SPACES) if r.fullmatch(last)), SPACES)
            keep = 1 if self.run is SPACES else 0
            out += self._bytes(text[: len(text) - keep].encode())
            text = text[len(text) - keep :]
        return out, text

    def _continue(self, text: str, final: bool) -> tuple[list[bytes], str]:
        end = self.run.match(text).end()
        keep = 1 if self.run is SPACES and not (final and end == len(text)) else 0
        out = self._bytes(text[: max(0, end - keep)].encode())
        if end < len(text) or final:
            out.append(packed(self.vocabulary.merge(self.pending)))
            self.pending, self.run = b"", None
        return out, text[max(0, end - keep) :]

    def _bytes(self, data: bytes) -> list[bytes]:
        """Add bytes to the open run and emit its stable tokens."""
        out, step = [], 4 * self.vocabulary.lookahead
        for at in range(0, len(data), step):
            self.pending += data[at : at + step]
            if len(self.pending) < step:
                break
            ids, end, stable = self.vocabulary.merge(self.pending), 0, 0
            for token in ids:
                size = len(self.vocabulary.bytes[token])
                if end + size > len(self.pending) - self.vocabulary.lookahead:
                    break
                end, stable = end + size, stable + 1
            out.append(packed(ids[:stable]))
            self.pending = self.pending[end:]
        return out


class Decoder:
    """Token ids in any portions to text; an unfinished character waits for its other bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = vocabulary.bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        known = self.bytes
        data = b"".join([known[i] for i in ids if 0 <= i < len(known)])
        return self.state.decode(data)

    def finish(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest

    def whole(self, ids: np.ndarray, portion: int = 1 << 16) -> str:
        """The text of all of a row's ids, read in portions."""
        parts = [self.feed(ids[at : at + portion].tolist()) for at in range(0, len(ids), portion)]
        return "".join([*parts, self.finish()])


_LOADED: dict[str, Vocabulary] = {}


def loaded(data: bytes) -> Vocabulary:
    """The vocabulary of these file bytes, built once per process."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(data)
    return _LOADED[name]


def _extended(df: DataFrame, name: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    same = [c for c in df.columns if c.lower() == name.lower()]
    kept = df.drop(*same)
    return kept, T.StructType([*kept.schema.fields, T.StructField(name, kind)])


def _with(batch: pa.RecordBatch, name: str, array: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, array], [*batch.schema.names, name])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of one row, or of more rows with ``SLICE_CHARS`` bytes of text at most."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype("i8"))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, "right")))
        yield batch.slice(start, end - start)
        start = end


def _shared(df: DataFrame, path: str):
    """The vocabulary file's bytes for all tasks; its size does not depend on the data."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """Add the token ids of ``text`` under the vocabulary file ``path``, and, where ``decoded`` names a
    column, the text that comes back from these ids, in the same pass."""
    data = _shared(df, path)
    replaced = {c.lower() for c in (ids, decoded) if c}
    source = df if text.lower() not in replaced else df.withColumnRenamed(text, text + "_")
    column = text if source is df else text + "_"
    kept, schema = _extended(source, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        kept = kept.drop(*[c for c in kept.columns if c.lower() == decoded.lower()])
        fields = [f for f in schema.fields if f.name.lower() != decoded.lower()]
        schema = T.StructType([*fields, T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(data.value)
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            for part in _slices(batch, column):
                texts = [t or "" for t in part.column(column).to_pylist()]
                encoder.learn([t for t in texts if len(t) <= encoder.window])
                found, offsets, back = [], np.zeros(len(texts) + 1, "i4"), []
                for i, whole in enumerate(texts):
                    own = []
                    for at in range(0, len(whole), encoder.window):
                        own += encoder.feed(whole[at : at + encoder.window])
                    own += encoder.finish()
                    found.append(b"".join(own))
                    offsets[i + 1] = offsets[i] + len(found[-1]) // 4
                    if decoded:
                        back.append(decoder.whole(np.frombuffer(found[-1], "<i4")))
                flat = pa.array(np.frombuffer(b"".join(found), "<i4"))
                out = _with(part, ids, pa.ListArray.from_arrays(pa.array(offsets), flat))
                yield _with(out, decoded, pa.array(back, pa.string())) if decoded else out

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of the token ids; special tokens keep their strings."""
    data = _shared(df, path)
    kept, schema = _extended(df, text, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(loaded(data.value))
        for batch in batches:
            texts = []
            for value in batch.column(ids):
                row = value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.empty(0, "i4")
                texts.append(decoder.whole(row))
            yield _with(batch, text, pa.array(texts, pa.string()))

    return kept.mapInArrow(run, schema)
