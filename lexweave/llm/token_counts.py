"""Token counts with a digest cache: every distinct text is encoded once, over all runs.

A text is named by the digest of its content, a tokenizer by the digest of its file, library and
settings. The cache is a Parquet folder of (version, digest, n_tokens), divided by version. A run joins its digests
to the stored counts, encodes one text of each digest that is missing, appends these
counts, and reads every result from the cache. An append is committed as a whole or not at all; runs
that append the same text at the same time store equal counts twice, which reading folds.

Content is normalised as the tokenizer itself does before it cuts, where its library shows that step: texts
that differ only so share a digest. A text in which a special token's string stands or appears by it
keeps its own digest, since libraries look for those strings before that step.

Texts that occur once and have no stored count are encoded where they are read; two bitmaps of fixed size tell them.
Only others are shuffled, one of each text from a task, and joined exactly. Byte-level texts above
a million characters are counted by the streaming encoder, so memory stays bounded.

Cases: null text counts as empty; repeated rows and ids, null ids included, stay rows of their own; a table without
rows gives no rows; a missing cache folder is an empty cache; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe
from lexweave.llm.support import looked_up, may_be_among, once_a_task, written
from lexweave.session import cut_lineage

#: Characters that are handed to a tokenizer at once, and above which a text is streamed.
GROUP_CHARS, LONG_CHARS = 1 << 19, 1 << 20


class Counter:
    """Counts tokens as the file's library does, without added tokens, truncation or padding."""

    def __init__(self, name: str, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=data) if name.endswith(".model") else None
        self.streamed, self.normalizer, self.special = None, None, ()
        if self.pieces:
            return
        self.words = tokenizers.Tokenizer.from_buffer(data)
        self.words.no_truncation()
        self.words.no_padding()
        self.normalizer = self.words.normalizer
        spec = json.loads(data)
        self.special = tuple(t["content"] for t in spec.get("added_tokens", ()))
        cut = spec.get("pre_tokenizer") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
        model = spec["model"]
        own = model["type"] == "BPE" and not model.get("ignore_merges") and not model.get("dropout")
        if plain and own and spec["normalizer"] is None:
            self.streamed = bpe.Encoder(bpe.loaded(data))

    def content(self, text: str) -> bytes:
        """What the digest is taken of."""
        if self.normalizer is None:
            return text.encode()
        normal = self.normalizer.normalize_str(text)
        if any(s in text or s in normal for s in self.special):
            return b"as it is:" + text.encode()
        return b"normal:" + normal.encode()

    def counts(self, texts: list[str]) -> list[int]:
        if self.pieces:
            return [len(ids) for ids in self.pieces.encode(texts, num_threads=1)]
        return [len(e) for e in self.words.encode_batch_fast(texts, add_special_tokens=False)]

    def count_streamed(self, text: str) -> int:
        step, size = self.streamed.window, 0
        for at in range(0, len(text), step):
            size += sum(map(len, self.streamed.feed(text[at : at + step])))
        return (size + sum(map(len, self.streamed.finish()))) // 4

    def all_counts(self, texts: Iterator[str]) -> Iterator[int]:
        """Counts in order; few characters at a time are held by the tokenizer."""
        group, chars = [], 0
        for text in texts:
            long = self.streamed and len(text) > LONG_CHARS
            if group and (long or chars + len(text) > GROUP_CHARS):
                yield from self.counts(group)
                group, chars = [], 0
            if long:
                yield self.count_streamed(text)
            else:
                group.append(text)
                chars += len(text)
        if group:
            yield from self.counts(group)


_COUNTERS: dict[str, Counter] = {}


class Tokenizer:
    """A tokenizer file as tasks need it: its bytes are broadcast, its size does not follow the data."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            data = file.read()
        self.name = os.path.basename(path)
        library = sentencepiece if path.endswith(".model") else tokenizers
        said = f"{library.__name__} {library.__version__}, no added tokens\n".encode()
        self.version = hashlib.sha256(said + data).hexdigest()
        self.raw = Counter(self.name, data).normalizer is None
        self._data = spark.sparkContext.broadcast(data)

    def counter(self) -> Counter:
        """The counter, made once per Python process."""
        if self.version not in _COUNTERS:
            _COUNTERS[self.version] = Counter(self.name, self._data.value)
        return _COUNTERS[self.version]

    def __getstate__(self):
        return self.name, self.version, self.raw, self._data

    def __setstate__(self, state):
        self.name, self.version, self.raw, self._data = state


def content_digests(docs: DataFrame, tokenizer: Tokenizer, text: Column, *kept: Column) -> DataFrame:
    """``kept``, ``digest`` and ``text``: 32 bytes that name what the tokenizer gets to see."""
    whole = F.coalesce(text, F.lit(""))
    rows = docs.select(*kept, whole.alias("text"))
    if tokenizer.raw:
        return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        content = tokenizer.counter().content
        found = (hashlib.sha256(content(t.as_py())).digest() for t in texts)
        return pa.array(found, pa.binary())

    return rows.withColumn("digest", digest("text"))


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; empty where the folder does not exist yet."""
    try:
        found = spark.read.schema("digest binary, n_tokens bigint").parquet(f"{cache}/version={version}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "digest binary, n_tokens bigint")
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _encoded(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of every row of (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = tokenizer.counter()
        for batch in batches:
            texts = (t.as_py() for t in batch.column("text"))
            counts = pa.array(counter.all_counts(texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), counts], ["digest", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, "digest binary, n_tokens bigint")


def token_counts(
    docs: DataFrame, path: str, cache: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(id, n_bytes, n_tokens) per document, under the tokenizer file ``path`` with the cache folder ``cache``."""
    spark = docs.sparkSession
    tokenizer = Tokenizer(spark, path)
    whole = content_digests(docs, tokenizer, F.col(text), F.col(doc_id).alias("id"))
    rows = written(whole.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    known = stored(spark, cache, tokenizer.version)
    sizes = rows.groupBy("digest").agg(F.count("*").alias("n"))
    missing = cut_lineage(sizes.join(known.select("digest"), "digest", "left_anti"))
    repeated = missing.where("n > 1").select("digest")
    hits = sizes.join(known.select("digest"), "digest", "left_semi").select("digest")
    # Everything that is not surely a single text without a stored count is joined exactly.
    told = repeated.unionByName(hits).select(F.xxhash64("digest").alias("h"))
    texts = content_digests(docs, tokenizer, F.col(text))
    flagged = may_be_among(texts, F.xxhash64("digest"), told, "maybe")
    alone = flagged.where("not maybe")
    others = once_a_task(flagged.where("maybe").select("digest", "text"), "digest").join(missing.select("digest"), "digest", "left_semi")
    misses = alone.select("digest", "text").unionByName(others.dropDuplicates(["digest"]))
    added = _encoded(misses, tokenizer)
    added.write.mode("append").parquet(f"{cache}/version={tokenizer.version}")
    return looked_up(rows, stored(spark, cache, tokenizer.version), "digest").select("id", "n_bytes", "n_tokens")
