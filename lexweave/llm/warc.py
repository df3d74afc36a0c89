"""Web archives as chunked record tables.

A payload is cut into chunks of 16 K characters, one row per record identifier and chunk number,
and each row becomes one archive record: the first a response, the others continuations with the
standard's segment fields. So no record, however long its payload, is held as one row again.
Spark's text source writes the rows and reads them back in splits: a record ends with the usual
empty line, and the next starts with a version line and a boundary field that is drawn for each
archive and occurs nowhere else. Of equal payloads of at least 100 bytes one record holds the
payload and the others revisit it.

Reading checks the length and digest of every chunk. A payload of one chunk has the chunk's digest;
a longer one's chunks are sorted by number and run through one incremental digest.

Cases: a null html is an empty payload, a null url an empty target; line ends in a url are escaped.
Rows with equal page_id and payload are all responses; a null page_id has the smallest rank only if
no other row shares the payload, and is then a response. Repeated rows give repeated records.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.support import may_be_among
from lexweave.session import ensure_checkpoint_dir

CHUNK, LEAST = 1 << 14, 100
END = "\r\n\r\n"


def _hash(digest: str) -> Column:
    return F.xxhash64(F.col(digest))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, size, digest, and for revisits the page they refer to."""
    rows = pages.select(
        "page_id",
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    shared = (
        rows.where(F.col("size") >= LEAST)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    # Payloads that surely occur once need no shuffle.
    flagged = may_be_among(rows, _hash("digest"), shared.select(_hash("digest")), "shared")
    alone = flagged.where("not shared").withColumn("first", F.lit(None).cast(rows.schema[0].dataType))
    joined = flagged.where("shared").join(shared, "digest", "left")
    both = alone.unionByName(joined).drop("shared")
    refers = F.when((F.col("first") != F.col("page_id")) | F.col("page_id").isNull(), F.col("first"))
    return both.withColumn("refers_to", refers).drop("first")


def chunk_rows(records: DataFrame) -> DataFrame:
    """One row per record and chunk; a revisit has one empty chunk."""
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")
    chunks = F.when(F.length(body) <= CHUNK, F.array(body)).otherwise(
        F.regexp_extract_all(body, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))
    )
    name = F.concat(
        F.lit("<urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(":"),
        F.monotonically_increasing_id().cast("string"),
        F.lit(">"),
    )
    named = records.withColumn("record", name).withColumn("chunks", chunks).drop("payload")
    return named.select(
        "*", F.size("chunks").alias("n_chunks"), F.posexplode("chunks").alias("chunk_no", "chunk")
    ).drop("chunks")


def write_archive(pages: DataFrame, folder: str) -> str:
    """Write the archive's files to ``folder``; returns its boundary."""
    boundary = uuid.uuid4().hex
    rows = chunk_rows(with_revisits(pages))
    first, revisit = F.col("chunk_no") == 0, F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")

    def field(name: str, value: Column, only: Column | None = None) -> Column:
        line = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return line if only is None else F.when(only, line).otherwise("")

    kind = F.when(revisit, "revisit").when(first, "response").otherwise("continuation")
    number = F.col("chunk_no") + 1
    segment = F.concat(F.substring_index("record", ">", 1), F.lit(":"), number, F.lit(">"))
    long = F.col("n_chunks") > 1
    target = F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))
    record = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Boundary: {boundary}\r\n"),
        field("WARC-Type", kind),
        field("WARC-Record-ID", F.when(first, F.col("record")).otherwise(segment)),
        field("WARC-Target-URI", url, F.col("url") != ""),
        field("WARC-Refers-To", target, revisit),
        field("WARC-Segment-Number", number, long),
        field("WARC-Segment-Origin-ID", F.col("record"), ~first),
        field("WARC-Segment-Total-Length", F.col("size"), long & (number == F.col("n_chunks"))),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest"), first),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("chunk", 256))),
        field("Content-Length", F.octet_length("chunk")),
        F.lit("\r\n"),
        F.col("chunk"),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(folder)
    return boundary


def read_chunks(spark: SparkSession, folder: str, boundary: str) -> DataFrame:
    """The archive's rows: record, number, kind, refers_to, whole digest, chunk; each one checked."""
    start = f"WARC/1.1\r\nWARC-Boundary: {boundary}\r\n"
    lines = spark.read.option("lineSep", END + start).text(folder)
    value = F.when(F.startswith("value", F.lit(start)), F.substr("value", F.lit(len(start) + 1)))
    rows = lines.select(F.coalesce(value, F.col("value")).alias("value"))
    rows = rows.select(
        F.substring_index("value", END, 1).alias("head"),
        F.substr("value", F.instr("value", END) + len(END)).alias("rest"),
    )
    fields = F.str_to_map("head", F.lit("\r\n"), F.lit(": "))
    rows = rows.withColumn("fields", fields)
    size = F.col("fields")["Content-Length"].cast("long")
    # Only the last record of a file still has its end.
    chunk = F.when(F.octet_length("rest") == size, F.col("rest")).otherwise(
        F.substr("rest", F.lit(1), F.greatest(F.length("rest") - len(END), F.lit(0)))
    )
    bare = "sha256:"
    rows = rows.select(
        F.coalesce(F.col("fields")["WARC-Segment-Origin-ID"], F.col("fields")["WARC-Record-ID"]).alias(
            "record"
        ),
        F.coalesce(F.col("fields")["WARC-Segment-Number"].cast("int"), F.lit(0)).alias("number"),
        F.col("fields")["WARC-Type"].alias("kind"),
        F.regexp_extract(F.col("fields")["WARC-Refers-To"], "<urn:page:(.*)>", 1).alias("refers_to"),
        F.replace(F.col("fields")["WARC-Payload-Digest"], F.lit(bare), F.lit("")).alias("digest"),
        F.replace(F.col("fields")["WARC-Block-Digest"], F.lit(bare), F.lit("")).alias("block"),
        size.alias("size"),
        chunk.alias("chunk"),
    )
    wrong = (F.octet_length("chunk") != F.col("size")) | (F.sha2("chunk", 256) != F.col("block"))
    broken = F.raise_error(F.concat(F.lit("damaged archive record "), "record"))
    return rows.withColumn("block", F.when(wrong, broken).otherwise(F.col("block")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per record from its chunks in order, with a running digest and no joined payload."""
    record, state, size, digest = None, hashlib.sha256(), 0, None

    def row() -> pa.RecordBatch:
        values = ([record], [size], [state.hexdigest()], [digest])
        types = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(values, types)], ["record", "size", "found", "digest"]
        )

    for batch in batches:
        for name, whole, chunk in zip(*(batch.column(c) for c in ("record", "digest", "chunk"))):
            if name.as_py() != record:
                if record is not None:
                    yield row()
                record, state, size, digest = name.as_py(), hashlib.sha256(), 0, whole.as_py()
            data = chunk.as_py().encode()
            state.update(data)
            size += len(data)
    if record is not None:
        yield row()


def read_records(spark: SparkSession, folder: str, boundary: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    rows = read_chunks(spark, folder, boundary)
    single = rows.where("number = 0").select(
        "record", "kind", "refers_to", "size", F.col("block").alias("found"), "digest"
    )
    long = rows.where("number > 0 and block is not null").select(
        "record", "number", "digest", "chunk"
    )
    joined = (
        long.repartition("record")
        .sortWithinPartitions("record", "number")
        .select("record", "digest", "chunk")
        .mapInArrow(_joined, "record string, size bigint, found string, digest string")
        .select("record", F.lit("response").alias("kind"), F.lit("").alias("refers_to"), "size", "found", "digest")
    )
    records = single.unionByName(joined)
    page = F.regexp_extract("record", "<urn:page:(-?[0-9]*)", 1)
    whole = records.where("kind = 'response'").select(
        F.when(page != "", page.try_cast("long")).alias("page_id"), "size", "found",
        F.when(
            F.col("found") != F.col("digest"),
            F.raise_error(F.concat(F.lit("damaged payload "), "record")),
        ).otherwise(F.lit("response")).alias("record_type"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = records.where("kind = 'revisit'").select(
        F.when(page != "", page.try_cast("long")).alias("page_id"),
        "digest",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )
    # A revisit has its payload's length and digest from the record that it refers to.
    known = whole.select(F.col("page_id").alias("of"), "size", "found").distinct()
    same = (revisits["refers_to"] == known["of"]) & (revisits["digest"] == known["found"])
    resolved = revisits.join(known, same, "left").select(
        "page_id", "size", "found", F.lit("revisit").alias("record_type"), "refers_to"
    )
    return whole.unionByName(resolved).select(
        "page_id",
        F.col("size").alias("payload_bytes"),
        F.col("found").alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page to an archive in the shared folder and read the archive back."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_records(spark, folder, write_archive(pages, folder))
