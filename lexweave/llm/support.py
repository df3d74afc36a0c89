"""Small helpers of the subpackage: column names, text keys, equal-component labels."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import cut_lineage, ensure_checkpoint_dir


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores added until no column of ``taken`` has it in any letter case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null and empty texts share a key."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def read(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of a data folder, in the splits that its files have."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage as a checkpoint does, in less space."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one computation in the shared folder, removed when they are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written once; what is read from then on is the written table."""
        path = f"{self.folder}/{len(self.paths)}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        return table

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of :meth:`keep`; nothing lazy may still read them."""
        for table in tables:
            self._remove(self.paths[id(table)])

    def clear(self) -> None:
        self._remove(self.folder)


#: Keys that a task remembers in :func:`once_a_task`; forgetting costs a row, not a result.
SEEN = 1 << 17


def once_a_task(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose binary ``key`` the task has had before, as far as it remembers: a
    cheap first step where rows of one key are alike, so that copies are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh_rows = []
            for at, value in enumerate(batch.column(key).to_pylist()):
                if value not in seen:
                    fresh_rows.append(at)
                    seen.add(value)
            if len(seen) > SEEN:
                seen.clear()
            yield batch.take(pa.array(fresh_rows, pa.int32()))

    return rows.mapInArrow(run, rows.schema)


#: Edges that a task of :func:`components` reads.
EDGES = 100_000


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Label every node of the undirected ``edges`` (a, b) with the least node it reaches.

    Returns (node, root). Alternating star contractions: every node first links its larger
    neighbours, then itself and its smaller ones, to the least node it sees; each round is two
    combinable minimum aggregations, so a node with very many links is never gathered in one task.
    The round's edges are written to the shared folder, which also ends the lineage; they are read with a
    task per ``EDGES`` of them, so what fits one task needs no shuffles.
    """

    def held(df: DataFrame) -> DataFrame:
        kept = cut_lineage(df)
        return kept.coalesce(kept.count() // EDGES + 1)

    current = held(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct()
    )
    signature = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.where("v > u")
            .join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u")
        current = held(
            linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(small.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        # The sets are equal once the two stars change nothing; counts and sums tell.
        told = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(told) == signature:
            break
        signature = tuple(told)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


#: Bits of the map that :func:`may_be_among` broadcasts: 1 MB of bits, about 2 MB as rows.
MAP_BITS = 23


def may_be_among(df: DataFrame, own: Column, keys: DataFrame, name: str) -> DataFrame:
    """Add ``name``: false where ``own``, a 64-bit hash, is surely not in the one column of ``keys``.

    The keys set bits of a map of fixed size, which is broadcast however many keys there are; with
    very many it merely tells less. Rows flagged true still need the exact join, the others don't.
    """
    word, bit = fresh("map_word", [*df.columns, name]), fresh("map_bits", [*df.columns, name])
    key = keys.columns[0]
    rest = 64 - MAP_BITS

    def place(h: Column) -> Column:
        return F.shiftrightunsigned(h, rest)

    bits = (
        keys.select(place(F.col(key)).alias("place"))
        .select(
            F.shiftrightunsigned("place", 6).cast("int").alias(word),
            F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"),
        )
        .groupBy(word)
        .agg(F.bit_or("bit").alias(bit))
    )
    joined = df.withColumn(name, place(own)).withColumn(
        word, F.shiftrightunsigned(name, 6).cast("int")
    )
    joined = joined.join(F.broadcast(bits), word, "left")
    is_set = F.expr(f"(shiftright(`{bit}`, cast(`{name}` & 63 as int)) & 1) = 1")
    return joined.withColumn(name, F.coalesce(is_set, F.lit(False))).drop(word, bit)


#: A key is hot if it has at least this part of all rows; there can be no more hot keys than this.
HOT_KEYS = 1000


def looked_up(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined with ``table``, which has one row per ``key`` and shares no other column.

    Keys with a thousandth of all rows or more, a thousand at most, get their row by broadcast; all other keys
    are shuffled, so no task holds more than a small part of the rows of ``df``. Null keys have no
    row. ``df`` is read three times and should be a written table.
    """
    flag = fresh("is_hot", [*df.columns, *table.columns])
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(flag))
    total = counted.agg(F.sum(flag)).first()[0] or 0
    hot = cut_lineage(counted.where(F.col(flag) * HOT_KEYS >= total).where(F.col(flag) > 1).select(key))
    rows = cut_lineage(table.join(F.broadcast(hot), key, "left_semi"))
    hot = hot.join(F.broadcast(rows), key, "left").withColumn(flag, F.lit(True))
    split = df.join(F.broadcast(hot), key, "left")
    settled = F.col(flag).isNotNull() | F.col(key).isNull()
    others = split.where(~settled).select(*df.columns).join(table, key, "left")
    return split.where(settled).select(*others.columns).unionByName(others)
