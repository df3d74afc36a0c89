"""Registered queries over the shared tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r6(x) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


# SQL spelling of the text functions.
def sql_ws(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x0b\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def sql_casefold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_surface(x: str) -> str:
    return sql_ws(sql_casefold(x))


def sql_drop_punctuation(x: str) -> str:
    return sql_ws(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s:/]', ' ', 'g')")


def sql_canonical(x: str) -> str:
    return sql_drop_punctuation(sql_casefold(x))


def sql_plain(x: str) -> str:
    return f"replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D')"


def sql_folded(x: str) -> str:
    return sql_plain(sql_canonical(x))


def sql_key(x: str) -> str:
    return f"sha256('42:' || {x})"


def sql_split(x: str) -> str:
    return (
        f"CASE WHEN substr({sql_key(x)}, 1, 2) < 'b3' THEN 'train' "
        f"WHEN substr({sql_key(x)}, 1, 2) < 'd9' THEN 'validation' ELSE 'test' END"
    )


def split_of(x: Column) -> Column:
    """A fixed share of the hash space per split."""
    head = F.substring(T.stable_order_key(x), 1, 2)
    return F.when(head < "b3", "train").when(head < "d9", "validation").otherwise("test")


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return read_table(spark, folder, "documents", *columns)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in the shape of labelled samples."""
    d = documents(spark, folder, "doc_id", "text", "lang", "source")
    region = (
        F.when(F.col("lang") == "en", "standard")
        .when(F.col("lang") == "fr", "north")
        .when(F.col("lang") == "de", "central")
        .otherwise("south")
    )
    intents = F.array(*[F.lit(x) for x in SAMPLE_INTENTS])
    quality = F.array(*[F.lit(x) for x in ("reviewed", "auto_mapped", "template_generated")])
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("group_id"),
        "text",
        region.alias("region"),
        F.get(intents, (F.col("doc_id") % 6).cast("int")).alias("intent"),
        F.col("source"),
        F.get(quality, (F.col("doc_id") % 3).cast("int")).alias("annotation_quality"),
        split_of(F.col("doc_id")).alias("split"),
    )


SAMPLE_INTENTS = (
    "set_reminder",
    "set_alarm",
    "ask_weather",
    "play_music",
    "call_contact",
    "chitchat",
)
SQL_SAMPLES = f"""samples AS (
  SELECT doc_id AS id, source AS group_id, text, source,
         CASE lang WHEN 'en' THEN 'standard' WHEN 'fr' THEN 'north' WHEN 'de' THEN 'central'
              ELSE 'south' END AS region,
         [{", ".join(repr(x) for x in SAMPLE_INTENTS)}][(doc_id % 6 + 1)::INT] AS intent,
         ['reviewed', 'auto_mapped', 'template_generated'][(doc_id % 3 + 1)::INT]
           AS annotation_quality,
         {sql_split("doc_id")} AS split
  FROM documents)"""


def load() -> None:
    """Import the query modules, which register themselves."""
    from lexweave.plans import queries_models  # noqa: F401
    from lexweave.plans import queries_quality  # noqa: F401
    from lexweave.plans import queries_scores  # noqa: F401
    from lexweave.plans import queries_text  # noqa: F401
