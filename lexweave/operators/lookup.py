"""Lookups against dimension tables: aliases, catalogues, code buckets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.rules import domains as D
from lexweave.session import literal_table


def lookup_key(x: Column) -> Column:
    return T.normalize_surface(x)


def alias_table(contacts: DataFrame) -> DataFrame:
    """``(name, aliases, phone_number)`` to one row per name or alias."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return contacts.select("name", "phone_number", F.explode(names).alias("alias")).withColumn(
        "alias_key", lookup_key(F.col("alias"))
    )


def duplicate_aliases(aliases: DataFrame) -> DataFrame:
    return aliases.groupBy("alias_key").agg(F.count("*").alias("n")).where("n > 1")


def alias_lookup(df: DataFrame, contacts: DataFrame, column: str = "contact_name") -> DataFrame:
    """Add ``resolved_name`` and ``resolved_phone``; both null when nobody has the name."""
    aliases = alias_table(contacts).select(
        "alias_key",
        F.col("name").alias("resolved_name"),
        F.col("phone_number").alias("resolved_phone"),
    )
    keyed = df.withColumn("alias_key", lookup_key(F.col(column)))
    return keyed.join(aliases, "alias_key", "left").drop("alias_key")


def catalog_match(
    df: DataFrame,
    catalog: DataFrame,
    song: str = "song",
    artist: str = "artist",
    position: str = "position",
) -> DataFrame:
    """Add ``n_matches`` and the first match, by song and/or artist; a missing key matches all,
    two missing keys match nothing.

    The catalogue collapses to one row per key before the joins, so a popular artist costs one
    row, not one per track. Three equi-joins replace the wildcard condition.
    """
    tracks = catalog.select(
        lookup_key(F.col("song")).alias("sk"),
        lookup_key(F.col("artist")).alias("ak"),
        F.struct(F.col(position).alias("p"), "song", "artist").alias("track"),
    )
    keyed = df.withColumns(
        {"__sk": lookup_key(F.col(song)), "__ak": lookup_key(F.col(artist))}
    )
    out = keyed
    keys = {"both": ["sk", "ak"], "song": ["sk"], "artist": ["ak"]}
    for name, columns in keys.items():
        side = tracks.groupBy(*columns).agg(
            F.count("*").alias(f"__n_{name}"), F.min("track").alias(f"__t_{name}")
        )
        wanted = {
            "both": F.col("__sk").isNotNull() & F.col("__ak").isNotNull(),
            "song": F.col("__sk").isNotNull() & F.col("__ak").isNull(),
            "artist": F.col("__sk").isNull() & F.col("__ak").isNotNull(),
        }[name]
        # Rows of another kind carry a null key, so they never meet this side.
        probe = {c: f"__{name}_{c}" for c in columns}
        out = out.withColumns({v: F.when(wanted, F.col(f"__{c}")) for c, v in probe.items()})
        side = side.withColumnsRenamed(probe)
        out = out.join(side, list(probe.values()), "left").drop(*probe.values())
    first = F.coalesce("__t_both", "__t_song", "__t_artist")
    return out.withColumns(
        {
            "n_matches": F.coalesce("__n_both", "__n_song", "__n_artist", F.lit(0)).cast("bigint"),
            "match_song": first["song"],
            "match_artist": first["artist"],
        }
    ).drop("__sk", "__ak", *[f"__{x}_{n}" for n in keys for x in ("n", "t")])


def catalog_matches(
    df: DataFrame, catalog: DataFrame, id_col: str = "id", song: str = "song", artist: str = "artist"
) -> DataFrame:
    """The matches themselves, one row each: ``(id, song, artist)``."""
    tracks = catalog.select(
        lookup_key(F.col("song")).alias("sk"),
        lookup_key(F.col("artist")).alias("ak"),
        F.col("song").alias("match_song"),
        F.col("artist").alias("match_artist"),
    )
    keyed = df.select(
        F.col(id_col).alias("id"),
        lookup_key(F.col(song)).alias("s"),
        lookup_key(F.col(artist)).alias("a"),
    )
    by_song = keyed.join(tracks, F.col("s") == F.col("sk")).where(
        F.col("a").isNull() | (F.col("a") == F.col("ak"))
    )
    by_artist = keyed.where("s is null").join(tracks, F.col("a") == F.col("ak"))
    return by_song.unionByName(by_artist).select(
        "id", F.col("match_song").alias("song"), F.col("match_artist").alias("artist")
    )


def code_bucket(
    df: DataFrame,
    column: str,
    buckets: Mapping[str, Sequence[int]] = D.WEATHER_CODES,
    otherwise: str = D.WEATHER_UNKNOWN,
    output: str = "condition",
) -> DataFrame:
    """Map codes to named buckets through a small code table."""
    rows = [(code, name) for name, codes in buckets.items() for code in codes]
    table = literal_table(df.sparkSession, rows, f"{column} int, {output} string")
    joined = df.join(table, column, "left")
    return joined.withColumn(output, F.coalesce(output, F.lit(otherwise)))
