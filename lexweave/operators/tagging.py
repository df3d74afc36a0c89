"""Entity tagging with patterns and dictionaries: one narrow stage, all in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.markup import spoken_phone
from lexweave.functions.stage import evaluate, let
from lexweave.operators.lexicon import (
    InlineLexicon,
    longest_in_texts,
    union_distinct_lexicon,
)
from lexweave.rules import tagging as R
from lexweave.session import literal_table

DEFAULT_ENTRIES = {
    "contact_name": R.CONTACTS,
    "location": R.LOCATIONS,
    "datetime": (*R.DATETIMES, *R.WEATHER_TIMES),
    "reminder_text": R.REMINDERS,
    "song": tuple(song for song, _ in R.TRACKS),
    "artist": tuple(artist for _, artist in R.TRACKS),
}


class Dictionaries:
    """Configured entries followed by learned ones, ready to tag with."""

    def __init__(
        self,
        configured: Mapping[str, Sequence[str]] = DEFAULT_ENTRIES,
        learned: Mapping[str, Sequence[str]] | None = None,
    ):
        learned = learned or {}
        self.lexicons = {
            slot: InlineLexicon([*values, *learned.get(slot, ())])
            for slot, values in configured.items()
        }

    def attach(self, df: DataFrame) -> DataFrame:
        return df

    def best(self, slot: str, text: Column, folded: Column) -> Column:
        return self.lexicons[slot].best(text, folded)


class TableDictionaries:
    """Entries of any number as a table ``(slot, value, ord)``, found by joins before the rules run.

    Each distinct text meets the lexicon once; what the rules need of it, the best entry of each slot, comes
    back as one small map per text. Slots without entries in the table have none.
    """

    def __init__(self, lexicon: DataFrame):
        self.lexicon = lexicon

    @classmethod
    def of(
        cls,
        spark: SparkSession,
        configured: Mapping[str, Sequence[str]] = DEFAULT_ENTRIES,
        learned: DataFrame | None = None,
    ) -> TableDictionaries:
        """Configured entries followed by learned ones, a table ``(slot, value)``."""
        rows = [(slot, i, v) for slot, values in configured.items() for i, v in enumerate(values)]
        own = literal_table(spark, rows, "slot string, position int, value string")
        if learned is None:
            learned = own.select("slot", "value").limit(0)
        return cls(union_distinct_lexicon(own, learned))

    def attach(self, df: DataFrame) -> DataFrame:
        keyed = df.withColumn("__text_key", F.md5("__t"))
        texts = keyed.select("__text_key", "__t").dropDuplicates(["__text_key"])
        found = longest_in_texts(texts, self.lexicon, "__t", "__text_key")
        known = found.groupBy(F.col("id").alias("__text_key")).agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("__known")
        )
        return keyed.join(known, "__text_key", "left").drop("__text_key")

    def best(self, slot: str, text: Column, folded: Column) -> Column:
        return F.col("__known")[slot]


def clean_entity(x: Column) -> Column:
    """Strip conversational endings and edge punctuation; nothing left is null."""
    cut = F.regexp_replace(F.trim(x), T.java(R.ENTITY_END), "")
    cut = F.regexp_replace(cut, T.java(R.POLITE_END), "")
    return let(F.btrim(cut, F.lit(R.EDGE_PUNCTUATION)), lambda c: F.when(c != "", c))


def _replace_first(x: Column, literal_value: Column, replacement: str) -> Column:
    pattern = F.concat(F.lit("(?s)^(.*?)"), T.whole_word(literal_value))
    return F.regexp_replace(x, pattern, F.lit("$1" + replacement))


def tag_datetime(text: Column, folded: Column, dictionaries: Dictionaries) -> Column:
    """Longest candidate, then most spaces, then the earliest rule; null for invalid clocks."""
    hits = [
        F.transform(F.regexp_extract_all(text, F.lit(T.java(p)), F.lit(0)), F.trim)
        for p in R.DATETIME
    ]
    known = dictionaries.best("datetime", text, folded)
    candidates = F.filter(
        F.concat(F.array(known), *hits), lambda c: c.isNotNull() & (c != "")
    )
    ranked = F.transform(
        candidates,
        lambda c, i: F.struct(
            F.char_length(c).alias("n"),
            (F.char_length(c) - F.char_length(F.replace(c, F.lit(" ")))).alias("spaces"),
            (-i).alias("o"),
            c.alias("value"),
        ),
    )
    return F.when(~text.rlike(T.java(R.INVALID_CLOCK)), F.array_max(ranked)["value"])


def tag_phone(text: Column) -> Column:
    """Phone number as written; a longer digit run is not cut down to one."""
    written = let(
        F.regexp_extract(text, T.java(R.PHONE), 0),
        lambda found: F.when((found != "") & ~text.rlike(T.java(R.PHONE_OVERLONG)), T.collapse(found)),
    )
    return F.coalesce(written, spoken_phone(text))


def _contact_residual(text: Column) -> Column:
    value = text
    for cue in R.CONTACT_CUE:
        value = F.trim(F.regexp_replace(value, T.java(cue), ""))
    return clean_entity(value)


def tag_contact(text: Column, folded: Column, dictionaries: Dictionaries) -> Column:
    """Known contact, else what follows the calling cue unless it is no name."""

    def named(value: Column) -> Column:
        bad = value.isin(*R.CONTACT_EMPTY)
        for pattern in R.CONTACT_REJECT:
            bad = bad | value.rlike(T.java(pattern))
        return F.when(~bad, value)

    found = let(_contact_residual(text), named)
    return F.coalesce(dictionaries.best("contact_name", text, folded), found)


def tag_location(text: Column, folded: Column, dictionaries: Dictionaries) -> Column:
    cue = F.regexp_extract(text, T.java(R.LOCATION_CUE), 1)
    found = let(clean_entity(cue), lambda v: F.when(~v.rlike(T.java(R.LOCATION_INVALID)), v))
    return F.coalesce(dictionaries.best("location", text, folded), found)


def _music_entity(cue: Column) -> Column:
    def named(value: Column) -> Column:
        bad = value.rlike(T.java(R.MUSIC_INVALID)) | value.rlike(T.java(R.MUSIC_STOP))
        return F.when(~bad, value)

    return let(clean_entity(cue), named)


def tag_artist(text: Column, folded: Column, dictionaries: Dictionaries) -> Column:
    cues = [
        _music_entity(
            F.try_element_at(F.regexp_extract_all(text, F.lit(T.java(p)), F.lit(1)), F.lit(-1))
        )
        for p in R.ARTIST_CUES
    ]
    return F.coalesce(dictionaries.best("artist", text, folded), *cues)


def tag_song(text: Column, folded: Column, dictionaries: Dictionaries) -> Column:
    found = let(
        _music_entity(F.regexp_extract(text, T.java(R.SONG_CUE), 1)),
        lambda v: F.when(~F.startswith(v, F.lit(R.SONG_NOT_PREFIX)), v),
    )
    return F.coalesce(dictionaries.best("song", text, folded), found)


def tag_reminder(
    text: Column, folded: Column, datetime: Column, dictionaries: Dictionaries
) -> Column:
    """Known reminder, else the text with triggers, time and politeness peeled off in order."""
    rest = text
    for pattern in R.REMINDER_PEEL:
        if pattern == "{datetime}":
            rest = let(rest, lambda r: F.coalesce(_replace_first(r, datetime, " "), r))
        else:
            rest = F.regexp_replace(F.trim(rest), T.java(pattern), "")

    def wanted(value: Column) -> Column:
        bad = value.isin("", *R.REMINDER_EMPTY) | value.rlike(T.java(R.REMINDER_INCOMPLETE))
        return F.when(~bad, value)

    found = let(T.collapse(F.btrim(rest, F.lit(R.EDGE_PUNCTUATION))), wanted)
    return F.coalesce(dictionaries.best("reminder_text", text, folded), found)


def tag_columns(
    df: DataFrame,
    text: str = "normalized_text",
    dictionaries: Dictionaries | TableDictionaries | None = None,
) -> DataFrame:
    """Add ``tag_<slot>`` columns with every slot's candidate. Which count depends on intent.

    Configured entries travel inside the expressions; a lexicon of any size is a table that is joined.
    """
    d = dictionaries or Dictionaries()
    out = evaluate(df, __t=T.normalize_surface(F.col(text)))
    out = evaluate(d.attach(out), __f=T.strip_diacritics(F.col("__t")))
    t, f = F.col("__t"), F.col("__f")
    out = evaluate(out, tag_datetime=tag_datetime(t, f, d), tag_phone_number=tag_phone(t))
    return evaluate(
        out,
        tag_location=tag_location(t, f, d),
        tag_song=tag_song(t, f, d),
        tag_artist=tag_artist(t, f, d),
        tag_contact_name=F.when(F.col("tag_phone_number").isNull(), tag_contact(t, f, d)),
        tag_reminder_text=tag_reminder(t, f, F.col("tag_datetime"), d),
    ).drop("__t", "__f", "__known")


# Slots in the order they are reported.
_ORDER = {
    "set_reminder": ("datetime", "reminder_text"),
    "set_alarm": ("datetime",),
    "ask_weather": ("datetime", "location"),
    "play_music": ("song", "artist"),
    "call_contact": ("phone_number", "contact_name"),
}


def slots_by_intent(intent: Column, order: Mapping[str, Sequence[str]] = _ORDER) -> Column:
    """Slot map of a tagged row, holding only what the intent allows."""
    out = F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")
    result = None
    for name, slots in order.items():
        entries = F.array(
            *[
                F.when(
                    F.col(f"tag_{s}").isNotNull(),
                    F.struct(F.lit(s).alias("key"), F.array(f"tag_{s}").alias("value")),
                )
                for s in slots
            ]
        )
        mapped = F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
        result = (
            F.when(intent == name, mapped) if result is None else result.when(intent == name, mapped)
        )
    return result.otherwise(out)


def matched_slots(slots: Column) -> Column:
    """Trace entries ``slot:value`` of a slot map."""
    return F.transform(
        F.map_entries(slots), lambda e: F.concat(e["key"], F.lit(":"), e["value"][0])
    )


def extract_by_intent(
    df: DataFrame,
    intent: str = "intent",
    text: str = "normalized_text",
    dictionaries: Dictionaries | TableDictionaries | None = None,
    output: str = "slots",
) -> DataFrame:
    """Tag rows and keep the slots their intent allows."""
    tagged = tag_columns(df, text, dictionaries)
    return tagged.withColumn(output, slots_by_intent(F.col(intent)))


def oracle_and_runtime(
    df: DataFrame, gold: str = "intent", predicted: str = "predicted", text: str = "normalized_text",
    dictionaries: Dictionaries | TableDictionaries | None = None,
) -> DataFrame:
    """Slots under the gold intent and under the predicted one, from a single tagging pass."""
    tagged = tag_columns(df, text, dictionaries)
    return tagged.withColumns(
        {
            "oracle_slots": slots_by_intent(F.col(gold)),
            "runtime_slots": slots_by_intent(F.col(predicted)),
        }
    )
