"""Rule dictionaries as small tables, and tables back as rule dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.rules import intents, rewrites, tagging
from lexweave.session import literal_table


def rewrite_rules(spark: SparkSession) -> DataFrame:
    """``(stage, region, src, dst, context)`` of all default rewrite rules."""
    rows = [("fix", None, s, d, None) for s, d in rewrites.TRANSCRIPTION_FIXES.items()]
    rows += [
        ("word", region, s, d, None)
        for region, words in rewrites.DIALECT_WORDS.items()
        for s, d in words.items()
    ]
    for region, particles in rewrites.PARTICLES.items():
        for src, (question, request) in particles.items():
            rows += [("particle", region, src, question, "question")]
            rows += [("particle", region, src, request, "request")]
    table = literal_table(
        spark, rows, "stage string, region string, src string, dst string, context string"
    )
    return table.withColumns({c: T.normalize_surface(F.col(c)) for c in ("src", "dst")})


def intent_rules(spark: SparkSession) -> DataFrame:
    rows = [(i, p) for i, found in intents.INTENT_PATTERNS.items() for p in found]
    return literal_table(spark, rows, "intent string, pattern string")


def slot_values(spark: SparkSession) -> DataFrame:
    """``(slot, position, value)`` of the configured entity dictionaries."""
    groups = {
        "contact_name": tagging.CONTACTS,
        "phone_number": tagging.PHONES,
        "location": tagging.LOCATIONS,
        "song": tuple(s for s, _ in tagging.TRACKS),
        "artist": tuple(dict.fromkeys(a for _, a in tagging.TRACKS)),
        "reminder_text": tagging.REMINDERS,
        "datetime": tagging.DATETIMES,
        "weather_time": tagging.WEATHER_TIMES,
    }
    rows = [(slot, i, v) for slot, values in groups.items() for i, v in enumerate(values)]
    return literal_table(spark, rows, "slot string, position int, value string")


def rules_from_table(rules: DataFrame) -> dict[str, dict[str, str]]:
    """A rule table ``(region, src, dst)`` as rewrite dictionaries, for inline rewriting."""
    out: dict[str, dict[str, str]] = {}
    for row in rules.select("region", "src", "dst").orderBy("region", "src").collect():
        out.setdefault(row["region"], {})[row["src"]] = row["dst"]
    return out


def entries_from_table(lexicon: DataFrame) -> dict[str, list[str]]:
    """A curated lexicon ``(slot, value)`` as tagging dictionaries; a mined one is joined as a table
    (:func:`lexweave.operators.lexicon.lexicon_hits`)."""
    out: dict[str, list[str]] = {}
    for row in lexicon.select("slot", "value").orderBy("slot", "value").collect():
        out.setdefault(row["slot"], []).append(row["value"])
    return out
