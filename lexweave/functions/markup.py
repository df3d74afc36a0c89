"""Slot markup, spoken digits and templates, row by row in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.stage import let, literal

# Markup and template syntax, joining words, wake words, digit words.
SPAN_MARKUP = r"\[([a-z_]+)\s*:\s*([^\]]+)\]"
PLACEHOLDER = r"\{([a-z_]+)\}"
TEMPORAL_JOINER = r"(?iu)^\s*(?:(?:lúc|vào|khoảng|tầm|đến|tới)\s*)?\z"
WAKE_WORD = r"(?iu)^(olly|alexa)\s*[,，]?\s*"
REMINDER_MARKER = r"(?iu)\b(nhắc|nhở|lời nhắc)\b"
DIGIT_WORDS = {
    "không": "0",
    "linh": "0",
    "lẻ": "0",
    "một": "1",
    "hai": "2",
    "ba": "3",
    "bốn": "4",
    "tư": "4",
    "năm": "5",
    "lăm": "5",
    "sáu": "6",
    "bảy": "7",
    "tám": "8",
    "chín": "9",
}
PLACEHOLDER_SLOTS = {
    "weather_time": "datetime",
    "datetime": "datetime",
    "reminder_text": "reminder_text",
    "location": "location",
    "song": "song",
    "artist": "artist",
    "contact_name": "contact_name",
    "phone_number": "phone_number",
}

SPANS = "array<struct<label:string,value:string,start:int,end:int>>"


#: Lengths are summed, and texts are cut, in blocks of so many: what a row costs grows with its length alone.
_SUMMED, _CUT = 64, 1024


def _starts(sizes: Column) -> Column:
    """For each size the sum of those before it."""

    def running(xs: Column, first: Column) -> Column:
        return F.aggregate(
            xs,
            F.array(first),
            lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
            lambda acc: F.slice(acc, 1, F.size(acc) - 1),
        )

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)

    def spread(blocks: Column) -> Column:
        firsts = running(F.transform(blocks, total), F.lit(0))
        return F.flatten(F.zip_with(blocks, firsts, running))

    last = F.greatest(F.size(sizes) - 1, F.lit(0))
    numbers = F.sequence(F.lit(0), (last / _SUMMED).cast("int"))
    return let(F.transform(numbers, lambda i: F.slice(sizes, i * _SUMMED + 1, _SUMMED)), spread)


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end`` of a text in blocks."""
    size = F.greatest(end - start, F.lit(0))
    first = (start / _CUT).cast("int")
    near = F.slice(blocks, first + 1, (size / _CUT).cast("int") + 2)
    return F.substring(F.array_join(near, ""), start - first * _CUT + 1, size)


def _in_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0))


def parse_annotations(marked: Column) -> Column:
    """``[label : value]`` markup to a struct ``(text, spans)`` with offsets on the plain text."""
    pattern = T.java(SPAN_MARKUP)

    def placed(pieces: Column, tail: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.char_length(p["gap"]) + F.char_length(p["value"]))

        def span(piece: Column, before: Column) -> Column:
            start = before + F.char_length(piece["gap"])
            return F.struct(
                piece["label"].alias("label"),
                piece["value"].alias("value"),
                start.alias("start"),
                (start + F.char_length(piece["value"])).alias("end"),
            )

        plain = F.array_join(F.transform(pieces, lambda p: F.concat(p["gap"], p["value"])), "")
        return F.struct(
            F.concat(plain, tail).alias("text"),
            F.zip_with(pieces, let(sizes, _starts), span).cast(SPANS).alias("spans"),
        )

    def parsed(text: Column) -> Column:
        labels = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        values = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), T.normalize_text
        )

        def pieces(gaps: Column) -> Column:
            return F.zip_with(
                F.arrays_zip(labels.alias("label"), values.alias("value")),
                F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))),
                lambda lv, gap: F.struct(
                    lv["label"].alias("label"), lv["value"].alias("value"), gap.alias("gap")
                ),
            )

        return let(
            F.split(text, pattern, -1),
            lambda gaps: let(pieces(gaps), lambda found: placed(found, F.element_at(gaps, -1))),
        )

    return let(marked, lambda text: F.when(text.isNotNull(), parsed(text)))


def combine_spans(text: Column, spans: Column, labels: Sequence[str]) -> Column:
    """Merge neighbouring spans when only white space or one joining word lies between them.

    One component or several, in text order; null when no span has one of the labels.
    """
    chosen = F.array_sort(
        F.transform(
            F.filter(spans, lambda s: s["label"].isin(*labels)),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
        )
    )

    def merged(found: Column, blocks: Column) -> Column:
        def begins(i: Column) -> Column:
            gap = _cut(blocks, F.get(found, i - 1)["end"], F.get(found, i)["start"])
            return (i == 0) | ~F.coalesce(gap.rlike(T.java(TEMPORAL_JOINER)), F.lit(False))

        def part(first: Column, after: Column) -> Column:
            own = _cut(blocks, F.get(found, first)["start"], F.get(found, after - 1)["end"])
            return T.normalize_text(own)

        firsts = F.filter(F.sequence(F.lit(0), F.size(found) - 1), begins)
        ends = F.array(F.size(found))
        return let(
            firsts,
            lambda f: F.zip_with(f, F.concat(F.slice(f, F.lit(2), F.size(f)), ends), part),
        )

    return let(
        chosen,
        lambda found: F.when(
            F.size(found) > 0, let(_in_blocks(text), lambda blocks: merged(found, blocks))
        ),
    )


def spans_hold(text: Column, spans: Column) -> Column:
    """Does the text show every span's value at its offsets?"""
    return let(
        _in_blocks(text),
        lambda blocks: F.forall(spans, lambda s: _cut(blocks, s["start"], s["end"]) == s["value"]),
    )


def first_span(spans: Column, label: str) -> Column:
    return F.get(F.filter(spans, lambda s: s["label"] == label), F.lit(0))["value"]


def wake_word_trim(x: Column) -> Column:
    return T.normalize_text(F.regexp_replace(x, T.java(WAKE_WORD), ""))


def spoken_phone(x: Column) -> Column:
    """Nine to eleven digit words after a calling cue, as digits; null unless it starts 0 or 84."""
    word = "(?:" + "|".join(DIGIT_WORDS) + ")"
    run = F.regexp_extract(
        x, T.java(rf"(?:số|gọi)\s+({word}(?:\s+{word}){{8,10}})(?!\w)"), 1
    )
    table = literal(DIGIT_WORDS, "map<string,string>")

    def spelled(found: Column) -> Column:
        return F.array_join(
            F.transform(F.split(found, r"(?U)\s+"), lambda w: F.element_at(table, w)), ""
        )

    def numbered(digits: Column) -> Column:
        begins = F.startswith(digits, F.lit("0")) | F.startswith(digits, F.lit("84"))
        return F.when(begins, digits)

    return let(run, lambda found: F.when(found != "", let(spelled(found), numbered)))


def fill_template(template: Column, values: Column) -> Column:
    filled = F.aggregate(
        F.map_entries(values),
        template,
        lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )
    return T.normalize_text(filled)


def template_slots(template: Column) -> Column:
    """Slot names that a template's placeholders stand for."""
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    table = literal(PLACEHOLDER_SLOTS, "map<string,string>")
    mapped = F.transform(names, lambda n: F.try_element_at(table, n))
    return F.array_sort(F.array_distinct(F.filter(mapped, lambda n: n.isNotNull())))


def slots_for_template(intent: Column, template: Column, values: Column) -> Column:
    """Slot labels of a filled template."""

    def uses(name: str) -> Column:
        return F.contains(template, F.lit("{" + name + "}"))

    def entry(slot: str, value: str, when: Column) -> Column:
        return F.when(
            when,
            F.struct(F.lit(slot).alias("key"), F.array(F.element_at(values, value)).alias("value")),
        )

    weather = intent == "ask_weather"
    music = intent == "play_music"
    call = intent == "call_contact"
    entries = F.array(
        entry("datetime", "weather_time", weather & uses("weather_time")),
        entry("datetime", "datetime", uses("datetime") & ~(weather & uses("weather_time"))),
        entry("reminder_text", "reminder_text", intent == "set_reminder"),
        entry("location", "location", weather),
        entry("song", "song", music & uses("song")),
        entry("artist", "artist", music & uses("artist")),
        entry("contact_name", "contact_name", call & uses("contact_name")),
        entry("phone_number", "phone_number", call & uses("phone_number")),
    )
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
