"""Marked spans of long texts: offsets, components and how often a text is read."""

import random
import re

from pyspark.sql import functions as F

from lexweave.functions import markup as M


def _analyzed(df):
    return df._jdf.queryExecution().analyzed().toString()


def _plain(marked):
    text, spans, at = "", [], 0
    for m in re.finditer(M.SPAN_MARKUP, marked):
        text += marked[at : m.start()]
        value = " ".join(m[2].split())
        spans.append((m[1], value, len(text), len(text) + len(value)))
        text, at = text + value, m.end()
    return text + marked[at:], spans


def _components(text, spans):
    out = []
    for _, _, start, end in sorted((s for s in spans if s[0] == "date"), key=lambda s: s[2:]):
        if out and re.match(r"\s*(?:(?:lúc|vào)\s*)?\Z", text[out[-1][1] : start]):
            out[-1][1] = end
        else:
            out.append([start, end])
    return [" ".join(text[a:b].split()) for a, b in out] or None


def test_offsets_and_components_of_long_texts(spark):
    rng = random.Random(5)
    bits = ["mai", " lúc ", " ", "𝄞 ở ", "[date : tám  giờ]", "[place : huế]", "[date :một]", "x" * 700]
    rows = [(i, "".join(rng.choices(bits, k=rng.choice([0, 3, 64, 65, 400])))) for i in range(40)]
    df = spark.createDataFrame([*rows, (99, None)], "id int, t string")
    p = df.select("id", M.parse_annotations(F.col("t")).alias("p")).select("id", "p.text", "p.spans")
    p = spark.createDataFrame(p.collect(), p.schema)
    parts = M.combine_spans(F.col("text"), F.col("spans"), ["date"])
    out = p.withColumns({"parts": parts, "hold": M.spans_hold(F.col("text"), F.col("spans"))})
    found = {r.id: r for r in out.collect()}
    for i, marked in rows:
        text, spans = _plain(marked)
        assert found[i].text == text and [tuple(s) for s in found[i].spans] == spans
        assert found[i].parts == _components(text, spans) and found[i].hold
    assert found[99].text is None and found[99].spans is None and found[99].parts is None
    assert max(len(r.spans or ()) for r in found.values()) > 64


def test_marked_text_is_read_once_and_not_searched_from_its_start(spark):
    df = spark.createDataFrame([("a [date : b]",)], "t string")
    marked = F.concat("t", F.lit("UNIQUE"))
    assert _analyzed(df.select(M.parse_annotations(marked).alias("p"))).count("UNIQUE") == 1
    spans = F.lit(None).cast(M.SPANS)
    assert "substring(t#" not in _analyzed(df.select(M.combine_spans(F.col("t"), spans, ["date"]).alias("p")))
