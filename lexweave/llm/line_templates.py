"""Line dedup by a log-template tree, with DataFrame functions only.

A line's place in the tree of fixed depth is its token count and its first four tokens, a token
with a digit, an at sign or a scheme counting as a variable field. Below that node the rest of the
line is cut into five equal parts, and a template is the line as it is, or with one part
generalised: lines of one template agree in their leading tokens and in at least 0.8 of all.
A template recurs if lines of at least ``min_docs`` texts have it; all its lines go.

Texts are told apart by content, so exact copies count once, and near copies shall not make each
other's lines recur either: a text of whose characters more than half lie in templates of many
texts is a copy, and templates are counted once more without the copies. So a group of near copies,
however large, keeps its lines for the document stages, and loses what others have too.

Cases: a null text stays null; blank lines stay; a text of which every line goes becomes empty.
Repeated rows are treated alike, ids are not used, and every other column passes unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.stage import evaluate
from lexweave.llm.support import fresh, may_be_among, text_key
from lexweave.session import cut_lineage

LEADING, PARTS = 4, 5
FIELD = r"\S*(?:[0-9@]|://)\S*"


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def parse_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line with tokens: key, line_no, share of the text, tokens as one string, leaf."""
    rows = docs.where(F.col(text).isNotNull()).select(
        text_key(F.col(text)).alias("key"),
        F.length(text).alias("all_chars"),
        F.posexplode(_lines(text)).alias("line_no", "line"),
    )
    share = F.length("line") / F.greatest("all_chars", F.lit(1))
    line = F.col("line")
    # Most lines have neither fields nor white space besides single spaces.
    odd = line.rlike(r"[0-9@:\t\x0B\f\r]") | F.contains(line, F.lit("  "))
    spelled = F.trim(F.regexp_replace(F.regexp_replace(line, r"\s+", " "), FIELD, "<*>"))
    cut = evaluate(
        rows.select("key", "line_no", share.alias("share"), "line"),
        tokens=F.when(odd, spelled).otherwise(F.trim(line)),
    ).where("tokens <> ''")
    n = F.length("tokens") - F.length(F.replace("tokens", F.lit(" "), F.lit("")))
    leaf = F.xxhash64(n, F.substring_index("tokens", " ", LEADING))
    return cut.select("key", "line_no", "share", "tokens", leaf.alias("leaf"))


def _parts() -> list[Column]:
    """The hashes of the five parts of a line's other tokens."""
    rest = F.greatest(F.size("words") - LEADING, F.lit(0))

    def part(i: int) -> Column:
        start = F.floor(rest * i / PARTS).cast("int")
        end = F.floor(rest * (i + 1) / PARTS).cast("int")
        return F.xxhash64(F.slice("words", start + LEADING + 1, end - start))

    return [part(i).alias(f"part{i}") for i in range(PARTS)]


def recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = 8) -> DataFrame:
    """(key, drop): the line numbers, from 0, that recurring templates take from each text."""
    lines = parse_lines(docs, text)
    # Most leaves belong to one text; only the others are parsed further.
    busy = (
        lines.groupBy("leaf", "key")
        .agg(F.lit(1).alias("one"))
        .groupBy("leaf")
        .count()
        .where(F.col("count") >= min_docs)
        .select("leaf")
    )
    busy = cut_lineage(busy)
    some = may_be_among(lines, F.col("leaf"), busy, "maybe").where("maybe")
    some = evaluate(some, words=F.split("tokens", " "))
    some = some.select("key", "line_no", "share", "leaf", *_parts())
    parts = [F.col(f"part{i}") for i in range(PARTS)]
    templates = F.array_distinct(
        F.array(
            F.xxhash64("leaf", F.lit(-1), *parts),
            *[
                F.xxhash64("leaf", F.lit(i), *[p for j, p in enumerate(parts) if j != i])
                for i in range(PARTS)
            ],
        )
    )
    candidates = cut_lineage(
        some.join(busy, "leaf")
        .groupBy("key", "line_no", "share", templates.alias("templates"))
        .agg(F.lit(1).alias("one"))
        .select("key", "line_no", "share", F.explode("templates").alias("template"))
    )

    def recurring(rows: DataFrame) -> DataFrame:
        by_text = rows.groupBy("template", "key").agg(F.lit(1).alias("one"))
        many = by_text.groupBy("template").agg(F.count("*").alias("n"))
        return many.where(F.col("n") >= min_docs).select("template")

    found = candidates.join(recurring(candidates), "template", "left_semi")
    copies = (
        found.groupBy("key", "line_no")
        .agg(F.first("share").alias("share"))
        .groupBy("key")
        .agg(F.sum("share").alias("shares"))
        .where("shares > 0.5")
        .select("key")
    )
    found = cut_lineage(
        candidates.join(copies.withColumn("copy", F.lit(True)), "key", "left")
    )
    kept = recurring(found.where("copy is null"))
    return (
        found.join(kept, "template", "left_semi")
        .groupBy("key")
        .agg(F.collect_set("line_no").alias("drop"))
    )


def drop_recurring_lines(docs: DataFrame, text: str = "text", min_docs: int = 8) -> DataFrame:
    """``docs`` with the lines of recurring templates taken out of ``text``."""
    cleaned, drop = _cleaned(docs, text, min_docs)
    return cleaned.drop(drop)


def _cleaned(docs: DataFrame, text: str, min_docs: int) -> tuple[DataFrame, str]:
    key, drop = fresh("line_key", docs.columns), fresh("line_drop", docs.columns)
    maybe = fresh("line_maybe", docs.columns)
    found = cut_lineage(
        recurring_lines(docs, text, min_docs).select(F.col("key").alias(key), F.col("drop").alias(drop))
    )
    hashed = F.xxhash64(F.col(key))
    keyed = may_be_among(
        docs.withColumn(key, text_key(F.col(text))), hashed, found.select(hashed.alias("h")), maybe
    )
    # Texts that surely lose no line need no shuffle.
    same = keyed.where(~F.col(maybe)).withColumn(drop, F.lit(None).cast("array<int>"))
    joined = same.unionByName(keyed.where(maybe).join(found, key, "left")).drop(key, maybe)
    lines = _lines(text)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
    bound = F.transform(F.array(lines), lambda all_: F.transform(kept, lambda i: F.get(all_, i)))
    clean = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(F.get(bound, F.lit(0)), "\n"))
    return joined.withColumn(text, clean), drop


def line_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 8):
    """Per document: its lines, how many went, and the digest of the remaining text."""
    narrow = docs.select(doc_id, text, F.size(_lines(text)).alias("all_lines"))
    cleaned, drop = _cleaned(narrow, text, min_docs)
    return cleaned.select(
        doc_id,
        F.greatest(F.coalesce("all_lines", F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(F.coalesce(F.size(drop), F.lit(0)), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"),
    )
