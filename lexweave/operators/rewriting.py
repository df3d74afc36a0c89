"""Phrase rewriting by a rule table of any size: every text folds over its own few rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.rewrite import conflicting_rules, rewrite_step
from lexweave.functions.stage import evaluate
from lexweave.operators.lexicon import LexiconIndex, lexicon_places, text_pieces
from lexweave.session import broadcast_if_small, cut_lineage

#: Rules that enable each other in a row, one a round; real tables need two or three.
MOST_ROUNDS = 50


def _prepared(rules: DataFrame) -> DataFrame:
    """One struct per rule that sorts as rules apply: longest source first, ties alphabetical."""
    quoted = F.concat(F.lit(f"(?<![{T.WORD}])\\Q"), "src", F.lit(f"\\E(?![{T.WORD}])"))
    escaped = F.replace(F.replace("dst", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    rule = F.struct(
        (-F.char_length("src")).alias("o"),
        F.col("src").alias("src"),
        quoted.alias("pattern"),
        escaped.alias("dst"),
        F.col("dst").alias("target"),
        F.concat("src", F.lit(" -> "), "dst").alias("label"),
    )
    return rules.where(F.col("src") != "").select("src", rule.alias("rule"))


def _enabled(texts: DataFrame, entries: LexiconIndex, rules: DataFrame) -> DataFrame:
    """(key, rule): rules whose source stands in a text (key, text) as whole words, accents included."""
    found = lexicon_places(texts, entries, "text", "key").where("exact")
    return found.select(F.col("id").alias("key"), F.col("value").alias("src")).distinct().join(rules, "src")


def _folded(texts: DataFrame, active: DataFrame) -> DataFrame:
    """(key, text, active, result, trace, states): each text after its rules, and all texts between."""
    own = active.groupBy("key").agg(F.array_sort(F.collect_set("rule")).alias("active"))
    start = F.struct(
        F.col("text").alias("text"),
        F.array().cast("array<string>").alias("trace"),
        F.array().cast("array<string>").alias("states"),
    )

    def step(acc, rule):
        return F.transform(
            F.array(rewrite_step(acc, rule)),
            lambda new: F.struct(
                new["text"].alias("text"),
                new["trace"].alias("trace"),
                F.when(new["text"] == acc["text"], acc["states"])
                .otherwise(F.array_append(acc["states"], new["text"]))
                .alias("states"),
            ),
        )[0]

    rows = texts.join(own, "key").withColumn("f", F.aggregate("active", start, step))
    return rows.select("key", "text", "active", F.inline(F.array("f")).alias("result", "trace", "states"))


def _between_words(rules: DataFrame) -> bool:
    """Does every rule lead from one word to one word?"""
    word = f"^[{T.WORD}]+$"
    others = ~(F.col("src").rlike(word) & F.col("dst").rlike(word)) | F.col("dst").isNull()
    return rules.where(F.col("src") != "").where(others).isEmpty()


def _chains(table: DataFrame) -> DataFrame:
    """(word, final, rules): what the rules make of a word that stands alone, and the rules in order.

    A rule's target meets the rule with that source if its turn is still to come. Chains double in length in a
    round, so rounds grow with the logarithm of the longest.
    """
    turn = F.struct("rule.o", "rule.src")
    chains = cut_lineage(
        table.join(table.select("src", F.col("rule.target").alias("final")), "src").select(
            F.col("src").alias("word"),
            "final",
            turn.alias("first"),
            turn.alias("last"),
            F.array(F.struct("rule.o", "rule.src", "rule.label")).alias("rules"),
        )
    )
    while True:
        after = chains.select(
            F.col("word").alias("final"),
            F.col("final").alias("__final"),
            F.col("first").alias("__first"),
            F.col("last").alias("__last"),
            F.col("rules").alias("__rules"),
        )
        joined = chains.join(after, "final", "left")
        more = F.coalesce(F.col("__first") > F.col("last"), F.lit(False))
        grown = cut_lineage(
            joined.select(
                "word",
                F.when(more, F.col("__final")).otherwise(F.col("final")).alias("final"),
                "first",
                F.when(more, F.col("__last")).otherwise(F.col("last")).alias("last"),
                F.when(more, F.concat("rules", "__rules")).otherwise(F.col("rules")).alias("rules"),
                more.alias("more"),
            )
        )
        if grown.where("more").isEmpty():
            return chains.select("word", "final", "rules")
        chains = grown.drop("more")


def _by_word(texts: DataFrame, table: DataFrame) -> DataFrame:
    """(key, result, trace) of the texts that hold a source, for rules from word to word: a word changes
    by itself, so each text takes the chains of its own words and is never searched again."""
    chains = broadcast_if_small(_chains(table))
    cut = cut_lineage(evaluate(texts.select("key", "text"), pieces=text_pieces(F.col("text"))).drop("text"))
    words = cut.select("key", F.explode(F.array_distinct("pieces")).alias("word"))
    entry = F.struct("word", F.struct("final", "rules"))
    own = words.join(chains, "word").groupBy("key")
    own = own.agg(F.map_from_entries(F.collect_list(entry)).alias("own"))
    done = F.transform("pieces", lambda p: F.coalesce(F.col("own")[p]["final"], p))
    none = F.array().cast("array<struct<o:int,src:string,label:string>>")
    taken = F.flatten(F.transform("pieces", lambda p: F.coalesce(F.col("own")[p]["rules"], none)))
    return cut.join(own, "key").select(
        "key",
        F.array_join(done, "").alias("result"),
        F.transform(F.array_sort(taken), lambda r: r["label"]).alias("trace"),
    )


def _by_rounds(texts: DataFrame, table: DataFrame) -> DataFrame:
    """(key, result, trace) of the texts that hold a source, for any rules."""
    entries = LexiconIndex(
        table.select(F.lit("rule").alias("slot"), F.col("src").alias("value"), F.lit(0).alias("ord"))
    )
    open_rows = cut_lineage(_folded(texts, _enabled(texts, entries, table)))
    settled = open_rows.limit(0)
    for _ in range(MOST_ROUNDS):
        states = open_rows.select("key", F.explode("states").alias("text"))
        numbered = states.select(F.struct("key", F.md5("text").alias("m")).alias("key"), "text")
        found = _enabled(numbered, entries, table).select(F.col("key.key").alias("key"), "rule")
        known = open_rows.select("key", F.explode("active").alias("rule"))
        fresh = cut_lineage(found.distinct().join(known, ["key", "rule"], "left_anti"))
        settled = settled.unionByName(open_rows.join(fresh, "key", "left_anti"))
        if fresh.isEmpty():
            break
        more = fresh.unionByName(known.join(fresh.select("key").distinct(), "key", "left_semi"))
        open_rows = cut_lineage(_folded(open_rows.select("key", "text"), more))
    else:
        raise RuntimeError(f"rules still enable others after {MOST_ROUNDS} rounds")
    return settled.select("key", "result", "trace")


def rewrite_by_table(
    df: DataFrame, rules: DataFrame, text: str = "text", output: str = "rewritten", trace: str = "trace"
) -> DataFrame:
    """Add the text after all ``rules`` (src, dst) in order, and the trace, as ``rewrite_phrases`` does
    with rules written in code.

    A rule can only change a text in which its source stands when its turn comes. Each distinct text
    gets the rules that stand in it, then folds over these few; a rule that stands in any
    text on the way joins the text's rules, and such texts fold again, until no rule
    is new. What is left out never stood in the text, so the fold over all rules is the same. Rules meet texts by
    the lexicon join, so neither side is held by one task or the driver. Rules that all lead from one word to
    one word need no rounds over texts: see :func:`_by_word`.

    A source with two targets is an error. Null text stays null with an empty trace; rules
    without a source don't apply.
    """
    if text in (output, trace):
        raise ValueError("the result needs columns of its own")
    rules = cut_lineage(rules.select("src", "dst").distinct())
    if not conflicting_rules(rules).isEmpty():
        raise ValueError("a source has two targets")
    table = _prepared(rules)
    keyed = df.withColumn("__rule_key", F.md5(text))
    texts = keyed.select(F.col("__rule_key").alias("key"), F.col(text).alias("text"))
    texts = cut_lineage(texts.where("text <> ''").dropDuplicates(["key"]))
    settled = _by_word(texts, table) if _between_words(rules) else _by_rounds(texts, table)
    done = settled.select(
        F.col("key").alias("__rule_key"), F.col("result").alias(output), F.col("trace").alias(trace)
    )
    none = F.array().cast("array<string>")
    joined = keyed.drop(output, trace)
    joined = joined.join(done, "__rule_key", "left").drop("__rule_key")
    return joined.withColumns({output: F.coalesce(output, text), trace: F.coalesce(trace, none)})
