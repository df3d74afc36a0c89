"""Phrase rewriting: ordered dictionary replacement with a trace, dialect detection."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.compose import composed
from lexweave.functions.stage import evaluate, evaluate_fields, let, literal
from lexweave.rules import domains as D
from lexweave.rules import rewrites as R

# Rule sets travel inside the expression as one literal; a dictionary kept as a table is joined on
# n-grams instead (operators.lexicon).
_MARK = "\ue000"


def ordered_rules(rules: Mapping[str, str]) -> list[tuple[str, str]]:
    """Longest source first, ties alphabetical."""
    return sorted(rules.items(), key=lambda r: (-len(r[0]), r[0]))


def _begins(phrases: Sequence[str]) -> str:
    """A look at one letter, which spares most places the look behind."""
    if not all(phrases):
        return ""
    return f"(?=[{''.join(T.quote(c) for c in sorted({p[0] for p in phrases}))}])"


def _phrase_pattern(phrase: str) -> str:
    return f"{_begins([phrase])}(?<![{T.WORD}])\\Q{phrase}\\E(?![{T.WORD}])"


def _rule_array(rules: Sequence[tuple[str, str]]) -> Column:
    rows = [
        {
            "src": src,
            "pattern": _phrase_pattern(src),
            "dst": dst.replace("\\", "\\\\").replace("$", "\\$"),
            "label": f"{src} -> {dst}",
        }
        for src, dst in rules
    ]
    return literal(rows, "array<struct<src:string,pattern:string,dst:string,label:string>>")


def any_phrase(sources: Sequence[str]) -> str:
    """One pattern that is true for any of the phrases as whole words."""
    alternatives = "|".join(T.quote(s) for s in sources)
    return f"{_begins(sources)}(?<![{T.WORD}])(?:{alternatives})(?![{T.WORD}])"


def _unchanged(text: Column) -> Column:
    return F.struct(text.alias("text"), F.array().cast("array<string>").alias("trace"))


def rewrite_phrases(text: Column, rules: Mapping[str, str]) -> Column:
    """Struct ``(text, trace)``: every rule in turn sees what the rules before it produced.

    Text holding none of the phrases skips the fold.
    """
    if not rules:
        return _unchanged(text)
    ordered = ordered_rules(rules)
    folded = F.aggregate(_rule_array(ordered), _unchanged(text), rewrite_step)
    touched = text.rlike(any_phrase([s for s, _ in ordered]))
    return F.when(touched, folded).otherwise(_unchanged(text))


def rewrite_step(acc: Column, rule: Column) -> Column:
    """``(text, trace)`` after one more rule, a struct ``(src, pattern, dst, label)``."""
    present = F.contains(acc["text"], rule["src"])
    hits = F.regexp_count(acc["text"], rule["pattern"])
    return F.struct(
        F.when(present, F.regexp_replace(acc["text"], rule["pattern"], rule["dst"]))
        .otherwise(acc["text"])
        .alias("text"),
        F.when(present, F.concat(acc["trace"], F.array_repeat(rule["label"], hits)))
        .otherwise(acc["trace"])
        .alias("trace"),
    )


def protect_term(text: Column) -> Column:
    """Hide the protected sense of an ambiguous word behind a private-use mark."""
    hidden = F.regexp_replace(text, T.java(R.PROTECTED_AFTER), "$1" + _MARK)
    hidden = F.regexp_replace(hidden, T.java(R.PROTECTED_BEFORE), _MARK + "$1")
    return F.when(F.contains(text, F.lit(R.PROTECTED_TERM)), hidden).otherwise(text)


def restore_term(text: Column) -> Column:
    return F.replace(text, F.lit(_MARK), F.lit(R.PROTECTED_TERM))


def particle_target(text: Column, particle: str, question: str, request: str) -> Column:
    """Standard form of a sentence-final particle, or null when the context does not say."""
    tail = rf"(?U)(?<![{T.WORD}]){T.quote(particle)}[?!.,]*\s*$"
    head = F.regexp_replace(text, tail, "")
    return F.when(
        text.rlike(tail),
        F.when(text.rlike(T.java(R.QUESTION_CUE)), F.lit(question)).when(
            head.rlike(T.java(R.REQUEST_CUE)), F.lit(request)
        ),
    )


def check_conflicts(tables: Mapping[str, Mapping[str, str]]) -> dict[str, str]:
    """Merge rule tables; one source may have only one target."""
    merged: dict[str, str] = {}
    for rules in tables.values():
        for src, dst in rules.items():
            if merged.setdefault(src, dst) != dst:
                raise ValueError(f"two targets for {src!r}: {merged[src]!r}, {dst!r}")
    return merged


def conflicting_rules(rules: DataFrame) -> DataFrame:
    """The same check for a rule table ``(region, src, dst)``."""
    return (
        rules.groupBy("src")
        .agg(F.min("dst").alias("first_dst"), F.max("dst").alias("last_dst"))
        .where(F.col("first_dst") != F.col("last_dst"))
    )


def _particle_rewrite(text: Column, particles: Sequence[tuple[str, str, str]]) -> Column:
    """Apply the particle forms chosen from the text as it stands now."""
    rules = sorted(set(particles), key=lambda p: (-len(p[0]), p[0]))
    if not rules:
        return _unchanged(text)
    chosen = F.array(
        *[
            F.struct(
                F.lit(p).alias("src"),
                F.lit(_phrase_pattern(p)).alias("pattern"),
                particle_target(text, p, q, r).alias("dst"),
            )
            for p, q, r in rules
        ]
    )

    def step(acc: Column, rule: Column) -> Column:
        hits = F.regexp_count(acc["text"], rule["pattern"])
        label = F.concat(rule["src"], F.lit(" -> "), rule["dst"])
        return F.struct(
            F.regexp_replace(acc["text"], rule["pattern"], rule["dst"]).alias("text"),
            F.concat(acc["trace"], F.array_repeat(label, hits)).alias("trace"),
        )

    folded = F.aggregate(
        F.filter(chosen, lambda c: c["dst"].isNotNull()), _unchanged(text), step
    )
    touched = text.rlike(any_phrase([p for p, _, _ in rules]))
    return F.when(touched, folded).otherwise(_unchanged(text))


def _is_word(value: str) -> bool:
    return value != "" and all(c == "_" or unicodedata.category(c)[0] in "LN" for c in value)


def count_rewrites(text: Column, rules: Mapping[str, str]) -> Column:
    """The length of the trace of :func:`rewrite_phrases`. Rules from word to word that make no other
    rule's source neither add nor take hits, so one pattern counts them in the text as it is."""
    alone = all(map(_is_word, [*rules, *rules.values()])) and not set(rules) & set(rules.values())
    if rules and alone:
        return F.regexp_count(text, F.lit(any_phrase([src for src, _ in ordered_rules(rules)])))
    return F.size(rewrite_phrases(text, rules)["trace"])


def _dialect_score(text: Column, dialect: str, words: Mapping, particles: Mapping) -> Column:
    score = count_rewrites(text, words[dialect])
    for particle, (question, request) in particles[dialect].items():
        target = particle_target(text, particle, question, request)
        score = score + F.when(target.isNotNull(), 1).otherwise(0)
    return score


def detect_region(scores: Mapping[str, Column]) -> Column:
    """Unique best dialect; none scored is ``standard``, a tie is ``unknown``."""
    best = F.greatest(*scores.values())
    leaders = sum((F.when(s == best, 1).otherwise(0) for s in scores.values()), F.lit(0))
    unique = F.coalesce(*[F.when(s == best, F.lit(name)) for name, s in scores.items()])
    return (
        F.when(best == 0, F.lit("standard"))
        .when(leaders > 1, F.lit(D.UNKNOWN))
        .otherwise(unique)
    )


def normalize_corpus(
    df: DataFrame,
    text: str = "text",
    hint: str | None = None,
    words: Mapping[str, Mapping[str, str]] = R.DIALECT_WORDS,
    particles: Mapping[str, Mapping[str, tuple[str, str]]] = R.PARTICLES,
    fixes: Mapping[str, str] = R.TRANSCRIPTION_FIXES,
    prefix: str = "",
    compose: bool = True,
) -> DataFrame:
    """Add ``normalized_text``, ``normalizer_region`` and ``matched_variants``.

    Transcription fixes run first, dialect scores are taken on that text, then the dialect words
    and particles are rewritten. A dialect hint limits both to that dialect. One narrow stage.
    Blank text gives a null ``normalized_text``.
    """
    merged = check_conflicts(words)
    all_particles = [(p, q, r) for d in words for p, (q, r) in particles[d].items()]
    hinted = F.col(hint).isin(*words) if hint else F.lit(False)

    def per_hint(build) -> Column:
        out = build(merged, all_particles)
        if hint:
            for d in words:
                own = [(p, q, r) for p, (q, r) in particles[d].items()]
                out = F.when(F.col(hint) == d, build(words[d], own)).otherwise(out)
        return out

    def name(x: str) -> str:
        return f"__{prefix}{x}"

    out, scores = _scored(df, text, words, particles, fixes, prefix, compose)
    shielded = F.col(name("shielded"))
    touched = F.col(name("touched"))

    def rewritten(x: Column, build) -> Column:
        return F.when(touched, per_hint(build)).otherwise(_unchanged(x))

    out = evaluate_fields(
        out,
        rewritten(shielded, lambda rules, _: rewrite_phrases(shielded, rules)),
        name("regional"),
        name("trace2"),
    )
    regional = F.col(name("regional"))
    out = evaluate_fields(
        out,
        rewritten(regional, lambda _, ps: _particle_rewrite(regional, ps)),
        name("final"),
        name("trace3"),
    )
    detected = detect_region({d: F.col(c) for d, c in scores.items()})
    region = F.when(hinted, F.col(hint)).otherwise(detected) if hint else detected
    inner = [name(x) for x in ("surface", "touched", "fixed", "shielded", "regional", "final")]
    traces = [name(f"trace{i}") for i in (1, 2, 3)]
    return out.withColumns(
        {
            f"{prefix}normalized_text": F.nullif(restore_term(F.col(name("final"))), F.lit("")),
            f"{prefix}normalizer_region": region,
            f"{prefix}matched_variants": F.concat(*traces),
        }
    ).drop(*inner, *traces, *scores.values())


def _scored(df, text, words, particles, fixes, prefix, compose) -> tuple[DataFrame, dict[str, str]]:
    """The text in surface form, with its transcription fixes and shielded, and its dialect scores."""

    def name(x: str) -> str:
        return f"__{prefix}{x}"

    source = composed(F.col(text), "NFKC") if compose else F.col(text)
    surface, touched = F.col(name("surface")), F.col(name("touched"))
    out = evaluate(df, **{name("surface"): T.normalize_surface(source)})
    # A text without any source, particle or protected term is told by one pattern: nothing changes it.
    found = [*fixes, *(x for d in words for x in (*words[d], *particles[d])), R.PROTECTED_TERM]
    out = evaluate(out, **{name("touched"): surface.rlike(any_phrase(sorted(set(found))))})
    out = evaluate_fields(
        out,
        F.when(touched, rewrite_phrases(surface, fixes)).otherwise(_unchanged(surface)),
        name("fixed"),
        name("trace1"),
    )
    fixed = F.col(name("fixed"))
    out = evaluate(out, **{name("shielded"): F.when(touched, protect_term(fixed)).otherwise(fixed)})
    scores = {d: name(f"score_{d}") for d in words}
    taken = {
        c: F.when(touched, _dialect_score(F.col(name("shielded")), d, words, particles)).when(~touched, 0)
        for d, c in scores.items()
    }
    return evaluate(out, **taken), scores


def with_detected_region(
    df: DataFrame,
    text: str = "text",
    output: str = "normalizer_region",
    words: Mapping[str, Mapping[str, str]] = R.DIALECT_WORDS,
    particles: Mapping[str, Mapping[str, tuple[str, str]]] = R.PARTICLES,
    fixes: Mapping[str, str] = R.TRANSCRIPTION_FIXES,
    compose: bool = True,
) -> DataFrame:
    """Add the region that :func:`normalize_corpus` detects, without rewriting the text."""
    out, scores = _scored(df, text, words, particles, fixes, "", compose)
    detected = detect_region({d: F.col(c) for d, c in scores.items()})
    inner = [f"__{x}" for x in ("surface", "touched", "fixed", "trace1", "shielded")]
    return out.withColumn(output, detected).drop(*inner, *scores.values())


def normalized_value(value: Column, region: Column) -> Column:
    """The rewritten form of one short value under a row's own region, for use in lambdas."""

    def run(fixed: Column, rules, ps) -> Column:
        return let(
            rewrite_phrases(fixed, rules)["text"],
            lambda t: restore_term(_particle_rewrite(t, ps)["text"]),
        )

    def fixed_value(body) -> Column:
        return let(
            T.normalize_surface(value),
            lambda s: let(
                rewrite_phrases(s, R.TRANSCRIPTION_FIXES)["text"],
                lambda f: let(protect_term(f), body),
            ),
        )

    merged = check_conflicts(R.DIALECT_WORDS)
    everything = [(p, q, r) for d in D.DIALECTS for p, (q, r) in R.PARTICLES[d].items()]

    def by_region(fixed: Column) -> Column:
        out = run(fixed, merged, everything)
        for d in D.DIALECTS:
            own = [(p, q, r) for p, (q, r) in R.PARTICLES[d].items()]
            out = F.when(region == d, run(fixed, R.DIALECT_WORDS[d], own)).otherwise(out)
        return out

    return fixed_value(by_region)


def normalize_slots(slots: Column, region: Column, normalized_text: Column) -> Column:
    """Normalise each slot value; keep the new value only where the new text still shows it."""

    def pick(slot: Column, value: Column) -> Column:
        return let(
            normalized_value(value, region),
            lambda c: F.when(T.slot_in_text(slot, c, normalized_text), c).otherwise(value),
        )

    return F.transform_values(slots, lambda k, vs: F.transform(vs, lambda v: pick(k, v)))
