"""Build a corpus: map external rows, fill templates, merge, remove near and exact duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexweave.functions import markup as M
from lexweave.functions import text as T
from lexweave.functions.rewrite import normalize_corpus, normalized_value
from lexweave.functions.stage import evaluate, evaluate_fields, literal
from lexweave.operators.ordering import first_per_key
from lexweave.operators.quality import filter_report
from lexweave.operators.similar import Similarity, cross_split_anti
from lexweave.operators.splits import external_candidates, quota_topk, same_split_pick
from lexweave.rules import domains as D
from lexweave.session import cut_lineage, literal_table

SLOTS_TYPE = "map<string,array<string>>"
COLUMNS = (
    "id", "group_id", "text", "region", "intent", "slots", "source", "source_ref",
    "variant_type", "annotation_quality", "split",
)


def judgments_ok(judgments: Column) -> Column:
    """At least two judges agree on intent, language and slots, and the text reads well."""

    def votes(test) -> Column:
        return F.size(F.filter(judgments, lambda j: F.coalesce(test(j), F.lit(False))))

    def mean(field: str) -> Column:
        total = F.aggregate(
            judgments,
            F.lit(0.0),
            lambda acc, j: acc + F.coalesce(j[field].cast("double"), F.lit(0.0)),
        )
        return F.try_divide(total, F.size(judgments))

    good = (
        (F.size(judgments) >= 2)
        & (votes(lambda j: j["intent_score"] == 1) >= 2)
        & (votes(lambda j: j["language_identification"] == "target") >= 2)
        & (votes(lambda j: j["slots_score"].isin(1, 2)) >= 2)
        & (mean("grammar_score") >= 3.5)
        & (mean("spelling_score") >= 1.5)
    )
    return F.coalesce(good, F.lit(False))


def map_external(
    df: DataFrame,
    intents: Mapping[str, str] = D.EXTERNAL_INTENTS,
    partitions: Mapping[str, str] = D.EXTERNAL_PARTITIONS,
    name: str = "massive",
) -> DataFrame:
    """Crowd-annotated rows to labelled rows; rows whose mapping is unsure are dropped."""
    spark = df.sparkSession
    by_intent = literal_table(spark, list(intents.items()), "intent string, __intent string")
    by_part = literal_table(spark, list(partitions.items()), "partition string, split string")
    rows = (
        df.where(judgments_ok(F.col("judgments")))
        .join(by_intent, "intent")
        .join(by_part, "partition")
        .select("id", "intent", "__intent", "split", "annot_utt")
    )
    rows = evaluate_fields(rows, M.parse_annotations(F.col("annot_utt")), "__marked", "__spans")
    spans = F.col("__spans")
    rows = evaluate(
        rows,
        __text=M.wake_word_trim(F.col("__marked")),
        __when=M.combine_spans(F.col("__marked"), spans, D.DATETIME_LABELS),
        location=M.first_span(spans, "place_name"),
        song=M.first_span(spans, "song_name"),
        artist=M.first_span(spans, "artist_name"),
        reminder_text=M.first_span(spans, "event_name"),
    )
    when = F.get(F.col("__when"), F.lit(0))
    target = F.col("__intent")
    marked = F.col("__text").rlike(T.java(M.REMINDER_MARKER))
    usable = (
        (F.size(T.words(F.col("__text"))) >= 3)
        & (F.coalesce(F.size("__when"), F.lit(0)) <= 1)
        & ((target != "set_alarm") | when.isNotNull())
        & ((target != "set_reminder") | (F.col("reminder_text").isNotNull() & marked))
    )
    kept = rows.where(F.coalesce(usable, F.lit(False))).withColumn("datetime", when)

    def entry(slot: str) -> Column:
        allowed = target.isin(*[i for i, s in D.ALLOWED_SLOTS.items() if slot in s])
        return F.when(
            allowed & F.col(slot).isNotNull(),
            F.struct(F.lit(slot).alias("key"), F.array(slot).alias("value")),
        )

    names = ("reminder_text", "location", "song", "artist", "datetime")
    slots = F.map_from_entries(
        F.filter(F.array(*[entry(s) for s in names]), lambda e: e.isNotNull())
    )
    return kept.select(
        F.concat_ws("_", F.lit(f"{name}_vi"), "intent", "id").alias("id"),
        F.concat_ws("_", F.lit(f"{name}_vi"), "id").alias("group_id"),
        F.col("__text").alias("text"),
        F.lit("standard").alias("region"),
        target.alias("intent"),
        slots.alias("slots"),
        F.lit(name).alias("source"),
        F.concat(F.lit(f"{name}:1.0:vi-VN:"), "id").alias("source_ref"),
        F.lit("translated").alias("variant_type"),
        F.lit("auto_mapped").alias("annotation_quality"),
        "split",
    )


def external_rows(mapped: DataFrame, seed: int = 42) -> DataFrame:
    """Deduplicate, protect evaluation splits row by row, and balance the intents."""
    unique = external_candidates(mapped, T.text_fingerprint(F.col("text")), seed)
    masked = cut_lineage(unique.withColumn("__mask", T.mask_slots(F.col("text"), F.col("slots"))))
    apart = cross_split_anti(masked, "__mask", group="id", id_col="id").drop("__mask")
    return quota_topk(apart, seed=seed).select(*COLUMNS)


def template_splits(templates: DataFrame, seed: int = 42) -> DataFrame:
    """``(intent, family, split)``: families in hash order, the first tests, the second validates,
    the others train. Parallel templates of all regions share a family, so none crosses splits.
    ``required_coverage`` tells which split misses a slot."""
    families = templates.select("intent", "family").distinct()
    key = T.stable_order_key(F.concat_ws(":", "intent", "family"), seed)
    rank = F.row_number().over(W.partitionBy("intent").orderBy(key))
    split = F.when(F.col("r") == 1, "test").when(F.col("r") == 2, "validation").otherwise("train")
    return families.withColumn("r", rank).select("intent", "family", split.alias("split"))


def permuted(at: Column, side: Column, *key: Column) -> Column:
    """A keyed permutation of 0 to ``side`` squared less one, without a table of it.

    ``at`` is two digits of base ``side``; each of four rounds adds a hash of one digit to the other,
    which can be undone, so different numbers stay different.
    """

    def whole(n: Column) -> Column:
        return F.call_function("div", n, side)

    high, low = whole(at), F.pmod(at, side)
    for step in range(4):
        high, low = low, F.pmod(high + F.pmod(F.xxhash64(F.lit(step), low, *key), side), side)
    return high * side + low


def template_rows(
    spark: SparkSession,
    templates: DataFrame,
    values: Mapping[str, Sequence[str]],
    tracks: Sequence[tuple[str, str]],
    targets: Mapping[str, int] = D.TEMPLATE_GROUP_TARGETS,
    seed: int = 42,
) -> DataFrame:
    """Fill templates with values: a fixed number of distinct texts per region, intent and split.

    All fillings of a cell's templates are numbered, and a keyed permutation of the numbers is drawn
    from its start, so no filling is drawn twice and every one can be. A text that several cells or
    templates give belongs to its earliest draw; draws go on until every cell has its number. Raises
    ValueError if a cell's templates can't give so many texts. Song and artist come from one catalogue
    entry. ``templates`` is ``(region, intent, family, template)``.
    """
    cell = ["region", "intent", "split"]

    def uses(*names: str) -> Column:
        return F.greatest(
            F.lit(False), *[F.contains("template", F.lit("{" + n + "}")) for n in names]
        )

    sizes = {slot: len(vs) for slot, vs in values.items() if slot not in ("song", "artist")}
    ways = {
        **{slot: F.when(uses(slot), F.lit(n)).otherwise(F.lit(1)) for slot, n in sizes.items()},
        "track": F.when(uses("song", "artist"), F.lit(len(tracks))).otherwise(F.lit(1)),
    }
    size = F.lit(1).cast("long")
    for n in ways.values():
        size = size * n
    before = W.partitionBy(*cell).orderBy("family", "template")
    numbered = cut_lineage(
        templates.join(template_splits(templates, seed), ["intent", "family"])
        .withColumn("size", size)
        .withColumn("stop", F.sum("size").over(before.rowsBetween(W.unboundedPreceding, 0)))
    )

    wanted = []
    for intent, n in targets.items():
        train, validation = round(n * 0.70), round(n * 0.15)
        shares = {"train": train, "validation": validation, "test": n - train - validation}
        wanted += [(intent, split, count) for split, count in shares.items()]
    quota = literal_table(spark, wanted, "intent string, split string, target int")
    cells = (
        numbered.groupBy(*cell)
        .agg(F.max("stop").alias("space"))
        .join(quota, ["intent", "split"])
        .withColumn("side", F.floor(F.sqrt("space")) + 1)
    )

    def drawn(span: int) -> DataFrame:
        """The first texts of every cell among its first ``span`` draws."""
        last = F.least(F.lit(span).cast("long"), F.col("side") * F.col("side")) - 1
        places = cells.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(
            "place", permuted(F.col("draw"), F.col("side"), F.lit(seed), *map(F.col, cell))
        )
        chosen = places.join(numbered, cell).where(
            (F.col("place") < F.col("stop")) & (F.col("place") >= F.col("stop") - F.col("size"))
        )
        rest = F.col("place") - F.col("stop") + F.col("size")
        picks, below = {}, F.lit(1).cast("long")
        for name, n in ways.items():
            picks[name] = F.pmod(F.call_function("div", rest, below), n).cast("int")
            below = below * n
        track = F.get(
            literal(
                [{"song": s, "artist": a} for s, a in tracks],
                "array<struct<song:string,artist:string>>",
            ),
            picks["track"],
        )
        fields = {
            slot: F.get(literal(list(values[slot]), "array<string>"), picks[slot]) for slot in sizes
        }
        fields |= {"song": track["song"], "artist": track["artist"]}
        filled = evaluate(
            chosen,
            values=F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]),
        )
        filled = evaluate(
            filled,
            text=M.fill_template(F.col("template"), F.col("values")),
            slots=M.slots_for_template(F.col("intent"), F.col("template"), F.col("values")),
        ).withColumn("fp", T.text_fingerprint(F.col("text")))
        unique = first_per_key(filled, ["fp"], [F.col("draw"), *map(F.col, cell)])
        order = W.partitionBy(*cell).orderBy("draw")
        return unique.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.col("target"))

    span = 2 * max([count for *_, count in wanted], default=0)
    while True:
        kept = cut_lineage(drawn(span))
        got = kept.groupBy(*cell).agg(F.count("*").alias("got"))
        short = cells.join(got, cell, "left").where(F.coalesce("got", F.lit(0)) < F.col("target"))
        told = short.agg(
            F.count("*").alias("cells"),
            F.max(F.when(F.col("side") * F.col("side") <= span, F.concat_ws("/", *cell))).alias("spent"),
        ).first()
        if told["spent"] is not None:
            raise ValueError(f"templates of {told['spent']} give fewer texts than asked for")
        if not told["cells"]:
            break
        span *= 2
    group = F.concat_ws(
        "_", F.lit("regional"), "region", "intent", "split", F.format_string("%03d", "n")
    )
    return kept.select(
        group.alias("group_id"), "text", "region", "intent", "slots",
        F.concat_ws(
            ":", F.lit("template"), "region", "intent", F.format_string("%02d", "family")
        ).alias("source_ref"),
        "split",
    ).transform(augment_no_diacritics)


def augment_no_diacritics(df: DataFrame) -> DataFrame:
    """Every generated row also gives its accent-free form, in the same group."""
    forms = F.array(
        F.struct(F.lit("regional").alias("variant_type"), F.col("text").alias("form")),
        F.struct(
            F.lit("no_diacritics").alias("variant_type"),
            T.strip_diacritics(F.col("text")).alias("form"),
        ),
    )
    return df.select("*", F.inline(forms)).select(
        F.concat_ws("_", "group_id", "variant_type").alias("id"),
        "group_id",
        F.col("form").alias("text"),
        "region",
        "intent",
        "slots",
        F.lit("synthetic").alias("source"),
        "source_ref",
        "variant_type",
        F.lit("template_generated").alias("annotation_quality"),
        "split",
    )


def merge_partitions(*parts: DataFrame) -> DataFrame:
    """All rows of all sources, each with the split its source chose."""
    out = parts[0].select(*COLUMNS)
    for part in parts[1:]:
        out = out.unionByName(part.select(*COLUMNS))
    return out


def normalized_mask(df: DataFrame) -> DataFrame:
    """Add ``normalized_text`` under the row's own region and its slot-masked ``mask``."""
    out = normalize_corpus(df, hint="region")
    slots = F.transform_values(
        "slots", lambda k, vs: F.transform(vs, lambda v: normalized_value(v, F.col("region")))
    )
    out = evaluate(out, __slots=slots)
    return evaluate(out, mask=T.mask_slots(F.col("normalized_text"), F.col("__slots"))).drop("__slots")


def build_corpus(
    *parts: DataFrame, seed: int = 42, rule: Similarity = Similarity()
) -> tuple[DataFrame, DataFrame]:
    """Merge sources, drop groups near another split's, keep one row per normalised text and split.

    Returns the corpus and the per-step filter report.
    """
    merged = cut_lineage(normalized_mask(merge_partitions(*parts)))
    apart = cut_lineage(cross_split_anti(merged, "mask", rule=rule))
    unique = cut_lineage(same_split_pick(apart, F.col("normalized_text"), seed=seed))
    report = filter_report(
        [
            ("all", merged),
            ("cross_split_near_similarity", apart),
            ("same_split_exact_after_normalization", unique),
        ]
    )
    return unique.select(*COLUMNS), report
