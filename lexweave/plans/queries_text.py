"""Text, contract, rewrite, tagging and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import markup as M
from lexweave.functions import text as T
from lexweave.functions.compose import composed
from lexweave.functions.rewrite import rewrite_phrases, with_detected_region
from lexweave.functions.stage import evaluate, evaluate_fields, let
from lexweave.operators import contracts as K
from lexweave.operators import gates as G
from lexweave.operators import lexicon as L
from lexweave.operators import lookup as U
from lexweave.operators import tagging as E
from lexweave.operators.rewriting import rewrite_by_table
from lexweave.plans.registry import (
    SQL_SAMPLES,
    documents,
    query,
    r6,
    samples,
    sql_canonical,
    sql_casefold,
    sql_drop_punctuation,
    sql_folded,
    sql_key,
    sql_plain,
    sql_split,
    sql_surface,
    sql_ws,
    split_of,
)
from lexweave.session import cut_lineage
from lexweave.sources.sinks import content_checksum
from lexweave.sources.tables import read_table


@query("q_surface", f"SELECT doc_id, {sql_surface('text')} AS surface FROM documents")
def q_surface(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return x.select("doc_id", T.normalize_surface(F.col("text")).alias("surface"))


@query("q_squeeze", f"SELECT doc_id, {sql_ws('text')} AS squeezed FROM documents")
def q_squeeze(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return x.select("doc_id", T.normalize_text(F.col("text")).alias("squeezed"))


@query("q_canonical", f"SELECT doc_id, {sql_canonical('text')} AS canonical FROM documents")
def q_canonical(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return x.select("doc_id", T.canonical_text(F.col("text")).alias("canonical"))


@query("q_plain", f"SELECT doc_id, {sql_plain('text')} AS plain FROM documents")
def q_plain(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return x.select("doc_id", T.strip_diacritics(F.col("text")).alias("plain"))


_FP = sql_drop_punctuation(sql_plain(sql_casefold("text")))


@query("q_fingerprint", f"SELECT doc_id, sha256({_FP}) AS fingerprint FROM documents")
def q_fingerprint(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return x.select("doc_id", F.sha2(T.text_fingerprint(F.col("text")), 256).alias("fingerprint"))


@query("q_compose", "SELECT doc_id, nfc_normalize(text) AS composed FROM documents")
def q_compose(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return x.select("doc_id", composed(F.col("text")).alias("composed"))


@query("q_stable_key", f"SELECT doc_id, {sql_key('doc_id')} AS order_key FROM documents")
def q_stable_key(spark, d):
    x = documents(spark, d, "doc_id")
    return x.select("doc_id", T.stable_order_key(F.col("doc_id")).alias("order_key"))


_MASKED = sql_ws(
    rf"regexp_replace({sql_folded('text')}, '\b[0-9][0-9\s]*[0-9]\b', '<number>', 'g')"
)


@query("q_mask_numbers", f"SELECT doc_id, {_MASKED} AS masked FROM documents")
def q_mask_numbers(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return x.select(
        "doc_id", T.mask_numbers(T.folded_canonical(F.col("text"))).alias("masked")
    )


@query(
    "q_mask_slots",
    rf"""
    WITH a AS (SELECT doc_id, {sql_folded('text')} AS t FROM documents),
    w AS (SELECT doc_id, t, string_split(t, ' ') AS w FROM a),
    v AS (SELECT doc_id, t, coalesce(w[1], '') AS head,
                 coalesce(array_to_string(w[2:3], ' '), '') AS pair FROM w),
    m AS (SELECT doc_id, CASE
        WHEN length(pair) > length(head) THEN
          CASE WHEN head = '' THEN replace(t, pair, '<pair>')
               ELSE replace(replace(t, pair, '<pair>'), head, '<head>') END
        WHEN head = '' THEN t
        WHEN pair = '' THEN replace(t, head, '<head>')
        ELSE replace(replace(t, head, '<head>'), pair, '<pair>') END AS x FROM v)
    SELECT doc_id, {sql_ws(r"regexp_replace(x, '\b[0-9][0-9\s]*[0-9]\b', '<number>', 'g')")} AS masked
    FROM m""",
)
def q_mask_slots(spark, d):
    x = evaluate(documents(spark, d, "doc_id", "text"), folded=T.folded_canonical(F.col("text")))
    w = F.split("folded", " ", -1)
    slots = F.create_map(
        F.lit("head"), F.array(F.get(w, F.lit(0))),
        F.lit("pair"), F.array(F.array_join(F.slice(w, 2, 2), " ")),
    )
    masked = T.mask_slots(F.col("text"), slots, F.col("folded"))
    return x.select("doc_id", masked.alias("masked"))


@query(
    "q_slot_in_text",
    rf"""
    WITH v AS (SELECT doc_id + 1 AS doc_id,
                 array_to_string(string_split({sql_surface('text')}, ' ')[1:2], ' ') AS value,
                 regexp_extract(text, '[0-9]{{3}}[-. ][0-9]{{4}}') AS phone FROM documents)
    SELECT d.doc_id,
      {sql_folded('v.value')} <> '' AND contains({sql_folded('d.text')}, {sql_folded('v.value')})
        AS has_value,
      regexp_replace(v.phone, '[^0-9]', '', 'g') <> ''
        AND contains(regexp_replace(d.text, '[^0-9]', '', 'g'),
                     regexp_replace(v.phone, '[^0-9]', '', 'g')) AS has_phone
    FROM documents d JOIN v ON d.doc_id = v.doc_id""",
)
def q_slot_in_text(spark, d):
    x = documents(spark, d, "doc_id", "text")
    surface = F.split(T.normalize_surface(F.col("text")), " ", -1)
    v = x.select(
        (F.col("doc_id") + 1).alias("doc_id"),
        F.array_join(F.slice(surface, 1, 2), " ").alias("value"),
        F.regexp_extract("text", "[0-9]{3}[-. ][0-9]{4}", 0).alias("phone"),
    )
    text = F.col("text")
    return x.join(v, "doc_id").select(
        "doc_id",
        T.slot_in_text(F.lit("song"), F.col("value"), text).alias("has_value"),
        T.slot_in_text(F.lit("phone_number"), F.col("phone"), text).alias("has_phone"),
    )


@query(
    "q_request_contract",
    r"""SELECT role, count(*) AS n,
      count(*) FILTER (length(text) BETWEEN 1 AND 500
        AND regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> '') AS valid
    FROM conversations GROUP BY role""",
)
def q_request_contract(spark, d):
    x = read_table(spark, d, "conversations", "role", "text")
    return x.groupBy("role").agg(
        F.count("*").alias("n"), F.count_if(K.request_ok(F.col("text"))).alias("valid")
    )


def _with_slots(spark, d):
    """Samples with derived slots, some of them breaking the contract."""
    x = samples(spark, d)
    first = T.first_word(F.col("text"))
    i = F.col("id")
    phone = F.regexp_extract("text", "[0-9]{3}[-. ][0-9]{4}", 0)
    entries = F.array(
        F.when(i % 2 == 0, F.struct(F.lit("contact_name").alias("key"), F.array(first).alias("value"))),
        F.when(i % 3 == 0, F.struct(F.lit("datetime").alias("key"), F.array(F.lit(" ")).alias("value"))),
        F.when(i % 5 == 0, F.struct(F.lit("mood").alias("key"), F.array(first).alias("value"))),
        F.when(phone != "", F.struct(F.lit("phone_number").alias("key"), F.array(phone).alias("value"))),
    )
    return x.withColumns(
        {
            "slots": F.map_from_entries(F.filter(entries, lambda e: e.isNotNull())),
            "source": F.when(i % 7 == 0, "massive").when(i % 7 == 1, "web_mined").otherwise("manual"),
            "source_ref": F.when(i % 4 == 0, F.concat(F.lit("r"), i.cast("string"))),
            "group_id": F.when(i % 97 == 0, F.lit("  ")).otherwise(F.col("group_id")),
        }
    )


_SLOTS_SQL = rf"""{SQL_SAMPLES},
    s AS (SELECT id, text, region, intent, split,
      string_split({sql_surface('text')}, ' ')[1] AS w,
      regexp_extract(text, '[0-9]{{3}}[-. ][0-9]{{4}}') AS ph,
      CASE WHEN id % 7 = 0 THEN 'massive' WHEN id % 7 = 1 THEN 'web_mined' ELSE 'manual' END AS source,
      CASE WHEN id % 4 = 0 THEN 'r' || id END AS source_ref,
      CASE WHEN id % 97 = 0 THEN '  ' ELSE group_id END AS group_id FROM samples),
    f AS (SELECT *, id % 2 = 0 AS has_contact, id % 3 = 0 AS has_dt, id % 5 = 0 AS has_mood,
      ph <> '' AS has_phone FROM s)"""


@query(
    "q_row_contract",
    rf"""
    WITH {_SLOTS_SQL},
    v AS (
      SELECT id, 'blank_group_id' AS rule, '' AS detail FROM f WHERE trim(group_id) = ''
      UNION ALL SELECT id, 'blank_text', '' FROM f WHERE regexp_replace(text, '[\s\p{{Z}}]+', '', 'g') = ''
      UNION ALL SELECT id, 'unknown_intent', intent FROM f WHERE intent = 'chitchat'
      UNION ALL SELECT id, 'unknown_slot', 'mood' FROM f WHERE has_mood
      UNION ALL SELECT id, 'empty_slot', array_to_string(list_sort(list_filter([
          CASE WHEN has_contact AND w = '' THEN 'contact_name' END,
          CASE WHEN has_dt THEN 'datetime' END,
          CASE WHEN has_mood AND w = '' THEN 'mood' END], lambda x: x IS NOT NULL)), ',')
        FROM f WHERE has_dt OR ((has_contact OR has_mood) AND w = '')
      UNION ALL SELECT id, 'slot_not_allowed', array_to_string(list_sort(list_filter([
          CASE WHEN has_contact AND intent <> 'call_contact' THEN 'contact_name' END,
          CASE WHEN has_dt AND intent NOT IN ('set_reminder','set_alarm','ask_weather')
               THEN 'datetime' END,
          CASE WHEN has_phone AND intent <> 'call_contact' THEN 'phone_number' END],
          lambda x: x IS NOT NULL)), ',')
        FROM f WHERE (has_contact AND intent <> 'call_contact')
          OR (has_dt AND intent NOT IN ('set_reminder','set_alarm','ask_weather'))
          OR (has_phone AND intent <> 'call_contact')
      UNION ALL SELECT id, 'missing_slot_group', 'reminder_text' FROM f WHERE intent = 'set_reminder'
      UNION ALL SELECT id, 'missing_slot_group', 'datetime' FROM f WHERE intent = 'set_alarm' AND NOT has_dt
      UNION ALL SELECT id, 'missing_slot_group', 'contact_name|phone_number' FROM f
        WHERE intent = 'call_contact' AND NOT has_contact AND NOT has_phone
      UNION ALL SELECT id, 'missing_source_ref', source FROM f
        WHERE source IN ('massive', 'web_mined') AND source_ref IS NULL
      UNION ALL SELECT id, 'external_region', region FROM f
        WHERE source = 'massive' AND region <> 'standard')
    SELECT * FROM v""",
)
def q_row_contract(spark, d):
    return K.row_contract(_with_slots(spark, d))


@query(
    "q_slot_traceability",
    rf"""
    WITH {_SLOTS_SQL},
    x AS (SELECT id, text, 'contact_name' AS slot, w AS value FROM f WHERE has_contact
      UNION ALL SELECT id, text, 'datetime', ' ' FROM f WHERE has_dt
      UNION ALL SELECT id, text, 'mood', w FROM f WHERE has_mood)
    SELECT id, 'slot_not_in_text' AS rule, slot || '=' || value AS detail FROM x
    WHERE {sql_folded('value')} = '' OR NOT contains({sql_folded('text')}, {sql_folded('value')})""",
)
def q_slot_traceability(spark, d):
    return K.slot_traceability(_with_slots(spark, d))


@query(
    "q_region_file",
    f"""WITH {SQL_SAMPLES},
    f AS (SELECT *, 'test_' || CASE WHEN id % 3 = 0 THEN 'north' ELSE region END || '.jsonl' AS file
          FROM samples)
    SELECT id, 'region_file' AS rule, region AS detail FROM f
    WHERE regexp_extract(file, '^test_([a-z]+)\\.', 1) <> region""",
)
def q_region_file(spark, d):
    x = samples(spark, d)
    own = F.when(F.col("id") % 3 == 0, "north").otherwise(F.col("region"))
    file = F.concat(F.lit("test_"), own, F.lit(".jsonl"))
    return K.region_file_check(x.withColumn("file", file))


# Single-word rewrite rules per language.
WORDS = {
    "en": {"the": "that", "and": "plus", "this": "that", "shall": "will"},
    "fr": {"le": "la", "un": "une", "des": "les"},
    "de": {"der": "die", "und": "sowie", "ein": "eine"},
    "es": {"el": "lo", "los": "las", "que": "qui"},
}
_MERGED = {k: v for words in WORDS.values() for k, v in words.items()}
_ORDERED = sorted(_MERGED.items(), key=lambda r: (-len(r[0]), r[0]))


def _sql_rewrite(x: str) -> str:
    out = "w"
    for src, dst in _ORDERED:
        out = f"(CASE WHEN {out} = '{src}' THEN '{dst}' ELSE {out} END)" if out == "w" else (
            f"list_transform([{out}], lambda q: CASE WHEN q = '{src}' THEN '{dst}' ELSE q END)[1]"
        )
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: {out}), ' ')"


@query(
    "q_rewrite",
    f"""WITH c AS (SELECT doc_id, {sql_canonical('text')} AS c FROM documents)
    SELECT doc_id, {_sql_rewrite('c')} AS rewritten FROM c""",
)
def q_rewrite(spark, d):
    x = documents(spark, d, "doc_id", "text").withColumn("c", T.canonical_text(F.col("text")))
    return x.select("doc_id", rewrite_phrases(F.col("c"), _MERGED)["text"].alias("rewritten"))


def _sql_hits(lang: str) -> str:
    words = ", ".join(repr(w) for w in WORDS[lang])
    return f"len(list_filter(w, lambda t: t IN ({words})))"


@query(
    "q_region_detect",
    f"""WITH c AS (SELECT doc_id, string_split({sql_canonical('text')}, ' ') AS w FROM documents),
    s AS (SELECT doc_id, {", ".join(f"{_sql_hits(k)} AS {k}_" for k in WORDS)} FROM c),
    b AS (SELECT *, greatest(en_, fr_, de_, es_) AS best FROM s)
    SELECT doc_id, CASE WHEN best = 0 THEN 'standard'
      WHEN (en_ = best)::INT + (fr_ = best)::INT + (de_ = best)::INT + (es_ = best)::INT > 1
        THEN 'unknown'
      WHEN en_ = best THEN 'en' WHEN fr_ = best THEN 'fr' WHEN de_ = best THEN 'de' ELSE 'es' END
      AS detected FROM b""",
)
def q_region_detect(spark, d):
    x = evaluate(documents(spark, d, "doc_id", "text"), c=T.canonical_text(F.col("text")))
    none = {k: {} for k in WORDS}
    # Words that are another rule's source would count twice, so detection uses pure sources.
    plain = {k: {w: f"{w}_" for w in words} for k, words in WORDS.items()}
    out = with_detected_region(x, "c", "detected", words=plain, particles=none, fixes={}, compose=False)
    return out.select("doc_id", "detected")


# Cue patterns per language, for pattern scores and gates.
CUES = {
    "en": (r"\bthe\b", r"\band\b", r"\bof\b"),
    "fr": (r"\ble\b", r"\bles\b", r"\bdes\b"),
    "de": (r"\bder\b", r"\bund\b", r"\bnicht\b"),
    "es": (r"\bel\b", r"\blos\b", r"\bque\b"),
}


def _sql_score(lang: str) -> str:
    return " + ".join(f"regexp_matches(c, '{p}')::INT" for p in CUES[lang])


SQL_RULE_CLASSIFY = f"""c AS (SELECT doc_id, lang, source, {sql_folded('text')} AS c FROM documents),
    s AS (SELECT doc_id, lang, source, {", ".join(f"({_sql_score(k)}) AS {k}_" for k in CUES)} FROM c),
    b AS (SELECT *, greatest(en_, fr_, de_, es_) AS best, en_ + fr_ + de_ + es_ AS total FROM s),
    p AS (SELECT doc_id, lang, source, best, total, CASE WHEN best = 0
        OR (en_ = best)::INT + (fr_ = best)::INT + (de_ = best)::INT + (es_ = best)::INT > 1
        THEN 'unknown'
      WHEN en_ = best THEN 'en' WHEN fr_ = best THEN 'fr' WHEN de_ = best THEN 'de' ELSE 'es' END
      AS predicted FROM b)"""


def rule_classified(spark, d):
    x = documents(spark, d, "doc_id", "text", "lang", "source")
    folded = x.withColumn("c", T.folded_canonical(F.col("text"))).drop("text")
    return G.rule_classify(folded, "c", CUES).drop("c")


@query(
    "q_rule_classify",
    f"""WITH {SQL_RULE_CLASSIFY}
    SELECT doc_id, predicted, round(CASE WHEN predicted = 'unknown' THEN 0.0
      ELSE best::DOUBLE / total END, 6) AS confidence FROM p""",
)
def q_rule_classify(spark, d):
    return rule_classified(spark, d).select(
        "doc_id", "predicted", r6("confidence").alias("confidence")
    )


GATE = (
    G.Rule("statement", (("plain", r"^(?:is|le|der|el)\b"),)),
    G.Rule("question", (("text", r"\?\s*$"),), intents=("en", "fr")),
    G.Rule("negated", (("plain", r"\b(?:not|nicht|non|sin)\b"),), unless=(("plain", r"\b(?:only|nur)\b"),)),
    *(G.Rule("cue", (("plain", CUES[k][0]),), intents=(k,), allow=True) for k in CUES),
)


def gated(spark, d):
    x = documents(spark, d, "doc_id", "text", "lang")
    out = x.withColumns({"plain": T.folded_canonical(F.col("text"))})
    columns = {"text": F.col("text"), "plain": F.col("plain")}
    none = F.struct(F.lit("missing_cue").alias("reason"), F.lit(False).alias("allowed"))
    gate = F.coalesce(G.first_match(GATE, columns, F.col("lang")), none)
    return G.evaluate_fields(out, gate, "gate_reason", "gate_allowed").select(
        "doc_id", "lang", "gate_reason", "gate_allowed"
    )


SQL_GATED = rf"""c AS (SELECT doc_id, lang, text, {sql_folded('text')} AS c FROM documents),
    g AS (SELECT doc_id, lang, CASE
      WHEN regexp_matches(c, '^(?:is|le|der|el)\b') THEN 'statement'
      WHEN lang IN ('en', 'fr') AND regexp_matches(text, '\?\s*$') THEN 'question'
      WHEN regexp_matches(c, '\b(?:not|nicht|non|sin)\b')
        AND NOT regexp_matches(c, '\b(?:only|nur)\b') THEN 'negated'
      WHEN {" OR ".join(f"(lang = '{k}' AND regexp_matches(c, '{CUES[k][0]}'))" for k in CUES)}
        THEN 'cue' ELSE 'missing_cue' END AS gate_reason FROM c)"""


@query(
    "q_gate_cascade",
    f"WITH {SQL_GATED} SELECT doc_id, gate_reason, gate_reason = 'cue' AS gate_allowed FROM g",
)
def q_gate_cascade(spark, d):
    return gated(spark, d).drop("lang")


@query(
    "q_gate_coverage",
    f"""WITH {SQL_GATED} SELECT lang AS intent, count(*) AS total,
      count(*) FILTER (gate_reason = 'cue') AS allowed,
      round(count(*) FILTER (gate_reason = 'cue')::DOUBLE / count(*), 6) AS coverage
    FROM g GROUP BY ROLLUP (lang)""",
)
def q_gate_coverage(spark, d):
    return G.gate_coverage(gated(spark, d), "lang").withColumn("coverage", r6("coverage"))


@query(
    "q_boundary_gate",
    f"""WITH {SQL_RULE_CLASSIFY},
    x AS (SELECT doc_id, CASE WHEN predicted = 'unknown' THEN 0.0 ELSE best::DOUBLE / total END AS f,
      doc_id % 3 = 0 AS matched FROM p)
    SELECT CASE WHEN f < 0.35 AND NOT matched THEN 'reject' WHEN f < 0.35 THEN 'override'
      ELSE 'pass' END AS verdict, count(*) AS n FROM x GROUP BY 1""",
)
def q_boundary_gate(spark, d):
    x = rule_classified(spark, d)
    verdict = G.confidence_gate(F.col("confidence"), F.col("doc_id") % 3 == 0)
    return x.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "q_required_slots",
    f"""WITH {_SLOTS_SQL}
    SELECT id, CASE WHEN intent = 'set_reminder' THEN 'reminder_text'
      WHEN intent = 'set_alarm' AND NOT has_dt THEN 'datetime'
      WHEN intent = 'call_contact' AND NOT has_contact AND NOT has_phone
        THEN 'contact_name|phone_number'
      WHEN intent = 'ask_weather' AND regexp_matches({sql_surface('text')},
        '(?:^|[^\\p{{L}}\\p{{N}}_])(?:đâu|dau|đây|day|chỗ nào|cho nao|nơi nào|noi nao)(?:[^\\p{{L}}\\p{{N}}_]|$)')
        THEN 'location' ELSE '' END AS missing FROM f""",
)
def q_required_slots(spark, d):
    x = _with_slots(spark, d)
    missing = G.required_slots(
        T.normalize_surface(F.col("text")), F.col("intent"), F.col("slots")
    )
    return x.select("id", F.array_join(missing, "|").alias("missing"))


#: A word pair is learned from this many training documents on.
_PAIR_DOCS = 8


def _learned(spark, d):
    """Lexicon of the word pairs that are frequent in the training documents, a slot per language."""
    x = documents(spark, d, "doc_id", "text", "lang").where(split_of(F.col("doc_id")) == "train")
    w = F.split(T.normalize_surface(F.col("text")), " ", -1)
    pairs = let(
        w, lambda a: F.zip_with(a, F.slice(a, 2, F.size(a)), lambda p, q: F.concat(p, F.lit(" "), q))
    )
    found = x.select("doc_id", "lang", F.explode(F.array_distinct(pairs)).alias("pair"))
    often = found.groupBy("lang", "pair").agg(F.count("*").alias("n"))
    often = often.where((F.col("n") >= _PAIR_DOCS) & F.col("pair").isNotNull())
    slots = F.map_from_arrays(F.array("lang"), F.array(F.array("pair")))
    return L.lexicon_build(often.withColumn("slots", slots), names=["en", "fr", "de", "es"])


SQL_LEARNED = f"""words AS (SELECT doc_id, lang, string_split({sql_surface('text')}, ' ') AS w
      FROM documents WHERE {sql_split('doc_id')} = 'train'),
    learned AS (SELECT lang AS slot, value FROM (
        SELECT DISTINCT doc_id, lang, w[i] || ' ' || w[i + 1] AS value
        FROM words, unnest(range(1, len(w))) u(i))
      GROUP BY ALL HAVING count(*) >= {_PAIR_DOCS})"""


@query("q_lexicon_build", f"WITH {SQL_LEARNED} SELECT slot, value FROM learned")
def q_lexicon_build(spark, d):
    return _learned(spark, d)


def _entries(spark, d):
    order = F.conv(F.substring(F.sha2("value", 256), 1, 12), 16, 10).cast("bigint")
    return _learned(spark, d).withColumn("ord", order)


_SQL_WORD, _SQL_PIECE = r"[\p{L}\p{N}_]", r"[\p{L}\p{N}_]+|[\s\p{Z}]+|[^\p{L}\p{N}_\s\p{Z}]"


def _sql_grams(key: str, table: str) -> str:
    return rf"""
    e AS (SELECT slot, value, {sql_plain('value')} AS gram,
            ('0x' || substr(sha256(value), 1, 12))::BIGINT AS ord,
            len(regexp_extract_all(value, '{_SQL_PIECE}')) AS n FROM learned),
    t AS (SELECT {key} AS id, regexp_extract_all({sql_surface('text')}, '{_SQL_PIECE}') AS p
          FROM {table}),
    r AS (SELECT id, array_to_string(p[i : i + n - 1], '') AS surface,
            coalesce(p[i - 1], '') AS before, coalesce(p[i + n], '') AS after
          FROM t, (SELECT DISTINCT n FROM e), unnest(range(1, (len(p) - n + 2)::BIGINT)) u(i)),
    g AS (SELECT DISTINCT id, surface FROM r
          WHERE NOT (regexp_matches(before, '^{_SQL_WORD}') AND NOT regexp_matches(surface, '^{_SQL_WORD}'))
            AND NOT (regexp_matches(after, '^{_SQL_WORD}') AND NOT regexp_matches(surface, '{_SQL_WORD}$'))),
    h AS (SELECT id, slot, value, ord, bool_or(surface = value) AS exact,
            any_value(length(gram)) AS n_chars
          FROM (SELECT id, surface, {sql_plain('surface')} AS gram FROM g) JOIN e USING (gram)
          GROUP BY ALL)"""


_SQL_GRAMS = _sql_grams("doc_id", "documents")


@query(
    "q_lexicon_match",
    f"WITH {SQL_LEARNED}, {_SQL_GRAMS} SELECT id, slot, value, exact, n_chars FROM h",
)
def q_lexicon_match(spark, d):
    x = documents(spark, d, "doc_id", "text").select("doc_id", T.normalize_surface(F.col("text")).alias("t"))
    hits = L.lexicon_hits(x, _entries(spark, d), "t", "doc_id")
    return hits.select("id", "slot", "value", "exact", F.col("n_chars").cast("bigint").alias("n_chars"))


@query(
    "q_longest",
    f"""WITH {SQL_LEARNED}, {_SQL_GRAMS}
    SELECT id, slot, value, exact FROM h QUALIFY row_number() OVER (
      PARTITION BY id, slot ORDER BY n_chars DESC, exact DESC, ord) = 1""",
)
def q_longest(spark, d):
    x = evaluate(documents(spark, d, "doc_id", "text"), t=T.normalize_surface(F.col("text")))
    return L.longest_in_texts(x, _entries(spark, d), "t", "doc_id")


@query(
    "q_union_lexicon",
    f"""WITH {SQL_LEARNED},
    c AS (SELECT 'en' AS slot, 0 AS origin, p_partkey AS position, {sql_surface('p_name')} AS value
          FROM part UNION ALL SELECT slot, 1, 0, value FROM learned),
    k AS (SELECT * FROM c QUALIFY row_number() OVER (
            PARTITION BY slot, value ORDER BY origin, position) = 1)
    SELECT slot, value, row_number() OVER (PARTITION BY slot
      ORDER BY length(value) DESC, origin, position, value) AS ord FROM k""",
)
def q_union_lexicon(spark, d):
    configured = read_table(spark, d, "part", "p_partkey", "p_name").select(
        F.lit("en").alias("slot"), F.col("p_partkey").alias("position"), F.col("p_name").alias("value")
    )
    out = L.union_distinct_lexicon(configured, _learned(spark, d))
    return out.withColumn("ord", F.col("ord").cast("bigint"))


#: The slot that each language's learned pairs count as.
_LEARNED_SLOTS = {"en": "song", "fr": "artist", "de": "location", "es": "reminder_text"}
_SQL_SLOT_OF = " ".join(f"WHEN '{lang}' THEN '{slot}'" for lang, slot in _LEARNED_SLOTS.items())


@query(
    "q_tag_table",
    f"""WITH {SQL_LEARNED}, {_sql_grams("conv_id || ':' || turn", "conversations")}
    SELECT id, CASE slot {_SQL_SLOT_OF} END AS slot, value FROM h WHERE slot IN ('en', 'fr', 'de', 'es')
    QUALIFY row_number() OVER (PARTITION BY id, slot ORDER BY n_chars DESC, exact DESC, ord) = 1""",
)
def q_tag_table(spark, d):
    """Tags of every conversation turn that come from a lexicon table, by the complete tagging."""
    slot_of = F.create_map(*[F.lit(x) for pair in _LEARNED_SLOTS.items() for x in pair])
    # Equal lengths leave the choice to the order, which is ascending here and in the lexicon.
    entries = _entries(spark, d).withColumn("slot", slot_of[F.col("slot")])
    entries = cut_lineage(entries.where("slot is not null"))
    turns = read_table(spark, d, "conversations", "conv_id", "turn", "text").select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), "text"
    )
    tagged = E.tag_columns(turns, "text", E.TableDictionaries(entries))
    slots = [*_LEARNED_SLOTS.values()]
    pairs = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"tag_{s}").alias("value")) for s in slots])
    found = tagged.select("id", F.inline(pairs)).where("value is not null")
    return found.join(entries.select("slot", "value"), ["slot", "value"], "left_semi").select("id", "slot", "value")


def _word_rules(spark, d):
    """Each first word of a learned German pair becomes the pair's second word, the least of several."""
    w = F.split("value", " ")
    pairs = _learned(spark, d).where("slot = 'de'").select(w[0].alias("src"), w[1].alias("dst"))
    letters = F.col("src").rlike(r"^\p{L}+$") & F.col("dst").rlike(r"^\p{L}+$")
    return pairs.where(letters & (F.col("src") != F.col("dst"))).groupBy("src").agg(F.min("dst").alias("dst"))


@query(
    "q_rewrite_table",
    rf"""WITH RECURSIVE {SQL_LEARNED},
    rules AS (SELECT src, min(dst) AS dst, row_number() OVER (ORDER BY length(src) DESC, src) AS rank
      FROM (SELECT split_part(value, ' ', 1) AS src, split_part(value, ' ', 2) AS dst FROM learned
            WHERE slot = 'de')
      WHERE regexp_full_match(src, '\p{{L}}+') AND regexp_full_match(dst, '\p{{L}}+') AND src <> dst
      GROUP BY src),
    t AS (SELECT conv_id, turn, regexp_extract_all({sql_surface('text')}, '{_SQL_PIECE}') AS p
      FROM conversations),
    vocabulary AS (SELECT DISTINCT unnest(p) AS word FROM t),
    c(word, now, rank, n) AS (SELECT word, word, 0, 0 FROM vocabulary
      UNION ALL SELECT c.word, rules.dst, rules.rank, n + 1 FROM c JOIN rules ON src = now AND rules.rank > c.rank),
    final AS (SELECT word, arg_max(now, n) AS now, max(n) AS n FROM c GROUP BY word),
    x AS (SELECT conv_id, turn, p[i] AS word, i FROM t, unnest(range(1, len(p) + 1)) u(i))
    SELECT t.conv_id, t.turn, coalesce(string_agg(now, '' ORDER BY i), '') AS rewritten,
      coalesce(sum(n), 0)::BIGINT AS n_rewrites
    FROM t LEFT JOIN x ON t.conv_id = x.conv_id AND t.turn = x.turn LEFT JOIN final USING (word)
    GROUP BY t.conv_id, t.turn""",
)
def q_rewrite_table(spark, d):
    """Every conversation turn after a table of rules learned from the documents."""
    x = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    x = x.withColumn("text", T.normalize_surface(F.coalesce("text", F.lit(""))))
    out = rewrite_by_table(x, _word_rules(spark, d))
    return out.select("conv_id", "turn", "rewritten", F.size("trace").cast("bigint").alias("n_rewrites"))


@query("q_tag_phone")
def q_tag_phone(spark, d):
    x = documents(spark, d, "doc_id", "text").withColumn("t", T.normalize_surface(F.col("text")))
    return x.select("doc_id", E.tag_phone(F.col("t")).alias("phone")).where("phone is not null")


@query("q_tag_entities")
def q_tag_entities(spark, d):
    x = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    tags = [f"tag_{s}" for s in ("datetime", "location", "song", "artist", "contact_name", "phone_number", "reminder_text")]
    return E.tag_columns(x, "text").select("conv_id", "turn", *tags)


@query("q_spans")
def q_spans(spark, d):
    """Mark the words after commas as spans, then recover text, offsets and merged components."""
    x = documents(spark, d, "doc_id", "text")
    marked = F.regexp_replace(
        T.normalize_text(F.translate("text", "[]", "  ")), rf", ([{T.WORD}]+)", ", [date : $1]"
    )
    x = evaluate(x, marked=marked).select("doc_id", "marked")
    parsed = evaluate_fields(x, M.parse_annotations(F.col("marked")), "plain", "spans")
    parts = M.combine_spans(F.col("plain"), F.col("spans"), ["date"])
    return parsed.select(
        "doc_id",
        F.size("spans").alias("n_spans"),
        F.coalesce(F.size(parts), F.lit(0)).alias("n_components"),
        M.first_span(F.col("spans"), "date").alias("first_value"),
        M.spans_hold(F.col("plain"), F.col("spans")).alias("offsets_hold"),
    )


@query(
    "q_wake_word",
    f"""WITH x AS (SELECT conv_id, turn,
        CASE WHEN turn % 2 = 0 THEN 'Olly, ' || text ELSE text END AS t FROM conversations),
    y AS (SELECT conv_id, turn, {sql_ws("regexp_replace(t, '(?i)^(olly|alexa)[ ]*[,，]?[ ]*', '')")} AS trimmed FROM x)
    SELECT conv_id, turn, trimmed FROM y WHERE len(string_split(trimmed, ' ')) >= 3""",
)
def q_wake_word(spark, d):
    x = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Olly, "), "text")).otherwise(F.col("text"))
    out = x.select("conv_id", "turn", M.wake_word_trim(t).alias("trimmed"))
    return out.where(F.size(T.words(F.col("trimmed"))) >= 3)


@query(
    "q_template_fill",
    f"""SELECT doc_id, {sql_ws("replace(replace('{x} nhắc {y} nhé {x}', '{x}', lang), '{y}', source)")}
      AS filled FROM documents""",
)
def q_template_fill(spark, d):
    x = documents(spark, d, "doc_id", "lang", "source")
    values = F.create_map(F.lit("x"), F.col("lang"), F.lit("y"), F.col("source"))
    return x.select("doc_id", M.fill_template(F.lit("{x} nhắc {y} nhé {x}"), values).alias("filled"))


_ALIASES = """a AS (SELECT n_nationkey AS k, lower(n_name) AS alias, n_name AS name FROM nation
      UNION ALL SELECT n_nationkey, 'country ' || n_nationkey, n_name FROM nation)"""


@query(
    "q_alias_lookup",
    f"""WITH {_ALIASES},
    c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'COUNTRY  ' || c_nationkey
        WHEN c_custkey % 3 = 1 THEN 'Nation_' || c_nationkey ELSE 'nobody' END AS q FROM customer)
    SELECT c_custkey, a.name AS resolved_name, a.k::VARCHAR AS resolved_phone
    FROM c LEFT JOIN a ON a.alias = {sql_surface('c.q')}""",
)
def q_alias_lookup(spark, d):
    nation = read_table(spark, d, "nation", "n_nationkey", "n_name")
    contacts = nation.select(
        F.col("n_name").alias("name"),
        F.array(F.concat(F.lit("country "), "n_nationkey")).alias("aliases"),
        F.col("n_nationkey").cast("string").alias("phone_number"),
    )
    key = F.col("c_custkey")
    asked = (
        F.when(key % 3 == 0, F.concat(F.lit("COUNTRY  "), "c_nationkey"))
        .when(key % 3 == 1, F.concat(F.lit("Nation_"), "c_nationkey"))
        .otherwise(F.lit("nobody"))
    )
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey").withColumn("q", asked)
    return U.alias_lookup(c, contacts, "q").select("c_custkey", "resolved_name", "resolved_phone")


@query(
    "q_catalog_match",
    """WITH q AS (SELECT p_partkey AS id,
        CASE WHEN p_partkey % 3 <> 1 THEN upper(p_name) END AS song,
        CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS artist FROM part),
      r AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE song END AS song,
        CASE WHEN id % 7 = 0 THEN NULL ELSE artist END AS artist FROM q),
      c AS (SELECT p_partkey AS p, p_name AS s, p_brand AS a FROM part),
      m AS (SELECT r.id, c.p, c.s, c.a FROM r JOIN c
        ON (r.song IS NULL OR lower(r.song) = lower(c.s))
        AND (r.artist IS NULL OR lower(r.artist) = lower(c.a))
        AND (r.song IS NOT NULL OR r.artist IS NOT NULL))
    SELECT r.id, count(m.p) AS n_matches, arg_min(m.s, m.p) AS match_song,
      arg_min(m.a, m.p) AS match_artist FROM r LEFT JOIN m ON r.id = m.id GROUP BY r.id""",
)
def q_catalog_match(spark, d):
    part = read_table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    key = F.col("p_partkey")
    asked = part.select(
        key.alias("id"),
        F.when((key % 3 != 1) & (key % 7 != 0), F.upper("p_name")).alias("song"),
        F.when((key % 3 != 0) & (key % 7 != 0), F.col("p_brand")).alias("artist"),
    )
    catalog = part.select(
        key.alias("position"), F.col("p_name").alias("song"), F.col("p_brand").alias("artist")
    )
    return U.catalog_match(asked, catalog).select("id", "n_matches", "match_song", "match_artist")


@query(
    "q_code_bucket",
    """SELECT condition, count(*) AS n FROM (SELECT CASE
      WHEN c = 0 THEN 'trời quang' WHEN c IN (1,2,3) THEN 'có mây' WHEN c IN (45,48) THEN 'có sương mù'
      WHEN c IN (51,53,55,56,57) THEN 'có mưa phùn'
      WHEN c IN (61,63,65,66,67,80,81,82) THEN 'có mưa' WHEN c IN (71,73,75,77,85,86) THEN 'có tuyết'
      WHEN c IN (95,96,99) THEN 'có dông' ELSE 'thời tiết chưa xác định' END AS condition
      FROM (SELECT (event_id % 100)::INT AS c FROM events)) GROUP BY condition""",
)
def q_code_bucket(spark, d):
    x = read_table(spark, d, "events", "event_id")
    coded = x.select((F.col("event_id") % 100).cast("int").alias("code"))
    return U.code_bucket(coded, "code").groupBy("condition").agg(F.count("*").alias("n"))


@query(
    "q_checksum",
    """SELECT lang, count(*) AS n_rows, sum(('0x' || substr(sha256(
        doc_id || chr(1) || n_chars || chr(1) || source || chr(1) || text), 1, 15))::HUGEINT)::VARCHAR
        AS fingerprint FROM documents GROUP BY lang""",
)
def q_checksum(spark, d):
    return content_checksum(documents(spark, d, "doc_id", "lang", "n_chars", "source", "text"), ["lang"])
