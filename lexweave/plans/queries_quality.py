"""Corpus quality, deduplication, split and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.stage import evaluate
from lexweave.operators import quality as Q
from lexweave.operators import splits as S
from lexweave.operators.similar import Similarity, cross_split_anti, near_dup_pairs
from lexweave.plans.queries_text import WORDS, _SLOTS_SQL, _with_slots
from lexweave.plans.registry import (
    SQL_SAMPLES,
    documents,
    query,
    r6,
    samples,
    split_of,
    sql_canonical,
    sql_casefold,
    sql_folded,
    sql_key,
    sql_split,
)
from lexweave.sources.sinks import manifest
from lexweave.sources.tables import read_table

DIMENSIONS = ("lang", "source", "quality")


def canonical():
    return T.canonical_text(F.col("text"))


def folded():
    return T.folded_canonical(F.col("text"))


def labelled(spark, d):
    x = documents(spark, d, "doc_id", "lang", "source").withColumn("split", split_of(F.col("doc_id")))
    return x.join(read_table(spark, d, "labels", "doc_id", "quality"), "doc_id", "left")


@query(
    "q_profile",
    f"""WITH x AS (SELECT d.lang, d.source, l.quality::VARCHAR AS quality,
        {sql_split('d.doc_id')} AS split
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    y AS (SELECT 'lang' AS dimension, lang AS value, split FROM x
      UNION ALL SELECT 'source', source, split FROM x
      UNION ALL SELECT 'quality', quality, split FROM x)
    SELECT dimension, value, split, count(*) AS n FROM y GROUP BY ALL
    UNION ALL SELECT dimension, value, NULL, count(*) FROM y GROUP BY dimension, value""",
)
def q_profile(spark, d):
    return Q.corpus_profile(labelled(spark, d), DIMENSIONS)


@query(
    "q_profile_slots",
    f"""WITH {_SLOTS_SQL},
    y AS (SELECT 'slot' AS dimension, unnest(list_filter([
        CASE WHEN has_contact THEN 'contact_name' END, CASE WHEN has_dt THEN 'datetime' END,
        CASE WHEN has_mood THEN 'mood' END, CASE WHEN has_phone THEN 'phone_number' END],
        lambda x: x IS NOT NULL)) AS value, split FROM f
      UNION ALL SELECT 'intent', intent, split FROM f)
    SELECT dimension, value, split, count(*) AS n FROM y GROUP BY ALL
    UNION ALL SELECT dimension, value, NULL, count(*) FROM y GROUP BY dimension, value""",
)
def q_profile_slots(spark, d):
    return Q.corpus_profile(_with_slots(spark, d), ["intent"], "slots")


def _dup_sql(key: str) -> str:
    return f"""WITH x AS (SELECT sha256({key}) AS text_key, source FROM documents)
    SELECT text_key, count(*) AS n, min(source) AS first_group, max(source) AS last_group
    FROM x GROUP BY text_key HAVING min(source) < max(source)"""


@query("q_dup_exact", _dup_sql(sql_canonical("text")))
def q_dup_exact(spark, d):
    return Q.dup_groups(documents(spark, d, "text", "source"), canonical(), "source")


@query("q_dup_accentless", _dup_sql(sql_folded("text")))
def q_dup_accentless(spark, d):
    return Q.dup_groups(documents(spark, d, "text", "source"), folded(), "source")


@query(
    "q_prev_dup",
    f"""WITH x AS (SELECT sha256({sql_canonical('text')}) AS text_key, doc_id, source FROM documents),
    y AS (SELECT *, lag(source) OVER w AS prev_group, lag(doc_id) OVER w AS prev_id FROM x
      WINDOW w AS (PARTITION BY text_key ORDER BY source, doc_id))
    SELECT text_key, doc_id AS id, prev_id, source AS group_id, prev_group FROM y
    WHERE prev_group <> source""",
)
def q_prev_dup(spark, d):
    x = documents(spark, d, "doc_id", "text", "source")
    return Q.prev_duplicate(x, canonical(), ["source", "doc_id"], "source", "doc_id")


@query(
    "q_id_dups",
    "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def q_id_dups(spark, d):
    return Q.id_dups(read_table(spark, d, "lineitem", "l_orderkey"), "l_orderkey")


@query(
    "q_group_leakage",
    f"""WITH x AS (SELECT sha256({sql_folded('text')}) AS g, {sql_split('doc_id')} AS s FROM documents)
    SELECT g AS group_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT s)), ',') AS splits
    FROM x GROUP BY g HAVING count(DISTINCT s) > 1""",
)
def q_group_leakage(spark, d):
    x = documents(spark, d, "doc_id", "text")
    return Q.group_leakage(
        x.select(F.sha2(folded(), 256).alias("group_id"), split_of(F.col("doc_id")).alias("split"))
    )


@query(
    "q_source_ref",
    f"""WITH x AS (SELECT sha256({sql_folded('text')}) AS r, doc_id % 50 AS g, source FROM documents)
    SELECT r AS source_ref, min(g) AS first_group, max(g) AS last_group, count(*) AS n FROM x
    WHERE source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')
    GROUP BY r HAVING min(g) < max(g)""",
)
def q_source_ref(spark, d):
    x = documents(spark, d, "doc_id", "text", "source").select(
        F.sha2(folded(), 256).alias("source_ref"), (F.col("doc_id") % 50).alias("group_id"), "source"
    )
    return Q.source_ref_conflict(x, [f"src{i}" for i in range(8)])


@query(
    "q_same_split_dups",
    f"""SELECT {sql_split('doc_id')} AS split, sha256({sql_folded('text')}) AS text_key, count(*) AS n
    FROM documents GROUP BY ALL HAVING count(*) > 1""",
)
def q_same_split_dups(spark, d):
    x = documents(spark, d, "doc_id", "text").withColumn("split", split_of(F.col("doc_id")))
    return Q.same_split_dups(x, folded())


@query(
    "q_label_conflict",
    f"""SELECT sha256({sql_folded('text')}) AS text_key, count(*) AS n, min(source) AS first_label,
      max(source) AS last_label FROM documents GROUP BY 1 HAVING min(source) < max(source)""",
)
def q_label_conflict(spark, d):
    return Q.label_conflict(documents(spark, d, "text", "source"), folded(), "source")


@query(
    "q_drop_conflicts",
    f"""WITH x AS (SELECT doc_id, sha256({sql_folded('text')}) AS k, source FROM documents)
    SELECT doc_id, source FROM x WHERE k NOT IN
      (SELECT k FROM x GROUP BY k HAVING min(source) < max(source))""",
)
def q_drop_conflicts(spark, d):
    x = documents(spark, d, "doc_id", "text", "source")
    return Q.drop_label_conflicts(x, folded(), "source", ["doc_id", "source"])


@query(
    "q_reconcile",
    """WITH a AS (SELECT source, count(*) FILTER (n_chars >= 200) AS r, count(*) AS n
      FROM documents GROUP BY source)
    SELECT 'source' AS metric, source AS value, CASE WHEN r > 0 THEN r END AS recorded, n AS actual
    FROM a WHERE r <> n""",
)
def q_reconcile(spark, d):
    x = documents(spark, d, "source", "n_chars")

    def counted(rows):
        return rows.groupBy(F.lit("source").alias("metric"), F.col("source").alias("value")).agg(
            F.count("*").alias("n")
        )

    return Q.reconcile(counted(x.where("n_chars >= 200")), counted(x))


_EXPECTED = tuple(f"src{i}" for i in range(25))


@query(
    "q_missing_files",
    f"""SELECT unnest([{", ".join(repr(x) for x in _EXPECTED)}]) AS file
    EXCEPT SELECT source FROM documents""",
)
def q_missing_files(spark, d):
    x = documents(spark, d, "source").withColumnRenamed("source", "file")
    return Q.missing_files(x, _EXPECTED)


@query(
    "q_norm_audit",
    f"""WITH x AS (SELECT doc_id, {sql_canonical('text')} AS norm, {sql_casefold('text')} AS raw, lang,
        {sql_split('doc_id')} AS split FROM documents),
    k AS (SELECT sha256(norm) AS k, count(DISTINCT doc_id) AS ids, count(DISTINCT split) AS splits
          FROM x GROUP BY 1),
    y AS (SELECT 'change' AS metric, CASE WHEN norm <> raw THEN 'changed' ELSE 'unchanged' END AS value
          FROM x UNION ALL SELECT 'region', lang FROM x
          UNION ALL SELECT 'collision', CASE WHEN splits > 1 THEN 'cross_split' ELSE 'same_split' END
          FROM k WHERE ids > 1)
    SELECT metric, value, count(*) AS n FROM y GROUP BY ALL""",
)
def q_norm_audit(spark, d):
    x = evaluate(documents(spark, d, "doc_id", "text", "lang"), normalized_text=canonical()).select(
        F.col("doc_id").alias("id"),
        "text",
        "normalized_text",
        F.col("lang").alias("normalizer_region"),
        split_of(F.col("doc_id")).alias("split"),
    )
    return Q.normalization_audit(x, T.casefold(F.col("text")))


@query(
    "q_dedupe_priority",
    f"""WITH x AS (SELECT doc_id, sha256({sql_folded('text')}) AS k, {sql_split('doc_id')} AS split
      FROM documents)
    SELECT doc_id, split FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY
      CASE split WHEN 'test' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END, {sql_key('doc_id')}) = 1""",
)
def q_dedupe_priority(spark, d):
    x = documents(spark, d, "doc_id", "text").withColumn("split", split_of(F.col("doc_id")))
    return S.dedupe_priority(x, folded(), id_col="doc_id").select("doc_id", "split")


@query(
    "q_first_seen",
    f"""WITH x AS (SELECT doc_id, sha256({sql_folded('text')}) AS k, {sql_split('doc_id')} AS split
      FROM documents)
    SELECT doc_id, split FROM x QUALIFY split = 'test' OR
      row_number() OVER (PARTITION BY split, k ORDER BY doc_id) = 1""",
)
def q_first_seen(spark, d):
    x = documents(spark, d, "doc_id", "text").withColumn("split", split_of(F.col("doc_id")))
    return S.first_seen_dedupe(x, folded(), [F.col("doc_id")]).select("doc_id", "split")


@query(
    "q_first_seen_conflicts",
    f"""WITH x AS (SELECT {sql_split('doc_id')} AS split, {sql_folded('text')} AS k, source FROM documents)
    SELECT sha256(split || chr(1) || k) AS text_key, count(*) AS n, min(source) AS first_label,
      max(source) AS last_label FROM x WHERE split <> 'test' GROUP BY 1 HAVING min(source) < max(source)""",
)
def q_first_seen_conflicts(spark, d):
    x = documents(spark, d, "doc_id", "text", "source")
    x = x.withColumn("split", split_of(F.col("doc_id")))
    return S.first_seen_conflicts(x, folded(), "source")


@query(
    "q_group_first",
    """SELECT source, doc_id, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1""",
)
def q_group_first(spark, d):
    x = documents(spark, d, "doc_id", "lang", "source", "n_chars")
    out = S.group_first(x, ["source"], [F.desc("n_chars"), F.col("doc_id")])
    return out.select("source", "doc_id", "lang")


@query(
    "q_same_split_pick",
    f"""WITH {SQL_SAMPLES},
    x AS (SELECT id, split, region, intent, sha256({sql_folded('text')}) AS k,
      CASE annotation_quality WHEN 'reviewed' THEN 0 WHEN 'auto_mapped' THEN 1 ELSE 2 END AS q
      FROM samples),
    c AS (SELECT split, region, intent, count(*) AS kept FROM x
      WHERE (split, k) IN (SELECT (split, k) FROM x GROUP BY split, k HAVING count(*) = 1)
      GROUP BY ALL)
    SELECT id, split FROM x LEFT JOIN c USING (split, region, intent)
    QUALIFY row_number() OVER (PARTITION BY split, k
      ORDER BY q, coalesce(kept, 0), {sql_key('id')}, id) = 1""",
)
def q_same_split_pick(spark, d):
    return S.same_split_pick(samples(spark, d), folded(), columns=["id", "split"])


@query(
    "q_group_split",
    f"""WITH g AS (SELECT DISTINCT conv_id FROM conversations),
    r AS (SELECT conv_id, row_number() OVER (ORDER BY {sql_key('conv_id')}) AS rk,
      count(*) OVER () AS n FROM g),
    s AS (SELECT conv_id, CASE WHEN rk <= round_even(n * 0.7::DOUBLE, 0) THEN 'train'
      WHEN rk <= round_even(n * 0.7::DOUBLE, 0) + round_even(n * 0.15::DOUBLE, 0) THEN 'validation'
      ELSE 'test' END AS split FROM r)
    SELECT conv_id, turn, split FROM conversations JOIN s USING (conv_id)""",
)
def q_group_split(spark, d):
    x = read_table(spark, d, "conversations", "conv_id", "turn")
    return S.group_split(x, "conv_id").select("conv_id", "turn", "split")


_LIMITS = {"en": 250, "fr": 150, "de": 90, "es": 30}


@query(
    "q_quota",
    f"""WITH q AS (SELECT * FROM (VALUES {", ".join(
        f"('{k}', '{s}', round_even({v * share!r}::DOUBLE, 0))"
        for k, v in _LIMITS.items()
        for s, share in (("train", 0.70), ("validation", 0.15), ("test", 0.15)))})
        t(lang, split, quota)),
    x AS (SELECT doc_id, lang, {sql_split('doc_id')} AS split FROM documents)
    SELECT doc_id, lang, split FROM x JOIN q USING (lang, split)
    QUALIFY row_number() OVER (PARTITION BY lang, split ORDER BY {sql_key('doc_id')}) <= quota""",
)
def q_quota(spark, d):
    x = documents(spark, d, "doc_id", "lang").withColumn("split", split_of(F.col("doc_id")))
    out = S.quota_topk(x, _LIMITS, label="lang", id_col="doc_id")
    return out.select("doc_id", "lang", "split")


@query(
    "q_spread",
    f"""WITH t AS (SELECT * FROM (VALUES ('train', 0.7::DOUBLE), ('validation', 0.15::DOUBLE),
        ('test', 0.15::DOUBLE)) v(split, target)),
    c AS (SELECT {sql_split('doc_id')} AS split, count(*) AS n FROM documents GROUP BY 1)
    SELECT t.split, target, coalesce(n, 0) AS n,
      round(coalesce(n, 0)::DOUBLE / (SELECT sum(n) FROM c), 6) AS share FROM t LEFT JOIN c USING (split)""",
)
def q_spread(spark, d):
    x = documents(spark, d, "doc_id").select(split_of(F.col("doc_id")).alias("split"))
    return Q.split_shares(x).withColumn("share", r6("share"))


@query(
    "q_minimums",
    f"""WITH {_SLOTS_SQL},
    i AS (SELECT unnest(['set_reminder','set_alarm','ask_weather','play_music','call_contact']) AS intent),
    r AS (SELECT unnest(['north','central','south']) AS region),
    sl AS (SELECT unnest(['datetime','location','song','artist','contact_name','phone_number',
      'reminder_text']) AS slot),
    sp AS (SELECT unnest(['validation','test']) AS split),
    z AS (SELECT split, unnest(list_filter([CASE WHEN has_contact THEN 'contact_name' END,
      CASE WHEN has_dt THEN 'datetime' END, CASE WHEN has_phone THEN 'phone_number' END],
      lambda x: x IS NOT NULL)) AS slot FROM f)
    SELECT 'total' AS rule, 'all' AS cell, count(*) AS n FROM f HAVING count(*) < 1200
    UNION ALL SELECT 'intent', intent, (SELECT count(*) FROM f WHERE f.intent = i.intent) AS n FROM i
      WHERE n < 200
    UNION ALL SELECT 'region', region, (SELECT count(*) FROM f WHERE f.region = r.region) AS n FROM r
      WHERE n < 250
    UNION ALL SELECT 'test_region_intent', region || '/' || intent, (SELECT count(*) FROM f
      WHERE f.region = r.region AND f.intent = i.intent AND split = 'test') AS n FROM r, i WHERE n < 8
    UNION ALL SELECT 'split_slot', split || '/' || slot, (SELECT count(*) FROM z
      WHERE z.split = sp.split AND z.slot = sl.slot) AS n FROM sp, sl WHERE n < 8""",
)
def q_minimums(spark, d):
    return Q.minimums(_with_slots(spark, d))


@query(
    "q_filter_report",
    f"""WITH x AS (SELECT doc_id, source, n_chars, sha256({sql_folded('text')}) AS k FROM documents),
    y AS (SELECT * FROM x WHERE n_chars >= 200),
    z AS (SELECT * FROM y WHERE k NOT IN (SELECT k FROM y GROUP BY k HAVING min(source) < max(source))),
    c AS (SELECT 0 AS p, source FROM x UNION ALL SELECT 1, source FROM y UNION ALL SELECT 2, source FROM z),
    a AS (SELECT * FROM c UNION ALL SELECT p, 'all' FROM c),
    w AS (SELECT source, count(*) FILTER (p = 0) AS a0, count(*) FILTER (p = 1) AS a1,
      count(*) FILTER (p = 2) AS a2 FROM a GROUP BY source)
    SELECT 'length' AS step, source, a0 AS before, a1 AS after, a0 - a1 AS dropped FROM w
    UNION ALL SELECT 'conflicts', source, a1, a2, a1 - a2 FROM w""",
)
def q_filter_report(spark, d):
    x = documents(spark, d, "doc_id", "text", "source", "n_chars")
    y = x.where("n_chars >= 200")
    z = Q.drop_label_conflicts(y, folded(), "source", ["source"])
    return Q.filter_report([("all", x), ("length", y), ("conflicts", z)])


@query(
    "q_preprocess_counts",
    f"""WITH x AS (SELECT doc_id, sha256({sql_folded('text')}) AS k, {sql_split('doc_id')} AS split
      FROM documents),
    y AS (SELECT split, split = 'test' OR
      row_number() OVER (PARTITION BY split, k ORDER BY doc_id) = 1 AS kept FROM x)
    SELECT split, count(*) AS input, count(*) FILTER (kept) AS output,
      count(*) FILTER (NOT kept) AS dropped FROM y GROUP BY ROLLUP (split)""",
)
def q_preprocess_counts(spark, d):
    x = documents(spark, d, "doc_id", "text").withColumn("split", split_of(F.col("doc_id")))
    return Q.preprocess_counts(x, S.first_seen_dedupe(x, folded(), [F.col("doc_id")]))


@query(
    "q_required_coverage",
    f"""WITH x AS (SELECT {sql_split('doc_id')} AS split, lang AS intent, source AS slot FROM documents),
    n AS (SELECT DISTINCT intent, slot FROM x), s AS (SELECT unnest(['train','validation','test']) AS split)
    SELECT split, intent, slot FROM n, s WHERE (split, intent, slot) NOT IN
      (SELECT (split, intent, slot) FROM x)""",
)
def q_required_coverage(spark, d):
    x = documents(spark, d, "doc_id", "lang", "source")
    return Q.required_coverage(
        x.select(
            split_of(F.col("doc_id")).alias("split"),
            F.col("lang").alias("intent"),
            F.array("source").alias("slot_names"),
        )
    )


@query(
    "q_merge",
    f"""SELECT 'd' || doc_id AS id, {sql_split('doc_id')} AS split, lang AS kind FROM documents
    UNION ALL SELECT 'b' || item_id, 'test', NULL FROM benchmark
    UNION ALL SELECT 'c' || conv_id || '_' || turn, 'train', role FROM conversations""",
)
def q_merge(spark, d):
    x = documents(spark, d, "doc_id", "lang").select(
        F.concat(F.lit("d"), "doc_id").alias("id"),
        split_of(F.col("doc_id")).alias("split"),
        F.col("lang").alias("kind"),
    )
    b = read_table(spark, d, "benchmark", "item_id").select(
        F.concat(F.lit("b"), "item_id").alias("id"), F.lit("test").alias("split")
    )
    c = read_table(spark, d, "conversations", "conv_id", "turn", "role").select(
        F.concat(F.lit("c"), F.concat_ws("_", "conv_id", "turn")).alias("id"),
        F.lit("train").alias("split"),
        F.col("role").alias("kind"),
    )
    return x.unionByName(b, allowMissingColumns=True).unionByName(c)


@query(
    "q_manifest",
    f"""WITH {SQL_SAMPLES},
    x AS (SELECT *, CASE WHEN split = 'test' THEN 'test_' || region ELSE split END AS bucket FROM samples),
    y AS (SELECT 'bucket' AS metric, bucket AS value FROM x UNION ALL SELECT 'split', split FROM x
      UNION ALL SELECT 'intent', intent FROM x UNION ALL SELECT 'region', region FROM x
      UNION ALL SELECT 'source', source FROM x
      UNION ALL SELECT 'annotation_quality', annotation_quality FROM x
      UNION ALL SELECT 'total', 'all' FROM x)
    SELECT metric, value, count(*) AS n FROM y GROUP BY ALL""",
)
def q_manifest(spark, d):
    return manifest(samples(spark, d).drop("text"))


TOKEN_RULE = Similarity(sequence=None)

# Pairs by token Jaccard and length, from an inverted token join; equal empty texts match.
SQL_PAIRS = """
    tok AS (SELECT id, split, text, length(text) AS nc, unnest(list_distinct(list_filter(
        string_split(text, ' '), lambda t: t <> ''))) AS tok FROM u),
    cnt AS (SELECT id, count(*) AS n FROM tok GROUP BY id),
    sp AS (SELECT * FROM (VALUES ('train', 0), ('validation', 1), ('test', 2)) v(split, part)),
    tp AS (SELECT * FROM tok JOIN sp USING (split) JOIN cnt USING (id)),
    inter AS (SELECT a.id AS l, b.id AS r, a.part AS lp, b.part AS rp, count(*) AS c,
        any_value(a.n) AS an, any_value(b.n) AS bn
      FROM tp a JOIN tp b ON a.tok = b.tok AND a.part < b.part
        AND least(a.nc, b.nc)::DOUBLE / greatest(a.nc, b.nc) >= 0.88
        AND least(a.n, b.n) * 2 >= greatest(a.n, b.n)
      GROUP BY ALL),
    pairs AS (SELECT l, r, lp, rp, c::DOUBLE / (an + bn - c) AS score FROM inter
      WHERE c::DOUBLE / (an + bn - c) >= 0.5
      UNION ALL SELECT a.id, b.id, sa.part, sb.part, 1.0 FROM u a JOIN sp sa ON a.split = sa.split
        JOIN u b ON a.text = '' AND b.text = '' JOIN sp sb ON b.split = sb.split
      WHERE sa.part < sb.part)"""


@query(
    "q_near_dup",
    f"""WITH base AS (SELECT doc_id AS id, {sql_split('doc_id')} AS split,
        {sql_folded('text')} AS text FROM documents),
    u AS (SELECT min(id) AS id, split, text FROM base GROUP BY split, text), {SQL_PAIRS}
    SELECT s1.split AS left_split, l AS left_id, s2.split AS right_split, r AS right_id,
      round(score, 6) AS score
    FROM pairs JOIN sp s1 ON lp = s1.part JOIN sp s2 ON rp = s2.part
    ORDER BY lp, rp, l, r LIMIT 50""",
)
def q_near_dup(spark, d):
    x = documents(spark, d, "doc_id", "text").select(
        "doc_id", folded().alias("text"), split_of(F.col("doc_id")).alias("split")
    )
    return near_dup_pairs(x, "text", "doc_id", TOKEN_RULE, limit=50).withColumn("score", r6("score"))


@query("q_near_dup_sequence")
def q_near_dup_sequence(spark, d):
    x = documents(spark, d, "doc_id", "text").select(
        "doc_id", folded().alias("text"), split_of(F.col("doc_id")).alias("split")
    )
    return near_dup_pairs(x, "text", "doc_id", limit=50)


@query(
    "q_cross_split_anti",
    f"""WITH base AS (SELECT doc_id, {sql_split('doc_id')} AS split, {sql_folded('text')} AS text
        FROM documents),
    u AS (SELECT min(doc_id) AS id, split, text FROM base GROUP BY split, text), {SQL_PAIRS},
    badv AS (SELECT DISTINCT l FROM pairs WHERE lp = 1 AND rp = 2),
    badt AS (SELECT DISTINCT l FROM pairs WHERE lp = 0
      AND (rp = 2 OR r NOT IN (SELECT l FROM badv))),
    bad AS (SELECT split, text FROM u WHERE id IN (SELECT l FROM badv) AND split = 'validation'
      UNION ALL SELECT split, text FROM u WHERE id IN (SELECT l FROM badt) AND split = 'train')
    SELECT doc_id, split FROM base WHERE (split, text) NOT IN (SELECT (split, text) FROM bad)""",
)
def q_cross_split_anti(spark, d):
    x = documents(spark, d, "doc_id", "text").select(
        "doc_id", folded().alias("text"), split_of(F.col("doc_id")).alias("split")
    )
    out = cross_split_anti(x, "text", group="doc_id", id_col="doc_id", rule=TOKEN_RULE)
    return out.select("doc_id", "split")


@query(
    "q_rule_conflicts",
    f"""WITH w AS (SELECT * FROM (VALUES {", ".join(
        f"('{k}', '{s}', '{t}')" for k, ws in WORDS.items() for s, t in ws.items())}) v(region, src, dst)),
    a AS (SELECT src, dst FROM w UNION ALL SELECT lang, source FROM documents)
    SELECT src, min(dst) AS first_dst, max(dst) AS last_dst FROM a GROUP BY src
    HAVING min(dst) <> max(dst)""",
)
def q_rule_conflicts(spark, d):
    from lexweave.functions.rewrite import conflicting_rules

    fixed = [(k, s, t) for k, words in WORDS.items() for s, t in words.items()]
    table = spark.createDataFrame(fixed, "region string, src string, dst string").select("src", "dst")
    mined = documents(spark, d, "lang", "source").select(
        F.col("lang").alias("src"), F.col("source").alias("dst")
    )
    return conflicting_rules(table.unionByName(mined))
