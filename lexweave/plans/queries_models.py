"""Feature, classifier, action, parse and stream queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.operators import classify as K
from lexweave.operators import features as X
from lexweave.operators import gates as G
from lexweave.operators import metrics as M
from lexweave.plans import build as B
from lexweave.plans import commands as C
from lexweave.plans.prepare import preprocess
from lexweave.plans.registry import documents, query, r6, samples, split_of, sql_surface
from lexweave.plans.scoring import score_table
from lexweave.session import ensure_checkpoint_dir
from lexweave.sources.tables import HEAVY_ROWS, read_table

_WORD_BLOCK = (X.Block("word", 1, 2, 2),)
_CHAR_BLOCK = (X.Block("char", 3, 4, 2),)


def _tfidf_report(spark, d, blocks):
    """Per term: document frequency, idf and summed weight over all documents."""
    weights = X.term_weights(documents(spark, d, "doc_id", "text"), "text", blocks, "doc_id")
    return weights.select(
        "term", "df", F.round("idf", 6).alias("idf"), F.round("weight", 4).alias("weight")
    )


def _sql_tfidf(terms: str) -> str:
    return f"""WITH n AS (SELECT count(*) AS n FROM documents), {terms},
    tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2),
    idf AS (SELECT term, df, ln((1.0::DOUBLE + n) / (df + 1.0::DOUBLE)) + 1 AS idf FROM df, n),
    raw AS (SELECT doc_id, term, df, idf, (ln(tf) + 1) * idf AS raw FROM tf JOIN idf USING (term)),
    nrm AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY doc_id)
    SELECT term, any_value(df) AS df, round(any_value(idf), 6) AS idf,
      round(sum(raw / norm), 4) AS weight FROM raw JOIN nrm USING (doc_id) GROUP BY term"""


@query(
    "q_tfidf_word",
    _sql_tfidf(
        r"""w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'),
          lambda t: length(t) >= 2) AS w FROM documents),
        g AS (SELECT doc_id, unnest(w) AS term FROM w
          UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM w, unnest(range(1, len(w)::BIGINT)) u(i))"""
    ),
)
def q_tfidf_word(spark, d):
    return _tfidf_report(spark, d, _WORD_BLOCK)


@query(
    "q_tfidf_char",
    _sql_tfidf(
        r"""p AS (SELECT doc_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text),
            '[\s\x0b\x{85}\p{Z}]+'), lambda t: t <> '')) || ' ' AS w FROM documents),
        g AS (SELECT doc_id, substr(w, i, 3) AS term FROM p, unnest(range(1, length(w) - 1)) u(i)
          UNION ALL SELECT doc_id, substr(w, i, 4) FROM p, unnest(range(1, length(w) - 2)) u(i)
            WHERE length(w) >= 4)"""
    ),
)
def q_tfidf_char(spark, d):
    return _tfidf_report(spark, d, _CHAR_BLOCK)


def _labelled(spark, d):
    """Conversation turns with their role as label; a conversation stays in one split."""
    x = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return x.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        F.col("role").alias("intent"),
        T.normalize_surface(F.col("text")).alias("normalized_text"),
        split_of(F.col("conv_id")).alias("split"),
    )


@query("q_lr_predict")
def q_lr_predict(spark, d):
    """Select a candidate on the validation split, refit, score the rows held out for test."""
    x = _labelled(spark, d)
    model, _ = K.select_candidate(
        x.where("split = 'train'"), x.where("split = 'validation'")
    )
    scored = model.score(x.where("split = 'test'"))
    return scored.select(
        "id", F.col("intent").alias("expected"), "predicted", r6("confidence").alias("confidence")
    )


def _vectors(spark, d):
    x = read_table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return x.withColumn("split", split_of(F.col("vec_id")))


@query("q_embedding_lr")
def q_embedding_lr(spark, d):
    x = _vectors(spark, d)
    model, _ = K.select_vectors(
        x.where("split = 'train'"), x.where("split = 'validation'"), "embedding", "label"
    )
    return model.score(x.where("split = 'test'")).select(
        "vec_id", "label", "predicted", r6("confidence").alias("confidence")
    )


@query("q_model_compare")
def q_model_compare(spark, d):
    """Rule baseline against the selected classifier on the rows held out for test."""
    x = _labelled(spark, d)
    held = x.where("split = 'test'").withColumn("expected", F.col("intent"))
    model, _ = K.select_candidate(x.where("split = 'train'"), x.where("split = 'validation'"))
    rules = {
        "user": (r"\?\s*$", r"^.{1,400}$"),
        "assistant": (r"^.{401,}$", r"^.{800,}$"),
        "system": (r"\bsystem\b",),
    }
    base = G.rule_classify(held, "normalized_text", rules)
    out = K.model_compare(base, model.score(held), ["assistant", "system", "user"])
    return out.withColumns({c: r6(c) for c in ("accuracy", "macro_f1", "weighted_f1")})


def _conversation_slots(spark, d):
    x = read_table(spark, d, "conversations", "conv_id", "turn", "text")
    intents = F.array(*[F.lit(i) for i in C.R.ACTION_TYPES])
    w = F.split(T.normalize_surface(F.col("text")), " ", -1)
    first = F.get(w, F.lit(0))
    others = F.when(F.size(w) > 1, F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))
    k = F.col("conv_id") + F.col("turn")
    return x.select(
        "conv_id",
        "turn",
        F.get(intents, (k % 5).cast("int")).alias("intent"),
        first.alias("a"),
        F.when(k % 2 == 0, others).alias("b"),
    )


@query(
    "q_action_payload",
    f"""WITH w AS (SELECT conv_id, turn, string_split({sql_surface('text')}, ' ') AS w,
        ['set_reminder','set_alarm','ask_weather','play_music','call_contact'][
          ((conv_id + turn) % 5 + 1)::INT] AS intent, (conv_id + turn) % 2 = 0 AS even
      FROM conversations),
    s AS (SELECT conv_id, turn, intent, w[1] AS a, CASE WHEN even AND len(w) > 1 THEN array_to_string(w[2:], ' ') END AS b FROM w)
    SELECT conv_id, turn, CASE intent
      WHEN 'set_reminder' THEN 'Đã giả lập tạo lời nhắc “' || a || '”' || coalesce(' vào ' || b, '') || '.'
      WHEN 'set_alarm' THEN 'Đã giả lập đặt báo thức vào ' || a || '.'
      WHEN 'ask_weather' THEN 'Đã giả lập yêu cầu thời tiết tại ' || coalesce(b, 'vị trí hiện tại')
        || ' vào ' || a || '.'
      WHEN 'play_music' THEN 'Đã giả lập phát ' || coalesce(b || ' của ' || a, 'nhạc của ' || a) || '.'
      ELSE 'Đã giả lập cuộc gọi tới ' || coalesce(b, a) || '.' END AS response,
      CASE intent WHEN 'set_reminder' THEN 'create_reminder' WHEN 'set_alarm' THEN 'set_alarm'
        WHEN 'ask_weather' THEN 'query_weather' WHEN 'play_music' THEN 'play_music' ELSE 'call' END
        AS action_type,
      CASE WHEN intent = 'call_contact' THEN coalesce(b, a) END AS target
    FROM s""",
)
def q_action_payload(spark, d):
    x = _conversation_slots(spark, d)
    names = {
        "set_reminder": ("reminder_text", "datetime"),
        "set_alarm": ("datetime", None),
        "ask_weather": ("datetime", "location"),
        "play_music": ("artist", "song"),
        "call_contact": ("phone_number", "contact_name"),
    }
    slots = None
    for intent, (one, two) in names.items():
        entries = [F.struct(F.lit(one).alias("key"), F.array("a").alias("value"))]
        if two:
            second = F.struct(F.lit(two).alias("key"), F.array("b").alias("value"))
            entries.append(F.when(F.col("b").isNotNull(), second))
        made = F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))
        hit = F.col("intent") == intent
        slots = F.when(hit, made) if slots is None else slots.when(hit, made)
    out = x.withColumn("slots", slots).withColumn(
        "p", C.action_payload(F.col("intent"), F.col("slots"))
    )
    return out.select(
        "conv_id",
        "turn",
        F.col("p.response").alias("response"),
        F.col("p.action.type").alias("action_type"),
        F.col("p.action.payload")["target"].alias("target"),
    )


def _requests(spark, d):
    x = read_table(spark, d, "conversations", "conv_id", "turn", "text", rows=HEAVY_ROWS)
    return x.select(F.concat_ws("_", "conv_id", "turn").alias("id"), "text")


def _parsed_columns(parsed):
    return parsed.select(
        "id",
        "normalized_text",
        "region",
        "intent",
        r6("confidence").alias("confidence"),
        F.to_json("slots").alias("slots"),
        F.col("action")["type"].alias("action_type"),
        "response",
        F.array_join("matched_features", "; ").alias("matched_features"),
    )


@query("q_parse_corpus")
def q_parse_corpus(spark, d):
    return _parsed_columns(C.parse_corpus(_requests(spark, d), G.rule_classify))


@query("q_parse_stream")
def q_parse_stream(spark, d):
    """The same parse as a stream over the table's files."""
    from lexweave.streaming.commands import parse_stream

    source = spark.readStream.schema("conv_id bigint, turn bigint, role string, text string")
    stream = source.parquet(f"{d}/conversations.parque[t]").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), "text"
    )
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = parse_stream(stream, G.rule_classify, f"{base}/rows", f"{base}/state")
    run.awaitTermination()
    if run.exception() is not None:
        raise run.exception()
    return _parsed_columns(spark.read.parquet(f"{base}/rows"))


@query("q_enrich")
def q_enrich(spark, d):
    """Action rows made from customers' nations and parts, resolved against both tables."""
    parsed = C.parse_corpus(_requests(spark, d), C.constant_scorer("call_contact"), gate=False)
    nation = read_table(spark, d, "nation", "n_nationkey", "n_name").select(
        F.col("n_name").alias("name"),
        F.array().cast("array<string>").alias("aliases"),
        F.col("n_nationkey").cast("string").alias("phone_number"),
    )
    catalog = read_table(spark, d, "part", "p_partkey", "p_name", "p_brand").select(
        F.col("p_partkey").alias("position"),
        F.col("p_name").alias("song"),
        F.col("p_brand").alias("artist"),
    )
    out = C.enrich_actions(parsed, nation, catalog)
    return out.select(
        "id", "intent", F.col("action")["status"].alias("status"), "response"
    )


@query("q_score_commands")
def q_score_commands(spark, d):
    """Scored table over short conversation turns labelled by turn number."""
    x = read_table(spark, d, "conversations", "conv_id", "turn", "role", "text", rows=HEAVY_ROWS)
    none = F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")
    rows = x.select(
        F.concat_ws("_", "conv_id", "turn").alias("id"),
        "text",
        F.lit("standard").alias("region"),
        F.get(F.array(*map(F.lit, C.D.INTENTS)), (F.col("turn") % 5).cast("int")).alias("intent"),
        none.alias("slots"),
        F.col("role").alias("source"),
        F.lit("casual").alias("variant_type"),
        F.lit("reviewed").alias("annotation_quality"),
    )
    scored = score_table(rows, G.rule_classify)
    flags = M.frame_flags()
    out = M.sliced_eval(scored, ["source", "expected"], flags)
    return out.withColumns({c: r6(c) for c in flags})


@query("q_preprocess")
def q_preprocess(spark, d):
    """Prepared corpus over the documents as samples, without their punctuation-free copies."""
    first = T.first_word(F.col("text"))
    rows = samples(spark, d).withColumn(
        "slots", F.create_map(F.lit("contact_name"), F.array(first))
    )
    return preprocess(
        rows,
        "id",
        "split",
        F.sha2("normalized_text", 256).alias("text_key"),
        "normalizer_region",
        F.size("matched_variants").alias("n_rules"),
        F.col("normalized_slots")["contact_name"][0].alias("contact"),
    )


@query(
    "q_judgments",
    """WITH j AS (SELECT l_orderkey, count(*) AS n,
        count(*) FILTER (l_quantity >= 20) AS iv, count(*) FILTER (l_returnflag <> 'R') AS lv,
        count(*) FILTER (l_linenumber IN (1, 2)) AS sv, avg(floor(l_quantity / 10)) AS g,
        avg(round(l_discount * 100)) AS s FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey, n >= 2 AND iv >= 2 AND lv >= 2 AND sv >= 2 AND g >= 3.5 AND s >= 1.5 AS good FROM j""",
)
def q_judgments(spark, d):
    """Order lines read as judgments of their order; an order has few lines."""
    x = read_table(
        spark, d, "lineitem", "l_orderkey", "l_quantity", "l_returnflag", "l_linenumber", "l_discount"
    )
    one = F.struct(
        (F.col("l_quantity") >= 20).cast("int").alias("intent_score"),
        F.when(F.col("l_returnflag") != "R", "target").otherwise("other").alias("language_identification"),
        F.col("l_linenumber").alias("slots_score"),
        F.floor(F.col("l_quantity") / 10).cast("double").alias("grammar_score"),
        F.round(F.col("l_discount") * 100).alias("spelling_score"),
    )
    grouped = x.groupBy("l_orderkey").agg(F.collect_list(one).alias("judgments"))
    return grouped.select("l_orderkey", B.judgments_ok(F.col("judgments")).alias("good"))
