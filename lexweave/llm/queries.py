"""The registered queries of the subpackage, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import bpe, chat, equal_average, filter_audit, warc
from lexweave.llm.bag_minhash import duplicate_classes
from lexweave.llm.contamination import leaks
from lexweave.llm.line_templates import line_report
from lexweave.llm.positive_unlabelled import is_held_out, score, train
from lexweave.llm.robust_outliers import with_verdicts
from lexweave.llm.suffix_repeats import repeats
from lexweave.llm.support import read
from lexweave.llm.token_counts import token_counts
from lexweave.llm.url_trust import verdicts
from lexweave.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op1_bpe")
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every document; the digests tell of every id and character."""
    documents = read(spark, folder, "documents", "doc_id", "text")
    back = bpe.encode(documents, VOCABULARY, decoded="decoded")
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op7_line_templates")
def op7_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: lines, lines of recurring templates, digest of what remains."""
    return line_report(read(spark, folder, "documents", "doc_id", "text"))


@query("op8_bag_minhash")
def op8_bag_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Per document: its class of near duplicates and the class's size."""
    return duplicate_classes(read(spark, folder, "documents", "doc_id", "text"))


@query("op3_contamination")
def op3_contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item of which it holds a copy or an edited copy."""
    return leaks(
        read(spark, folder, "documents", "doc_id", "text"),
        read(spark, folder, "benchmark", "item_id", "text"),
    )


@query("op5_quality")
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The quality score of every document."""
    documents = read(spark, folder, "documents", "doc_id", "text")
    scorer = train(documents, read(spark, folder, "labels", "doc_id", "quality"))
    return score(documents, scorer).select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op2_url_trust")
def op2_url_trust(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict, by the longest rule or by its host's trust and distrust."""
    return verdicts(read(spark, folder, "pages", "page_id", "url", "html"))


SQL_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'),
                   (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
sized AS (
  SELECT *, length(role) + length(text) + 14
         + 2 * 0 + length(regexp_replace(text, '[^\\#<]', '', 'g'))
         + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) AS size
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
         AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""


@query("op6_chat_prefix_targets", SQL_CHAT)
def op6_chat_prefix_targets(spark: SparkSession, folder: str) -> DataFrame:
    """Format every conversation, and read turns and replies back from the formatted strings."""
    turns = read(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(own)))


SQL_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT d.page_id, d.n::BIGINT AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN coalesce(f.first, d.page_id) = d.page_id THEN 'response' ELSE 'revisit' END
         AS record_type,
       CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON f.digest = d.digest"""


@query("op9_warc_chunks", SQL_WARC)
def op9_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Write an archive record for every page and read the archive's files back."""
    return warc.round_trip(read(spark, folder, "pages", "page_id", "url", "html"))


@query("op4_robust_outliers")
def op4_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's base statistics and its verdict within its language and source."""
    documents = read(spark, folder, "documents", "doc_id", "text", "lang", "source")
    return with_verdicts(documents).drop("lang", "source", "distance")


@query("op10_suffix_repeats")
def op10_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that shares a passage of 50 words or more with another text."""
    return repeats(read(spark, folder, "documents", "doc_id", "text"))


SQL_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part FROM documents),
w AS (SELECT doc_id, t, part, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part,
             (len(words) < 200)::INT
             + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > first, FALSE)::INT AS failed
      FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
      FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
      FROM m LEFT JOIN l USING (doc_id) GROUP BY part, failed),
f(i, name) AS (VALUES (0, 'A'), (1, 'B'), (2, 'C'), (3, 'D'), (4, 'E')),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
             [1 << a.i, 1 << b.i, 1 << c.i, 1 << d.i, 1 << e.i] AS bits
      FROM f a, f b, f c, f d, f e
      WHERE (1 << a.i) | (1 << b.i) | (1 << c.i) | (1 << d.i) | (1 << e.i) = 31),
s AS (SELECT filter_order, step, bits[step] AS own,
             coalesce(list_sum(list_slice(bits, 1, step - 1)), 0)::INT AS before
      FROM o, range(1, 6) AS r(step)),
k AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (failed & (before | own) = 0), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (failed & before = 0 AND failed & own > 0), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (failed & before > 0 AND failed & own > 0), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (failed & before = 0 AND failed & own > 0), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (failed & before = 0 AND failed & own > 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM k"""


@query("op11_filter_audit", SQL_AUDIT)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What each of five filters removes in every order of them, per source."""
    return filter_audit.audit(
        read(spark, folder, "documents", "doc_id", "text", "source"),
        read(spark, folder, "labels", "doc_id", "quality", "toxic"),
    )


def _sql_codes(rounds: int) -> str:
    """The codebooks of each round follow from the assignments to those of the round before."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
e{i} AS (SELECT *, list_dot_product(c, c) AS cc FROM c{i}),
a{i} AS (SELECT r, part, x, arg_min(entry, (round(xx - 2 * list_dot_product(x, c) + cc)::BIGINT, entry)) AS entry,
               min(round(xx - 2 * list_dot_product(x, c) + cc)::BIGINT) AS distance
        FROM p JOIN e{i} USING (part) GROUP BY r, part, x)""")
        if i < rounds:
            steps.append(f"""
u{i} AS (SELECT part, entry, place, floor(sum(x[place]) / count(*)) AS mean
        FROM a{i}, unnest(generate_series(1, len(x))) AS g(place) GROUP BY part, entry, place),
v{i} AS (SELECT part, entry, list(mean ORDER BY place) AS c FROM u{i} GROUP BY part, entry),
c{i + 1} AS (SELECT part, entry, coalesce(v{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN v{i} USING (part, entry))""")
    return f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
                  list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
h AS (SELECT r, part, list_slice(v, part * len(v) // 4 + 1, (part + 1) * len(v) // 4) AS x
      FROM k, range(4) AS t(part)),
p AS (SELECT *, list_dot_product(x, x) AS xx FROM h),
c0 AS (SELECT part, r - 1 AS entry, x AS c FROM h WHERE r <= 256),{','.join(steps)},
b AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ','
                               ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
s AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
             sum(distance)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM k JOIN s USING (r), b"""


@query("op12_equal_average", _sql_codes(4))
def op12_equal_average(spark: SparkSession, folder: str) -> DataFrame:
    """The codes of every vector by four codebooks of 256 entries, with their errors."""
    vectors = read(spark, folder, "embeddings", "vec_id", "embedding", "label")
    digits = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return equal_average.compressed(vectors).select(
        F.col("id").alias("vec_id"),
        digits.alias("code"),
        "error",
        "label_error",
        F.col("codebooks").alias("codebooks_sha256"),
    )


@query("op13_token_counts")
def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The token count of every document; each call fills a cache of its own, so that its work is whole."""
    documents = read(spark, folder, "documents", "doc_id", "text")
    cache = f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    return token_counts(documents, VOCABULARY, cache).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit")
    )
