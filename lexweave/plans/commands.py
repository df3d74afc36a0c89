"""Parse commands: normalise, score, resolve boundaries, gate, tag, and build the action row.

With a narrow scorer the whole plan is one narrow stage, so it runs the same on a stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions import text as T
from lexweave.functions.rewrite import normalize_corpus
from lexweave.functions.stage import evaluate, evaluate_fields, literal
from lexweave.operators import gates as G
from lexweave.operators.contracts import request_ok
from lexweave.operators.lookup import alias_lookup, catalog_match
from lexweave.operators.tagging import (
    Dictionaries,
    matched_slots,
    slots_by_intent,
    tag_columns,
    tag_contact,
    tag_phone,
)
from lexweave.rules import domains as D
from lexweave.rules import gates as R

Scorer = Callable[[DataFrame], DataFrame]

RESULT = (
    "text",
    "normalized_text",
    "region",
    "intent",
    "confidence",
    "slots",
    "action",
    "response",
    "matched_features",
)
_ACTION = "struct<type:string,status:string,payload:map<string,string>>"


def _slot(slots: Column, name: str) -> Column:
    return F.try_element_at(F.try_element_at(slots, F.lit(name)), F.lit(1))


def action_payload(intent: Column, slots: Column) -> Column:
    """Struct ``(action, response)`` for a complete command; a simulated action and its sentence."""
    reminder, datetime = _slot(slots, "reminder_text"), _slot(slots, "datetime")
    location, song, artist = _slot(slots, "location"), _slot(slots, "song"), _slot(slots, "artist")
    contact, phone = _slot(slots, "contact_name"), _slot(slots, "phone_number")

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def optional(prefix: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(prefix), value), F.lit(""))

    target = F.coalesce(contact, phone)
    by_artist = F.concat(F.lit("nhạc của "), artist)
    with_song = F.concat(song, optional(" của ", artist))
    payloads = {
        "set_reminder": (
            {"reminder_text": reminder, "datetime": datetime},
            text("Đã giả lập tạo lời nhắc “", reminder, "”", optional(" vào ", datetime), "."),
        ),
        "set_alarm": (
            {"datetime": datetime},
            text("Đã giả lập đặt báo thức vào ", datetime, "."),
        ),
        "ask_weather": (
            {"location": location, "datetime": datetime},
            text(
                "Đã giả lập yêu cầu thời tiết tại ",
                F.coalesce(location, F.lit("vị trí hiện tại")),
                " vào ",
                F.coalesce(datetime, F.lit("hiện tại")),
                ".",
            ),
        ),
        "play_music": (
            {"song": song, "artist": artist},
            text(
                "Đã giả lập phát ",
                F.coalesce(with_song, by_artist, F.lit("danh sách nhạc mặc định")),
                ".",
            ),
        ),
        "call_contact": (
            {"contact_name": contact, "phone_number": phone, "target": target},
            text("Đã giả lập cuộc gọi tới ", target, "."),
        ),
    }
    out = None
    for name, (payload, response) in payloads.items():
        entries = F.create_map(*[x for k, v in payload.items() for x in (F.lit(k), v)])
        action = F.struct(
            F.lit(R.ACTION_TYPES[name]).alias("type"),
            F.lit("mocked").alias("status"),
            entries.alias("payload"),
        ).cast(_ACTION)
        row = F.struct(action.alias("action"), response.alias("response"))
        out = F.when(intent == name, row) if out is None else out.when(intent == name, row)
    return out


#: The reason of a refused request.
INVALID = "invalid_request"


def invalid_requests(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~request_ok(F.col(text)))


def parse_corpus(
    df: DataFrame,
    scorer: Scorer,
    text: str = "text",
    hint: str | None = None,
    dictionaries: Dictionaries | None = None,
    threshold: float = D.CONFIDENCE_THRESHOLD,
    gate: bool = True,
    act: bool = True,
    compose: bool = True,
    keep: tuple[str, ...] = ("id",),
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Parse every request; see ``RESULT`` for the columns added to ``keep``.

    A request that breaks its contract is refused: it stays as a row with intent ``unknown``,
    confidence 0, no slots and no action, and says ``invalid_request`` as its reason, so reports
    count it as a failure.

    ``scorer`` adds ``predicted``, ``confidence`` and ``probs`` from ``normalized_text``. Rejected
    rows get intent ``unknown``, no slots and no action. ``extra`` names inner columns to keep
    (``predicted``, ``probs``, ``tag_<slot>``, ``gate_reason``).
    """
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold lies in [0, 1]")
    dictionaries = dictionaries or Dictionaries()
    columns = dict.fromkeys([*keep, text, *([hint] if hint else [])])
    rows = evaluate(df.select(*columns), __ok=F.coalesce(request_ok(F.col(text)), F.lit(False)))
    rows = normalize_corpus(rows, text, hint, compose=compose)
    rows = tag_columns(scorer(rows), "normalized_text", dictionaries)

    norm = F.col("normalized_text")
    reminder = F.col("tag_reminder_text")
    rows = evaluate(rows, __call_phone_number=tag_phone(reminder), __reminder=T.strip_diacritics(reminder))
    contact = tag_contact(reminder, F.col("__reminder"), dictionaries)
    rows = evaluate(
        rows, __call_contact_name=F.when(F.col("__call_phone_number").isNull(), contact)
    ).drop("__reminder")
    boundary_rule = G.boundary_resolve(
        norm,
        F.col("predicted"),
        lambda slot: F.col(f"tag_{slot}"),
        lambda slot: F.col(f"__call_{slot}"),
    )
    rows = evaluate_fields(rows, boundary_rule, "__intent", "__matched")
    intent, matched = F.col("__intent"), F.col("__matched")
    rows = evaluate(
        rows,
        __check=G.confidence_gate(F.col("confidence"), matched, threshold),
        __slots=slots_by_intent(intent),
    )
    if gate:
        rows = G.action_gate(rows, "normalized_text", "__intent", "__slots")
    else:
        rows = rows.withColumns({"gate_reason": F.lit("off"), "gate_allowed": F.lit(True)})
    slots = F.col("__slots")
    low = F.col("__check") == "reject"
    blocked = ~F.col("gate_allowed")
    rows = evaluate(rows, __missing=G.required_slots(norm, intent, slots))
    rows = evaluate_fields(rows, action_payload(intent, slots), "__action", "__answer")
    missing = F.col("__missing")
    incomplete = F.size(missing) > 0
    vague = (
        (intent == "ask_weather")
        & incomplete
        & ~F.map_contains_key("__slots", "location")
    )
    changed = intent != F.col("predicted")
    boundary = F.concat(
        F.when(
            changed,
            F.array(F.concat(F.lit("intent_boundary:"), "predicted", F.lit("->"), intent)),
        )
        .when(matched, F.array(F.concat(F.lit("intent_boundary_confirmed:"), intent)))
        .otherwise(_none()),
        F.when(
            F.col("__check") == "override",
            F.array(F.lit("confidence_override:high_precision_boundary")),
        ).otherwise(_none()),
    )
    variants = F.col("matched_variants")
    features = (
        F.when(
            low,
            F.concat(
                variants,
                F.array(
                    F.concat(F.lit("intent_rejected:"), "predicted"),
                    F.lit(f"confidence_threshold:{threshold:.2f}"),
                ),
            ),
        )
        .when(
            blocked,
            F.concat(
                variants,
                boundary,
                F.array(
                    F.concat(F.lit("intent_rejected:"), intent),
                    F.concat(F.lit("action_gate:"), F.col("gate_reason")),
                ),
            ),
        )
        .otherwise(
            F.concat(
                variants,
                F.array(F.concat(F.lit("intent_model:"), "predicted")),
                boundary,
                matched_slots(slots),
                F.when(vague, F.array(F.lit("location_clarification:placeholder")))
                .when(
                    incomplete,
                    F.array(
                        F.concat(F.lit("missing_required_slots:"), F.array_join(missing, "|"))
                    ),
                )
                .otherwise(_none()),
            )
        )
    )
    ok = F.col("__ok")
    rejected = low | blocked | ~ok
    done = F.col("__answer") if act else F.concat(
        F.lit("Đã nhận diện intent "), intent, F.lit(".")
    )
    no_slots = F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")
    acted = ~rejected & ~incomplete & F.lit(act)
    result = {
        "region": F.col("normalizer_region"),
        "intent": F.when(rejected, F.lit(D.UNKNOWN)).otherwise(intent),
        "slots": F.when(rejected, no_slots).otherwise(slots),
        "action": F.when(acted, F.col("__action")),
        "response": F.when(~ok, F.lit(None))
        .when(low, F.lit(R.LOW_CONFIDENCE))
        .when(blocked, F.lit(R.NOT_A_COMMAND))
        .when(incomplete, G.prompt_for(intent, missing))
        .otherwise(done),
        "matched_features": F.when(ok, features).otherwise(F.array(F.lit(INVALID))),
        "gate_reason": F.when(~ok, F.lit(INVALID)).when(~low, F.col("gate_reason")),
    }
    final = evaluate(rows, **{f"__r_{k}": c for k, c in result.items()})
    named = {k: F.col(f"__r_{k}").alias(k) for k in result}
    named |= {"text": F.col(text).alias("text"), "normalized_text": norm}
    named["confidence"] = F.when(ok, F.col("confidence")).otherwise(0.0).alias("confidence")
    named["predicted"] = F.when(ok, F.col("predicted")).otherwise(D.UNKNOWN).alias("predicted")
    own = [k for k in keep if k not in RESULT]
    return final.select(*own, *[named[k] for k in RESULT], *[named.get(k, F.col(k)) for k in extra])


def _none() -> Column:
    return F.array().cast("array<string>")


def enrich_actions(parsed: DataFrame, contacts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolve call targets and music against dimension tables and say what was found.

    Weather without a real place becomes ``unavailable``. Rows without action pass unchanged.
    """
    kind = F.col("action")["type"]
    keyed = parsed.withColumns(
        {
            "__contact": F.when(kind == "call", _slot(F.col("slots"), "contact_name")),
            "__song": F.when(kind == "play_music", _slot(F.col("slots"), "song")),
            "__artist": F.when(kind == "play_music", _slot(F.col("slots"), "artist")),
        }
    )
    found = catalog_match(
        alias_lookup(keyed, contacts, "__contact"), catalog, "__song", "__artist"
    )
    place = T.normalize_surface(_slot(F.col("slots"), "location"))
    no_place = (kind == "query_weather") & (place.isNull() | place.isin(*R.PLACEHOLDER_PLACES))
    known = (kind == "call") & F.col("resolved_name").isNotNull()
    music = (kind == "play_music") & (F.col("n_matches") > 0)
    response = (
        F.when(no_place, F.lit("Bạn muốn xem thời tiết ở địa điểm nào?"))
        .when(
            known,
            F.concat(
                F.lit("Đã tìm thấy "), "resolved_name", F.lit(" trong danh bạ giả lập ("),
                "resolved_phone", F.lit("); chưa thực hiện cuộc gọi thật."),
            ),
        )
        .when(
            music & F.col("__song").isNotNull(),
            F.concat(
                F.lit("Đã chọn “"), "match_song", F.lit("” của "), "match_artist",
                F.lit(" trong catalog demo; chưa phát trên thiết bị thật."),
            ),
        )
        .when(
            music,
            F.concat(
                F.lit("Catalog demo có "), F.col("n_matches").cast("string"), F.lit(" bài của "),
                "match_artist", F.lit("; chưa phát trên thiết bị thật."),
            ),
        )
        .otherwise(F.col("response"))
    )
    extra = (
        F.when(
            known,
            F.create_map(
                F.lit("resolved_name"), F.col("resolved_name"),
                F.lit("resolved_phone_number"), F.col("resolved_phone"),
                F.lit("data_source"), F.lit("fake_contacts"),
            ),
        )
        .when(
            music,
            F.create_map(
                F.lit("match_song"), F.col("match_song"),
                F.lit("match_artist"), F.col("match_artist"),
                F.lit("n_matches"), F.col("n_matches").cast("string"),
                F.lit("data_source"), F.lit("music_catalog"),
            ),
        )
        .otherwise(F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))
    )
    payload = F.when(
        no_place, F.create_map(F.lit("reason"), F.lit("missing_location"))
    ).otherwise(F.map_concat(F.col("action")["payload"], extra))
    status = F.when(no_place, F.lit("unavailable")).otherwise(F.col("action")["status"])
    action = F.when(
        F.col("action").isNotNull(),
        F.struct(kind.alias("type"), status.alias("status"), payload.alias("payload")),
    )
    return found.withColumns({"response": response, "action": action}).select(*parsed.columns)


def constant_scorer(intent: str, confidence: float = 1.0) -> Scorer:
    """Scorer that predicts one intent, for callers that bring their own labels."""

    def run(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "predicted": F.lit(intent),
                "confidence": F.lit(confidence),
                "probs": literal({intent: confidence}, "map<string,double>"),
            }
        )

    return run
