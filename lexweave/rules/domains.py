"""Label domains and slot contracts.

Fixed values: label names, their order, and which slots each intent allows or needs.
"""

INTENTS = ("set_reminder", "set_alarm", "ask_weather", "play_music", "call_contact")
UNKNOWN = "unknown"
REGIONS = ("standard", "north", "central", "south")
DIALECTS = ("north", "central", "south")
SLOTS = (
    "datetime",
    "location",
    "song",
    "artist",
    "contact_name",
    "phone_number",
    "reminder_text",
)
SPLITS = ("train", "validation", "test")
EXTERNAL_SOURCES = ("massive", "web_mined")
SOURCES = ("synthetic", "manual", "massive", "web_mined", "asr_noise")
VARIANTS = (
    "accented",
    "no_diacritics",
    "regional",
    "asr_noise",
    "formal",
    "casual",
    "translated",
)
QUALITY_ORDER = ("reviewed", "auto_mapped", "template_generated")

ALLOWED_SLOTS = {
    "set_reminder": ("reminder_text", "datetime"),
    "set_alarm": ("datetime",),
    "ask_weather": ("location", "datetime"),
    "play_music": ("song", "artist"),
    "call_contact": ("contact_name", "phone_number"),
}
# One complete group is enough; an empty group means nothing is needed.
REQUIRED_GROUPS = {
    "set_reminder": (("reminder_text",),),
    "set_alarm": (("datetime",),),
    "ask_weather": ((),),
    "play_music": ((),),
    "call_contact": (("contact_name",), ("phone_number",)),
}
LEXICON_SLOTS = ("artist", "contact_name", "location", "reminder_text", "song")

EXPECTED_FILES = (
    "train.jsonl",
    "validation.jsonl",
    "test_standard.jsonl",
    "test_north.jsonl",
    "test_central.jsonl",
    "test_south.jsonl",
)

# Corpus size floors.
MIN_TOTAL = 1200
MIN_PER_INTENT = 200
MIN_PER_REGION = 250
MIN_PER_CELL = 8
SPLIT_SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
SHARE_TOLERANCE = 0.08

# External corpus mapping.
EXTERNAL_INTENTS = {
    "alarm_set": "set_alarm",
    "weather_query": "ask_weather",
    "play_music": "play_music",
    "calendar_set": "set_reminder",
}
EXTERNAL_PARTITIONS = {"train": "train", "dev": "validation", "test": "test"}
EXTERNAL_LIMITS = {
    "set_alarm": 250,
    "ask_weather": 400,
    "play_music": 400,
    "set_reminder": 150,
}
TEMPLATE_GROUP_TARGETS = {
    "set_reminder": 50,
    "set_alarm": 52,
    "ask_weather": 30,
    "play_music": 30,
    "call_contact": 74,
}
DATETIME_LABELS = ("date", "time", "timeofday", "general_frequency")

CONFIDENCE_THRESHOLD = 0.35
SWEEP_THRESHOLDS = (0.0, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70)
MIN_INTENT_COVERAGE = 0.95

# Weather condition codes, bucketed.
WEATHER_CODES = {
    "trời quang": (0,),
    "có mây": (1, 2, 3),
    "có sương mù": (45, 48),
    "có mưa phùn": (51, 53, 55, 56, 57),
    "có mưa": (61, 63, 65, 66, 67, 80, 81, 82),
    "có tuyết": (71, 73, 75, 77, 85, 86),
    "có dông": (95, 96, 99),
}
WEATHER_UNKNOWN = "thời tiết chưa xác định"
