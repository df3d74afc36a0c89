"""Dialect and transcription rewrite rules.

Fixed values: source and target phrases, particles and context cues.
"""

DIALECT_WORDS = {
    "north": {
        "giời": "trời",
        "zời": "trời",
        "nhá": "nhé",
        "hộ tôi": "giúp tôi",
        "tớ": "tôi",
    },
    "central": {
        "răng": "sao",
        "mô": "đâu",
        "tê": "kia",
        "ni": "này",
        "chừ": "bây giờ",
        "bữa ni": "hôm nay",
        "mạ": "mẹ",
        "eng": "anh",
        "nớ": "đó",
        "ri": "thế này",
        "tui": "tôi",
    },
    "south": {
        "hông": "không",
        "hổng": "không",
        "hem": "không",
        "dzô": "vào",
        "vô": "vào",
        "bữa nay": "hôm nay",
        "dùm": "giúp",
        "giùm": "giúp",
        "má": "mẹ",
        "tía": "bố",
        "tui": "tôi",
    },
}

TRANSCRIPTION_FIXES = {
    "hom nay": "hôm nay",
    "ngay mai": "ngày mai",
    "bao thuc": "báo thức",
    "thoi tiet": "thời tiết",
    "nhac toi": "nhắc tôi",
    "goi cho": "gọi cho",
    "mo nhac": "mở nhạc",
    "may gio": "mấy giờ",
    "bay gio": "bây giờ",
    "sai gon": "sài gòn",
    "da nang": "đà nẵng",
    "ha noi": "hà nội",
    "coi thời tiết": "xem thời tiết",
}

# particle -> (form after a question cue, form after a request cue)
PARTICLES = {
    "north": {},
    "central": {"hỉ": ("nhỉ", "nhé")},
    "south": {"nghen": ("nhỉ", "nhé"), "hen": ("nhỉ", "nhé")},
}

QUESTION_CUE = r"\?|\b(không|hông|hổng|hem|sao|răng|mấy|bao nhiêu|gì|đâu|chưa)\b"
REQUEST_CUE = (
    r"\b(gọi|kêu|liên lạc|mở|bật|phát|nghe|nhắc|đặt|cài|hẹn|xem|coi|giúp|dùm|giùm|hãy|đừng)\b"
)

# The tooth sense of a word that is also a dialect question word stays untouched.
PROTECTED_TERM = "răng"
PROTECTED_AFTER = r"(?<!\w)((?:khám|đánh|đau|nhổ|chữa|trám|niềng)\s+)răng(?!\w)"
PROTECTED_BEFORE = r"(?<!\w)răng(\s+(?:miệng|hàm|khôn|cửa|sữa)(?!\w))"
