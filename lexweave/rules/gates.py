"""Ordered command-gate rules and parse-time phrases.

Fixed values: patterns, verdict names, response sentences.
"""

UNSUPPORTED = r"(?<!\w)(?:hủy|huỷ|xóa|xoá|bỏ|dừng|tắt|ngắt|hoãn)\b"
UNSUPPORTED_PLAIN = (
    r"(?<!\w)(?:huy|xoa|hoan)\b|(?<!\w)(?:bo|dung|tat|ngat)\s+"
    r"(?:nhac|phat|bai|cuoc goi|goi|bao thuc|chuong|loi nhac|hoi|xem|du bao|thoi tiet)\b"
)
NEGATED = (
    r"(?<!\w)(?:đừng|chớ|khỏi)\s+(?!quên\s+(?:nhắc|báo|gọi))|"
    r"(?<!\w)(?:không|chưa)\s+(?:cần\s+)?"
    r"(?:gọi|liên lạc|liên hệ|quay số|bấm|nối máy|hẹn giờ|mở|phát|chơi|nghe|đặt|cài|nhắc|hỏi|xem|báo)|"
    r"(?<!\w)tôi\s+không\s+muốn\b"
)
_PLAIN_VERBS = (
    r"(?:goi|lien lac|lien he|quay so|bam|noi may|hen gio|mo|phat|choi|nghe|dat|cai|nhac|hoi|xem|bao)"
)
NEGATED_PLAIN = (
    rf"(?<!\w)(?:dung|khoi)\s+(?!quen\s+(?:nhac|bao|goi)){_PLAIN_VERBS}\b|"
    rf"(?<!\w)(?:khong|chua)\s+(?:can\s+)?{_PLAIN_VERBS}\b|"
    r"(?<!\w)(?:khong|chua)\s+can\s+(?:thoi tiet|du bao|bao thuc|chuong|loi nhac|nhac)\b|"
    r"(?<!\w)(?:toi\s+)?khong\s+muon\s+"
    r"(?:thoi tiet|du bao|bao thuc|chuong|loi nhac|nhac|am nhac|bai hat)\b|"
    r"(?<!\w)toi\s+khong\s+muon\b"
)
DONT_FORGET_PLAIN = r"(?<!\w)dung\s+quen\s+(?:nhac|bao|goi)\b"
OUT_OF_SCOPE = r"(?<!\w)gọi\s+món\b"
OUT_OF_SCOPE_PLAIN = r"(?<!\w)goi\s+mon\b"

_WHO = r"(?:toi|minh|me|bo|ba|ma|co ay|anh ay|em ay|ho|ban)"
STATEMENT_PLAIN = (
    rf"^{_WHO}\s+(?:dang|da|vua|se|thich|yeu|ghet)\b|"
    rf"^{_WHO}\s+(?:uong|mua|goi|bam|lien lac|lien he|quay so|noi may|thuc hien cuoc goi|"
    r"nop|gui|tuoi|hop|hen gio|kiem tra|thanh toan|tra|don|tap|nghe|mo|phat)\b|"
    r"^(?:hom qua|toi qua|sang qua|chieu qua)\b.*(?<!\w)(?:troi|thoi tiet)\b.*"
    r"(?<!\w)(?:mua|nang|lanh|nong|gio|dep)\s*[.!?]*$|"
    r"^(?:day|do)\s+la\b|^(?:roi|qua)\s*[.!?]*$|(?<!\w)chuong\s+cua\b|"
    r"^(?:hom nay\s+)?troi\s+(?:dang\s+)?(?:dep|mua|nang|lanh|nong|nhieu gio|co gio)"
    r"(?:\s+(?:roi|qua))?\s*[.!?]*$|"
    rf"^{_WHO}\s+(?:nghe|mo|phat)\s+(?:nhac|am nhac|bai hat)"
    r"(?:\s+(?:moi ngay|hang ngay|thuong xuyen))?\s*[.!?]*$|"
    r"^(?:nhac|am nhac|bai hat(?: nay)?)\s+(?:dang\s+phat|hay)\s*[.!]*$|"
    r"^nhiet do\s+la\s+(?:\d+|am\s+\d+)\s+do\s*[.!]*$|"
    r"^.{2,40}\s+dang\s+(?:mua|nang|lanh|nong)(?:\s+(?:roi|qua))?\s*[.!]*$|"
    r"^(?:hom nay|ngay mai|mai|toi nay)\s+co\s+cuoc hop\s*[.!]*$"
)
_ACT = (
    r"(?:goi|lien lac|lien he|quay so|bam(?: so| may)?|noi may|thuc hien cuoc goi|"
    r"mo|bat|phat|choi|nghe|dat|cai|hen gio|nhac|tao loi nhac|danh thuc)"
)
STATUS_QUESTION_PLAIN = (
    rf"^(?:da\s+)?{_ACT}(?:\s+.+?)?\s+chua\s*[?!.]*$|"
    rf"^co\s+(?:can\s+|nen\s+)?{_ACT}(?:\s+.+?)?\s+khong\s*[?!.]*$|"
    rf"^{_ACT}(?:\s+.+?)?\s+phai\s+khong\s*[?!.]*$|"
    r"^goi(?:\s+.+?)?\s+hay\s+.+\s*[?!.]*$|"
    r"^(?:nhac|am nhac|bai hat|bai)(?:\s+\w+){0,4}\s+"
    r"(?:dang\s+phat(?:\s+(?:a|ha|u|vay))?|ten\s+gi)\s*[?!.]*$|"
    r"^(?:nhac|am nhac|bai hat|bai)(?:\s+\w+){0,4}\s+"
    r"(?:co\s+dang\s+(?:phat|choi)\s+khong|cua\s+(?:ai|nghe si nao))\s*[?!.]*$|"
    r"^dang\s+phat\s+(?:nhac|am nhac|bai hat)(?:\s+(?:a|ha|u|vay))?\s*[?!.]*$"
)
SIDE_EFFECT_INTENTS = ("set_reminder", "set_alarm", "play_music", "call_contact")

# Matched on accent-free text.
INTENT_CUES = {
    "set_reminder": (
        r"(?<!\w)(?:nhac|loi nhac|nho bao|dung quen|goi|uong|kiem tra|hop|"
        r"nop|don|mua|gui|tap|tuoi|thanh toan|tra|mang|di lam)\b"
    ),
    "set_alarm": (
        r"(?<!\w)(?:bao thuc|danh thuc|(?:goi|keu)(?:\s+\w+){0,3}\s+day|"
        r"thuc day|chuong|hen gio)\b"
    ),
    "ask_weather": (
        r"(?<!\w)(?:thoi tiet|du bao|nhiet do|troi|mua|nang|lanh|nong|tuyet|gio|"
        r"ao khoac|ao mua|gang tay|mang theo o|mac do|mac ao|quan ao)\b"
    ),
    "play_music": (
        r"(?<!\w)(?:nhac|am nhac|bai hat|bai|ca khuc|album|danh sach phat|playlist|"
        r"nghe|phat|rap|jazz)\b"
    ),
    "call_contact": (
        r"(?<!\w)(?:goi|lien lac|lien he|quay so|bam so|bam may|noi may|"
        r"thuc hien cuoc goi|dien thoai)\b"
    ),
}

# Boundary between alarms, calls and reminders about calls.
WAKE_UP = (
    r"(?<!\w)(?:(?:gọi|kêu)(?:\s+\w+){0,3}\s+dậy|"
    r"đánh thức(?:\s+(?:tôi|tớ|tui|mình|em|con|cháu|tao))?)(?!\w)"
)
CALL_COMMAND = (
    r"(?<!\w)(?:gọi|goi|liên lạc|lien lac|liên hệ|lien he|"
    r"quay (?:số|so)|bấm (?:số|so)|bam (?:so|may)|bấm máy|"
    r"nối máy|noi may|thực hiện cuộc gọi|thuc hien cuoc goi)(?!\w)"
)
IMMEDIATE = ("bây giờ", "bay gio")
PLACEHOLDER_PLACE = r"(?<!\w)(?:đâu|dau|đây|day|chỗ nào|cho nao|nơi nào|noi nao)(?!\w)"
PLACEHOLDER_PLACES = ("đâu", "dau", "đây", "day", "chỗ nào", "cho nao", "nơi nào", "noi nao")

PROMPTS = {
    "set_reminder": "Bạn muốn mình nhắc việc gì?",
    "set_alarm": "Bạn muốn đặt báo thức lúc nào?",
    "ask_weather": "Bạn muốn xem thời tiết ở tỉnh hoặc thành phố nào?",
    "call_contact": "Bạn muốn gọi cho ai hoặc gọi tới số điện thoại nào?",
}
LOW_CONFIDENCE = "Mình chưa đủ chắc chắn để thực hiện yêu cầu. Bạn vui lòng nói rõ hơn."
NOT_A_COMMAND = (
    "Mình nhận ra đây chưa phải yêu cầu có thể thực hiện. "
    "Bạn vui lòng nói lại bằng một lệnh được hỗ trợ."
)
ACTION_TYPES = {
    "set_reminder": "create_reminder",
    "set_alarm": "set_alarm",
    "ask_weather": "query_weather",
    "play_music": "play_music",
    "call_contact": "call",
}
