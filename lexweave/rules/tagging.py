"""Entity patterns and dictionaries.

Fixed values: the patterns, stop lists and dictionary entries below decide which tags come out.
"""

PHONE = r"(?<!\d)(?:\+?84|0)(?:[ .-]?\d){8,10}(?![ .-]?\d)"
PHONE_OVERLONG = r"(?<!\d)(?:\+?84|0)(?:[ .-]?\d){11,}(?![ .-]?\d)"

NUMBER = (
    r"(?:không|một|mốt|hai|ba|bốn|tư|năm|lăm|sáu|bảy|tám|chín|mười|mươi|trăm|nghìn|ngàn)"
    r"(?:\s+(?:không|một|mốt|hai|ba|bốn|tư|năm|lăm|sáu|bảy|tám|chín|mười|mươi|trăm|nghìn|ngàn))*"
)
CLOCK = (
    r"(?:[01]?\d|2[0-3])\s*(?:h|giờ)"
    r"(?:\s*rưỡi|\s+kém\s+(?:[0-5]?\d)(?:\s*phút)?|\s*(?:[0-5]?\d)\s*(?:phút)?)?"
)
PART_OF_DAY = r"(?:sáng|trưa|chiều|tối|đêm)"
DAY = r"(?:hôm nay|ngày mai|mai|thứ (?:hai|ba|tư|năm|sáu|bảy)|chủ nhật)"

INVALID_CLOCK = (
    r"(?<!\w)[+-]\s*\d+\s*(?:h|giờ)(?!\w)|"
    r"(?<!\w)(?:[01]?\d|2[0-3])\s*(?:h|giờ)\s+"
    r"(?:kém\s+)?(?:[+-]\s*\d+|[6-9]\d|\d{3,})(?:\s*phút)?(?!\w)"
)

# In order of preference among equally long matches.
DATETIME = (
    rf"(?<!\w)(?:buổi\s+)?{PART_OF_DAY}?\s*{DAY}\s+(?:lúc\s+)?{NUMBER}(?:\s+giờ|\s+rưỡi)"
    rf"(?:\s+{PART_OF_DAY})?(?!\w)",
    rf"(?<!\w)(?:buổi\s+)?{PART_OF_DAY}?\s*{DAY}\s+(?:lúc\s+)?{CLOCK}(?!\w)",
    rf"(?<!\w){CLOCK}\s+(?:buổi\s+)?{PART_OF_DAY}?\s*{DAY}(?!\w)",
    rf"(?<!\w)sau\s+{NUMBER}(?:\s+giờ|\s+rưỡi)(?:\s+{PART_OF_DAY})?(?!\w)",
    rf"(?<!\w)(?:ngày\s+)?{NUMBER}\s+tháng\s+{NUMBER}(?:\s+(?:năm\s+)?{NUMBER})?(?!\w)",
    rf"(?<!\w)ngày\s+{NUMBER}\s+hàng\s+tháng(?!\w)",
    rf"(?<!\w)(?:(?:trong|sau)\s+(?:{NUMBER}|\d+)\s+(?:phút|tiếng|giờ|ngày|tuần|tháng)"
    rf"|(?:{NUMBER}|\d+)\s+(?:phút|tiếng|giờ|ngày|tuần|tháng)\s+"
    r"(?:nữa|tới|sau|kể từ bây giờ))(?!\w)",
    r"(?<!\w)(?:\d+|một|hai|ba|bốn|năm|sáu|bảy|tám|chín|mười)\s+(?:phút|tiếng|giờ)\s+nữa(?!\w)",
    rf"(?<!\w){NUMBER}(?:\s+giờ|\s+rưỡi)(?:\s+kém\s+{NUMBER}(?:\s+phút)?|\s+{NUMBER}\s+phút)?"
    rf"(?:\s+{PART_OF_DAY})?(?:\s+(?:hôm nay|ngày mai|mai|mỗi buổi sáng))?(?!\w)",
    rf"(?<!\w){CLOCK}(?!\w)",
    rf"(?<!\w)(?:buổi\s+)?{PART_OF_DAY}?\s*(?:thứ (?:hai|ba|tư|năm|sáu|bảy)|chủ nhật)"
    r"(?:\s+(?:tuần (?:này|sau|tới)|này))?(?!\w)",
    rf"(?<!\w){PART_OF_DAY} nay|(?<!\w)(?:tuần (?:này|tới|sau)|tháng sau|cuối tuần(?: này)?)(?!\w)",
    rf"(?<!\w){PART_OF_DAY}?\s*"
    r"(?:hôm nay|ngày mai|mai|thứ (?:hai|ba|tư|năm|sáu|bảy|chủ nhật)|cuối tuần này)(?!\w)",
)

POLITE_END = (
    r"(?:^|\s)(?:nhé|nhá|nha|nghen|hen|hỉ|với|giúp tôi|dùm|giùm|được không|đi|ngay)\s*$"
)
ENTITY_END = (
    r"\s+(?:bây giờ|ngay bây giờ|một lần nữa|cho (?:tôi|tớ|tui|mình)|"
    r"để (?:tôi|tớ|tui|mình)|nhé|nha|với|đi|ngay|được không|không)\s*$"
)
EDGE_PUNCTUATION = " ,.!?"

# What is peeled off around reminder content, in this order; "{datetime}" marks where the tagged
# time is cut out.
REMINDER_PEEL = (
    r"^vui lòng\s+",
    r"^(?:hãy\s+)?(?:nhắc|nhớ báo|đừng quên(?:\s+nhắc)?|tạo lời nhắc)"
    r"(?:\s+cho)?(?:\s+(?:tôi|tớ|tui|mình))?(?:\s+|$)",
    r"^(?:cài đặt một nhắc nhở|đặt lời nhắc|đặt lịch|tôi cần phải được nhắc rằng)"
    r"(?:\s+(?:cho|tôi))?(?:\s+|$)",
    r"^(?:giúp|dùm|giùm)(?:\s+(?:tôi|tớ|tui|mình))?(?:\s+|$)",
    "{datetime}",
    r"^(?:vào|lúc|đến|cho|về|rằng|sau|trước)(?:\s+|$)",
    r"\s+(?:vào|lúc|đến|cho|sau|trước)\s*$",
    r"\s+(?:vì|tại|ở)\s+.*",
    r"\s+(?:của (?:tôi|mình)|tiếp theo)\s*$",
    POLITE_END,
)
REMINDER_EMPTY = (
    "nhắc",
    "lời nhắc",
    "tạo lời nhắc",
    "đặt lời nhắc",
    "tôi",
    "tớ",
    "tui",
    "mình",
    "giúp",
    "giúp tôi",
    "dùm",
    "giùm",
)
REMINDER_INCOMPLETE = (
    r"^(?:gọi(?:\s+lại)?|mua|uống|gửi|nộp|tưới|đón|trả|thanh toán|kiểm tra)$"
)

CONTACT_CUE = (r"^(?:hãy\s+)?gọi(?:\s+(?:điện|lại)){0,2}(?=\s|$)", r"^(?:cho|đến|tới)(?=\s|$)")
CONTACT_EMPTY = (
    "cho",
    "đến",
    "tới",
    "tôi",
    "tớ",
    "tui",
    "mình",
    "giúp",
    "giúp tôi",
    "dùm",
    "giùm",
    "đi",
    "ngay",
    "bây giờ",
    "ngay bây giờ",
    "điện",
    "số",
    "ai",
    "người nào",
    "nguoi nao",
)
CONTACT_REJECT = (
    r"^(?:giúp|dùm|giùm|đi|ngay|bây giờ|điện|số)(?:\s|$)",
    r"^(?:ai|người nào|nguoi nao)(?:\s+(?:vậy|thế|nào|đó|vay|the|nao|do))?$",
    r"(?<!\w)dậy\s*$",
    r"\d",
    r"^\+",
)

LOCATION_CUE = (
    r"(?<!\w)(?:ở|tại|trên|của)\s+(.+?)(?=\s+(?:bây giờ|hôm nay|ngày mai|tối nay|đêm nay|"
    r"chiều nay|sáng mai|tuần (?:này|tới|sau)|thứ (?:hai|ba|tư|năm|sáu|bảy)|chủ nhật|vào)\b|$)"
)
LOCATION_INVALID = (
    r"(?:^|\s)(?:tôi|mình|bao nhiêu|mưa|gió|độ|là|nên|khu vực của|"
    r"đâu|dau|đây|day|chỗ nào|cho nao|nơi nào|noi nao)(?:\s|$)"
)

ARTIST_CUES = (
    r"(?:của|bởi)\s+((?:(?!\s+(?:của|bởi)\s+).)+)$",
    r"(?:mở|phát|chơi)\s+nhạc\s+(.+)$",
)
SONG_CUE = (
    r"(?:phát|mở|nghe)(?:\s+(?:cho tôi|tiếp theo))?\s+"
    r"(?:bài hát|bài)\s+(?!của\b|bởi\b)(.+?)(?=\s+(?:của|bởi)\s+)"
)
SONG_NOT_PREFIX = "từ "
MUSIC_INVALID = (
    r"(?:^|\s)(?:tôi|mình|danh sách phát|yêu thích|tất cả|bất kỳ|bất cứ|"
    r"hàng đầu|thính phòng|đồng quê)(?:\s|$)"
)
MUSIC_STOP = (
    r"^(?:đi|ngay|lên|thôi|nào|giúp tôi|chưa|không|à|hả|ư|vậy|thế|sao|phải|ai)$"
)

CONTACTS = (
    "mẹ", "má", "mạ", "cha", "bố", "ba", "tía", "anh nam", "chị linh", "em an", "cô lan",
    "chú hùng", "bác sĩ minh", "sếp hải", "bạn phương", "đồng nghiệp", "ông nội", "bà ngoại",
    "anh tuấn", "chị mai", "bạn khánh",
)
PHONES = (
    "090 000 0000", "091 111 1111", "032 222 2222", "038 888 8888", "070 000 0000",
    "076 666 6666", "077 777 7777", "078 888 8888", "079 999 9999", "081 111 1111",
    "082 222 2222", "083 333 3333", "084 444 4444", "085 555 5555",
)
LOCATIONS = (
    "hà nội", "hải phòng", "hạ long", "thái nguyên", "vinh", "đồng hới", "huế", "đà nẵng",
    "hội an", "quy nhơn", "nha trang", "buôn ma thuột", "đà lạt", "sài gòn", "thủ đức",
    "biên hòa", "cần thơ", "long xuyên", "hà giang", "cao bằng", "bắc kạn", "lạng sơn",
    "tuyên quang", "lào cai", "điện biên", "lai châu", "sơn la", "yên bái", "hòa bình",
    "thái bình", "hải dương", "bắc ninh", "vĩnh phúc", "hưng yên", "nam định", "hà nam",
    "ninh bình", "bắc giang", "phú thọ", "quảng ninh", "thanh hóa", "nghệ an", "hà tĩnh",
    "quảng bình", "quảng trị", "thừa thiên huế", "quảng nam", "quảng ngãi", "bình định",
    "phú yên", "khánh hòa", "ninh thuận", "bình thuận", "kon tum", "gia lai", "đắk lắk",
    "đắk nông", "lâm đồng", "bình phước", "tây ninh", "bình dương", "đồng nai",
    "bà rịa - vũng tàu", "tp hcm", "long an", "tiền giang", "bến tre", "trà vinh", "vĩnh long",
    "đồng tháp", "an giang", "kiên giang", "hậu giang", "sóc trăng", "bạc liêu", "cà mau",
)
TRACKS = (
    ("nắng ấm xa dần", "sơn tùng"),
    ("em của ngày hôm qua", "sơn tùng"),
    ("nối vòng tay lớn", "trịnh công sơn"),
    ("một cõi đi về", "khánh ly"),
    ("để mị nói cho mà nghe", "hoàng thùy linh"),
    ("đi để trở về", "soobin hoàng sơn"),
    ("tháng tư là lời nói dối của em", "hà anh tuấn"),
    ("có chắc yêu là đây", "sơn tùng"),
    ("lạc trôi", "sơn tùng"),
    ("phía sau một cô gái", "soobin hoàng sơn"),
)
REMINDERS = (
    "gọi mẹ", "uống thuốc", "kiểm tra email", "họp với nhóm", "nộp báo cáo", "đón con",
    "mua sữa", "gửi tài liệu", "tập thể dục", "tưới cây", "thanh toán hóa đơn",
    "gọi lại cho khách hàng",
)
DATETIMES = (
    "mai lúc 7 giờ sáng", "ngày mai lúc 8 giờ", "hôm nay lúc 6 giờ chiều", "tối nay lúc 9 giờ",
    "15 phút nữa", "30 phút nữa", "2 tiếng nữa", "thứ hai tuần sau lúc 8 giờ sáng",
    "ngày 4 tháng 5 lúc 10 giờ", "sáng mai", "trưa mai", "chiều thứ sáu", "tối thứ bảy",
    "45 phút nữa", "3 tiếng nữa", "6 giờ sáng mai", "7 giờ tối mai", "đầu giờ chiều",
    "cuối ngày hôm nay",
)
WEATHER_TIMES = ("hôm nay", "ngày mai", "tối nay", "cuối tuần này", "bây giờ")
