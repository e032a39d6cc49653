"""The words that the SQL expects, written apart from the library's own, so that a wrong word there shows."""

SUITE_WORDS = ("套房", "獨立套房", "分租套房", "獨套", "分套", "1房1衛", "一房一衛",)
EXCLUDED_WORDS = ("雅房", "整層", "整層住家", "住辦", "車位", "停車位", "店面", "辦公", "廠房", "土地", "頂讓", "倉庫",)
SUBSIDY_WORDS = ("租金補貼", "租補", "可申請補助", "補助",)
SUBSIDY_DENIED = ("不可租補", "不能租補", "不租補",)
TAX_WORDS = ("可報稅", "報稅", "可入籍", "設籍", "社會住宅", "社宅",)
TAX_DENIED = ("不可報稅", "不能報稅",)
WASHER_WORDS = ("獨立洗衣機", "室內洗衣機", "專用洗衣機", "私人洗衣機", "獨洗",)
WASHER_SHARED = ("共用洗衣機", "公共洗衣機", "投幣式洗衣",)
GARBAGE_WORDS = ("垃圾代收", "代收垃圾", "垃圾代丟", "代丟垃圾", "專人收垃圾",)
GARBAGE_DENIED = ("無垃圾代收", "不代收垃圾", "自行倒垃圾", "垃圾自行處理",)
TRACKING_KEYS = (
    "from", "func", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid",
    "gclid", "yclid",
)
CAPTCHA_WORDS = ("captcha", "recaptcha", "驗證碼", "安全驗證",)
LOGIN_WORDS = ("請先登入", "登入後繼續", "login required",)
RATE_WORDS = ("too many requests", "rate limit", "請求過於頻繁",)
FORBIDDEN_WORDS = ("access denied", "forbidden",)
