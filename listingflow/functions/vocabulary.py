"""Word lists, patterns and scoring tables the results depend on."""

# --- classification of a record's own text -------------------------------------------
SUITE_WORDS = ("套房", "獨立套房", "分租套房", "獨套", "分套", "1房1衛", "一房一衛")
EXCLUDED_WORDS = (
    "雅房", "整層", "整層住家", "住辦", "車位", "停車位",
    "店面", "辦公", "廠房", "土地", "頂讓", "倉庫",
)
SUBSIDY_WORDS = ("租金補貼", "租補", "可申請補助", "補助")
SUBSIDY_DENIED = ("不可租補", "不能租補", "不租補")
TAX_WORDS = ("可報稅", "報稅", "可入籍", "設籍", "社會住宅", "社宅")
TAX_DENIED = ("不可報稅", "不能報稅")
WASHER_WORDS = ("獨立洗衣機", "室內洗衣機", "專用洗衣機", "私人洗衣機", "獨洗")
WASHER_SHARED = ("共用洗衣機", "公共洗衣機", "投幣式洗衣")
GARBAGE_WORDS = ("垃圾代收", "代收垃圾", "垃圾代丟", "代丟垃圾", "專人收垃圾")
GARBAGE_DENIED = ("無垃圾代收", "不代收垃圾", "自行倒垃圾", "垃圾自行處理")

# --- flags read while extracting a page: wider lists, the denial always wins ---------
PAGE_SUBSIDY_DENIED = ("不可租補", "不能租補", "不租補", "無租補")
PAGE_TAX_DENIED = ("不可報稅", "不能報稅", "不報稅", "不可入籍", "不能入籍")
PAGE_WASHER_WORDS = ("獨立洗衣機", "室內洗衣機", "專用洗衣機", "私人洗衣機", "獨洗", "洗衣機")
FLAG_TAGS = ("租補", "可報稅", "獨立洗衣機", "垃圾代收")

# --- occupant restriction, matched on text with all white space removed -------------
FEMALE_ONLY_PATTERNS = (
    r"(?<!不)(?:限|只限|僅限|限租|限收|只租|僅租|限住|限入住)(?:單身)?"
    r"(?:女生|女性|女學生|女上班族|女房客|女租客|女)(?:入住|租住|承租|租客|房客)?",
    r"(?:女生|女性|女學生|女上班族|女房客|女租客|女)"
    r"(?:限定|限住|限租|入住|租住|承租|專屬|優先|佳)",
)
FEMALE_ONLY_BRACKET = r"\[(?:女生|女性|女學生|女上班族|女房客|女租客|女)/"
FEMALE_VALUES = ("女", "女性", "女生", "female", "f")
GENDER_NEUTRAL_WORDS = (
    "不限", "不拘", "皆可", "男女", "男/女", "男、女", "male/female", "any",
)
GENDER_KEY_PATTERN = (
    r"(?i)(?:gender|sex|性別|租客|房客|tenant|renter|roomer|身分|身份|條件|condition|入住|租住)"
)

# --- access walls, matched on lower-cased page text, first group wins ----------------
CAPTCHA_WORDS = ("captcha", "recaptcha", "驗證碼", "安全驗證")
LOGIN_WORDS = ("請先登入", "登入後繼續", "login required")
RATE_WORDS = ("too many requests", "rate limit", "請求過於頻繁")
FORBIDDEN_WORDS = ("access denied", "forbidden")

# --- URL query keys that only track the visitor (any utm_* key is dropped too) -------
TRACKING_KEYS = (
    "from", "func", "utm_source", "utm_medium", "utm_campaign",
    "utm_content", "utm_term", "fbclid", "gclid", "yclid",
)

# --- marketing words ignored by the content fingerprint ------------------------------
FINGERPRINT_NOISE = ("近捷運", "全新", "採光", "稀有", "專約", "急租")

# --- proximity evidence: (basis, label, terms, score, districts) ---------------------
TARGET_CITY = "台北市"
ROAD_RULES = (
    ("campus_edge:roosevelt_4", "羅斯福路四段", ("羅斯福路4段",), 96, ("大安區", "中正區")),
    ("campus_edge:zhoushan", "舟山路側門", ("舟山路",), 96, ("大安區", "中正區")),
    ("campus_edge:xinsheng_south_3", "新生南路三段", ("新生南路3段",), 94, ("大安區",)),
    ("campus_edge:xinhai_2", "辛亥路二段", ("辛亥路2段",), 92, ("大安區",)),
    ("campus_edge:keelung_4", "基隆路四段", ("基隆路4段",), 90, ("大安區",)),
    ("campus_gate:changxing", "長興街校門", ("長興街",), 90, ("大安區",)),
    ("walkable:wenzhou", "溫州街", ("溫州街",), 88, ("大安區",)),
    ("walkable:taishun", "泰順街", ("泰順街",), 86, ("大安區",)),
    ("walkable:tingzhou_3", "汀州路三段", ("汀州路3段",), 86, ("大安區", "中正區")),
    ("walkable:roosevelt_3", "羅斯福路三段", ("羅斯福路3段",), 84, ("大安區", "中正區")),
    ("walkable:xinhai_1", "辛亥路一段", ("辛亥路1段",), 82, ("大安區", "中正區")),
    ("walkable:shida", "師大路", ("師大路",), 82, ("大安區",)),
    ("walkable:longquan", "龍泉街", ("龍泉街",), 82, ("大安區",)),
    ("walkable:siyuan", "思源街", ("思源街",), 82, ("中正區",)),
    ("walkable:pucheng", "浦城街", ("浦城街",), 80, ("大安區",)),
    ("approach:fuxing_south_2", "復興南路二段", ("復興南路2段",), 78, ("大安區",)),
    ("approach:heping_east_2", "和平東路二段", ("和平東路2段",), 76, ("大安區",)),
)
# (basis, label, terms, score)
STATION_RULES = (
    ("mrt:g07_gongguan", "公館站", ("公館站", "捷運公館", "公館捷運"), 90),
    ("mrt:g08_taipower_building", "台電大樓站", ("台電大樓站", "捷運台電大樓", "台電大樓捷運"), 84),
    ("mrt:br08_technology_building", "科技大樓站", ("科技大樓站", "捷運科技大樓", "科技大樓捷運"), 84),
    ("mrt:g06_wanlong", "萬隆站", ("萬隆站", "捷運萬隆", "萬隆捷運"), 82),
    ("mrt:g09_guting", "古亭站", ("古亭站", "捷運古亭", "古亭捷運"), 78),
    ("mrt:g05_jingmei", "景美站", ("景美站", "捷運景美", "景美捷運"), 76),
    ("mrt:g04_dapinglin", "大坪林站", ("大坪林站", "捷運大坪林", "大坪林捷運"), 70),
    ("mrt:br07_liuzhangli", "六張犁站", ("六張犁站", "捷運六張犁", "六張犁捷運"), 68),
    ("mrt:g03_qizhang", "七張站", ("七張站", "捷運七張", "七張捷運"), 66),
    ("mrt:o04_dingxi", "頂溪站", ("頂溪站", "捷運頂溪", "頂溪捷運"), 64),
    ("mrt:br06_linguang", "麟光站", ("麟光站", "捷運麟光", "麟光捷運"), 62),
    (
        "mrt:g02_xindian_district_office", "新店區公所站",
        ("新店區公所站", "捷運新店區公所", "新店區公所捷運"), 60,
    ),
    ("mrt:br05_xinhai", "辛亥站", ("辛亥站", "捷運辛亥", "辛亥捷運"), 58),
    ("mrt:g01_xindian", "新店站", ("新店站", "捷運新店", "新店捷運"), 55),
)
# (city, district, score)
DISTRICT_BASES = (
    ("台北市", "大安區", 50),
    ("台北市", "中正區", 48),
    ("新北市", "永和區", 42),
    ("台北市", "文山區", 40),
    ("新北市", "新店區", 32),
    ("台北市", "萬華區", 30),
    ("台北市", "信義區", 28),
    ("台北市", "松山區", 24),
    ("台北市", "中山區", 22),
    ("台北市", "大同區", 18),
)
# Cities an address or text may state explicitly, in order of preference.
EXPLICIT_CITIES = ("新北市", "台北市")
SECTION_DIGITS = "一二三四五六七八九", "123456789"

# --- ordered keys of one attribute inside a JSON object ------------------------------
TITLE_KEYS = ("title", "name", "subject", "case_name", "caseName", "house_title", "houseTitle")
URL_KEYS = (
    "url", "@id", "link", "detail_url", "detailUrl", "house_url", "houseUrl", "canonical_url",
)
ID_KEYS = (
    "id", "houseid", "houseId", "house_id", "case_id", "caseId",
    "object_id", "objectId", "rent_id",
)
PRICE_KEYS = (
    "price", "rent", "rent_price", "rentPrice", "price_total", "priceTotal", "money", "amount",
)
FEE_KEYS = (
    "manage_fee", "manageFee", "management_fee", "managementFee", "service_fee", "extra_fee",
)
AREA_KEYS = ("area", "area_ping", "ping", "坪數", "buildingArea", "building_area")
ROOM_KEYS = (
    "kind_name", "kindName", "room_type", "roomType", "type_name", "shape_name", "layout", "use",
)
CITY_KEYS = ("region_name", "regionName", "city", "county", "addressRegion")
DISTRICT_KEYS = ("section_name", "sectionName", "district", "addressLocality", "town")
ADDRESS_KEYS = ("address", "addr", "street_name", "streetName", "streetAddress", "location")
DESCRIPTION_KEYS = ("description", "desc", "content", "remark", "house_desc", "houseDesc")
IMAGE_KEYS = (
    "image", "images", "img", "cover", "photo", "photos", "photo_list", "photoList", "filename",
)
TAG_KEYS = (
    "tags", "tag", "label", "labels", "feature", "features", "facility", "facilities",
)
GENDER_KEYS = ("gender", "sex", "性別", "租客", "房客", "tenant", "condition", "入住條件")

# The portal with numeric record ids reads a slightly different set of keys.
PORTAL_TITLE_KEYS = (
    "title", "name", "subject", "case_name", "caseName", "house_title", "post_title",
)
PORTAL_URL_KEYS = (
    "url", "link", "detail_url", "detailUrl", "house_url", "share_url", "shareUrl",
)
PORTAL_ID_KEYS = (
    "id", "houseid", "houseId", "house_id", "post_id", "postid", "case_id", "caseId",
)
PORTAL_PRICE_KEYS = ("price", "rent", "rent_price", "rentPrice", "price_total", "priceTotal", "money")
PORTAL_AREA_KEYS = ("area", "area_ping", "ping", "坪數")
PORTAL_ROOM_KEYS = (
    "kind_name", "kindName", "room_type", "roomType", "type_name", "shape_name", "layout",
)
PORTAL_DISTRICT_KEYS = ("section_name", "sectionName", "district", "addressLocality")
PORTAL_TAG_KEYS = ("tags", "tag", "label", "labels", "feature", "features")
PORTAL_TEXT_KEYS = ("name", "text", "label", "title", "value")
PORTAL_FLOOR_KEYS = ("floor", "floor_str", "floorStr")
PORTAL_ALL_FLOOR_KEYS = ("allfloor", "all_floor", "allFloor")
PORTAL_ROOM_BY_KIND = (("2", "獨立套房"), ("3", "分租套房"))

# Marks that make an inline script worth parsing.
SCRIPT_MARKS = ("rent", "house", "case", "套房", "租金", "坪", "address")
PORTAL_SCRIPT_MARKS = ("591", "rent", "套房")
STATE_NAMES = (
    "__INITIAL_STATE__", "__NEXT_DATA__", "__NUXT__", "__APOLLO_STATE__",
    "INITIAL_STATE", "APP_STATE", "STATE", "state",
)
PORTAL_STATE_NAMES = (
    "__INITIAL_STATE__", "__NEXT_DATA__", "__NUXT__", "INITIAL_STATE", "APP_STATE", "state",
)
IMAGE_ATTRIBUTES = (
    "src", "data-src", "data-original", "data-lazy", "data-url", "data-img",
    "data-original-src", "srcset", "data-srcset",
)
IMAGE_OBJECT_KEYS = ("url", "src", "path", "image", "filename")

# --- forum posts ---------------------------------------------------------------------
FORUM_ADDRESS_LABELS = (
    "地址", "地點", "位置", "房屋地點", "租屋地點", "房屋地址", "租屋地址",
)
FORUM_FLOOR_LABELS = ("樓層", "所在樓層", "樓別")
FORUM_WANTED_WORDS = ("徵室友", "求租", "交換", "短租")
FORUM_TITLE_WORDS = ("出租", "租屋", "套房", "雅房", "整層")
FORUM_TAGS = (
    ("租補", ("租補", "租金補貼")),
    ("報稅", ("可報稅", "報稅")),
    ("獨立洗衣機", ("獨立洗衣機", "室內洗衣機", "獨洗")),
    ("垃圾代收", ("垃圾代收", "代收垃圾")),
)
FORUM_AREA_ALIASES = (
    ("桃區", "桃園區"), ("南崁", "蘆竹區"), ("內壢", "中壢區"), ("埔心", "楊梅區"),
)
FORUM_CITY = "桃園市"
FORUM_CITY_STEM = "桃園"

# --- display -------------------------------------------------------------------------
UNKNOWN = "未知"
UNKNOWN_GROUP = "未知區"
NEW_RECORD = "新房源"
PRICE_DROP = "價格下降"
OTHER_UPDATE = "其他更新"
RELISTED = "重新上架"
FLAG_GAINED = (
    ("has_rent_subsidy", "新增租補標記"),
    ("has_tax_registration", "新增可報稅標記"),
    ("has_independent_washer", "新增獨立洗衣機資訊"),
    ("has_garbage_collection", "新增垃圾代收資訊"),
)
CONFIDENCE_LABELS = (
    ("high", "高信心"), ("medium", "中信心"), ("low", "低信心"), ("none", "資料不足"),
)
WEBHOOK_PATTERN = (
    r"(?i)https://(?:(?:canary|ptb)\.)?(?:discord(?:app)?\.com)/api/webhooks/"
    r"""[^\s/'"<>]+/[^\s'"<>]+"""
)
REDACTED_WEBHOOK = "<redacted Discord webhook>"
COLOUR_NEW = 0x42A66A
COLOUR_CHANGED = 0xF2A93B

# --- numbers, floors and dates in text: patterns whose matches are the results ---------
LABELLED_RENT = r"(?:租金|月租|價格|房租|租)\D{0,%d}(\d[\d,]{3,6})"
SUFFIXED_RENT = r"(\d[\d,]{3,6})(?U:\s*)(?:元/月|元|/月|每月)"
LABELLED_FEE = r"(?:管理費|管費)\D{0,8}(\d[\d,]{1,5})"
SUFFIXED_FEE = r"(\d[\d,]{1,5})(?U:\s*)(?:元)?(?U:\s*)(?:管理費|管費)"
FLOOR = (
    r"(?iU)(?<!\w)((?:B\d+|地下\d+|頂樓加蓋|頂樓|\d+|--)\s*/\s*(?:B?\d+|地下\d+|\d+|--)\s*(?:F|樓))"
)
PORTAL_FLOOR = (
    r"(?iU)(?<!\w)((?:B\d+|地下\d+|頂樓加蓋|\d+)\s*F?\s*/\s*(?:B?\d+|地下\d+|\d+)\s*F)"
)
LAYOUTS = (
    r"(?U)(\d+\s*房(?:\s*\d+\s*廳)?(?:\s*\d+\s*衛)?(?:\s*\d+\s*陽台)?)",
    r"(?U)(\d+\s*廳\s*\d+\s*衛)",
)
UPDATED_TEXTS = (
    r"(?:新上架|剛剛更新|今天更新|今日更新|昨日更新|昨天更新)",
    r"(?U)\d+\s*(?:分鐘|小時|天)(?:內|前)?更新",
    r"更新(?:時間|日期)?[:：]?(?U:\s*)[0-9/\-.年月日 ]{4,20}",
)
LISTED_TEXTS = (r"(?:刊登|上架)(?:時間|日期)?[:：]?(?U:\s*)[0-9/\-.年月日 ]{4,20}",)
