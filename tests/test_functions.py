import json
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from listingflow.functions import numbers as N
from listingflow.functions import text as X
from listingflow.functions import urls as U

from .fixtures import one


def column(spark, values, expression, schema="t string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, {schema}")
    got = df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()
    return [r.v for r in got]


def test_cleaning_and_titles(spark):
    assert column(spark, ["  a　 b\n", ""], X.clean) == ["a b", ""]
    assert column(spark, ["12,000 元\n採光套房近捷運。後文", "abc"], X.short_title) == ["採光套房近捷運", "abc"]
    assert column(spark, ["12,000 元\n採光"], lambda c: X.short_title(c, skip_numeric=False)) == ["12,000 元"]
    assert column(spark, [" 臺中市 ", "峨嵋鄉"], X.normalize_spelling) == ["台中市", "峨眉鄉"]
    assert column(spark, ["臺北市大安區羅斯福路４段７４號", "汀洲路 三段"], X.normalize_location) == [
        "台北市大安區羅斯福路4段74號",
        "汀州路3段",
    ]
    assert column(spark, ["㎡１"], lambda c: X.normalize_location(c, full_nfkc=True)) == ["m21"]
    assert column(spark, ["近捷運 全新！套房-A_1"], X.fingerprint_text) == ["套房A_1"]


def test_tri_state(spark):
    got = column(spark, ["可租補", "不可租補", "無", ""], lambda c: X.tri_state(c, ("租補",), ("不可租補",)))
    assert got == [True, False, None, None]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("此房屋限女生租住", True),
        ("性別不限女性男性皆可", False),
        ("限 單身 女 入住", True),
        ("[女/桃園/中壢]", True),
        ("女性優先", True),
        ("男女不拘", False),
    ],
)
def test_female_only(spark, text, expected):
    assert one(spark, text, X.female_only) is expected


def test_female_values(spark):
    got = column(spark, ["女", " Female ", "男女不限", "限女生", "", "f"], X.female_only_value)
    assert got == [True, True, False, True, False, True]
    assert column(spark, ["套房限女生入住喔", "無"], X.gender_snippet) == ["限女生入住", None]


def test_numbers(spark):
    assert column(spark, ["約 12,500 起", "無", "４５００"], N.first_int) == [12500, None, 4500]
    assert column(spark, ["999", "1,000", "300001"], lambda c: N.bounded_int(c, 1000, 300000)) == [
        None, 1000, None,
    ]
    assert column(spark, ["7.5坪", "0.5", "x"], lambda c: N.bounded_float(c, 1, 300)) == [7.5, None, None]
    text = "租金 12,000 元，押金 24000 元"
    assert one(spark, text, lambda c: N.rent_in_text(c, 300000)) == 24000
    assert one(spark, text, lambda c: N.rent_in_text(c, 80000, gap=8, pick="min")) == 12000
    assert one(spark, "租金 900000", lambda c: N.rent_in_text(c, 300000)) is None
    assert one(spark, "管理費 500 / 1,200 元管理費", lambda c: N.fee_in_text(c, 20000)) == 1200
    assert one(spark, "約 6.5 坪", lambda c: N.area_in_text(c, 1, 300)) == 6.5
    assert one(spark, "500 坪", lambda c: N.area_in_text(c, 1, 300)) is None
    assert one(spark, "500 坪", lambda c: N.area_in_text(c, None, None)) == 500.0
    assert one(spark, "8p", lambda c: N.area_in_text(c, 1, 80, "坪|p|P")) == 8.0


def test_rooms_floors_ages(spark):
    assert column(spark, ["獨套", "分租套房", "整層", "辦公", "x"], lambda c: N.room_type(c, N.ROOM_RULES)) == [
        "獨立套房", "分租套房", "整層住家", "辦公", None,
    ]
    # The orders differ: 分租套房 comes before 獨套 for the portal only.
    assert one(spark, "獨套 分租套房", lambda c: N.room_type(c, N.ROOM_RULES)) == "獨立套房"
    assert one(spark, "獨套 分租套房", lambda c: N.room_type(c, N.PORTAL_ROOM_RULES)) == "分租套房"
    assert column(spark, ["1 房 1 廳 1 衛", "2廳1衛", "x"], N.layout) == ["1房1廳1衛", "2廳1衛", None]
    assert column(spark, ["樓層 3 / 5 樓", "b1/7f", "頂樓加蓋/5F"], N.floor_text) == ["3/5樓", "B1/7F", "頂樓加蓋/5F"]
    assert column(spark, ["3/5樓", "B1/7F", None], N.total_floor) == ["5", "7", None]
    ages = ["新上架", "5分鐘前更新", "4天前更新", "昨日更新", "x"]
    assert column(spark, ages, N.update_age_days) == [0, 0, 4, 1, None]
    assert column(spark, ["4天內更新", "4天前更新"], lambda c: N.update_age_days(c, "前")) == [None, 4]
    assert column(spark, ["3天前更新 x", "更新日期：2026/07/01", "y"], X.updated_text) == [
        "3天前更新", "更新日期：2026/07/01", None,
    ]


def test_parsers(spark):
    assert column(spark, ["1", "Yes", "off", "2", None], N.to_bool) == [True, True, False, None, None]
    assert column(spark, ["90.5s", "29s", "150s", "5m"], N.duration_minutes) == [2, 1, 2, None]
    assert column(spark, ['["a","b"]', "a", None], X.string_list) == [["a", "b"], ["a"], []]
    snaps = ['{"total_monthly_cost":0,"rent":"900"}', '{"total_monthly_cost":true,"rent":7}', "{}"]
    assert column(spark, snaps, lambda c: N.snapshot_cost(F.try_parse_json(c))) == [900, 7, None]
    times = column(spark, ["2026-07-19T02:20:00+08:00", "2026-07-19T02:20:00", "x"], N.iso_timestamp)
    assert [t and t.strftime("%H:%M") for t in times] == ["18:20", "02:20", None]
    text = "標題\n地點： 桃園\n地址: 中壢 "
    assert one(spark, text, lambda c: X.labelled_field(c, ("地址", "地點"))) == "桃園"


def test_display(spark):
    assert column(spark, [15800, None], X.money, "t int") == ["15,800 元", "未知"]
    values = [8.0, 7.5, 123.456789, 0.0, 1234.5, None, 8.25]
    got = column(spark, values, lambda c: X.number_with_unit(c, " 坪"), "t double")
    assert got == [f"{v:g} 坪" if v is not None else "未知" for v in values]
    assert column(spark, [True, False, None], X.flag_mark, "t boolean") == ["✅", "❌", "未知"]
    secret = "https://discord.com/api/webhooks/1/abc"
    got = one(spark, f"x {secret} y https://ptb.discordapp.com/api/webhooks/2/t-k z", X.redact)
    assert got == "x <redacted Discord webhook> y <redacted Discord webhook> z"


LINKS = [
    ("http://a.example/x/y.html?p=1#f", "z?utm_source=q&b=2&a=1&b=3"),
    ("http://a.example/x/y.html?p=1#f", "../up/./w//v/?from=1"),
    ("http://a.example/x/y.html?p=1#f", "?k=v%20w&empty=&bare"),
    ("http://a.example/x/y.html?p=1#f", "#frag"),
    ("http://a.example", "sub"),
    ("http://a.example/d/", "e/../../f/"),
    ("https://a.example/d/", "//other.example/p/?gclid=1&q=%E5%8F%B0*~"),
    ("https://a.example/d/", "HTTPS://b.example/?UTM_X=1"),
    ("https://a.example/d/", "/"),
]


def test_urls_match_the_standard_library(spark):
    df = spark.createDataFrame(LINKS, "base string, href string")
    got = df.select(
        "base", "href",
        U.resolve_url(F.col("base"), F.col("href")).alias("url"),
        U.canonical_url(U.resolve_url(F.col("base"), F.col("href"))).alias("canonical"),
    ).collect()
    for row in got:
        expected = "https:" + row.href if row.href.startswith("//") else urljoin(row.base, row.href)
        assert row.url.lower() == expected.lower(), row
        assert row.canonical == U.page_link(row.base, row.href), row


def test_ids(spark):
    patterns = (r"rent\.yungching\.com\.tw/house/([A-Za-z0-9_-]+)",)
    urls = [
        "https://rent.yungching.com.tw/house/YC1", "https://x/y?caseId=7", "https://x/a/b-cd.e", "https://x/abc",
    ]
    assert column(spark, urls, lambda c: U.id_from_url(c, patterns)) == ["YC1", "7", "b_cd_e", None]
    portal = [
        "https://rent.591.com.tw/rent-detail-123.html", "https://rent.591.com.tw/12345", "https://x.com/12345",
        "/home/77",
    ]
    assert column(spark, portal, U.portal_id) == ["123", "12345", None, "77"]
    assert column(spark, [429, 401, 403, 200], U.status_code_name, "t int") == [
        "HTTP_RATE_LIMITED", "LOGIN_REQUIRED", "HTTP_FORBIDDEN", None,
    ]


def test_json_objects(spark):
    from listingflow.sources.walk import walk_objects

    df = spark.createDataFrame([(1, '{"a":{"b":[{"c":1}]},"d":2}'), (2, "{bad"), (3, None)], "k int, j string")
    rows = walk_objects(df, "k", "j").orderBy("k", "pos").collect()
    assert [(r.k, r.pos, json.loads(r.object)) for r in rows] == [
        (1, 0, {"a": {"b": [{"c": 1}]}, "d": 2}), (1, 1, {"b": [{"c": 1}]}), (1, 2, {"c": 1}),
    ]
