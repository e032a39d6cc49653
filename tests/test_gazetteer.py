import random

import pytest
from pyspark.sql import functions as F

from listingflow.operators import gazetteer as G
from listingflow.operators import place_table
from listingflow.operators.place_table import PlaceTable
from listingflow.sources.registry import extract_all

from .fixtures import PLACES, gazetteer, gazetteer_table


def resolve(spark, text, city=None, district=None):
    df = spark.createDataFrame([(text, city, district)], "t string, c string, d string")
    return tuple(gazetteer(spark).add_place(df, "t", "c", "d").first().place)


@pytest.mark.parametrize(
    "text,city,district,expected",
    [
        ("套房", "臺中市", "大安區", ("台中市", "大安區")),
        ("臺南市東區東門路套房", None, None, ("台南市", "東區")),
        ("大安區採光套房", None, None, (None, None)),
        ("東區近車站套房", None, None, (None, None)),
        ("套房", "台北市", "西屯區", ("台北市", None)),
        ("西屯區套房出租", None, None, ("台中市", "西屯區")),
        ("套房", "高雄", "苓雅區", ("高雄市", "苓雅區")),
        ("套房", None, "永和區", ("新北市", "永和區")),
        ("新北市永和區與台北市大安區", None, None, ("新北市", "永和區")),
    ],
)
def test_resolve(spark, text, city, district, expected):
    assert resolve(spark, text, city, district) == expected


def test_portal_order_and_page_defaults(spark):
    g = gazetteer(spark)
    df = spark.createDataFrame(
        [
            ("大安區 套房", "https://rent.591.com.tw/list?kind=2&region=1&section=5"),
            ("套房", "https://rent.591.com.tw/list?region=8&section=104"),
            ("套房", "https://rent.591.com.tw/list?region=8&section=104-99"),
            ("東區 西屯區", "https://rent.591.com.tw/list"),
        ],
        "t string, u string",
    )
    got = [tuple(r.place) for r in g.add_place_longest_first(df, "t", "u").collect()]
    assert got == [("台北市", "大安區"), ("台中市", "西屯區"), ("台中市", None), ("台中市", "西屯區")]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("[無/桃園/中壢] 套房\n租屋地址：桃園縣龜山鄉明成街", ("桃園市", "龜山區")),
        ("[無/桃園/南崁] 近車站", ("桃園市", "蘆竹區")),
        ("[無/桃園/青埔] 近車站\n桃園市", ("桃園市", None)),
        ("套房\n地址：台北市大安區羅斯福路", (None, None)),
        ("出租 桃園市中壢區 套房", ("桃園市", "中壢區")),
    ],
)
def test_board(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(gazetteer(spark).add_place_on_board(df, "t").first().place) == expected


def test_lookup_jobs(spark):
    table = gazetteer_table(spark)
    back = {r.district: (r.city, r.n_cities) for r in G.reverse_lookup(table).collect()}
    assert back["大安區"] == (None, 2) and back["永和區"] == ("新北市", 1)
    legacy = spark.createDataFrame([(26, 256, "東沙")], "region_id int, section_id int, label string")
    names = {(r.region_id, r.section_id): r.district for r in G.id_names(table, legacy).collect()}
    assert names[(26, 256)] == "東沙" and names[(3, 37)] == "永和區"
    first = G.district_listing(table).orderBy("ord").first()
    assert first.city == "台北市" and first.districts.startswith("大安區、文山區")


def test_allowlist_violations(spark):
    allow = spark.createDataFrame(
        [("台北市", ["西屯區"]), ("高雄市", ["*", "鼓山區"]), ("台中市", ["*"]), ("火星市", ["*"]), ("新北市", [])],
        "city string, districts array<string>",
    )
    got = {(r.city, r.problem) for r in G.validate_allowlist(allow, gazetteer_table(spark)).collect()}
    assert got == {
        ("台北市", "unknown district"), ("高雄市", "'*' must stand alone"),
        ("火星市", "unknown city"), ("新北市", "no district"),
    }


def test_names_by_join_agree_with_expression(spark):
    texts = spark.createDataFrame(
        [(1, "在東區與西屯區"), (2, "中正區大安區"), (3, "無")], "k int, t string"
    )
    names = gazetteer_table(spark).select("district")
    joined = {r.k: r.district for r in G.names_in_text(texts, names, "k", "t", "district").collect()}
    direct = {
        r.k: r.v for r in texts.select("k", gazetteer(spark).earliest_district(F.col("t")).alias("v")).collect()
    }
    assert joined == {k: v for k, v in direct.items() if v}
    blocked = {r.k: r.district for r in G.names_in_text(texts, names, "k", "t", "district", block=1).collect()}
    assert blocked == joined


def test_address(spark):
    df = spark.createDataFrame(
        [("位於臺北市 大安區羅斯福路四段，近", "台北市", "大安區"), ("x|大安區 路 1 號", None, "大安區")],
        "t string, c string, d string",
    )
    got = [r.a for r in df.select(G.address_in_text(F.col("t"), F.col("c"), F.col("d")).alias("a")).collect()]
    assert got == ["台北市 大安區羅斯福路四段", "大安區 路 1 號"]
    portal = G.address_in_text(F.col("t"), F.col("c"), F.col("d"), 40, portal=True)
    assert [r.a for r in df.select(portal.alias("a")).collect()] == ["大安區羅斯福路四段", "大安區"]


@pytest.mark.parametrize("block", [3, 100_000])
def test_a_table_gives_what_expressions_give(spark, block):
    draw = random.Random(block)
    words = [*{x for c, _, d, _ in PLACES for x in (c, d)}, "高雄", "台北", "桃園", "臺南市", "套房", " ", "、", "x", "地址：", "\n", "[無/桃園/中壢] "]

    def text(n):
        return "".join(draw.choice(words) for _ in range(draw.randint(0, n)))

    rows = [
        (
            i, text(6), draw.choice([None, "", text(1), text(2)]), draw.choice([None, "", text(1), text(2)]),
            draw.choice([None, "https://x/list?region=%d&section=%s" % (draw.choice([1, 2, 8, 26, 99]), draw.choice(["5", "15", "104", "256", "1-2"]))]),
        )
        for i in range(400)
    ]
    rows += [(1_000, None, None, None, None), (1_001, "台北市", None, "大安區", ""), (1_001, "台北市", None, "大安區", "")]
    df = spark.createDataFrame(rows, "i int, t string, c string, d string, u string")
    legacy = [(26, 256, "東沙")]
    both = gazetteer(spark), PlaceTable(gazetteer_table(spark), legacy, block)
    named = df.withColumn("t2", F.col("t"))
    for use in (
        lambda g: g.add_place(df, "t", "c", "d"),
        lambda g: g.add_place(df, "t"),
        lambda g: g.add_place_longest_first(df, "t"),
        lambda g: g.add_place_longest_first(df, "t", "u"),
        lambda g: g.add_place_of_page(df, "u", "place"),
        lambda g: g.add_city_of(named, "d", "c", "place"),
        lambda g: g.add_place_on_board(df, "t"),
    ):
        literal, table = (sorted(map(str, use(g).collect())) for g in both)
        assert literal == table and len(table) == len(rows)


def test_extraction_with_over_100_000_names(spark):
    """Names of the fixture among many others, read from pages of three kinds of source."""
    places = spark.range(110_000).selectExpr(
        "concat('City', id % 500, '縣') AS city", "100 + id % 500 AS region_id", "concat('Ward', id, '區') AS district",
        "id AS section_id", "1000 + id AS ord",
    ).unionByName(gazetteer_table(spark))
    book = G.Gazetteer.from_table(places)
    assert isinstance(book, PlaceTable)
    card = '<p><a href="https://rent.rakuya.com.tw/detail/%s">獨立套房 %s 8坪 9,000 元/月 ' + "好" * 240 + "</a></p>"
    post = '<div id="main-content">標題 [無/桃園/中壢] 套房\n租金：9000 元\n約 8 坪 獨立套房 Ward7區\n--\n</div>'
    portal = '<p><a href="https://rent.591.com.tw/204801">獨立套房 8坪 永和區 9,000 元/月</a></p>'
    rows = [
        (0, "rakuya", "https://rent.rakuya.com.tw/a", card % ("77ab01", "Ward109999區") + card % ("77ab02", "City3縣 Ward503區") + card % ("77ab03", "大安區")),
        (1, "591", "https://rent.591.com.tw/list?kind=2&region=1", portal),
        (2, "ptt_rent_tao", "https://www.ptt.cc/bbs/Rent_tao/M.1.A.html", post),
    ]
    pages = spark.createDataFrame(rows, "page_id int, source string, url string, html string")
    found, _ = extract_all(pages, book)
    small, _ = extract_all(pages, gazetteer(spark))
    got = {r.listing_id: (r.city, r.district) for r in found.collect()}
    assert got["77ab01"] == ("City499縣", "Ward109999區") and got["77ab02"] == ("City3縣", "Ward503區")
    wanted = {r.listing_id: (r.city, r.district) for r in small.collect()}
    assert {k: v for k, v in got.items() if not k.startswith("77ab0")} == {k: v for k, v in wanted.items() if not k.startswith("77ab0")}
    assert got["204801"] == ("新北市", "永和區")


def test_the_work_does_not_grow_with_texts_times_names(spark):
    """More names than an automaton takes: the texts are read once, not once for each block of names."""
    places = spark.range(300).selectExpr("concat('C', id % 7) AS city", "id AS region_id", "concat('W', id, '區') AS district", "id AS section_id", "id AS ord")
    texts = spark.createDataFrame([("a", 0, "W7區W17區 W7區 C3"), ("b", 0, "W17區"), ("c", 1, ""), ("d", 2, None), ("e", 0, "𠀀W299區é")], "key string, what int, text string")
    many, few = (PlaceTable(places, block=block)._hits(texts) for block in (10, 1_000))
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


@pytest.mark.parametrize("most", [0, 200_000])
def test_pieces_begin_and_end_as_names_do(spark, monkeypatch, most):
    """However little the filter tells, few pieces of a text meet the names; hits stay the same."""
    monkeypatch.setattr(place_table, "MOST_ENDS", most)
    monkeypatch.setattr(place_table, "MOST_BITS", 1 << 10)
    places = spark.range(2_000).selectExpr("concat('C', id % 7) AS city", "id AS region_id", "concat('W', id, '區') AS district", "id AS section_id", "id AS ord")
    texts = spark.createDataFrame([("a", 0, "W7區W17區 W7區 C3" + "".join(chr(97 + i * i * i % 89 % 23) for i in range(1_000))), ("b", 0, "W1999區𠀀"), ("c", 0, "區W")], "key string, what int, text string")
    table, whole = PlaceTable(places, block=10), PlaceTable(places, block=100_000)
    hits = table._hits(texts)
    assert sorted(map(str, hits.collect())) == sorted(map(str, whole._hits(texts).collect()))
    pieces = texts.mapInArrow(place_table._pieces(table._sent), "key string, " + place_table._PIECE).count()
    assert pieces < 10 if most else pieces > 100
