import json
import time

from pyspark.sql import functions as F

from catalog.tables import dealt
from listingflow.operators.classify import add_female_only
from listingflow.operators.gazetteer import Gazetteer
from listingflow.schema import conform
from listingflow.sources import forum, pages
from listingflow.sources.collect import collect_all, collect_source
from listingflow.sources.extract import extract_records, page_candidates
from listingflow.sources.registry import extract_all
from listingflow.sources.specs import HOUSEPRICE, PORTAL, RAKUYA, SPECS, YUNGCHING

from .fixtures import gazetteer


def table(spark, *rows):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "page_id int, source string, url string, html string"
    )


def state_page(item: dict) -> str:
    data = json.dumps({"props": {"pageProps": {"items": [item]}}}, ensure_ascii=False)
    return f'<script id="__NEXT_DATA__" type="application/json">{data}</script>'


LIST = "https://rent.591.com.tw/list?kind=2&region=3&section=37"
CARDS = """<ul><li class="row"><span class="cover" style="background: no-repeat url(//img.example/one.png)"></span>
<a href="https://rent.591.com.tw/204801">頂樓小窩 分租套房 6坪 永和區-中正路 9,500 元/月</a></li>
<li class="row"><picture><source srcset="//img.example/two.webp 1x, //img.example/three.webp 2x"></picture>
<a href="https://rent.591.com.tw/204802">轉角採光 獨立套房 9坪 永和區-永貞路 17,200 元/月 6F/7F 3天前更新</a></li></ul>"""


def test_portal_pages(spark):
    item = {
        "id": "604131", "title": "河濱小屋", "price": "10500", "area": "6.5坪", "region_name": "新北市",
        "section_name": "永和區", "address": "永和區-環河東路9號", "kind_name": "獨立套房", "floor": 4, "allfloor": "6",
        "photo_list": [{"url": "//img.example/river.jpg"}], "tags": ["有電梯", {"name": "租補"}], "manage_fee": 300,
        "rules": {"性別": {"text": "屋主說明：限女生租住"}}, "desc": "管理費 300 元",
    }
    jsonld = {
        "@type": "Apartment", "name": "巷弄裡的獨立套房", "description": "獨立套房 5坪 11,111 元", "url": "/rent-detail-700123.html",
        "address": {"addressRegion": "台北市", "addressLocality": "大安區", "streetAddress": "和平東路一段"},
        "offers": {"price": "13900"}, "image": ["https://img.example/a.jpg", "https://img.example/b.jpg"],
    }
    sparse = '<a href="https://rent.591.com.tw/330011">看得到海的獨立套房 6坪 8,800 元/月</a>'
    shared = '<a href="https://rent.591.com.tw/330012">東區靜巷分租套房 5坪 7,000 元/月</a>'
    found, refused = extract_records(
        table(
            spark,
            ("591", LIST, state_page(item)),
            ("591", LIST, CARDS),
            ("591", LIST, f'<script type="application/ld+json">{json.dumps([jsonld, {"name": "x"}])}</script>'),
            ("591", "https://rent.591.com.tw/list?kind=2&region=17&section=247", sparse),
            ("591", "https://rent.591.com.tw/list?kind=3&region=8&section=99", shared),
            ("591", LIST, "<div id='app'></div>"),
            ("591", LIST, "<html><script>{bad"),
            ("591", LIST, "<p>Access <b>denied</b></p>"),
        ),
        PORTAL,
        gazetteer(spark),
    )
    rows = {r.listing_id: r for r in found.collect()}
    assert set(rows) == {"604131", "204801", "204802", "700123", "330011", "330012"}
    a = rows["604131"]
    assert (a.url, a.city, a.district, a.rent, a.total_monthly_cost, a.area_ping, a.room_type, a.floor) == (
        "https://rent.591.com.tw/rent-detail-604131.html", "新北市", "永和區", 10500, 10800, 6.5, "獨立套房", "4/6F",
    )
    assert a.image_urls == ["https://img.example/river.jpg"] and a.tags == ["有電梯", "租補"]
    assert json.loads(a.raw)["gender_restriction"] == "屋主說明：限女生租住"
    # Images belong to their own card only.
    assert rows["204801"].image_urls == ["https://img.example/one.png"]
    assert rows["204802"].image_urls == ["https://img.example/two.webp", "https://img.example/three.webp"]
    assert (rows["204802"].floor, rows["204802"].update_age_days) == ("6F/7F", 3)
    b = rows["700123"]
    assert (b.city, b.district, b.rent, b.area_ping, b.address) == ("台北市", "大安區", 13900, 5.0, "台北市 大安區 和平東路一段")
    assert len(b.image_urls) == 2 and json.loads(b.raw)["jsonld"]["name"] == "巷弄裡的獨立套房"
    assert (rows["330011"].city, rows["330011"].district) == ("高雄市", "鼓山區")
    assert (rows["330012"].city, rows["330012"].district) == ("台中市", "東區")
    assert sorted((r.url == LIST, r.code) for r in refused.collect()) == [
        (True, "EMPTY_RESULT"), (True, "EMPTY_RESULT"), (True, "HTTP_FORBIDDEN"),
    ]
    flagged = add_female_only(conform(found)).select("listing_id", "female_only").collect()
    assert {r.listing_id for r in flagged if r.female_only} == {"604131"}


LINKED_LIST = """<script type="application/ld+json">{"itemListElement":[{"@type":"Thing","name":"no link"},{"@type":"House","id":"77ab01",
"url":"https://community.rakuya.com.tw/9/rent/77ab01?fbclid=z&page=2&utm_medium=m","name":"有院子的獨立套房",
"description":"台北市大安區金山南路 獨立套房 10坪 2/4樓 今日更新 可租補 垃圾代收 室內獨立洗衣機 可報稅",
"offers":[{"name":"y"},{"price":"14300"}],"image":["/yard.jpg"]}]}</script>"""
STATE = """<script>let n = 0; window.__INITIAL_STATE__ = {"page":{"rows":[{"houseId":"QT0042","title":"屋主's {自租}","rentPrice":"11800",
"detailUrl":"https://rent.yungching.com.tw/house/QT0042","city":"台北市","district":"大安區","area":"7坪","layout":"2房1衛",
"features":["可報稅"],"description":"今日更新，可租補"}]}}; start(n)</script>
<script>load(JSON.parse('{"caseId":"QT0099","url":"/house/QT0099","name":"q \\u5957 \\'x\\'","rent":8700}'))</script>"""
DETAIL = """<html><head><title>木柵 - 分租套房</title></head><body><h1>z</h1><p>台北市文山區木柵路 分租套房 4.5坪 4/4樓</p>
<p>7900 元/月 男女不限 可入籍 獨立洗衣機 專人收垃圾 5天前更新 限女性入住</p><script>const town='台北市大安區'</script>
<img src="/door.jpg"></body></html>"""
BLOCK_LINK = """<body><a href="https://rent.houseprice.tw/house/5550_66?utm_campaign=c"><div><img src="https://img.example/lift.jpg">
<h3>圓環旁電梯套房</h3><b>台北市大同區重慶北路</b><b>12600</b><b>元/月</b><em>8 坪</em></div></a></body>"""


def test_generic_pages(spark):
    g = gazetteer(spark)
    found, _ = extract_records(table(spark, ("rakuya", "https://rent.rakuya.com.tw/result", LINKED_LIST)), RAKUYA, g)
    (r,) = found.collect()
    assert (r.listing_id, r.url) == ("77ab01", "https://community.rakuya.com.tw/9/rent/77ab01?page=2")
    assert (r.city, r.district, r.rent, r.area_ping, r.floor, r.update_age_days) == ("台北市", "大安區", 14300, 10.0, "2/4樓", 0)
    assert sorted(r.tags) == sorted(["租補", "可報稅", "獨立洗衣機", "垃圾代收"]) and r.has_rent_subsidy is True
    assert r.image_urls == ["https://rent.rakuya.com.tw/yard.jpg"]

    url = "https://rent.yungching.com.tw/house/QT0500"
    pages_ = table(spark, ("yungching", "https://rent.yungching.com.tw/list/demo", STATE), ("yungching", url, DETAIL))
    found, _ = extract_records(pages_, YUNGCHING, g)
    rows = {r.listing_id: r for r in found.collect()}
    assert set(rows) == {"QT0042", "QT0099", "QT0500"}
    assert json.loads(rows["QT0042"].raw)["layout"] == "2房1衛" and rows["QT0042"].rent == 11800
    assert rows["QT0099"].rent == 8700 and rows["QT0099"].title == "q 套 'x'"
    d = rows["QT0500"]
    assert (d.title, d.district, d.rent, d.area_ping, d.room_type, d.update_age_days) == (
        "木柵 分租套房", "文山區", 7900, 4.5, "分租套房", 5,
    )
    assert json.loads(d.raw)["gender_restriction"] == "限女性入住"
    assert d.image_urls == ["https://rent.yungching.com.tw/door.jpg"]

    found, _ = extract_records(table(spark, ("houseprice_5168", "https://rent.houseprice.tw/", BLOCK_LINK)), HOUSEPRICE, g)
    (h,) = found.collect()
    assert (h.listing_id, h.title, h.district, h.rent, h.area_ping) == ("5550_66", "圓環旁電梯套房", "大同區", 12600, 8.0)


POST = """<html><head><title>x - 批踢踢實業坊</title></head><div id="main-content"><div class="article-metaline">
<span class="article-meta-tag">作者</span><span class="article-meta-value">me</span></div><div class="article-metaline">
<span class="article-meta-tag">標題</span><span class="article-meta-value">[無/桃園/南崁] 獨套</span></div>
地址：桃園縣龜山鄉明成街
租金：9000 元 押金 18000 元
樓層: 3樓
管理費 500 8坪 可報稅
--
簽名 1000 元 <span class="f2">※ 發信站: x</span><div class="push">推 5000元</div>
<a href="//i.imgur.com/a.jpg">i</a></div></html>"""


def test_forum_posts(spark):
    base = "https://www.ptt.cc/bbs/Rent_tao/"
    other = POST.replace("[無/桃園/南崁] 獨套", "[求租] 桃園市").replace("出租", "")
    rows = forum.forum_records(
        table(spark, ("p", f"{base}M.1.A.html", POST), ("p", f"{base}M.2.html", other.replace("獨套", "求租")),
              ("p", f"{base}M.3.html", POST.replace("桃園縣龜山鄉", "台北市大安區")), ("p", f"{base}x", "<p>no</p>")),
        gazetteer(spark),
    ).collect()
    by_id = {r.listing_id: r for r in rows}
    assert set(by_id) == {"M.1.A"}
    r = by_id["M.1.A"]
    assert (r.title, r.city, r.district, r.address) == ("[無/桃園/南崁] 獨套", "桃園市", "龜山區", "桃園縣龜山鄉明成街")
    assert (r.rent, r.total_monthly_cost, r.area_ping, r.room_type, r.floor) == (9000, 9500, 8.0, "獨立套房", "3樓")
    assert r.tags == ["報稅"] and r.image_urls == ["https://i.imgur.com/a.jpg"]
    assert "簽名" not in r.description and "推" not in r.description


def test_sources_in_order_first_key_wins(spark):
    same = LINKED_LIST
    pages_ = table(spark, ("rakuya", "https://rent.rakuya.com.tw/a", same), ("rakuya", "https://rent.rakuya.com.tw/b", same),
                   ("ptt_rent_tao", "https://www.ptt.cc/bbs/Rent_tao/M.1.html", POST))
    specs = [s for s in SPECS if s.name in ("rakuya", "ptt_rent_tao")]
    found, refused = extract_all(pages_, gazetteer(spark), specs)
    assert sorted((r.source, r.page_id) for r in found.collect()) == [("ptt_rent_tao", 2), ("rakuya", 0)]
    assert pages.quarantine_counts(refused).count() == 0


def test_all_kinds_of_source_at_once(spark):
    """Portal, forum and linked pages, refusals, and a gazetteer that lacks the forum's city."""
    rows = [
        ("591", LIST, CARDS), ("591", LIST, "<p>Access <b>denied</b></p>"), ("591", LIST, "<p>nothing</p>"),
        ("rakuya", "https://rent.rakuya.com.tw/a", LINKED_LIST), ("ptt_rent_tao", "https://www.ptt.cc/bbs/Rent_tao/M.7.html", POST),
        ("ptt_rent_tao", "https://www.ptt.cc/bbs/Rent_tao/x.html", "<p>no post</p>"), ("unknown", "https://u.example/", "<p>x</p>"),
    ]
    found, refused = extract_all(table(spark, *rows), gazetteer(spark))
    assert sorted((r.source, r.listing_id) for r in found.collect()) == [
        ("591", "204801"), ("591", "204802"), ("ptt_rent_tao", "M.7"), ("rakuya", "77ab01"),
    ]
    assert sorted(r.code for r in refused.collect()) == ["EMPTY_RESULT", "HTTP_FORBIDDEN"]
    small = Gazetteer((("台北市", 1, "大安區", 5),))
    found, _ = extract_all(table(spark, *rows[3:5]), small)
    assert [(r.source, r.district) for r in found.collect()] == [("rakuya", "大安區")]
    none, gone = extract_all(table(spark, *rows).limit(0), gazetteer(spark))
    assert none.count() == gone.count() == 0


def test_statuses_and_walls(spark):
    df = spark.createDataFrame([(1, 403), (1, 429), (2, 200), (3, 401), (3, 403)], "page_id int, status int")
    assert {r.page_id: r.status for r in pages.worst_status(df).collect()} == {1: 429, 2: None, 3: 403}
    texts = [
        ("<p>請完成安全驗證</p>", "CAPTCHA_DETECTED"), ("<p>請先登入</p>", "LOGIN_REQUIRED"),
        ("<p>Too many\n requests</p>", None), ("<p>Too many <b>requests</b></p>", "HTTP_RATE_LIMITED"),
        ("<h1>403 Forbidden</h1>", "HTTP_FORBIDDEN"), ("<script>captcha()</script><p>ok</p>", None),
    ]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(texts)], "i int, html string")
    got = [r.code for r in pages.page_errors(df).orderBy("i").collect()]
    assert got == [code for _, code in texts]


def test_policy(spark):
    urls = spark.createDataFrame([(f"https://{h}/list/a?x=1",) for h in "abcd"], "url string")
    policies = spark.createDataFrame(
        [("https://a", "unavailable", None), ("https://b", "absent", None),
         ("https://c", "rules", [("/list/a", True), ("/list", False)])],
        "origin string, state string, rules array<struct<prefix:string,allow:boolean>>",
    )
    got = [r.policy_code for r in pages.url_policy(urls, policies).orderBy("url").collect()]
    assert got == ["ROBOTS_UNAVAILABLE", None, None, "ROBOTS_UNAVAILABLE"]
    deny = policies.withColumn("rules", F.expr("array(struct('/list' AS prefix, false AS allow))"))
    assert pages.url_policy(urls, deny).filter("url LIKE 'https://c%'").first().policy_code == "ROBOTS_DISALLOWED"


def test_collecting_a_source(spark):
    """Details fill gaps, old records drop out, pages after the last new one do not count."""

    def card(n, more):
        return f'<p><a href="https://rent.houseprice.tw/house/H{n:04d}">獨立套房 {n} 台北市大同區 {more} {"好" * 240}</a></p>'

    def page(search, n, *cards):
        return search, n, f"https://rent.houseprice.tw/list?s={search}&page={n}", "".join(cards)

    rows = [
        page(0, 0, card(1, "8坪 9,000 元/月"), card(2, "")),
        page(0, 1, card(1, "8坪 9,000 元/月")),
        page(0, 2, card(3, "8坪 9,000 元/月")),
        page(1, 0, card(4, "30天前更新 8坪")),
        page(2, 0, card(3, "8坪 9,000 元/月")),
        page(2, 1, ""),
        page(3, 0, "<p>請先登入</p>"),
        page(4, 0, ""),
    ]
    pages_ = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "page_id int, search int, page int, url string, html string"
    )
    detail = "<h1>x</h1><p>台北市大同區 獨立套房 5.5坪 12000 元/月</p>"
    details = spark.createDataFrame(
        [(100, "https://rent.houseprice.tw/house/H0002", detail), (101, "https://rent.houseprice.tw/house/H0009", "forbidden")],
        "page_id int, url string, html string",
    )
    found, refused, kept = collect_source(pages_, HOUSEPRICE, gazetteer(spark), details)
    rows = {r.listing_id: r for r in found.collect()}
    # H0003 first stands on a page that no longer counts, so the later search has it.
    assert {k: r.search for k, r in rows.items()} == {"H0001": 0, "H0002": 0, "H0003": 2}
    assert (rows["H0002"].rent, rows["H0002"].area_ping) == (12000, 5.5)
    # The refusal ends the source: the empty search after it was never asked.
    assert sorted((r.code, r.message[:6]) for r in refused.collect()) == [
        ("HTTP_FORBIDDEN", "detail"), ("LOGIN_REQUIRED", "LOGIN_"),
    ]
    assert {(r.search, r.page) for r in kept.collect() if not r.kept} == {(0, 2)}
    assert json.loads(rows["H0002"].raw)["detail_raw_json"]["parser"] == "detail_text"


def test_a_refusal_ends_the_source(spark):
    def card(n):
        return f'<p><a href="https://rent.houseprice.tw/house/H{n:04d}">獨立套房 {n} 台北市大同區 8坪 9,000 元/月 {"好" * 240}</a></p>'

    rows = [
        (0, 0, card(1)), (0, 1, card(1)), (0, 2, "<p>請先登入</p>"),  # never met: the search had ended
        (1, 0, card(2)), (1, 1, "<p>請先登入</p>"), (1, 2, card(3)), (2, 0, card(4)),
    ]
    pages_ = spark.createDataFrame(
        [(i, s, p, f"https://rent.houseprice.tw/list?s={s}&page={p}", h) for i, (s, p, h) in enumerate(rows)],
        "page_id int, search int, page int, url string, html string",
    )
    found, refused, kept = collect_source(pages_, HOUSEPRICE, gazetteer(spark))
    assert {r.listing_id for r in found.collect()} == {"H0001", "H0002"}
    assert [(r.code, "s=1&page=1" in r.url) for r in refused.collect()] == [("LOGIN_REQUIRED", True)]
    assert max((r.search, r.page) for r in kept.collect()) == (1, 0)


def test_a_page_with_many_links_is_read_in_linear_time():
    from listingflow.sources.dom import candidates

    rules = HOUSEPRICE.page_rules()

    def seconds(n):
        html = "<div>" + "".join(f'<p><a href="/house/H{i}_1">套房 {i}</a><img src="/{i}.jpg"></p>' for i in range(n)) + "</div>"
        start = time.process_time()
        rows = list(candidates("https://rent.houseprice.tw/list", html, rules))
        assert len(rows) == n and rows[5]["images"] == ["https://rent.houseprice.tw/5.jpg"]
        return time.process_time() - start

    seconds(500)
    assert seconds(10_000) < 12 * seconds(2_000)


def test_collecting_all_sources_in_one_run(spark):
    """Each source by its own settings; a refusal ends its own source only; posts have no searches."""

    def card(site, n, more="8坪 9,000 元/月"):
        link = {"591": f"https://rent.591.com.tw/{200_000 + n}", "houseprice_5168": f"https://rent.houseprice.tw/house/H{n:04d}"}[site]
        return f'<p><a href="{link}">獨立套房 {n} 台北市大同區 {more} {"好" * 240}</a></p>'

    wall = "<p>請先登入</p>"
    post = "<div id='main-content'><span>標題</span>[套房/桃園/中壢] 房\n地址：桃園市中壢區路\n租金：8000 元</div>"
    rows = []
    for site, url in (("591", "https://rent.591.com.tw/list?kind=2"), ("houseprice_5168", "https://rent.houseprice.tw/list?x=1")):
        shown = [
            (0, 0, card(site, 1), ), (0, 1, card(site, 1)), (0, 2, card(site, 1)), (0, 3, card(site, 2)),
            (1, 0, card(site, 3, "")), (1, 1, wall if site == "591" else card(site, 5)), (2, 0, card(site, 4)),
        ]
        rows += [(i, site, s, p, f"{url}&s={s}&p={p}", h) for i, (s, p, h) in enumerate(shown)]
    rows += [(0, "ptt_rent_tao", None, None, "https://www.ptt.cc/bbs/Rent_tao/M.1.html", post), (1, "ptt_rent_tao", None, None, "https://www.ptt.cc/bbs/Rent_tao/M.2.html", wall)]
    rows += [(0, "unknown", 0, 0, "https://x.example/", card("591", 9))]
    schema = "page_id int, source string, search int, page int, url string, html string"
    told = '<script type="application/ld+json">{"name": "獨立套房", "description": "8坪 大同區", "offers": {"price": 12000}}</script>'
    details = spark.createDataFrame(
        [
            (0, "591", "https://rent.591.com.tw/200003", told), (0, "houseprice_5168", "https://rent.houseprice.tw/house/H0003", "<h1>x</h1><p>台北市大同區 獨立套房 5.5坪 11000 元/月</p>"),
            (1, "houseprice_5168", "https://rent.591.com.tw/200003", wall),
        ],
        "page_id int, source string, url string, html string",
    )
    pages_ = spark.createDataFrame(rows, schema)
    found, refused, kept = collect_all(pages_, gazetteer(spark), SPECS, details)
    got = {(r.source, r.listing_id): r.rent for r in found.collect()}
    assert got == {
        ("ptt_rent_tao", "M.1"): 8000,
        ("591", "200001"): 9000, ("591", "200003"): 12000,  # ended by the refusal
        ("houseprice_5168", "H0001"): 9000, ("houseprice_5168", "H0003"): 11000, ("houseprice_5168", "H0005"): 9000, ("houseprice_5168", "H0004"): 9000,
    }
    assert sorted((r.source, r.code, r.message[:6]) for r in refused.collect()) == [
        ("591", "LOGIN_REQUIRED", "LOGIN_"), ("houseprice_5168", "LOGIN_REQUIRED", "detail"), ("ptt_rent_tao", "LOGIN_REQUIRED", "LOGIN_"),
    ]
    # Two pages without anything new end a search of the one, one page a search of the other.
    assert {(r.source, r.search, r.page) for r in kept.collect() if r.kept} == {
        ("591", 0, 0), ("591", 0, 1), ("591", 0, 2), ("591", 1, 0),
        ("houseprice_5168", 0, 0), ("houseprice_5168", 0, 1), ("houseprice_5168", 1, 0), ("houseprice_5168", 1, 1), ("houseprice_5168", 2, 0),
    }
    only = collect_all(pages_.filter("source = 'ptt_rent_tao'"), gazetteer(spark), SPECS, details)
    assert [r.listing_id for r in only[0].collect()] == ["M.1"] and only[1].count() == 1 and only[2].count() == 0
    none = collect_all(pages_.filter("1 = 0"), gazetteer(spark), SPECS, details)
    assert [x.count() for x in (none[0], none[2])] == [0, 0]


def test_pages_are_dealt_to_tasks_before_they_are_read(spark, folder):
    """A table of one row group is no work for one task; nor is the test for refusals done before the dealing."""
    spark.range(40).selectExpr("CAST(id AS INT) AS page_id").coalesce(1).write.parquet(f"{folder}/t")
    rows = dealt(spark.read.parquet(f"{folder}/t"))
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    pages = rows.selectExpr("page_id", "'591' AS source", "'https://rent.591.com.tw/list?kind=2' AS url", "concat('請先登入 ', page_id) AS html")
    records, refused = extract_records(pages, PORTAL, gazetteer(spark))
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "請先登入" not in plan[plan.index("Repartition") :]
    assert records.count() == 0 and {r.code for r in refused.collect()} == {"LOGIN_REQUIRED"}


def test_pages_reach_python_a_few_at_a_time(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    page_candidates(table(spark, ("591", LIST, CARDS)), PORTAL)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 250


def test_a_page_without_markup_has_no_records(spark):
    records, refused = extract_records(table(spark, ("591", LIST, None), ("591", LIST, CARDS)), PORTAL, gazetteer(spark))
    assert records.count() == 2 and [r.code for r in refused.collect()] == ["EMPTY_RESULT"]
