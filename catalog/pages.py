"""Pages to records: cards, detail text, embedded data, forum posts."""

from pyspark.sql import functions as F

from listingflow.operators.gazetteer import Gazetteer
from listingflow.sources import forum
from listingflow.sources.collect import collect_all, collect_source
from listingflow.sources.extract import extract_records, page_candidates
from listingflow.sources.registry import extract_all
from listingflow.sources.specs import HOUSEPRICE, PORTAL, SourceSpec

from .state import page_walk_sql
from .tables import customers_orders, dealt, gazetteer, load, query

# Every page of the table counts as a detail page of its site; cards are its menu links.
DETAIL = SourceSpec(name="web", ordinal=1, detail_url_patterns=(r"example\.(?:com|net|org)/[a-z]{2}/(\d+)",))
LINKS = SourceSpec(name="web", ordinal=1, detail_url_patterns=(r"^https?://[^/]*example\.[a-z]+/([^/]+)$",))


def _pages(spark, sf):
    return dealt(load(spark, sf, "pages")).select("page_id", F.lit("web").alias("source"), "url", "html")


BODY = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '<i>', 'g')" \
       ", '(?s)<[^>]*>', chr(1), 'g')"
CLEAN = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(f"""
    WITH t AS (SELECT page_id, regexp_extract(url, 'example\\.(?:com|net|org)/[a-z]{{2}}/(\\d+)', 1) AS listing_id,
        {CLEAN.format("replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' - ', ' ')")} AS title FROM pages),
    f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY page_id) = 1)
    SELECT page_id, listing_id, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title,
        '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), 1, 120)
        AS title FROM f""")
def page_extract_detail(spark, sf):
    records, _ = extract_records(_pages(spark, sf), DETAIL, gazetteer(spark, sf))
    return records.filter("strategy = 3").select("page_id", "listing_id", "title")


@query("""
    WITH a AS (SELECT page_id, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS origin,
        unnest(regexp_extract_all(html, '<a href="/([^/"]+)"', 1)) AS href FROM pages)
    SELECT page_id, count(*) AS n_cards, count(DISTINCT href) AS n_distinct FROM a GROUP BY page_id""")
def page_extract_cards(spark, sf):
    cards = page_candidates(_pages(spark, sf), LINKS).filter("strategy = 2")
    return cards.groupBy("page_id").agg(F.count("*").alias("n_cards"), F.count_distinct("url").alias("n_distinct"))


ITEMS = """concat('<html><head><script type="application/ld+json">[', '{"@type":"Apartment","id":"ord', CAST(o_orderkey AS STRING),
    '","url":"https://web.example.com/en/', CAST(o_orderkey AS STRING), '?utm_source=z","name":"', n_name,
    ' 獨立套房","description":"', r_name, ' ', n_name, ' ', CAST(o_custkey % 30 + 1 AS STRING), '坪 可租補 今日更新","offers":{"price":"',
    CAST(CAST(floor(o_totalprice / 20) AS INT) AS STRING), '"},"image":["/i.jpg"]}', ']</script></head><body><script>',
    'window.__INITIAL_STATE__ = {"list":[{"houseId":"case', CAST(o_orderkey AS STRING), '","detailUrl":"/en/', CAST(o_orderkey + 10000000 AS STRING),
    '","title":"B ', n_name, '","city":"', r_name, '","district":"', n_name, '","rentPrice":"', CAST(o_custkey + 5000 AS STRING),
    ' 元","manageFee":"1,000","area":"7.5坪","kind_name":"分租套房","gender":"限女生"}]};</script></body></html>')"""
ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


@query(f"""
    SELECT 'ord' || o_orderkey AS listing_id, 'https://web.example.com/en/' || o_orderkey AS url, n_name || ' 獨立套房' AS title,
        r_name AS city, n_name AS district, n_name || ' 獨立套房' AS address,
        CASE WHEN floor(o_totalprice / 20) >= 1000 THEN CAST(floor(o_totalprice / 20) AS INT) END AS rent,
        CASE WHEN floor(o_totalprice / 20) >= 1000 THEN CAST(floor(o_totalprice / 20) AS INT) END AS total_monthly_cost,
        CAST(o_custkey % 30 + 1 AS DOUBLE) AS area_ping, '獨立套房' AS room_type, TRUE AS has_rent_subsidy, 0 AS update_age_days,
        NULL AS gender_restriction, 'https://web.example.com/i.jpg' AS image FROM {ORDERS}
    UNION ALL SELECT 'case' || o_orderkey, 'https://web.example.com/en/' || (o_orderkey + 10000000), 'B ' || n_name, r_name, n_name,
        n_name, CAST(o_custkey + 5000 AS INT), CAST(o_custkey + 6000 AS INT), 7.5, '分租套房', NULL, NULL, '限女生', NULL FROM {ORDERS}""")
def page_extract_embedded(spark, sf):
    rows = customers_orders(spark, sf)
    pages = rows.select(
        F.col("o_orderkey").alias("page_id"),
        F.lit("web").alias("source"),
        F.lit("https://web.example.com/list?page=1").alias("url"),
        F.expr(ITEMS).alias("html"),
    )
    records, _ = extract_records(pages, DETAIL, gazetteer(spark, sf))
    return records.select(
        "listing_id", "url", "title", "city", "district", "address", "rent", "total_monthly_cost", "area_ping",
        "room_type", "has_rent_subsidy", "update_age_days",
        F.get_json_object("raw", "$.gender_restriction").alias("gender_restriction"),
        F.try_element_at("image_urls", F.lit(1)).alias("image"),
    )


AUDITED = """concat('<script>window.__INITIAL_STATE__ = {"list":[{"houseId":"case', CAST(o_orderkey AS STRING), '","detailUrl":"/en/',
    CAST(o_orderkey AS STRING), '?utm_source=z","title":"B ', n_name, '","rentPrice":"', CAST(o_custkey + 5000 AS STRING),
    ' 元","manageFee":"1,000","area":"7.5坪","kind_name":"', CAST(o_custkey % 3 + 1 AS STRING), '房1廳1衛","gender":"限女生","remark":"',
    CAST(o_custkey % 8 + 1 AS STRING), '/9F 租金 ', CAST(o_custkey % 1000 + 7000 AS STRING), ' 元/月 ', CAST(o_custkey % 6 + 2 AS STRING),
    '天前更新 刊登日期：2024-01-0', CAST(o_custkey % 9 + 1 AS STRING), '。","extra":{"deep":[', CAST(o_custkey AS STRING), ']}}]};</script>')"""
AUDIT = ("parser", "page_url", "canonical_url", "source_listing_id", "rent_monthly", "management_fee", "layout", "total_floor",
    "updated_at_text", "listed_at_text", "update_age_days", "gender_restriction")


@query(f"""
    SELECT CAST(o_orderkey AS BIGINT) AS page_id, 'embedded_state' AS parser, 'https://web.example.com/list?page=1' AS page_url,
        'https://web.example.com/en/' || o_orderkey AS canonical_url, 'case' || o_orderkey AS source_listing_id,
        CAST(o_custkey % 1000 + 7000 AS VARCHAR) AS rent_monthly, '1000' AS management_fee, (o_custkey % 3 + 1) || '房1廳1衛' AS layout,
        '9' AS total_floor, (o_custkey % 6 + 2) || '天前更新' AS updated_at_text, '刊登日期：2024-01-0' || (o_custkey % 9 + 1) AS listed_at_text,
        CAST(o_custkey % 6 + 2 AS VARCHAR) AS update_age_days, '限女生' AS gender_restriction,
        CAST(o_custkey AS VARCHAR) AS deep, (o_custkey + 5000) || ' 元' AS price FROM {ORDERS}""")
def audit_fields(spark, sf):
    """Where a record came from and what its text says, beside the payload it was read from."""
    pages = customers_orders(spark, sf).select(
        F.col("o_orderkey").alias("page_id"), F.lit("web").alias("source"), F.lit("https://web.example.com/list?page=1").alias("url"),
        F.expr(AUDITED).alias("html"),
    )
    records, _ = extract_records(pages, DETAIL, gazetteer(spark, sf))
    told = [F.get_json_object("raw", f"$.{n}").alias(n) for n in AUDIT]
    payload = {"deep": "$.raw_payload.extra.deep[0]", "price": "$.raw_payload.rentPrice"}
    return records.select(F.col("page_id").cast("bigint").alias("page_id"), *told, *[F.get_json_object("raw", p).alias(n) for n, p in payload.items()])


PORTAL_PAGE = """concat('<body><a href="https://rent.591.com.tw/', CAST(p_partkey + 100000 AS STRING), '"><img src="//i.example/',
    CAST(p_partkey AS STRING), '.jpg">', p_name, ' 分租套房 ', CAST(p_size AS STRING), '坪 2F/4F NATION_',
    CAST(p_partkey % 25 AS STRING), '-路1號 ', CAST(p_size * 1000 AS STRING), ' 元/月 3天前更新</a></body>')"""


@query("""
    SELECT CAST(p_partkey + 100000 AS VARCHAR) AS listing_id, r_name AS city, n_name AS district, n_name || '-路1號' AS address,
        CASE WHEN p_size * 1000 >= 3000 THEN CAST(p_size * 1000 AS INT) END AS rent, CAST(p_size AS DOUBLE) AS area_ping,
        '分租套房' AS room_type, '2F/4F' AS floor, 3 AS update_age_days, 'https://i.example/' || p_partkey || '.jpg' AS image
    FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON n_regionkey = r_regionkey""")
def page_extract_portal(spark, sf):
    pages = dealt(load(spark, sf, "part")).select(
        F.col("p_partkey").alias("page_id"),
        F.lit("591").alias("source"),
        F.expr("concat('https://rent.591.com.tw/list?kind=3&region=', CAST(p_partkey % 5 AS STRING))").alias("url"),
        F.expr(PORTAL_PAGE).alias("html"),
    )
    records, _ = extract_records(pages, PORTAL, gazetteer(spark, sf))
    return records.select(
        "listing_id", "city", "district", "address", "rent", "area_ping", "room_type", "floor", "update_age_days",
        F.try_element_at("image_urls", F.lit(1)).alias("image"),
    )


POST = """concat('<html><head><title>T - 批踢踢實業坊</title></head><div id="main-content"><div class="article-metaline">',
    '<span class="article-meta-tag">標題</span><span class="article-meta-value">[套房/桃園/', CASE s_suppkey % 3 WHEN 0 THEN '中壢' WHEN 1 THEN '南崁'
    ELSE '青埔' END, '] ', s_name, '</span></div>', CASE s_suppkey % 5 WHEN 0 THEN '地址：桃園縣龜山鄉路' WHEN 1 THEN '地點: 台北市路' ELSE '近車站' END,
    chr(10), '租金：', CAST(s_suppkey * 100 + 3000 AS STRING), ' 元 押金 99999元 管理費 500', chr(10), '約 ', CAST(s_suppkey % 20 AS STRING), 'p 獨套 可報稅',
    chr(10), CASE WHEN s_suppkey % 7 = 0 THEN '求租' ELSE '' END, chr(10), '--', chr(10), '簽名 1元/月<a href="//i.imgur.com/', CAST(s_suppkey AS STRING),
    '">x</a><div class="push">推 3000元</div></div>')"""


@query("""
    WITH s AS (SELECT s_suppkey, s_name, CASE s_suppkey % 5 WHEN 0 THEN '龜山區' WHEN 1 THEN NULL ELSE
        CASE s_suppkey % 3 WHEN 0 THEN '中壢區' WHEN 1 THEN '蘆竹區' END END AS district FROM supplier WHERE s_suppkey % 7 <> 0)
    SELECT 'M.' || s_suppkey AS listing_id, '桃園市' AS city, district, CASE WHEN s_suppkey % 5 = 0 THEN '桃園縣龜山鄉路' END AS address,
        CASE WHEN s_suppkey * 100 + 3000 <= 80000 THEN CAST(s_suppkey * 100 + 3000 AS INT) END AS rent,
        CASE WHEN s_suppkey * 100 + 3000 <= 80000 THEN CAST(s_suppkey * 100 + 3500 AS INT) END AS total_monthly_cost,
        CASE WHEN s_suppkey % 20 >= 1 THEN CAST(s_suppkey % 20 AS DOUBLE) END AS area_ping, '獨立套房' AS room_type, '報稅' AS tags,
        'https://i.imgur.com/' || s_suppkey AS image FROM s WHERE district IS NOT NULL""")
def forum_extract(spark, sf):
    board = Gazetteer(
        tuple(
            (FORUM_CITY, 6, d, i)
            for i, d in enumerate(("桃園區", "中壢區", "龜山區", "蘆竹區", "楊梅區"))
        )
        + (("台北市", 1, "大安區", 5),)
    )
    pages = dealt(load(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("page_id"),
        F.expr("concat('https://www.ptt.cc/bbs/Rent_tao/M.', CAST(s_suppkey AS STRING), '.html')").alias("url"),
        F.expr(POST).alias("html"),
    )
    return forum.forum_records(pages, board).select(
        "listing_id", "city", "district", "address", "rent", "total_monthly_cost", "area_ping", "room_type",
        F.array_join("tags", ";").alias("tags"), F.try_element_at("image_urls", F.lit(1)).alias("image"),
    )


FORUM_CITY = "桃園市"
INDEX = """concat('<div class="r-ent"><div class="title"><a href="/bbs/Rent_tao/M.', CAST(s_suppkey AS STRING), '.html">',
    CASE s_suppkey % 4 WHEN 0 THEN '[公告] 桃園市出租' WHEN 1 THEN '[無/桃園/南崁] 房' WHEN 2 THEN '桃園市套房' ELSE '問題' END,
    '</a></div></div><a class="btn wide" href="/bbs/Rent_tao/index', CAST(s_suppkey AS STRING), '.html">‹ 上頁</a>')"""


@query("""
    SELECT s_suppkey AS page_id, 'previous' AS kind, 'https://www.ptt.cc/bbs/Rent_tao/index' || s_suppkey || '.html' AS url FROM supplier
    UNION ALL SELECT s_suppkey, 'entry', 'https://www.ptt.cc/bbs/Rent_tao/M.' || s_suppkey || '.html' FROM supplier
        WHERE s_suppkey % 4 IN (1, 2)""")
def forum_index(spark, sf):
    pages = dealt(load(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("page_id"),
        F.lit("https://www.ptt.cc/bbs/Rent_tao/index.html").alias("url"),
        F.expr(INDEX).alias("html"),
    )
    return forum.index_links(pages).select("page_id", "kind", "url")


@query("""
    WITH p AS (SELECT page_id, url, page_id % 3 AS m, regexp_extract(url, 'example\\.(?:com|net|org)/[a-z]{2}/(\\d+)', 1) AS id FROM pages),
    n AS (SELECT m, id, row_number() OVER (PARTITION BY m, id ORDER BY page_id) AS rn FROM p WHERE page_id % 10 <> 4)
    SELECT 'site' || m AS source, 'record' AS kind, count(*) AS n FROM n WHERE rn = 1 GROUP BY m
    UNION ALL SELECT 'site' || m, 'LOGIN_REQUIRED', count(*) FROM p WHERE page_id % 10 = 4 GROUP BY m""")
def extract_all_sources(spark, sf):
    specs = [SourceSpec(name=f"site{i}", ordinal=i, detail_url_patterns=DETAIL.detail_url_patterns) for i in range(3)]
    pages = _pages(spark, sf).withColumns(
        {
            "source": F.concat(F.lit("site"), (F.col("page_id") % 3).cast("string")),
            "status": F.when(F.col("page_id") % 10 == 4, 401).otherwise(200),
        }
    )
    records, refused = extract_all(pages, gazetteer(spark, sf), specs)
    kinds = records.select("source", F.lit("record").alias("kind")).unionByName(
        refused.select("source", F.col("code").alias("kind"))
    )
    return kinds.groupBy("source", "kind").agg(F.count("*").alias("n"))


@query(page_walk_sql("""SELECT page_id // 10 AS search, page_id % 10 AS page, count(*) AS n_parsed,
        list(DISTINCT regexp_extract(url, 'example\\.(?:com|net|org)/[a-z]{2}/(\\d+)', 1)) AS keys FROM pages GROUP BY ALL""", 1))
def collect_pages(spark, sf):
    """Every ten pages as one search: which of them a run would have fetched."""
    pages = dealt(load(spark, sf, "pages")).select(
        "page_id",
        F.floor(F.col("page_id") / 10).cast("int").alias("search"),
        (F.col("page_id") % 10).cast("int").alias("page"),
        "url",
        "html",
    )
    _, _, kept = collect_source(pages, DETAIL, gazetteer(spark, sf))
    return kept


# Five cards a list page, none with a price; a detail page of each record tells it.
PORTAL_CARD = """concat('<p><a href="https://rent.591.com.tw/', CAST(100000 + k AS STRING), '">獨立套房 NATION_', CAST(k % 25 AS STRING),
    '-路 ', repeat('好', 240), '</a></p>')"""
PORTAL_DETAIL = """concat('<script type="application/ld+json">{"name": "獨立套房", "description": "8坪", "offers": {"price": ',
    CAST(5000 + k % 9000 AS STRING), '}}</script>')"""


@query("""
    WITH c AS (SELECT g * 5 + i AS k, i FROM (SELECT DISTINCT p_partkey // 5 AS g FROM part), (SELECT unnest(range(5)) AS i))
    SELECT CAST(100000 + k AS VARCHAR) AS listing_id, n_name AS district, CASE WHEN i < 3 THEN CAST(5000 + k % 9000 AS INT) END AS rent,
        CASE WHEN i < 3 THEN CAST(8 AS DOUBLE) END AS area_ping FROM c JOIN nation ON n_nationkey = k % 25""")
def portal_details(spark, sf):
    """What the list pages don't say is filled from detail pages, of three records a page."""
    # Dealt before they are made distinct: a dealing by the same key afterwards is no shuffle of its own, and few rows go to one task.
    groups = dealt(load(spark, sf, "part").select(F.expr("CAST(floor(p_partkey / 5) AS INT) AS g")), "g").distinct()
    cards = groups.select("g", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("g", "i", F.expr("g * 5 + i AS k"))
    lists = cards.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", F.expr(PORTAL_CARD).alias("card")))).alias("cards"))  # five a page
    pages = lists.select(
        F.col("g").alias("page_id"), F.col("g").alias("search"), F.lit(0).alias("page"),
        F.expr("concat('https://rent.591.com.tw/list?kind=2&s=', CAST(g AS STRING))").alias("url"),
        F.array_join(F.col("cards.card"), "").alias("html"),
    )
    details = cards.select(
        F.col("k").alias("page_id"),
        F.expr("concat('https://rent.591.com.tw/', CAST(100000 + k AS STRING))").alias("url"),
        F.expr(PORTAL_DETAIL).alias("html"),
    )
    records, _, _ = collect_source(pages, PORTAL, gazetteer(spark, sf), details)
    return records.select("listing_id", "district", "rent", "area_ping")


BROKEN = """CASE s_suppkey % 5 WHEN 0 THEN concat('<a href="/en/', CAST(s_suppkey AS STRING), '">NATION_1 8坪 9,000 元/月</a>')
    WHEN 1 THEN concat('<script>window.__INITIAL_STATE__ = ', repeat('[', 50000 + s_suppkey), '</script>')
    WHEN 2 THEN concat('<script type="application/ld+json">', repeat('{"url":', 50000), '1', repeat('}', 50000), '</script>')
    WHEN 3 THEN concat('<script>window.__INITIAL_STATE__ = ', repeat('{"title":"\\\\ud800","x":[', 3000), '</script>')
    ELSE repeat('<div><b>', 20000) END"""


@query("""
    SELECT s_suppkey AS page_id, CASE WHEN s_suppkey % 5 = 0 THEN 'record' ELSE 'EMPTY_RESULT' END AS outcome FROM supplier""")
def broken_pages(spark, sf):
    """Scripts nested deeper than any reader that recurses could follow: each page has its own outcome."""
    pages = dealt(load(spark, sf, "supplier")).select(
        F.col("s_suppkey").alias("page_id"), F.lit("web").alias("source"),
        F.expr("concat('https://web.example.com/list?p=', CAST(s_suppkey AS STRING))").alias("url"), F.expr(BROKEN).alias("html"),
    )
    records, refused = extract_all(pages, gazetteer(spark, sf), [DETAIL])
    return refused.select(F.regexp_extract("url", "p=([0-9]+)", 1).cast("bigint").alias("page_id"), F.col("code").alias("outcome")).unionByName(
        records.select(F.col("listing_id").cast("bigint").alias("page_id"), F.lit("record").alias("outcome"))
    )


# Two sources of list pages, dealt from parts: five cards a page, six pages a search. Of seven pages the fourth and fifth show
# the first's cards again; a card in eleven is too old; prices stand on detail pages; one page of the second source is refused.
SITES = {"591": (PORTAL, "https://rent.591.com.tw/", 100_000), "houseprice_5168": (HOUSEPRICE, "https://rent.houseprice.tw/house/H", 100_000)}
SHOWN = "CASE WHEN q % 7 IN (3, 4) THEN q - q % 7 ELSE q END"
REFUSED_AT = 150
SITE_CARD = """concat('<p><a href="', link, '">獨立套房 NATION_', CAST(k % 25 AS STRING), '-路 ', CASE WHEN k % 11 = 5 THEN '30天前更新 ' ELSE '' END,
    repeat('好', 240), '</a></p>')"""
SITE_DETAIL = """CASE WHEN site = '591' THEN concat('<script type="application/ld+json">{"name": "獨立套房", "description": "8坪", "offers": {"price": ',
        CAST(5000 + k % 9000 AS STRING), '}}</script>')
    ELSE concat('<h1>x</h1><p>獨立套房 NATION_', CAST(k % 25 AS STRING), '-路 8坪 ', CAST(5000 + k % 9000 AS STRING), ' 元/月</p>') END"""
SITE_PAGES = f"""SELECT DISTINCT CASE WHEN (p_partkey // 5) % 2 = 0 THEN '591' ELSE 'houseprice_5168' END AS site, (p_partkey // 5) // 2 AS q FROM part"""


@query(f"""
    WITH p AS ({SITE_PAGES}),
    c AS (SELECT site, q, q // 6 AS search, q % 6 AS page, i, {SHOWN} * 5 + i AS k, site <> '591' AND q = {REFUSED_AT} AS refused FROM p, (SELECT unnest(range(5)) AS i)),
    w AS ({page_walk_sql('''SELECT (CASE site WHEN '591' THEN 0 ELSE 100000000 END) + search AS search, page, count(*) AS n_parsed,
        coalesce(list(site || k) FILTER (k % 11 <> 5), []) AS keys FROM c WHERE NOT refused GROUP BY ALL''',
        'CASE WHEN search < 100000000 THEN 2 ELSE 1 END', 'kept AND NOT over AS went_on')}),
    k AS (SELECT CASE WHEN search < 100000000 THEN '591' ELSE 'houseprice_5168' END AS site, search % 100000000 AS search, page, kept, went_on FROM w),
    e AS (SELECT site, min(search * 6 + page) AS stop FROM (SELECT DISTINCT site, search, page FROM c WHERE refused) r WHERE page = 0 OR EXISTS
        (SELECT 1 FROM k WHERE k.site = r.site AND k.search = r.search AND k.page = r.page - 1 AND went_on) GROUP BY site),
    s AS (SELECT c.* FROM c JOIN k ON k.site = c.site AND k.search = c.search AND k.page = c.page AND kept LEFT JOIN e ON e.site = c.site
        WHERE k % 11 <> 5 AND NOT refused AND (stop IS NULL OR c.search * 6 + c.page < stop)
        QUALIFY row_number() OVER (PARTITION BY c.site, k ORDER BY c.search, c.page) = 1)
    SELECT site AS source, 'record' AS kind, CASE site WHEN '591' THEN '' ELSE 'H' END || (100000 + k) AS listing_id, CAST(search AS INT) AS search,
        CAST(page AS INT) AS page, n_name AS district, CASE WHEN i < 3 THEN CAST(5000 + k % 9000 AS INT) END AS rent, CASE WHEN i < 3 THEN CAST(8 AS DOUBLE) END AS area_ping
    FROM s JOIN nation ON n_nationkey = k % 25
    UNION ALL SELECT site, 'LOGIN_REQUIRED', NULL, CAST(stop // 6 AS INT), CAST(stop % 6 AS INT), NULL, NULL, NULL FROM e""")
def collect_sources(spark, sf):
    """All sources' searches in one run: details, recency, each source's page rule, a refusal that ends one of them."""
    group = F.floor(F.col("p_partkey") / 5)
    site = F.when(group % 2 == 0, "591").otherwise("houseprice_5168")
    pages = dealt(load(spark, sf, "part").select(site.alias("site"), F.floor(group / 2).cast("int").alias("q")), "site", "q").distinct()
    address = F.coalesce(*[F.when(F.col("site") == n, F.concat(F.lit(url), (F.lit(at) + F.col("k")).cast("string"))) for n, (_, url, at) in SITES.items()])
    cards = pages.select("site", "q", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"), F.expr(SHOWN).alias("_shown"))
    cards = cards.withColumn("k", F.expr("_shown * 5 + i")).withColumn("link", address)
    lists = cards.groupBy("site", "q").agg(F.array_sort(F.collect_list(F.struct("i", F.expr(SITE_CARD).alias("card")))).alias("cards"))  # five a page
    searches = {n: url.split("/house")[0].rstrip("/") + "/list?kind=2&q=" for n, (_, url, _) in SITES.items()}
    html = F.when((F.col("site") != "591") & (F.col("q") == REFUSED_AT), "<p>請先登入</p>").otherwise(F.array_join("cards.card", ""))
    listed = lists.select(
        F.col("q").alias("page_id"), F.col("site").alias("source"), F.floor(F.col("q") / 6).cast("int").alias("search"), (F.col("q") % 6).alias("page"),
        F.coalesce(*[F.when(F.col("site") == n, F.concat(F.lit(u), F.col("q").cast("string"))) for n, u in searches.items()]).alias("url"), html.alias("html"),
    )
    details = cards.filter("_shown = q").select(F.col("k").alias("page_id"), F.col("site").alias("source"), F.col("link").alias("url"), F.expr(SITE_DETAIL).alias("html"))
    records, refused, _ = collect_all(listed, gazetteer(spark, sf), [spec for spec, _, _ in SITES.values()], details)
    met = refused.join(listed.select("source", "url", "search", "page").hint("merge"), ["source", "url"]).select("source", F.col("code").alias("kind"), "search", "page")
    told = records.select("source", F.lit("record").alias("kind"), "listing_id", "search", "page", "district", "rent", "area_ping")
    return told.unionByName(met, allowMissingColumns=True)
