"""Scalar columns: URLs, texts, numbers, JSON."""

from pyspark.sql import functions as F

from listingflow.functions import numbers as N
from listingflow.functions import text as X
from listingflow.functions import urls as U
from listingflow.functions import vocabulary as V
from listingflow.sources import pages as P
from listingflow.sources.walk import names_women_only, walk_objects

from . import words
from .tables import L_SQL, dealt, like_any, listings, load, query, sql_list

URL_PARTS = """
    regexp_extract(url, '^([^:]+)://', 1) AS sch, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS hst,
    regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS pth, regexp_extract(url, '\\?([^#]*)', 1) AS qry
"""


@query(f"""
    WITH p AS (SELECT page_id, {URL_PARTS} FROM pages),
    k AS (SELECT *, array_to_string(list_filter(string_split(qry, '&'), lambda x: x <> '' AND NOT
        (lower(split_part(x, '=', 1)) IN {sql_list(words.TRACKING_KEYS)}
         OR lower(x) LIKE 'utm\\_%' ESCAPE '\\')), '&') AS kept FROM p)
    SELECT page_id, sch || '://' || hst || CASE WHEN rtrim(pth, '/') = '' THEN pth ELSE rtrim(pth, '/') END
        || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS url FROM k""")
def url_canonicalize(spark, sf):
    return dealt(load(spark, sf, "pages")).select("page_id", U.canonical_url(F.col("url")).alias("url"))


@query(f"""
    WITH p AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS hrefs, {URL_PARTS} FROM pages),
    d AS (SELECT *, regexp_replace(pth, '[^/]*$', '') AS dir FROM p)
    SELECT page_id, CAST(pos - 1 AS INT) AS pos, sch || '://' || hst || hrefs[pos] AS link,
        sch || '://' || hst || regexp_replace(dir, '[^/]+/$', '') || 'x/' || page_id AS up_link
    FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS pos FROM d)""")
def url_resolve(spark, sf):
    """Every link of every page."""
    up = F.concat(F.lit(".././x//"), F.col("page_id").cast("string"))
    links = dealt(load(spark, sf, "pages")).select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "href")
    )
    return links.select(
        "page_id",
        "pos",
        U.resolve_url(F.col("url"), F.col("href")).alias("link"),
        U.resolve_url(F.col("url"), up).alias("up_link"),
    )


@query(f"""
    WITH p AS (SELECT page_id, {URL_PARTS} FROM pages),
    s AS (SELECT *, length(hst) % 4 AS m FROM p)
    SELECT page_id, CASE WHEN m IN (0, 3) THEN 'ROBOTS_UNAVAILABLE' WHEN m = 1 THEN NULL
        WHEN starts_with(pth, '/en/7') THEN NULL WHEN starts_with(pth, '/en') THEN 'ROBOTS_DISALLOWED'
        END AS policy_code FROM s""")
def url_policy_filter(spark, sf):
    pages = dealt(load(spark, sf, "pages")).select("page_id", "url")
    kind = F.length(U.host(F.col("url"))) % 4
    rule = "array(struct('/en/7' AS prefix, true AS allow), struct('/en' AS prefix, false AS allow))"
    policies = (
        pages.select(
            F.concat(U.scheme(F.col("url")), F.lit("://"), U.host(F.col("url"))).alias("origin"),
            kind.alias("kind"),
        )
        .distinct()
        .filter("kind < 3")
        .select(
            "origin",
            F.expr("CASE kind WHEN 0 THEN 'unavailable' WHEN 1 THEN 'absent' ELSE 'rules' END").alias("state"),
            F.expr(f"CASE kind WHEN 2 THEN {rule} END").alias("rules"),
        )
    )
    return P.url_policy(pages, policies).select("page_id", "policy_code")


@query(f"""
    WITH p AS (SELECT page_id, url, {URL_PARTS} FROM pages)
    SELECT page_id, coalesce(nullif(regexp_extract(url, 'example\\.com/(?:en|fr)/(\\d+)', 1), ''),
        nullif(regexp_extract(qry, '(?:^|&)id=([^&]+)', 1), ''),
        CASE WHEN length(regexp_extract(pth, '([^/]+)/*$', 1)) >= 4
            THEN regexp_replace(regexp_extract(pth, '([^/]+)/*$', 1), '\\W+', '_', 'g') END) AS record_id,
        regexp_matches(url, 'example\\.com/(?:en|fr)/(\\d+)') AS is_detail,
        'web:' || substr(sha256(trim(url)), 1, 24) AS hash_id FROM p""")
def record_ids(spark, sf):
    patterns = (r"example\.com/(?:en|fr)/(\d+)",)
    url = F.col("url")
    return dealt(load(spark, sf, "pages")).select(
        "page_id",
        U.id_from_url(url, patterns).alias("record_id"),
        U.is_detail_url(url, patterns).alias("is_detail"),
        U.canonical_id(F.lit("web"), url).alias("hash_id"),
    )


WALLS = "CASE page_id % 9 WHEN 0 THEN '請先登入' WHEN 1 THEN 'Too Many <b>Requests</b>' WHEN 2 THEN 'reCAPTCHA 請先登入'" \
        " WHEN 3 THEN 'Access Denied' WHEN 4 THEN '<script>captcha()</script>' ELSE '' END"
STATUS = "CASE page_id % 25 WHEN 5 THEN 429 WHEN 6 THEN 403 WHEN 7 THEN 401 ELSE 200 END"
WALL_SQL = f"""
    WITH p AS (SELECT page_id, url, {STATUS} AS status, concat(html, {WALLS}) AS html FROM pages),
    t AS (SELECT page_id, url, status, lower(regexp_replace(regexp_replace(html,
        '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<template\\b.*?</template\\s*>|<!--.*?-->',
        '<i>', 'g'), '\\s*(?:<[^>]*>\\s*)+', ' ', 'g')) AS txt FROM p),
    c AS (SELECT page_id, url, CASE status WHEN 429 THEN 'HTTP_RATE_LIMITED' WHEN 401 THEN 'LOGIN_REQUIRED'
        WHEN 403 THEN 'HTTP_FORBIDDEN' ELSE
        CASE WHEN {like_any('txt', words.CAPTCHA_WORDS)} THEN 'CAPTCHA_DETECTED'
        WHEN {like_any('txt', words.LOGIN_WORDS)} THEN 'LOGIN_REQUIRED'
        WHEN {like_any('txt', words.RATE_WORDS)} THEN 'HTTP_RATE_LIMITED'
        WHEN {like_any('txt', words.FORBIDDEN_WORDS)} THEN 'HTTP_FORBIDDEN' END END AS code FROM t)
"""


def _walled(spark, sf):
    pages = dealt(load(spark, sf, "pages")).select(
        "page_id", F.lit("web").alias("source"), "url", F.expr(STATUS).alias("status"),
        F.expr(f"concat(html, {WALLS})").alias("html"),
    )
    return P.page_errors(pages)


@query(WALL_SQL + "SELECT page_id, code FROM c")
def access_wall_split(spark, sf):
    return _walled(spark, sf).select("page_id", "code")


@query(WALL_SQL + "SELECT 'web' AS source, code, count(*) AS n FROM c WHERE code IS NOT NULL GROUP BY code")
def quarantine_counts(spark, sf):
    return P.quarantine_counts(_walled(spark, sf).filter("code IS NOT NULL"))


@query("""
    SELECT user_id AS page_id, CASE WHEN bool_or(event_type = 'error') THEN 429
        WHEN bool_or(event_type = 'click') THEN 403 WHEN bool_or(event_type = 'view') THEN 401 END AS status
    FROM events GROUP BY user_id, CAST(ts AS DATE) """.replace(
        "user_id AS page_id", "concat_ws('/', CAST(user_id AS VARCHAR), CAST(CAST(ts AS DATE) AS VARCHAR)) AS page_id"))
def worst_status(spark, sf):
    status = "CASE event_type WHEN 'error' THEN 429 WHEN 'click' THEN 403 WHEN 'view' THEN 401 ELSE 200 END"
    responses = load(spark, sf, "events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("page_id"),
        F.expr(status).alias("status"),
    )
    return P.worst_status(responses)


POSITIVE, NEGATIVE = ("hation", "erung", "ciónue"), ("hable", "enkeit", "étion")


@query(f"""
    SELECT doc_id, CASE WHEN {like_any('text', NEGATIVE)} THEN FALSE
        WHEN {like_any('text', POSITIVE)} THEN TRUE END AS flag FROM documents""")
def keyword_tristate(spark, sf):
    return dealt(load(spark, sf, "documents")).select(
        "doc_id", X.tri_state(F.col("text"), POSITIVE, NEGATIVE).alias("flag")
    )


@query("""
    WITH t AS (SELECT doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS c,
        list_filter(list_transform(string_split_regex(text, '[\\n。]'),
            lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))),
            lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[\\d,./坪元月樓F\\s|]+')) AS lines FROM documents)
    SELECT doc_id, substr(coalesce(lines[1], c), 1, 120) AS title, substr(c, 1, 160) AS summary,
        length(regexp_replace(text, '\\s', '', 'g')) AS n_visible FROM t""")
def text_summary(spark, sf):
    text = F.col("text")
    return dealt(load(spark, sf, "documents")).select(
        "doc_id",
        X.short_title(text).alias("title"),
        X.short_summary(text).alias("summary"),
        F.length(X.squeeze(text)).cast("bigint").alias("n_visible"),
    )


PHRASE = """concat('月租 ', CASE WHEN o_orderkey % 3 = 0 THEN '1,' ELSE '' END, CAST(CAST(floor(o_totalprice / 30) AS INT) AS STRING),
    ' 元/月 押金 ', CAST(CAST(floor(o_totalprice / 15) AS INT) AS STRING), '元 管理費 ', CAST(o_orderkey % 3000 AS STRING),
    ' 元 約 ', CAST(o_custkey % 400 AS STRING), '.5 坪 ', CAST(o_orderkey % 5 AS STRING), ' 房 1 廳 1衛 ',
    CAST(o_orderkey % 9 AS STRING), ' / 12 樓 ', CASE o_orderkey % 6 WHEN 0 THEN '新上架' WHEN 1 THEN '5 小時前更新'
    WHEN 2 THEN '昨日更新' WHEN 3 THEN '' ELSE concat(CAST(o_orderkey % 40 AS STRING), ' 天內更新') END,
    CASE o_orderkey % 4 WHEN 0 THEN ' 獨套' WHEN 1 THEN ' 套房' WHEN 2 THEN ' 整層' ELSE '' END)"""


def _money_sql(low: int, high: int, gap: int, how: str) -> str:
    return f"""{how}(list_filter(list_transform(list_concat(
        regexp_extract_all(t, '(?:租金|月租|價格|房租|租)\\D{{0,{gap}}}(\\d[\\d,]{{3,6}})', 1),
        regexp_extract_all(t, '(\\d[\\d,]{{3,6}})\\s*(?:元/月|元|/月|每月)', 1)),
        lambda x: TRY_CAST(replace(x, ',', '') AS BIGINT)), lambda x: x BETWEEN {low} AND {high}))"""


@query(f"""
    WITH p AS (SELECT o_orderkey, {PHRASE} AS t FROM orders),
    n AS (SELECT *, {_money_sql(3000, 300000, 12, 'list_max')} AS rent, list_max(list_filter(list_transform(list_concat(
        regexp_extract_all(t, '(?:管理費|管費)\\D{{0,8}}(\\d[\\d,]{{1,5}})', 1),
        regexp_extract_all(t, '(\\d[\\d,]{{1,5}})\\s*(?:元)?\\s*(?:管理費|管費)', 1)),
        lambda x: TRY_CAST(replace(x, ',', '') AS BIGINT)), lambda x: x BETWEEN 0 AND 20000)) AS fee,
        TRY_CAST(regexp_extract(t, '(\\d+(?:\\.\\d+)?)\\s*坪', 1) AS DOUBLE) AS area FROM p)
    SELECT o_orderkey, CAST(rent AS INT) AS rent, CAST({_money_sql(3000, 80000, 8, 'list_min')} AS INT) AS forum_rent,
        CAST(fee AS INT) AS fee, CAST(coalesce(rent + fee, rent) AS INT) AS total,
        CASE WHEN area BETWEEN 1 AND 300 THEN area END AS area,
        regexp_replace(regexp_extract(t, '(\\d+\\s*房(?:\\s*\\d+\\s*廳)?(?:\\s*\\d+\\s*衛)?)', 1), '\\s', '', 'g') AS layout,
        regexp_replace(regexp_extract(t, '(\\d+\\s*/\\s*\\d+\\s*樓)', 1), '\\s', '', 'g') AS floor, '12' AS total_floor,
        CASE WHEN contains(t, '獨套') THEN '獨立套房' WHEN contains(t, '套房') THEN '套房'
            WHEN contains(t, '整層') THEN '整層住家' END AS room,
        CAST(CASE WHEN contains(t, '新上架') OR regexp_matches(t, '\\d+\\s*小時前更新') THEN 0
            WHEN regexp_matches(t, '\\d+\\s*天內更新') THEN CAST(regexp_extract(t, '(\\d+)\\s*天內更新', 1) AS INT)
            WHEN contains(t, '昨日更新') THEN 1 END AS INT) AS age,
        CAST(NULLIF(CASE WHEN TRY_CAST(replace(regexp_extract(t, '\\d[\\d,]*', 0), ',', '') AS BIGINT) BETWEEN 1000 AND 300000
            THEN TRY_CAST(replace(regexp_extract(t, '\\d[\\d,]*', 0), ',', '') AS INT) END, NULL) AS INT) AS first_amount
    FROM n""")
def number_from_text(spark, sf):
    t = F.col("t")
    rows = dealt(load(spark, sf, "orders")).select("o_orderkey", F.expr(PHRASE).alias("t"))
    rows = rows.withColumns({"rent": N.rent_in_text(t, 300_000), "fee": N.fee_in_text(t, 20_000), "fl": N.floor_text(t)})
    return rows.select(
        "o_orderkey", "rent",
        N.rent_in_text(t, 80_000, gap=8, pick="min").alias("forum_rent"),
        "fee",
        N.total_cost(F.col("rent"), F.col("fee")).alias("total"),
        N.area_in_text(t, 1, 300).alias("area"),
        N.layout(t).alias("layout"),
        F.col("fl").alias("floor"),
        N.total_floor(F.col("fl")).alias("total_floor"),
        N.room_type(t, N.ROOM_RULES).alias("room"),
        N.update_age_days(t).alias("age"),
        N.bounded_int(t, 1_000, 300_000).alias("first_amount"),
    )


POST = "concat('[套房/', p_brand, '] ', p_name, chr(10), '租金：', CAST(p_size * 1000 AS STRING), chr(10)," \
       " CASE WHEN p_partkey % 3 = 0 THEN concat('地點 ： ', p_type, ' ') ELSE concat('房屋地址: ', p_name) END, chr(10), '樓層:', CAST(p_size AS STRING))"


@query(f"""
    WITH p AS (SELECT p_partkey, {POST} AS t FROM part)
    SELECT p_partkey, trim(regexp_extract(t, '(?m)^(?:地址|地點|房屋地址)\\s*[:：]\\s*(.+)$', 1)) AS place,
        regexp_extract(t, '(?m)^樓層\\s*[:：]\\s*(.+)$', 1) AS floor FROM p""")
def labelled_fields(spark, sf):
    t = F.col("t")
    return load(spark, sf, "part").select("p_partkey", F.expr(POST).alias("t")).select(
        "p_partkey",
        X.labelled_field(t, V.FORUM_ADDRESS_LABELS).alias("place"),
        X.labelled_field(t, V.FORUM_FLOOR_LABELS).alias("floor"),
    )


@query("""
    SELECT event_id, CAST(greatest(1, CASE WHEN s % 60 = 30 AND (s // 60) % 2 = 0
        THEN s // 60 ELSE round(s / 60) END) AS INT) AS minutes,
        CASE WHEN event_type IN ('click', 'view') THEN TRUE WHEN event_type = 'error' THEN FALSE END AS flag,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE date_trunc('second', ts) END AS seen
    FROM (SELECT *, CAST(floor(value) AS BIGINT) AS s FROM events)""")
def parsed_fields(spark, sf):
    flag = F.expr("CASE event_type WHEN 'click' THEN ' Yes' WHEN 'view' THEN '1' WHEN 'error' THEN 'off' ELSE 'maybe' END")
    stamp = F.when(F.col("event_id") % 4 == 0, F.lit("not a time")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    )
    return load(spark, sf, "events").select(
        "event_id",
        N.duration_minutes(F.concat(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("s"))).alias("minutes"),
        N.to_bool(flag).alias("flag"),
        N.iso_timestamp(stamp).alias("seen"),
    )


@query(f"""
    WITH l AS ({L_SQL})
    SELECT listing_id, coalesce(format('{{:,}}', rent) || ' 元', '未知') AS rent_text,
        coalesce(format('{{:g}}', area_ping) || ' 坪', '未知') AS area_text,
        CASE has_rent_subsidy WHEN TRUE THEN '✅' WHEN FALSE THEN '❌' ELSE '未知' END AS mark,
        coalesce(strftime(first_seen_at, '%Y-%m-%d %H:%M'), '未知') AS seen,
        coalesce(nullif(concat(city, district, address), ''), '未知') AS place FROM l""")
def display_values(spark, sf):
    return listings(spark, sf).select(
        "listing_id",
        X.money(F.col("rent")).alias("rent_text"),
        X.number_with_unit(F.col("area_ping"), " 坪").alias("area_text"),
        X.flag_mark(F.col("has_rent_subsidy")).alias("mark"),
        X.time_text(F.col("first_seen_at")).alias("seen"),
        X.location_text(F.col("city"), F.col("district"), F.col("address")).alias("place"),
    )


HOOK = "concat(text, ' https://discord.com/api/webhooks/', CAST(doc_id AS STRING), '/Tok-en_', source, ' end s3cret')"


@query(f"""
    SELECT doc_id, sha256(replace(regexp_replace({HOOK},
        'https://discord\\.com/api/webhooks/[^\\s/]+/[^\\s]+', '<redacted Discord webhook>', 'g'),
        's3cret', '<redacted Discord webhook>')) AS digest FROM documents""")
def redact(spark, sf):
    return dealt(load(spark, sf, "documents")).select(
        "doc_id", F.sha2(X.redact(F.expr(HOOK), secret="s3cret"), 256).alias("digest")
    )


NESTED = """concat('{"id": ', CAST(event_id AS STRING), ', "props": ', props, ', "tags": [{"name": "',
    event_type, '"}, {"name": " "}], "note": "n"}')"""


@query("""
    SELECT event_id, 0 AS pos, CAST(event_id AS VARCHAR) AS id, NULL AS k, NULL AS name FROM events
    UNION ALL SELECT event_id, 1, NULL, json_extract_string(props, '$.k'), NULL FROM events
    UNION ALL SELECT event_id, 2, NULL, NULL, event_type FROM events
    UNION ALL SELECT event_id, 3, NULL, NULL, ' ' FROM events""")
def json_walk(spark, sf):
    rows = load(spark, sf, "events").select("event_id", F.expr(NESTED).alias("j"))
    obj = F.try_parse_json("object")
    return walk_objects(rows, "event_id", "j").select(
        "event_id",
        "pos",
        F.try_variant_get(obj, "$.id", "string").alias("id"),
        F.try_variant_get(obj, "$.k", "string").alias("k"),
        F.try_variant_get(obj, "$.name", "string").alias("name"),
    )


@query("""
    SELECT event_id, coalesce(nullif(trim(CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END), ''),
        json_extract_string(props, '$.k')) AS value FROM events""")
def first_key(spark, sf):
    text = F.expr("""concat('{"title": "', CASE WHEN event_id % 3 = 0 THEN ' ' ELSE event_type END, '", "name": ',
        get_json_object(props, '$.k'), '}')""")
    return load(spark, sf, "events").select(
        "event_id", X.first_key(F.try_parse_json(text), ("subject", "title", "name")).alias("value")
    )


# What a record's own words may say about dates, and amounts and lists as stored; the expected values stand beside.
SAID = """CASE event_id % 6 WHEN 0 THEN concat('套房 ', CAST(event_id % 50 AS STRING), ' 天前更新') WHEN 1 THEN '今日更新 刊登：2024/01/05'
    WHEN 2 THEN '更新時間：2024-01-07' WHEN 3 THEN '上架日期 2023年12月3日' ELSE '沒有日期' END"""
STORED = """CASE event_id % 5 WHEN 0 THEN concat('{"rent":', CAST(event_id % 9000 AS STRING), ',"total_monthly_cost":0}')
    WHEN 1 THEN concat('{"rent":1,"total_monthly_cost":', CAST(event_id % 9000 AS STRING), '.7}')
    WHEN 2 THEN '{"rent":true}' WHEN 3 THEN 'no json' ELSE '{"rent":"77"}' END"""
LISTED = """CASE event_id % 3 WHEN 0 THEN concat('["a","', event_type, '"]') WHEN 1 THEN event_type END"""


@query("""
    SELECT event_id,
        CASE event_id % 6 WHEN 0 THEN (event_id % 50) || ' 天前更新' WHEN 1 THEN '今日更新' WHEN 2 THEN '更新時間：2024-01-07' END AS updated,
        CASE event_id % 6 WHEN 1 THEN '刊登：2024/01/05' WHEN 3 THEN '上架日期 2023年12月3日' END AS listed,
        CASE WHEN floor(value * 1000) BETWEEN 3000 AND 80000 THEN CAST(floor(value * 1000) AS INT) END AS price,
        CAST(CASE event_id % 5 WHEN 0 THEN nullif(event_id % 9000, 0) WHEN 1 THEN CASE WHEN event_id % 9000 > 0 THEN event_id % 9000 ELSE 1 END
            WHEN 4 THEN 77 END AS INT) AS told,
        CASE event_id % 3 WHEN 0 THEN 'a|' || event_type WHEN 1 THEN event_type ELSE '' END AS items,
        CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n_items FROM events""")
def said_and_stored(spark, sf):
    price = F.concat(F.lit("約 "), F.format_number(F.floor(F.col("value") * 1000), 0), F.lit(" 元"))
    items = X.string_list(F.expr(LISTED))
    return load(spark, sf, "events").select(
        "event_id",
        X.updated_text(F.expr(SAID)).alias("updated"),
        X.listed_text(F.expr(SAID)).alias("listed"),
        N.price_like(price).alias("price"),
        N.snapshot_cost(F.try_parse_json(F.expr(STORED))).alias("told"),
        F.array_join(items, "|").alias("items"),
        F.size(items).alias("n_items"),
    )


@query(f"""
    WITH l AS ({L_SQL}) SELECT listing_id, (CAST(listing_id AS BIGINT) % 12) IN (0, 2) AS female_only FROM l""")
def gender_key_predicate(spark, sf):
    return listings(spark, sf).select(
        "listing_id", names_women_only(F.col("raw")).alias("female_only")
    )


ISO = """concat('2024-0', CAST(o_orderkey % 9 + 1 AS STRING), '-1', CAST(o_orderkey % 10 AS STRING), CASE o_orderkey % 4 WHEN 0 THEN ''
    WHEN 1 THEN 'T07:30:00' WHEN 2 THEN ' 07:30:00+08:00' ELSE 'T07:30:00Z' END)"""


@query(f"""
    SELECT o_orderkey, epoch_us(CAST(substr(t, 1, 10) AS TIMESTAMP)) + CAST(1000000 AS BIGINT) * CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 2 THEN 27000 - 28800
        ELSE 27000 END AS micros FROM (SELECT o_orderkey, {ISO} AS t FROM orders)""")
def naive_times(spark, sf):
    """Text without a zone is UTC whatever the session's zone is."""
    orders = load(spark, sf, "orders")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Taipei")
    try:
        return orders.select("o_orderkey", F.unix_micros(N.iso_timestamp(F.expr(ISO))).alias("micros"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
