"""Ordering, cutting, counting and rendering what is announced."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from listingflow.operators import outbox as O
from listingflow.operators.score import rank_score
from listingflow.operators.state import pending
from listingflow.schema import conform
from listingflow.sources.extract import preview

from .assess import COST, RANK_SQL, T, assessed
from .tables import L_SQL, listings, query

LABEL = "coalesce(nullif(district, ''), nullif(city, ''), '未知區')"
# One event per listing: new, price drop, or another update.
PRIORITY = "CAST(listing_id AS BIGINT) % 3"
REASON = f"""CASE {PRIORITY} WHEN 0 THEN '新房源' WHEN 1 THEN '價格下降 9 -> 8' ELSE '重新上架' END"""
W = f"""WITH l AS ({L_SQL}),
    w AS (SELECT *, CAST({PRIORITY} AS INT) AS priority, {REASON} AS reason, {RANK_SQL} AS rank, {LABEL} AS label FROM l
        WHERE status = 'active')"""
ORDER = "rank DESC, first_seen_at ASC NULLS FIRST, source, listing_id"


def _waiting(spark, sf):
    rows = conform(listings(spark, sf)).filter("status = 'active'")
    return rows.withColumn("priority", F.expr(PRIORITY).cast("int")).withColumn("reasons", F.array(F.expr(REASON)))


GROUPED = """, n AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY {order}) AS rn FROM w),
    h AS (SELECT *, min(rn) OVER (PARTITION BY priority, label) AS head FROM n)"""


@query(W + GROUPED.format(order=ORDER) + """ SELECT CAST(row_number() OVER (ORDER BY priority, head, rn) AS INT) AS position,
    source, listing_id, priority, round(rank, 4) AS rank, label FROM h ORDER BY priority, head, rn LIMIT 200""")
def watch_topn(spark, sf):
    top = O.watch_top_n(_waiting(spark, sf), 200)
    return top.select(
        "position", "source", "listing_id", "priority", F.round(rank_score(), 4).alias("rank"), O.group_label().alias("label")
    )


@query(W + f""", b AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rn FROM w ORDER BY {ORDER} LIMIT 100),
    h AS (SELECT *, min(rn) OVER (PARTITION BY label) AS head FROM b)
    SELECT CAST(row_number() OVER (ORDER BY head, rn) AS INT) AS position, source, listing_id, label FROM h""")
def backfill_topn(spark, sf):
    top = O.backfill_top_n(_waiting(spark, sf), 100)
    return top.select("position", "source", "listing_id", O.group_label().alias("label"))


@query(W + GROUPED.format(order=ORDER) + """ SELECT priority, head_rank, label, n FROM (SELECT priority, label,
    dense_rank() OVER (PARTITION BY priority ORDER BY min(head)) AS head_rank, count(*) AS n FROM h GROUP BY priority, label)""")
def contiguous_groups(spark, sf):
    rows, _ = O.order_outbox(_waiting(spark, sf))
    # One row per group from here on.
    groups = rows.groupBy("priority", "_label").agg(F.min("_head").alias("_head"), F.count("*").alias("n"))
    rank = F.dense_rank().over(Window.partitionBy("priority").orderBy("_head")).cast("bigint")
    return groups.select("priority", rank.alias("head_rank"), F.col("_label").alias("label"), "n")


@query(f"""WITH l AS ({L_SQL}) SELECT {LABEL} AS label, count(*) AS n, min(CAST(listing_id AS BIGINT)) AS first_at FROM l GROUP BY 1""")
def district_counts(spark, sf):
    rows = listings(spark, sf).withColumn("k", F.col("listing_id").cast("bigint"))
    return O.district_counts(rows, ["k"]).select("label", "n", F.col("first_at.k").alias("first_at"))


@query(W + """ SELECT count(*) FILTER (priority = 0) AS n_new, count(*) FILTER (priority = 1) AS n_drop,
    count(*) FILTER (priority = 2) AS n_other FROM w""")
def event_counts(spark, sf):
    return O.event_counts(_waiting(spark, sf))


SUMMARY_ORDER = "priority, head, rn"


@query(W + GROUPED.format(order=ORDER) + f""", p AS (SELECT *, row_number() OVER (ORDER BY {SUMMARY_ORDER}) AS pos FROM h),
    a AS (SELECT string_agg(label || n || '間', '、' ORDER BY pos) AS txt FROM (SELECT label, count(*) AS n, min(pos) AS pos FROM p GROUP BY label)),
    s AS (SELECT string_agg(label || n || '間', '、' ORDER BY pos) AS txt FROM (SELECT label, count(*) AS n, min(pos) AS pos FROM p
        WHERE pos <= 20 GROUP BY label)),
    c AS (SELECT count(*) AS n, least(20, count(*)) AS m, count(*) FILTER (priority = 0) AS x, count(*) FILTER (priority = 1) AS y,
        count(*) FILTER (priority = 2) AS z FROM p)
    SELECT n AS n_candidates, m AS n_sending, '待通知 ' || n || ' 間（新房源 ' || x || '、價格下降 ' || y || '、其他更新 ' || z || '）：' || a.txt
        || '。這次依新房源、價格下降、其他更新的順序先傳 ' || m || ' 間：' || s.txt || '。' AS message FROM c, a, s""")
def run_summary(spark, sf):
    _, summary = O.announce(_waiting(spark, sf), 20)
    return summary.select("n_candidates", "n_sending", "message")


# Six reasons on some records, of which a message shows five; none to four images, of which it shows three.
SAID = "CASE WHEN CAST(listing_id AS BIGINT) % 6 = 1 THEN '價格下降 9 -> 8;b;c;d;e;f' WHEN CAST(listing_id AS BIGINT) % 3 = 1 THEN '價格下降 9 -> 8' END"
IMAGES = "substr('p1;p2;p3;p4', 1, CAST(CAST(listing_id AS BIGINT) % 5 AS INT) * 3 - 1)"


def _mark(column: str) -> str:
    return f"CASE {column} WHEN TRUE THEN '✅' WHEN FALSE THEN '❌' ELSE '未知' END"


def _seen(column: str) -> str:
    return f"coalesce(strftime({column}, '%Y-%m-%d %H:%M'), '未知')"


@query(f"""WITH l AS ({L_SQL}),
    s AS (SELECT *, {SAID} AS said, CASE WHEN CAST(listing_id AS BIGINT) % 5 > 0 THEN string_split({IMAGES}, ';') ELSE [] END AS images FROM l)
    SELECT listing_id,
    title || CASE WHEN rent IS NULL THEN '' ELSE ' - ' || format('{{:,}}', rent) || ' 元' END AS title,
    CASE WHEN said IS NULL THEN 4367978 ELSE 15903035 END AS color, url, substr(description, 1, 300) AS description,
    images[1] AS image, source || ' | ' || listing_id AS footer,
    concat_ws('|', '重要更新=' || array_to_string(string_split(said, ';')[:5], chr(10)),
        '地區/地址=' || coalesce(nullif(concat(city, district, address), ''), '未知'),
        '月租/總月租=' || coalesce(format('{{:,}}', rent) || ' 元', '未知') || ' / ' || coalesce(format('{{:,}}', total_monthly_cost) || ' 元', '未知'),
        '坪數=' || coalesce(format('{{:g}}', area_ping) || ' 坪', '未知'), '房型=' || coalesce(nullif(room_type, ''), '未知'),
        '樓層=' || coalesce(nullif(floor, ''), '未知'), '是否租補=' || {_mark('has_rent_subsidy')}, '是否可報稅=' || {_mark('has_tax_registration')},
        '是否獨立洗衣機=' || {_mark('has_independent_washer')}, '垃圾代收=' || {_mark('has_garbage_collection')},
        '距台大=' || CASE WHEN commute_minutes IS NOT NULL THEN commute_minutes || ' 分鐘' WHEN near_ntu_score IS NOT NULL
            THEN '近似 ' || near_ntu_score || '/100（近似）' ELSE '未知' END,
        '更新時間/首次看到=' || {_seen('last_seen_at')} || ' / ' || {_seen('first_seen_at')},
        '其他圖片=' || nullif(array_to_string(images[2:3], chr(10)), '')) AS fields FROM s""")
def render_outbox(spark, sf):
    """Every part of every message."""
    rows = conform(listings(spark, sf)).withColumns(
        {
            "reasons": F.split(F.expr(SAID), ";"),
            "image_urls": F.when(F.expr("CAST(listing_id AS BIGINT) % 5 > 0"), F.split(F.expr(IMAGES), ";")).otherwise(F.array()),
        }
    )
    schema = """title string, url string, description string, color int, image struct<url:string>, footer struct<text:string>,
        fields array<struct<name:string,value:string,inline:boolean>>"""
    read = rows.select("listing_id", F.from_json(O.message(), schema).alias("m"))
    fields = F.transform("m.fields", lambda f: F.concat_ws("=", f["name"], f["value"]))
    return read.select(
        "listing_id", "m.title", "m.color", "m.url", "m.description",
        F.col("m.image.url").alias("image"), F.col("m.footer.text").alias("footer"), F.array_join(fields, "|").alias("fields"),
    )


@query(f"""WITH l AS ({L_SQL}) SELECT coalesce({COST}, 0) AS cost, area_ping, concat(city, district) AS location, title, url
    FROM l WHERE source = '1-URGENT' ORDER BY CAST(listing_id AS BIGINT) LIMIT 20""")
def source_preview(spark, sf):
    rows = listings(spark, sf).selectExpr(
        "*", "CAST(listing_id AS BIGINT) AS page_id", "0 AS strategy", "0 AS pos"
    )
    return preview(rows, "1-URGENT", 20).drop("room_type")


@query(T + f""" SELECT source, count(*) AS n_records, count(*) FILTER ({COST} <= 18600) AS n_affordable FROM t GROUP BY source""")
def source_counts(spark, sf):
    return O.source_counts(listings(spark, sf), 18_600)


@query()
def watch_run(spark, sf):
    """Assess every listing, take all as new, order and cut."""
    waiting = pending(conform(assessed(spark, sf)))
    return O.watch_top_n(waiting, 50).select("position", "source", "listing_id", "near_ntu_score", "dedupe_fingerprint")
