"""Classification, filtering, scoring, duplicates and detail merging."""

from pyspark.sql import functions as F

from listingflow.functions.text import blank_to_null, normalize_spelling
from listingflow.operators import classify as C
from listingflow.operators import merge as M
from listingflow.operators import score as S
from listingflow.operators.dedupe import content_fingerprint, first_wins, mark_duplicates
from listingflow.plans.runs import Rules, assess
from listingflow.schema import conform

from . import words
from .tables import L_SQL, TEXT_SQL, like_any, listings, load, query

FEMALE = "regexp_matches(regexp_replace(txt, '\\s', '', 'g'), '限女')"
T = f"WITH l AS ({L_SQL}), t AS (SELECT *, CAST(listing_id AS BIGINT) AS k, {TEXT_SQL} AS txt FROM l)"
RULES_SQL = f""",
    f AS (SELECT *, ({FEMALE} OR k % 12 IN (0, 2)) AS female_only FROM t),
    c AS (SELECT *, {like_any('txt', words.SUITE_WORDS)} AND NOT {like_any('txt', words.EXCLUDED_WORDS)} AS is_suite,
        CASE WHEN {like_any('txt', words.SUBSIDY_DENIED)} THEN FALSE WHEN {like_any('txt', words.SUBSIDY_WORDS)} THEN TRUE END AS c_subsidy,
        CASE WHEN {like_any('txt', words.TAX_DENIED)} THEN FALSE WHEN {like_any('txt', words.TAX_WORDS)} THEN TRUE END AS c_tax,
        CASE WHEN {like_any('txt', words.WASHER_WORDS)} THEN TRUE WHEN {like_any('txt', words.WASHER_SHARED)} THEN FALSE END AS c_washer,
        CASE WHEN {like_any('txt', words.GARBAGE_DENIED)} THEN FALSE WHEN {like_any('txt', words.GARBAGE_WORDS)} THEN TRUE END AS c_garbage,
        concat_ws(';', {", ".join(f"CASE WHEN contains(txt, '{w}') THEN '{w}' END" for w in words.EXCLUDED_WORDS)},
            CASE WHEN female_only THEN '限女' END) AS red FROM f)
"""
FLAGS = ("has_rent_subsidy", "has_tax_registration", "has_independent_washer", "has_garbage_collection")


@query(T + RULES_SQL + """SELECT listing_id, is_suite, c_subsidy AS has_rent_subsidy, c_tax AS has_tax_registration,
    c_washer AS has_independent_washer, c_garbage AS has_garbage_collection, red AS red_flags,
    substr(trim(regexp_replace(txt, '\\s+', ' ', 'g')), 1, 160) AS summary FROM c""")
def keyword_classify(spark, sf):
    got = C.classify(conform(listings(spark, sf)))
    return got.select(
        "listing_id",
        "classification.is_suite",
        *[f"classification.{f}" for f in FLAGS],
        F.array_join("classification.red_flags", ";").alias("red_flags"),
        "classification.summary",
    )


APPLIED = """listing_id, coalesce(has_rent_subsidy, c_subsidy) AS has_rent_subsidy,
    coalesce(has_tax_registration, c_tax) AS has_tax_registration,
    coalesce(has_independent_washer, c_washer) AS has_independent_washer,
    coalesce(has_garbage_collection, c_garbage) AS has_garbage_collection,
    CASE WHEN coalesce(room_type, '') = '' AND is_suite THEN '套房' ELSE room_type END AS room_type"""


@query(T + RULES_SQL + f"""SELECT {APPLIED},
    CASE WHEN red = '' THEN '' ELSE 'red_flag:' || replace(red, ';', ';red_flag:') END AS tags FROM c""")
def classify_apply(spark, sf):
    got = C.apply_classification(C.classify(conform(listings(spark, sf))))
    return got.select("listing_id", *FLAGS, "room_type", F.array_join("tags", ";").alias("tags"))


@query("""
    SELECT CAST(d.doc_id AS VARCHAR) AS listing_id,
        CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN toxic = 1 THEN TRUE END
            ELSE CASE WHEN contains(text, '租補') THEN TRUE END END AS has_rent_subsidy,
        CASE WHEN l.doc_id IS NOT NULL THEN quality = 1 ELSE contains(text, '套房') END AS is_suite,
        CASE WHEN l.doc_id IS NOT NULL THEN 'label' ELSE 'keyword fallback' END AS score_reason
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def labels_override(spark, sf):
    docs = load(spark, sf, "documents").select(
        F.lit("docs").alias("source"),
        F.col("doc_id").cast("string").alias("listing_id"),
        F.col("text").alias("description"),
    )
    empty = F.lit(None).cast("boolean")
    labels = load(spark, sf, "labels").select(
        F.lit("docs").alias("source"),
        F.col("doc_id").cast("string").alias("listing_id"),
        (F.col("quality") == 1).alias("is_suite"),
        F.when(F.col("toxic") == 1, F.lit(True)).alias("has_rent_subsidy"),
        empty.alias("has_tax_registration"),
        empty.alias("has_independent_washer"),
        empty.alias("has_garbage_collection"),
        F.array().cast("array<string>").alias("red_flags"),
        F.lit("").alias("summary"),
        F.lit("label").alias("score_reason"),
    )
    got = C.classify(conform(docs), labels)
    return got.select(
        "listing_id", "classification.has_rent_subsidy", "classification.is_suite", "classification.score_reason"
    )


ALLOWLIST = {"ASIA": {"*"}, "EUROPE": {"NATION_3", "NATION_8", "NATION_13"}, "AFRICA": {"NATION_0", "NATION_5"}}
ALLOW_SQL = """(coalesce(city = 'ASIA' AND district IS NOT NULL
    OR city = 'EUROPE' AND district IN ('NATION_3', 'NATION_8', 'NATION_13')
    OR city = 'AFRICA' AND district IN ('NATION_0', 'NATION_5'), FALSE))"""
COST = "coalesce(nullif(total_monthly_cost, 0), rent)"
REASONS_SQL = f"""concat_ws(';',
    CASE WHEN NOT {ALLOW_SQL} THEN '地區不符: ' || coalesce(city, '未知') || ' ' || coalesce(district, '未知') END,
    CASE WHEN {like_any('txt', words.EXCLUDED_WORDS)} THEN '排除房型/用途' END,
    CASE WHEN female_only THEN '限女/女性限定' END,
    CASE WHEN contains(coalesce(room_type, ''), '雅房') THEN '雅房' END,
    CASE WHEN NOT contains(coalesce(room_type, ''), '套房') AND NOT {like_any('txt', words.SUITE_WORDS)} THEN '不是明確套房' END,
    CASE WHEN {COST} IS NULL THEN '租金未知' WHEN {COST} > 18600 THEN '租金超過 18600: ' || {COST} END,
    CASE WHEN area_ping IS NULL THEN '坪數未知' WHEN area_ping < 6 THEN '坪數小於 6.0: ' || area_ping END)"""


def _routed(spark, sf):
    rows = C.add_female_only(conform(listings(spark, sf)))
    ok = C.allowed_place(
        blank_to_null(normalize_spelling(F.col("city"))),
        blank_to_null(normalize_spelling(F.col("district"))),
        ALLOWLIST,
    )
    return C.route(rows, C.reject_reasons(ok))


@query(T + RULES_SQL + f""", r AS (SELECT listing_id, {REASONS_SQL} AS reasons FROM c)
    SELECT listing_id, reasons, CASE WHEN reasons = '' THEN 'active' ELSE 'filtered_out' END AS status FROM r""")
def filter_reasons(spark, sf):
    return _routed(spark, sf).select("listing_id", F.array_join("filter_reasons", ";").alias("reasons"), "status")


@query(f"WITH l AS ({L_SQL}) SELECT listing_id, {ALLOW_SQL} AS place_ok FROM l")
def allowlist_semi(spark, sf):
    allow = spark.createDataFrame([(c, d) for c, ds in ALLOWLIST.items() for d in sorted(ds)], "city string, district string")
    return C.allowed_places(listings(spark, sf), allow).select("listing_id", "place_ok")


@query(f"WITH l AS ({L_SQL}) SELECT listing_id, commute_minutes FROM l WHERE commute_minutes IS NULL OR commute_minutes <= 7")
def recent_only(spark, sf):
    return C.recent(listings(spark, sf), 7, age="commute_minutes").select("listing_id", "commute_minutes")


CASCADE_SQL = """, n AS (SELECT *, CASE k % 6 WHEN 0 THEN '台北市大安區羅斯福路4段' || (k % 200) || '號' WHEN 1 THEN '台北市大安區新生南路3段'
        WHEN 2 THEN '捷運公館站3號出口' WHEN 3 THEN '新北市永和區竹林路12巷' ELSE '' END AS addr FROM t),
    e AS (SELECT *, CASE WHEN contains(addr, '台北市') THEN '台北市' WHEN contains(addr, '新北市') THEN '新北市' ELSE city END AS ct,
        CASE WHEN contains(addr, '大安區') THEN '大安區' WHEN contains(addr, '永和區') THEN '永和區' ELSE district END AS ds FROM n),
    s AS (SELECT *, CASE WHEN k % 6 = 0 THEN 1 WHEN k % 6 = 1 THEN 2
        WHEN k % 10 = 2 AND (ct IS NULL OR ct = '台北市') AND (ds IS NULL OR ds = '大安區') THEN 3
        WHEN k % 6 = 2 THEN 4 WHEN k % 8 = 4 THEN 5 WHEN ct = '新北市' AND ds = '永和區' THEN 6 ELSE 7 END AS step FROM e)
    SELECT listing_id, CAST(CASE step WHEN 1 THEN 96 WHEN 2 THEN 92 WHEN 3 THEN 70 WHEN 4 THEN 90 WHEN 5 THEN 70 WHEN 6 THEN 42 END AS INT) AS score,
        CASE step WHEN 1 THEN 'address_road' WHEN 2 THEN 'address_road' WHEN 3 THEN 'context_road' WHEN 4 THEN 'mrt_station'
            WHEN 5 THEN 'mrt_station' WHEN 6 THEN 'district' ELSE 'unknown' END AS method,
        CASE step WHEN 1 THEN 'road:campus_edge:roosevelt_4' WHEN 2 THEN 'road:campus_edge:xinsheng_south_3'
            WHEN 3 THEN 'context_road:walkable:wenzhou' WHEN 4 THEN 'mrt:g07_gongguan' WHEN 5 THEN 'mrt:g06_wanlong'
            WHEN 6 THEN 'district:新北市/永和區' ELSE 'unknown:insufficient_location' END AS basis,
        CASE step WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'medium' WHEN 5 THEN 'low'
            WHEN 6 THEN 'low' ELSE 'none' END AS confidence FROM s"""


def _evidence(rows):
    return rows.select(
        "listing_id",
        F.col("near_ntu_score").alias("score"),
        F.col("score_method").alias("method"),
        F.col("score_basis").alias("basis"),
        F.col("score_confidence").alias("confidence"),
    )


@query(T + CASCADE_SQL)
def evidence_cascade(spark, sf):
    return _evidence(S.add_proximity(conform(listings(spark, sf))))


@query(T + """, o AS (SELECT *, CASE WHEN k % 6 < 4 THEN CASE WHEN k % 6 = 2 THEN coalesce(city, '') || coalesce(district, '') || address
            WHEN k % 6 = 3 THEN coalesce(city, '') || coalesce(district, '') || address
            ELSE coalesce(city, '') || coalesce(district, '') || address END END AS origin FROM t),
    m AS (SELECT *, CASE WHEN origin IS NOT NULL AND length(origin) % 3 > 0 THEN length(origin) * 2 END AS minutes FROM o)
    SELECT listing_id, CAST(CASE WHEN minutes <= 15 THEN 100 WHEN minutes <= 25 THEN 85 WHEN minutes <= 35 THEN 70
        WHEN minutes <= 50 THEN 50 WHEN minutes IS NOT NULL THEN 30 END AS INT) AS measured,
        CAST(coalesce(minutes, commute_minutes) AS INT) AS commute_minutes, minutes IS NOT NULL AS by_route FROM m""")
def commute_override(spark, sf):
    rows = conform(listings(spark, sf))
    origins = rows.filter("address IS NOT NULL").select(S.route_origin().alias("origin")).distinct()
    commute = origins.withColumn(
        "minutes", F.when(F.length("origin") % 3 > 0, (F.length("origin") * 2).cast("int"))
    )
    got = S.add_proximity(rows, commute)
    by_route = F.col("score_method") == "google_routes"
    return got.select(
        "listing_id",
        F.when(by_route, F.col("near_ntu_score")).alias("measured"),
        "commute_minutes",
        by_route.alias("by_route"),
    )


@query("SELECT CAST(o_orderkey AS VARCHAR) AS listing_id, CAST(NULL AS INT) AS score, CAST(NULL AS VARCHAR) AS method,"
       " CAST(NULL AS VARCHAR) AS basis, CAST(NULL AS VARCHAR) AS confidence FROM orders")
def scoring_disabled(spark, sf):
    return _evidence(S.add_proximity(conform(listings(spark, sf)), enabled=False))


RANK_SQL = f"""round(coalesce(near_ntu_score, 0) + CASE WHEN coalesce({COST}, 0) <> 0 THEN greatest(0, (18600 - {COST}) / 300) ELSE 0 END
    + CASE WHEN area_ping IS NULL THEN 0 ELSE least(15, area_ping) END + CASE WHEN has_rent_subsidy THEN 12 ELSE 0 END
    + CASE WHEN has_tax_registration THEN 8 ELSE 0 END + CASE WHEN has_independent_washer THEN 10 ELSE 0 END
    + CASE WHEN has_garbage_collection THEN 5 ELSE 0 END + CASE WHEN commute_minutes <= 15 THEN 15 ELSE 0 END, 6)"""


@query(f"WITH l AS ({L_SQL}) SELECT listing_id, {RANK_SQL} AS rank FROM l")
def rank_score(spark, sf):
    return conform(listings(spark, sf)).select("listing_id", F.round(S.rank_score(), 6).alias("rank"))


@query("""
    SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""")
def dedupe_first_wins(spark, sf):
    order = [F.col("ts"), F.col("event_id")]
    rows = first_wins(load(spark, sf, "events"), ["user_id", "event_type"], order)
    return rows.select("event_id", "user_id", "event_type", "value")


PRINT_SQL = f""", p AS (SELECT *, regexp_replace(coalesce(address, ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS a,
        replace(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '採光', '') AS ti, {COST} AS cost FROM t),
    fp AS (SELECT *, CASE WHEN city IS NOT NULL AND district IS NOT NULL AND coalesce(cost, 0) <> 0 AND area_ping IS NOT NULL
        THEN substr(sha256(concat_ws('|', city, district, substr(a, 1, 18), CAST(cost AS VARCHAR), CAST(area_ping AS VARCHAR),
            coalesce(room_type, ''), substr(ti, 1, 24))), 1, 24) END AS fingerprint FROM p)"""


@query(T + PRINT_SQL + """
    SELECT listing_id, fingerprint, fingerprint IS NOT NULL AND row_number() OVER (PARTITION BY fingerprint ORDER BY k) > 1
        AS possible_duplicate FROM fp""")
def fingerprint_mark(spark, sf):
    rows = conform(listings(spark, sf)).withColumn("fingerprint", content_fingerprint()).withColumn(
        "k", F.col("listing_id").cast("bigint")
    )
    got = mark_duplicates(rows, "fingerprint", ["k"])
    return got.select("listing_id", "fingerprint", "possible_duplicate")


@query("""
    WITH d AS (SELECT sha256(trim(text)) AS fp, doc_id FROM documents)
    SELECT doc_id, row_number() OVER (PARTITION BY fp ORDER BY doc_id) > 1 AS possible_duplicate FROM d""")
def text_copies_mark(spark, sf):
    rows = load(spark, sf, "documents").select("doc_id", F.sha2(F.trim("text"), 256).alias("fp"))
    return mark_duplicates(rows, "fp", ["doc_id"]).select("doc_id", "possible_duplicate")


BASE_SQL = """
    b AS (SELECT p_partkey, p_size AS page, p_partkey AS pos, 'u' || (p_partkey % 600) AS url,
        CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS rent,
        CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS area_ping,
        CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS district, p_type AS room_type,
        concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' with a description of more than forty letters' ELSE '' END) AS description
        FROM part),
    d AS (SELECT 'u' || s_suppkey AS url, CAST(1000 + s_suppkey AS INT) AS rent, s_acctbal AS area_ping, s_name AS district,
        concat(s_name, ' described at some length') AS description FROM supplier)"""


@query(f"""
    WITH {BASE_SQL},
    needy AS (SELECT *, (rent IS NULL OR area_ping IS NULL OR district = '' OR coalesce(room_type, '') = ''
        OR length(description) < 40) AS need FROM b),
    once AS (SELECT * FROM needy WHERE need QUALIFY row_number() OVER (PARTITION BY page, url ORDER BY pos) = 1),
    taken AS (SELECT p_partkey, d.* FROM once JOIN d USING (url) QUALIFY row_number() OVER (PARTITION BY page ORDER BY pos) <= 3)
    SELECT needy.p_partkey, coalesce(needy.rent, taken.rent) AS rent, coalesce(needy.area_ping, taken.area_ping) AS area_ping,
        CASE WHEN needy.district = '' THEN coalesce(taken.district, needy.district) ELSE needy.district END AS district,
        CASE WHEN length(taken.description) > length(needy.description) THEN taken.description ELSE needy.description END AS description
    FROM needy LEFT JOIN taken ON taken.p_partkey = needy.p_partkey""")
def detail_merge(spark, sf):
    part, supplier = load(spark, sf, "part"), load(spark, sf, "supplier")
    base = part.selectExpr(
        "p_partkey", "p_size AS page", "p_partkey AS pos", "concat('u', CAST(p_partkey % 600 AS STRING)) AS url",
        "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(floor(p_retailprice) AS INT) END AS rent",
        "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS area_ping",
        "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS district", "p_type AS room_type",
        "concat(p_name, CASE WHEN p_partkey % 2 = 0 THEN ' with a description of more than forty letters' ELSE '' END) AS description",
    )
    details = supplier.selectExpr(
        "concat('u', CAST(s_suppkey AS STRING)) AS url", "CAST(1000 + s_suppkey AS INT) AS rent", "s_acctbal AS area_ping",
        "s_name AS district", "concat(s_name, ' described at some length') AS description",
    )
    got = M.merge_details(base, details, "page", "pos")
    return got.select("p_partkey", "rent", "area_ping", "district", "description")


def assessed(spark, sf):
    rows = listings(spark, sf).drop("status").withColumn("pos", F.col("listing_id").cast("bigint"))
    return assess(rows, Rules(allowlist=ALLOWLIST), order=("pos",))


@query(T + RULES_SQL + f""", a AS (SELECT k, c.* EXCLUDE (k, room_type), {APPLIED.split('END AS room_type')[0].split('AS has_garbage_collection,')[1]} END AS room_type FROM c),
    tg AS (SELECT *, concat_ws(chr(10), nullif(title, ''), nullif(city, ''), nullif(district, ''), nullif(address, ''),
        nullif(room_type, ''), nullif(description, ''),
        nullif(CASE WHEN red = '' THEN '' ELSE 'red_flag:' || replace(red, ';', ' red_flag:') END, '')) AS txt2 FROM a),
    r AS (SELECT *, {REASONS_SQL.replace("'txt'", "'txt2'").replace('(txt,', '(txt2,').replace('female_only', '(female_only OR red LIKE ' + chr(39) + '%限女%' + chr(39) + ')')} AS reasons FROM tg),
    p AS (SELECT *, regexp_replace(coalesce(address, ''), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS a,
        replace(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), '採光', '') AS ti, {COST} AS cost FROM r),
    fp AS (SELECT *, CASE WHEN reasons = '' AND city IS NOT NULL AND district IS NOT NULL AND coalesce(cost, 0) <> 0
        AND area_ping IS NOT NULL THEN substr(sha256(concat_ws('|', city, district, substr(a, 1, 18), CAST(cost AS VARCHAR),
            CAST(area_ping AS VARCHAR), coalesce(room_type, ''), substr(ti, 1, 24))), 1, 24) END AS fingerprint FROM p)
    SELECT listing_id, reasons, CASE WHEN reasons = '' THEN 'active' ELSE 'filtered_out' END AS status, fingerprint,
        fingerprint IS NOT NULL AND row_number() OVER (PARTITION BY fingerprint ORDER BY k) > 1 AS possible_duplicate FROM fp""")
def assess_records(spark, sf):
    return assessed(spark, sf).select(
        "listing_id",
        F.array_join("filter_reasons", ";").alias("reasons"),
        "status",
        F.col("dedupe_fingerprint").alias("fingerprint"),
        "possible_duplicate",
    )


