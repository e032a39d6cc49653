from collections import Counter

import pytest
from pyspark.sql import functions as F

from listingflow.operators import classify as C
from listingflow.operators import score as S
from listingflow.operators.dedupe import content_fingerprint, first_wins, mark_duplicates
from listingflow.operators.skew import attach_facts
from listingflow.plans.runs import Rules, assess, backfill

from .fixtures import gazetteer_table, records


def assessed(spark, *changes, **rules):
    base = [{"total_monthly_cost": None, "area_ping": 6.5, **c} for c in changes]
    return assess(records(spark, *base), Rules(**rules)).orderBy("listing_id").collect()


def test_filter_cases(spark):
    rows = assessed(
        spark,
        {"description": "可租補 可報稅 獨洗 垃圾代收"},
        {"description": "自行倒垃圾"},
        {"title": "台北市大安區套房 限女"},
        {"description": "此房屋限女生租住"},
        {"raw": '{"gender":"此房屋限女生租住"}'},
        {"raw": '{"x":{"gender":"男女不限"}}'},
        {"description": "性別不限女性男性皆可"},
        {"area_ping": 5.5},
        {"title": "雅房", "room_type": "雅房"},
        {"city": "臺北市"},
        {"rent": None},
        {"rent": 20000},
        {"city": None},
        {"rent": 0},
    )
    reasons = [r.filter_reasons for r in rows]
    assert reasons[0] == [] and rows[0].status == "active"
    assert [rows[0][f] for f in (
        "has_rent_subsidy", "has_tax_registration", "has_independent_washer", "has_garbage_collection",
    )] == [True] * 4
    assert rows[1].has_garbage_collection is False
    for i in (2, 3, 4):
        assert any("限女" in x for x in reasons[i]) and rows[i].status == "filtered_out"
        assert "red_flag:限女" in rows[i].tags
    assert reasons[5] == reasons[6] == []
    assert reasons[7] == ["坪數小於 6.0: 5.5"]
    assert reasons[8] == ["排除房型/用途", "雅房", "不是明確套房"]
    assert reasons[9] == []
    assert reasons[10] == ["租金未知"]
    assert reasons[11] == ["租金超過 18600: 20000"]
    assert reasons[12] == ["地區不符: 未知 大安區"]
    assert reasons[13] == []  # a cost of 0 is known and low


def test_switches_and_wildcard(spark):
    rows = assessed(
        spark,
        {"title": "大安 限女 房", "room_type": None},
        exclude_female_only=False,
        suite_only=False,
    )
    assert rows[0].filter_reasons == []
    rows = assessed(
        spark,
        {"city": "高雄市", "district": "鼓山區"},
        {"city": "臺中市", "district": "西屯區"},
        {"city": "台中市", "district": "東區"},
        allowlist={"高雄市": {"*"}, "台中市": {"西屯區"}},
    )
    assert [r.status for r in rows] == ["active", "active", "filtered_out"]


def test_allowlist_table_form_agrees(spark):
    rows = records(spark, {"city": "高雄市", "district": "鼓山區"}, {"city": "臺中市", "district": "東區"},
                   {"district": None}, {"city": "台中市", "district": "西屯區"})
    allow = {"高雄市": {"*"}, "台中市": {"西屯區"}}
    table = spark.createDataFrame([(c, d) for c, ds in allow.items() for d in ds], "city string, district string")
    joined = {r.listing_id: r.place_ok for r in C.allowed_places(rows, table).collect()}
    place = C.allowed_place(F.translate("city", "臺", "台"), F.col("district"), allow)
    direct = {r.listing_id: r.ok for r in rows.select("listing_id", place.alias("ok")).collect()}
    assert joined == direct == {"r000": True, "r001": False, "r002": False, "r003": True}


def test_existing_values_are_kept(spark):
    row = assessed(spark, {"has_independent_washer": False, "description": "獨立洗衣機", "room_type": ""})[0]
    assert row.has_independent_washer is False
    assert row.room_type == "套房"


def test_labels_override_rules(spark):
    rows = records(spark, {"description": "可租補"}, {"description": "可租補"})
    labels = spark.createDataFrame(
        [("fixture", "r000", True, None, None, None, None, ["頂加"], "s", "model")],
        "source string, listing_id string, is_suite boolean, has_rent_subsidy boolean, "
        "has_tax_registration boolean, has_independent_washer boolean, has_garbage_collection boolean, "
        "red_flags array<string>, summary string, score_reason string",
    )
    got = C.apply_classification(C.classify(rows, labels)).orderBy("listing_id").collect()
    assert [r.has_rent_subsidy for r in got] == [None, True]
    assert got[0].tags == ["red_flag:頂加"] and got[0].classifier_score_reason == "model"


GOLDEN = [
    ({"address": "台北市大安區羅斯福路四段74號"}, 96, "address_road", "high"),
    ({"address": "台北市大安區新生南路三段86巷"}, 94, "address_road", "high"),
    ({"address": "台北市大安區辛亥路二段170號"}, 92, "address_road", "high"),
    ({"address": "台北市大安區長興街31號"}, 90, "address_road", "high"),
    ({"address": "台北市中正區汀洲路三段284巷", "district": "中正區"}, 86, "address_road", "high"),
    ({"address": "臺北市大安區羅斯福路４段７４號"}, 96, "address_road", "high"),
    ({"address": "台北市大安區溫州街"}, 86, "address_road", "medium"),
    ({"address": "台北市文山區羅斯福路六段", "title": "近台大"}, 40, "district", "low"),
    ({"title": "羅斯福路四段套房"}, 78, "context_road", "low"),
    ({"title": "羅斯福路四段 羅斯福路四段 羅斯福路四段"}, 78, "context_road", "low"),
    ({"city": "新北市", "district": "永和區", "title": "台北市大安區羅斯福路四段"}, 42, "district", "low"),
    ({"title": "公館站套房", "district": None, "city": None}, 78, "mrt_station", "low"),
    ({"title": "捷運萬隆站", "district": "文山區"}, 70, "mrt_station", "low"),
    ({"title": "景美捷運站旁", "district": "文山區"}, 64, "mrt_station", "low"),
    ({"title": "大坪林站附近", "city": "新北市", "district": "新店區"}, 58, "mrt_station", "low"),
    ({"address": "捷運公館站3號出口", "title": "套房"}, 90, "mrt_station", "medium"),
    ({"title": "套房"}, 50, "district", "low"),
    ({"title": "套房", "city": "新北市", "district": "永和區"}, 42, "district", "low"),
    ({"title": "套房", "district": "大同區"}, 18, "district", "low"),
    ({"title": "套房", "city": None, "district": None}, None, "unknown", "none"),
]


def test_scoring_golden_table(spark):
    got = S.add_proximity(records(spark, *[c for c, *_ in GOLDEN])).orderBy("listing_id").collect()
    for row, (change, score, method, confidence) in zip(got, GOLDEN, strict=True):
        assert (row.near_ntu_score, row.score_method, row.score_confidence) == (score, method, confidence), change


def test_measured_time_and_switch(spark):
    rows = records(
        spark,
        {"address": "大安區和平東路", "city": "臺北市"},
        {"address": None},
        {"address": "台北市大安區x"},
    )
    commute = spark.createDataFrame(
        [("台北市大安區和平東路", 12), ("台北市大安區x", None)], "origin string, minutes int"
    )
    # The origin repeats neither the city nor a district the address already names.
    got = S.add_proximity(rows, commute).orderBy("listing_id").collect()
    assert (got[0].near_ntu_score, got[0].commute_minutes, got[0].score_method) == (100, 12, "google_routes")
    assert [r.score_method for r in got[1:]] == ["district", "district"]
    off = S.add_proximity(rows, enabled=False).first()
    assert off.near_ntu_score is None and off.score_method is None


@pytest.mark.parametrize("minutes,score", [(15, 100), (16, 85), (35, 70), (50, 50), (51, 30), (None, None)])
def test_minute_bands(spark, minutes, score):
    df = spark.createDataFrame([(minutes,)], "m int")
    assert df.select(S.minutes_score(F.col("m")).alias("s")).first().s == score


def test_rank(spark):
    rows = records(
        spark,
        {"near_ntu_score": 96, "rent": 15600, "total_monthly_cost": None, "area_ping": 8.0,
         "has_rent_subsidy": True, "has_tax_registration": True, "has_independent_washer": True,
         "has_garbage_collection": True, "commute_minutes": 15},
        {"rent": None, "total_monthly_cost": 0, "area_ping": None},
        {"rent": 90000, "total_monthly_cost": None, "area_ping": 40.0},
    )
    got = [r.v for r in rows.select("listing_id", S.rank_score().alias("v")).orderBy("listing_id").collect()]
    assert got == [96 + 10 + 8 + 12 + 8 + 10 + 5 + 15, 0, 15]


def test_fingerprints_mark_only_accepted_repeats(spark):
    rows = assessed(spark, {}, {}, {"rent": None}, {"area_ping": None}, {"title": "另一個套房"}, {"rent": 90000}, {"rent": 90000})
    assert [bool(r.possible_duplicate) for r in rows] == [False, True, False, False, False, False, False]
    assert rows[1].notification_suppressed is True and rows[1].status == "active"
    assert rows[0].dedupe_fingerprint == rows[1].dedupe_fingerprint is not None


def test_hot_groups_give_the_same_marks(spark):
    df = spark.range(2000).select(
        F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("fp")
    )
    plain = mark_duplicates(df, "fp", ["n"])
    split = mark_duplicates(df.repartition(3), "fp", ["n"])
    assert sorted(plain.collect()) == sorted(split.collect())
    assert plain.filter("possible_duplicate").count() == 2000 - plain.select("fp").distinct().count()


def test_first_wins_is_independent_of_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    a = first_wins(df.repartition(5), ["k"], [F.col("v")]).collect()
    b = first_wins(df.repartition(3, "v"), ["k"], [F.col("v")]).collect()
    assert sorted(a) == sorted(b) and {r.v for r in a} == set(range(7))


def test_backfill_cuts_then_groups(spark):
    rows = assess(
        records(
            spark,
            {"title": "a 套房", "district": "大安區", "area_ping": 9.0},
            {"title": "b 套房", "district": "萬華區", "area_ping": 8.0},
            {"title": "c 套房", "district": "大安區", "area_ping": 7.0},
            {"title": "d 套房", "district": "松山區", "area_ping": 6.5},
        ),
        Rules(max_results=3, proximity=False),
    )
    got = backfill(rows, Rules(max_results=3, proximity=False)).orderBy("position").collect()
    assert [r.title[0] for r in got] == ["a", "c", "b"]


def test_gazetteer_table_is_ordered(spark):
    assert gazetteer_table(spark).orderBy("ord").first().district == "大安區"
    assert content_fingerprint() is not None


def test_rows_without_a_key_do_not_meet_in_one_task(spark):
    rows = spark.range(4_000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id END AS k", "parse_json('{}') AS v", "map(1, 2) AS m")
    facts = spark.range(0, 4_000, 20).selectExpr("id AS k", "id + 1 AS f")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got = attach_facts(rows, facts, ["k"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert sorted((r.id, r.k, r.f) for r in got if r.f is not None) == [(i, i, i + 1) for i in range(0, 4_000, 20)]
    alone = Counter(r.task for r in got if r.k is None)
    assert len(got) == 4_000 and max(alone.values()) < 1_000
