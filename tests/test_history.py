"""Two-level windows, the page rule and detail merging against plain brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from listingflow.operators import history as H
from listingflow.operators.merge import merge_details
from listingflow.operators import stop_rule
from listingflow.operators.stop_rule import kept_pages
from listingflow.plans import search as S

from .fixtures import gazetteer_table, one, records

START = datetime(2026, 7, 1)


def observations(seed: int):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        # One key holds half of all rows.
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(9)}"
        ts = START + timedelta(minutes=rng.randrange(60 * 24 * 20))
        rows.append((key, ts, i, rng.choice([None, 0, 10, 20, 30]), rng.choice(["active", "inactive"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_a_sequential_pass(spark, seed):
    rows = observations(seed)
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq int, cost int, status string").repartition(5)
    got = H.replay(df, ["key"], ["ts", "seq"], "ts", "cost", "status").collect()
    expected = {}
    for key, ts, _, cost, status in sorted(rows, key=lambda r: (r[1], r[2])):
        e = expected.setdefault(key, {"n": 0, "drops": 0, "back": 0, "cost": None, "status": None, "first": ts})
        if e["n"]:
            e["drops"] += bool(cost and e["cost"] and cost < e["cost"])
            e["back"] += status == "active" and e["status"] != "active"
        e.update(n=e["n"] + 1, prev=e["cost"], cost=cost, status=status, last=ts)
    assert len(got) == len(expected)
    for r in got:
        e = expected[r.key]
        assert (r.observations, r.price_drops, r.relistings, r.last_cost, r.previous_cost, r.status) == (
            e["n"], e["drops"], e["back"], e["cost"], e["prev"], e["status"],
        )
        assert (r.first_seen_at, r.last_seen_at, r.ever_relisted) == (e["first"], e["last"], e["back"] > 0)


def test_sessions_and_versions(spark):
    rows = observations(3)
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq int, cost int, status string")
    got = H.gap_sessions(df, ["key"], ["ts", "seq"], "ts", 3600 * 5).collect()
    expected = {}
    last = {}
    for key, ts, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        groups = expected.setdefault(key, [])
        if key not in last or ts - last[key] > timedelta(hours=5):
            groups.append([ts, ts, 0])
        groups[-1][1] = last[key] = ts
        groups[-1][2] += 1
    assert {(r.key, r.session): [r.started_at, r.ended_at, r.observations] for r in got} == {
        (k, i + 1): g for k, gs in expected.items() for i, g in enumerate(gs)
    }
    at = START + timedelta(days=10)
    versions = {r.key: r.seq for r in H.as_of(df, ["key"], ["ts", "seq"], "ts", F.lit(at)).collect()}
    brute = {}
    for key, ts, seq, *_ in sorted(rows, key=lambda r: (r[1], r[2])):
        if ts <= at:
            brute[key] = seq
    assert versions == brute


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_a_key_that_fills_many_ranges(spark, ranges):
    """A third of all rows have one key and one time; whole ranges hold nothing else."""
    rng = random.Random(ranges)
    rows = [("hot", START, i, rng.choice([None, 1, 2, 5])) for i in range(1_000)]
    rows += [(f"k{rng.randrange(700)}", START + timedelta(minutes=rng.randrange(900)), 1_000 + i, 3) for i in range(2_000)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, seq int, cost int").repartition(4)
    ranged = H.in_ranges(df, ["key"], ["ts", "seq"], ranges)
    assert ranged.groupBy("_range", "key").count().agg(F.max("count")).first()[0] <= max(2 * 3_000 / ranges, 100) or ranges == 1
    got = H.with_previous(df, ["key"], ["ts", "seq"], ["cost"], ranges=ranges)
    w = Window.partitionBy("key").orderBy("ts", "seq")
    plain = df.select("key", "seq", F.lag("cost").over(w).alias("prev_cost"), (F.row_number().over(w) == 1).alias("is_first"))
    assert sorted(got.select(*plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)
    total = H.running_total(df, ["key"], ["ts", "seq"], F.col("cost"), "s", ranges)
    plain = df.select("seq", F.coalesce(F.sum("cost").over(w), F.lit(0)).alias("s"))
    assert sorted(total.select("seq", "s").collect()) == sorted(plain.collect())
    sessions = H.gap_sessions(df, ["key"], ["ts", "seq"], "ts", 3600, ranges).filter("key = 'hot'").collect()
    assert [(r.session, r.started_at, r.ended_at, r.observations) for r in sessions] == [(1, START, START, 1_000)]


def test_rows_are_not_shuffled_to_what_is_carried(spark):
    df = spark.createDataFrame(observations(4), "key string, ts timestamp, seq int, cost int, status string")
    frame = H.with_previous(df, ["key"], ["ts", "seq"], ["cost"])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_no_observations(spark):
    df = spark.createDataFrame([], "key string, ts timestamp, seq int, cost int, status string")
    assert H.replay(df, ["key"], ["ts", "seq"], "ts", "cost", "status").count() == 0
    assert H.gap_sessions(df, ["key"], ["ts", "seq"], "ts", 5).count() == 0


def crawl(pages, misses):
    """Search after search, page after page, as a crawler would."""
    seen, kept, new = set(), set(), {}
    for search in sorted({s for s, _ in pages}):
        missed = 0
        for page in sorted(p for s, p in pages if s == search):
            parsed, keys = pages[search, page]
            kept.add((search, page))
            if not parsed:
                break
            fresh = set(keys) - seen
            seen |= fresh
            new[search, page] = len(fresh)
            missed = 0 if fresh else missed + 1
            if missed >= misses:
                break
    return kept, new


@pytest.mark.parametrize("misses,seed,block_rows", [(1, 1, 1_000_000), (1, 2, 15), (2, 1, 15), (2, 3, 1_000_000)])
def test_page_rule(spark, misses, seed, block_rows):
    rng = random.Random(seed)
    pages = {}
    for s in range(6):
        for p in range(6):
            keys = [rng.randrange(14) for _ in range(rng.randrange(0, 4))]
            pages[s, p] = (len(keys) + (rng.random() < 0.3), keys)
    table = spark.createDataFrame([(s, p, n) for (s, p), (n, _) in pages.items()], "search int, page int, n_parsed int")
    shown = spark.createDataFrame([(s, p, k) for (s, p), (_, ks) in pages.items() for k in ks], "search int, page int, k int")
    got = kept_pages(shown, table, ["k"], misses, block_rows=block_rows).collect()
    kept, new = crawl(pages, misses)
    assert len(got) == len(pages)
    assert {(r.search, r.page) for r in got if r.kept} == kept
    assert {(r.search, r.page): r.n_new for r in got if r.kept and r.n_parsed} == new


@pytest.mark.parametrize("block_rows", [1_000_000, 1_500])
def test_a_chain_of_searches_that_depend_on_each_other(spark, block_rows, monkeypatch):
    """Whether a search goes on depends on the one before it, a thousand times over."""
    pages = {(s, p): (1, [s + p]) for s in range(1_000) for p in range(3)}
    table = spark.createDataFrame([(s, p, n) for (s, p), (n, _) in pages.items()], "search int, page int, n_parsed int")
    shown = spark.createDataFrame([(s, p, k) for (s, p), (_, ks) in pages.items() for k in ks], "search int, page int, k int")
    walks = []
    walk = stop_rule._walk
    monkeypatch.setattr(stop_rule, "_walk", lambda marked, *rest: walks.append(marked.count()) or walk(marked, *rest))
    got = kept_pages(shown, table, ["k"], 1, block_rows=block_rows).collect()
    kept, _ = crawl(pages, 1)
    assert {(r.search, r.page) for r in got if r.kept} == kept
    assert sum(walks) < 3 * (len(pages) + shown.count())
    assert (len(walks) == 1) == (block_rows == 1_000_000)


def test_detail_merge(spark):
    base = records(
        spark,
        {"url": "u1", "rent": None, "description": "short", "tags": ["a"]},
        {"url": "u1", "rent": None},
        {"url": "u2", "room_type": "", "description": "d" * 50},
        {"url": "u3", "rent": 5, "description": "d" * 50},
        {"url": "u4", "area_ping": None},
        {"url": "u5", "area_ping": None},
        {"url": "u6", "area_ping": None},
    ).withColumn("page", F.lit(1)).withColumn("pos", F.col("listing_id"))
    details = spark.createDataFrame(
        [("u1", 9000, 5.0, "套房", "long " * 12, ["a", "b", "b"], ["i1", "i2", "i3", "i4"]),
         ("u2", 1, 1.0, "雅房", "x", [], []), ("u3", 1, 1.0, "x", "y" * 99, [], []),
         ("u5", 1, 7.0, "x", "", [], []), ("u6", 1, 7.0, "x", "", [], [])],
        "url string, rent int, area_ping double, room_type string, description string, tags array<string>, image_urls array<string>",
    )
    got = {r.listing_id: r for r in merge_details(base, details, "page", "pos").collect()}
    assert got["r000"].rent == 9000 and got["r000"].area_ping == 8.0 and got["r000"].tags == ["a", "b"]
    assert got["r000"].description.startswith("long") and got["r000"].image_urls == ["i1", "i2", "i3", "i4"]
    assert got["r001"].rent is None  # the same URL is used once per page
    assert got["r002"].room_type == "雅房" and got["r002"].rent == 18000
    assert got["r003"].description == "d" * 50  # complete records are left alone
    assert got["r004"].area_ping is None  # its detail page was not fetched, so it takes no turn
    assert got["r005"].area_ping == 7.0 and got["r006"].area_ping is None  # three per page


def test_search_plan(spark):
    table = gazetteer_table(spark)
    allow = spark.createDataFrame([("台北市", "文山區"), ("台北市", "大安區"), ("高雄市", "*")], "city string, district string")
    plan = S.search_plan(allow, table).collect()
    assert [(r.district, r.kind) for r in plan] == [("大安區", 2), ("大安區", 3), ("文山區", 2), ("文山區", 3), (None, 2), (None, 3)]
    assert plan[0].url == "https://rent.591.com.tw/list?kind=2&region=1&section=5"
    assert plan[-1].url == "https://rent.591.com.tw/list?kind=3&region=17"
    every = table.select("city", "district").distinct()
    with pytest.raises(ValueError, match="more than 30 searches"):
        S.search_plan(every, table, max_searches=30)


def test_page_urls(spark):
    url = "https://rent.591.com.tw/list?kind=2&region=1&section=2-3,4&firstRow=90"
    assert one(spark, url, S.section_urls) == [
        f"https://rent.591.com.tw/list?kind=2&region=1&section={n}" for n in (2, 3, 4)
    ]
    single = "https://rent.591.com.tw/list?section=5&firstRow=30"
    assert one(spark, single, S.section_urls) == [single]
    assert one(spark, single, lambda c: S.offset_pages(c, 3, 30)) == [
        "https://rent.591.com.tw/list?section=5",
        "https://rent.591.com.tw/list?section=5&firstRow=30",
        "https://rent.591.com.tw/list?section=5&firstRow=60",
    ]
    assert one(spark, "https://a.example/x?page=9&q=1", lambda c: S.numbered_pages(c, 2)) == [
        "https://a.example/x?q=1", "https://a.example/x?q=1&page=2",
    ]


@pytest.mark.parametrize(
    "last,now,pages",
    [("02:20", "04:16", 2), ("02:20", "03:16", 1), (None, "03:16", 1), ("05:00", "04:00", 1), ("02:00", "03:15", 1)],
)
def test_catch_up(spark, last, now, pages):
    day = "2026-07-19 "
    df = spark.createDataFrame([(last and day + last, day + now)], "a string, b string")
    depth = S.catch_up_pages(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))
    assert df.select(depth.alias("p")).first().p == pages


def test_null_keys_and_times_stay(spark):
    rows = [("a", 1, 10.0), ("a", None, 5.0), (None, 2, 3.0), (None, 1, 4.0), (None, None, 7.0), ("b", 3, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, cost double")
    got = H.with_previous(df, ["k"], ["t"], ["cost"])
    plain = df.withColumn("p", F.lag("cost").over(Window.partitionBy("k").orderBy("t")))
    assert sorted(map(str, got.select("k", "t", "cost", "prev_cost").collect())) == sorted(
        str(r) for r in plain.withColumnRenamed("p", "prev_cost").collect()
    )
    total = H.running_total(df, ["k"], ["t"], F.col("cost"), "s")
    running = df.withColumn("s", F.sum("cost").over(Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted(map(str, total.collect())) == sorted(map(str, running.collect()))


def test_a_fetched_page_without_a_record_counts(spark):
    rows = [(0, i, f"u{i}", None, "{}") for i in range(5)]
    base = spark.createDataFrame(rows, "page int, pos int, url string, rent int, raw string").selectExpr(
        "*", "1.0D AS area_ping", "'d' AS district", "'r' AS room_type", "repeat('x', 50) AS description"
    )
    details = spark.createDataFrame([(f"u{i}", 100 + i, '{"k":1}') for i in (1, 2, 3, 4)], "url string, rent int, raw string")
    fetched = spark.createDataFrame([(f"u{i}",) for i in range(5)], "url string")
    got = {r.url: r for r in merge_details(base, details, "page", "pos", 3, fetched=fetched).collect()}
    assert [got[f"u{i}"].rent for i in range(5)] == [None, 101, 102, None, None]
    assert got["u1"].raw == '{"detail_raw_json":{"k":1}}' and got["u0"].raw == "{}"
