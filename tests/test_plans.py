"""The shape of physical plans that matters at scale."""

import re

import pytest
from pyspark.sql import functions as F

from listingflow.operators.dedupe import first_wins, mark_duplicates
from listingflow.operators.outbox import announce, watch_top_n
from listingflow.operators.state import mark_notified, upsert
from listingflow.schema import conform
from listingflow.sources.collect import collect_source
from listingflow.sources.extract import extract_records
from listingflow.sources.pages import url_policy
from listingflow.sources.registry import read_once
from listingflow.sources.specs import PORTAL, SPECS, SourceSpec
from listingflow.sources.store import StateStore

from .fixtures import gazetteer, records


def plan(df) -> str:
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def shuffled(spark):
    """Plans as for tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_wins_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    text = plan(first_wins(df, ["k"], [F.col("id")]))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Exchange hashpartitioning(k") < text.rindex("WindowGroupLimit")


@pytest.fixture
def splitting(shuffled):
    """Adaptive execution that calls small partitions skewed."""
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in small.items():
        shuffled.conf.set(key, value)
    yield shuffled
    for key in small:
        shuffled.conf.unset(key)


def test_a_hot_group_is_split_over_tasks(splitting):
    df = splitting.range(0, 60_000, 1, 8).select("id", F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("fp"))
    got = mark_duplicates(df, "fp", ["id"])
    got.select("id", F.spark_partition_id().alias("p"), "fp").filter("fp = -1").groupBy("p").count()
    held = [r["count"] for r in got.withColumn("p", F.spark_partition_id()).filter("fp = -1").groupBy("p").count().collect()]
    assert sum(held) == 20_000 and len(held) > 3 and max(held) < 10_000
    assert got.filter("possible_duplicate").count() == 19_999
    text = plan(got)
    assert "partial_min(id)" in text and "CartesianProduct" not in text


def scans(text: str) -> int:
    return text.count("Scan ")


def test_top_n_reads_wide_rows_once_and_keys_twice(shuffled, folder):
    waiting = records(shuffled, {}, {}).withColumn("priority", F.lit(0)).withColumn("reasons", F.array(F.lit("新房源")))
    waiting.write.parquet(f"{folder}/waiting")
    text = plan(watch_top_n(shuffled.read.parquet(f"{folder}/waiting"), 10))
    assert scans(text) == 3
    narrow = [line for line in text.splitlines() if "FileScan" in line and "description" not in line]
    assert len(narrow) == 2


def test_an_announcement_reads_the_pending_set_twice(shuffled, folder):
    waiting = records(shuffled, {}, {}).withColumn("priority", F.lit(0)).withColumn("reasons", F.array(F.lit("新房源")))
    waiting.write.parquet(f"{folder}/waiting")
    top, summary = announce(shuffled.read.parquet(f"{folder}/waiting"), 10)
    # Once for the narrow table, which both use, and once for the rows that made it.
    assert plan(top).count("FileScan") == 1 and plan(summary).count("FileScan") == 0
    assert top.count() == 2 and "待通知 2 間" in summary.first().message


def test_all_sources_are_read_in_one_pass(spark, folder):
    spark.createDataFrame([(1, "rakuya", "https://a.example", "<p>")], "page_id int, source string, url string, html string").write.parquet(f"{folder}/pages")
    text = plan(read_once(spark.read.parquet(f"{folder}/pages"), SPECS))
    assert text.count("FileScan") == 1 and text.count("MapInPandas") == 1


def test_a_policy_scans_the_pages_once(shuffled, folder):
    shuffled.createDataFrame([("https://a.example/x",)], "url string").write.parquet(f"{folder}/pages")
    policies = shuffled.createDataFrame([("https://a.example", "absent", None)], "origin string, state string, rules array<struct<prefix:string,allow:boolean>>")
    assert plan(url_policy(shuffled.read.parquet(f"{folder}/pages"), policies)).count("FileScan") == 1


def test_top_n_needs_no_global_window_over_all_rows(shuffled):
    waiting = records(shuffled, {}, {}).withColumn("priority", F.lit(0)).withColumn("reasons", F.array(F.lit("新房源")))
    text = plan(watch_top_n(waiting, 10))
    assert "TakeOrderedAndProject(limit=10" in text
    # The one window without a partition runs on the rows already cut.
    assert text.index("Window [") < text.index("TakeOrderedAndProject(limit=10")
    assert text.count("Window [") == 1


def test_incremental_writes_reduce_the_state_first(shuffled):
    state, batch = records(shuffled, {}), records(shuffled, {})
    text = plan(upsert(state, batch, F.current_timestamp(), full=False))
    assert "LeftSemi" in text and "FullOuter" not in text
    keys = shuffled.createDataFrame([("a", "b")], "source string, listing_id string")
    assert "Inner" in plan(mark_notified(state, keys, F.current_timestamp(), full=False))


def test_filters_and_columns_reach_the_scan(spark, folder):
    conform(records(spark, {}, {"status": "filtered_out"})).write.parquet(f"{folder}/state")
    df = spark.read.parquet(f"{folder}/state").filter("status = 'active'").select("source", "listing_id", "rent")
    text = plan(df)
    assert "EqualTo(status,active)" in text
    assert re.search(r"ReadSchema: struct<source:string,listing_id:string,rent:int,status:string>", text)


def test_state_reads_prune_the_snapshot(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    store.write(records(spark, {}, {}, {"status": "filtered_out"}), "whole")
    store.write(records(spark, {"rent": 1}))
    store.write(records(spark, {"rent": 2}))
    live = store.read().filter("status = 'active'").select("source", "listing_id", "rent")
    text = plan(live)
    snapshot = next(line for line in text.splitlines() if "FileScan" in line)
    assert "EqualTo(status,active)" in snapshot
    assert "struct<source:string,listing_id:string,rent:int,status:string>" in snapshot
    # The snapshot's side runs from the scan to the anti join without an exchange.
    before = text[text.index("LeftAnti") : text.index("FileScan")]
    assert "Exchange" not in before and "BroadcastHashJoin" in text
    assert sorted(r.rent for r in live.collect()) == [2, 18000]


def test_page_records_narrow_only_what_they_find(spark):
    """The page pass hands on Arrow batches, and no whole text is rewritten digit by digit to find numbers in it."""
    spark.conf.set("spark.sql.maxToStringFields", "1000")
    pages = spark.createDataFrame([(1, "https://x.example/en/1", "<p>租金１２,０００元 8坪")], "page_id int, url string, html string")
    web = SourceSpec(name="web", ordinal=1, detail_url_patterns=(r"example/en/(\d+)",))
    records, _ = extract_records(pages, web, gazetteer(spark))
    text = plan(records)
    spark.conf.unset("spark.sql.maxToStringFields")
    assert "MapInArrow" in text and "translate(text" not in text
    assert records.select("rent", "area_ping").first() == (12_000, 8.0)


def test_collection_broadcasts_nothing_of_guessed_size(spark):
    """What pages, cards and details come to isn't known from the files they began as; no side of theirs goes through the driver."""
    html = '<a href="https://rent.591.com.tw/204801">獨立套房 8坪 永和區 9,000 元/月</a>'
    pages = spark.createDataFrame([(1, 0, 0, "https://rent.591.com.tw/list?kind=2", html)], "page_id int, search int, page int, url string, html string")
    records, refused, kept = collect_source(pages, PORTAL, gazetteer(spark))
    assert [r.listing_id for r in records.collect()] == ["204801"]
    assert not any("BroadcastHashJoin" in plan(df) for df in (records, refused, kept))
