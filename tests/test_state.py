import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from listingflow.operators import outbox as O
from listingflow.operators.state import (
    PENDING_ORDER,
    get,
    mark_notified,
    mark_status,
    pending,
    read_evolved,
    recent_records,
    snapshot_json,
    upsert,
)
from listingflow.schema import KEY, RECORD_COLUMNS, RECORD_DDL, record_schema
from listingflow.sources.log import Files, Version, VersionExpired, VersionLog, VersionTaken
from listingflow.sources.store import RunLog, StateStore, StateView, high_water

from .fixtures import records

T0 = datetime(2026, 7, 19, 2, 20)
FIELDS = list(RECORD_COLUMNS)


class Sequence:
    """Applies steps to one state, as runs would."""

    def __init__(self, spark):
        self.spark = spark
        self.state = spark.createDataFrame([], RECORD_DDL)
        self.hour = 0

    def up(self, *changes):
        self.hour += 1
        now = F.lit(T0.replace(hour=self.hour))
        self.last = upsert(self.state, records(self.spark, *changes), now)
        self._keep(self.last.select(*FIELDS))

    def notify(self, *ids):
        keys = self.spark.createDataFrame([("fixture", i) for i in ids], "source string, listing_id string")
        self._keep(mark_notified(self.state, keys, F.lit(T0)))

    def _keep(self, df):
        self.state = self.spark.createDataFrame(df.collect(), record_schema())

    def pending(self):
        rows = pending(self.state).orderBy(*PENDING_ORDER).collect()
        return [(r.listing_id, r.reasons, r.priority) for r in rows]


def test_new_then_price_and_flag(spark):
    s = Sequence(spark)
    s.up({})
    assert s.pending() == [("r000", ["新房源"], 0)]
    s.notify("r000")
    assert s.pending() == []
    s.up({"rent": 16000, "total_monthly_cost": 16000, "has_rent_subsidy": True})
    assert s.pending() == [("r000", ["價格下降 18000 -> 16000", "新增租補標記"], 1)]
    row = s.state.first()
    assert row.notified_snapshot.rent == 18000 and row.first_seen_at.hour == 1 and row.last_seen_at.hour == 2


def test_rebound_cancels_a_drop(spark):
    s = Sequence(spark)
    s.up({})
    s.notify("r000")
    s.up({"rent": 15000, "total_monthly_cost": 15000})
    assert s.pending()[0][2] == 1
    s.up({"rent": 19000, "total_monthly_cost": 19000})
    assert s.pending() == []


def test_relisting_sticks_until_announced(spark):
    s = Sequence(spark)
    s.up({})
    s.notify("r000")
    s.up({"status": "filtered_out"})
    assert s.pending() == []
    s.up({})
    assert s.last.select("important_changes").first()[0] == ["重新上架"]
    s.up({})
    assert s.pending() == [("r000", ["重新上架"], 2)]
    s.notify("r000", "unknown")
    assert s.pending() == []


def test_priorities_and_order(spark):
    s = Sequence(spark)
    s.up({}, {})
    s.notify("r000", "r001")
    flags = dict.fromkeys(
        ("has_rent_subsidy", "has_tax_registration", "has_independent_washer", "has_garbage_collection"), True
    )
    s.up({"rent": 1, "total_monthly_cost": 17000}, flags, {})
    assert s.pending() == [
        ("r002", ["新房源"], 0),
        ("r000", ["價格下降 18000 -> 17000"], 1),
        ("r001", ["新增租補標記", "新增可報稅標記", "新增獨立洗衣機資訊", "新增垃圾代收資訊"], 2),
    ]


def test_suppression_is_inherited(spark):
    s = Sequence(spark)
    s.up({"notification_suppressed": True})
    s.up({})
    assert s.pending() == [] and s.state.first().notification_suppressed is True


def test_upsert_twice_changes_nothing_but_last_seen(spark):
    s = Sequence(spark)
    s.up({}, {"rent": 9000})
    before = sorted(s.state.drop("last_seen_at").collect(), key=lambda r: r.listing_id)
    s.up({}, {"rent": 9000})
    assert sorted(s.state.drop("last_seen_at").collect(), key=lambda r: r.listing_id) == before
    assert s.last.filter("is_new").count() == 0 and s.last.filter("size(important_changes) > 0").count() == 0


def test_incremental_form_returns_only_the_batch(spark):
    s = Sequence(spark)
    s.up({}, {}, {})
    part = upsert(s.state, records(spark, {"rent": 5}), F.lit(T0), full=False)
    assert [r.listing_id for r in part.collect()] == ["r000"]
    marked = mark_notified(s.state, part, F.lit(T0), full=False).collect()
    assert [r.listing_id for r in marked] == ["r000"]


def test_legacy_tables(spark):
    rows = records(spark, {"has_rent_subsidy": True})
    old = rows.drop("notified_snapshot", "has_garbage_collection")
    got = read_evolved(old)
    assert got.columns == FIELDS and got.first().notified_snapshot.rent == 18000
    assert pending(got).count() == 0 and got.first().last_notified_at is None
    kept = read_evolved(rows)
    assert kept.first().notified_snapshot is None


def test_snapshot_text(spark):
    df = records(spark, {"has_rent_subsidy": True}).select(F.struct(*FIELDS).alias("r"))
    text = df.select(snapshot_json(F.col("r")).alias("t")).first().t
    assert text == (
        '{"has_garbage_collection":null,"has_independent_washer":null,"has_rent_subsidy":true,'
        '"has_tax_registration":null,"rent":18000,"status":"active","total_monthly_cost":18000}'
    )


def test_reads(spark):
    s = Sequence(spark)
    s.up({}, {})
    s.up({"rent": 1})
    assert [r.listing_id for r in recent_records(s.state, 2).collect()] == ["r000", "r001"]
    keys = spark.createDataFrame([("fixture", "r001")], "source string, listing_id string")
    assert get(s.state, keys).count() == 1
    gone = mark_status(s.state, keys, "filtered_out", F.lit(T0))
    assert gone.filter("status = 'filtered_out'").count() == 1


def test_store_versions(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    assert store.version() == 0 and store.read().count() == 0
    store.write(upsert(store.read(), records(spark, {}, {}), F.lit(T0)), "whole")
    store.write(upsert(store.read(), records(spark, {"rent": 7}), F.lit(T0), full=False))
    assert store.version() == 2
    assert {r.listing_id: r.rent for r in store.read().collect()} == {"r000": 7, "r001": 18000}
    store.compact()
    assert store.version() == 3 and store.read().count() == 2


def test_a_crashed_write_blocks_nothing(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    store.write(records(spark, {}), "whole")
    spark.range(1).write.parquet(f"{folder}/state/data/halfway")  # data without a manifest
    assert store.write(records(spark, {"rent": 5})) == 2
    assert [r.rent for r in store.read().collect()] == [5]


def test_two_writers_cannot_take_one_number(spark, folder):
    one, two = StateStore(spark, f"{folder}/state"), StateStore(spark, f"{folder}/state")
    one.write(records(spark, {}), "whole")
    base = two.version()
    one.write(records(spark, {"rent": 5}), based_on=base)
    with pytest.raises(VersionTaken):
        two.write(records(spark, {"rent": 6}), based_on=base)
    with pytest.raises(VersionTaken):
        two.log.publish(Version(2, "changes"))
    assert [r.rent for r in one.read().collect()] == [5]


def test_a_batch_beside_a_compaction_stays(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    store.write(records(spark, {}, {}), "whole")
    store.write(records(spark, {"rent": 5}))
    upto = store.version()
    snapshot = store.read(upto)
    snapshot.write.parquet(store._data("folded"))
    store.write(records(spark, {"rent": 6}))  # commits while the snapshot is made
    store.publish("whole", "folded", covers=upto)
    assert {r.listing_id: r.rent for r in store.read().collect()} == {"r000": 6, "r001": 18000}
    store.compact()
    assert {r.listing_id: r.rent for r in store.read().collect()} == {"r000": 6, "r001": 18000}


def test_many_changes_are_folded(spark, folder):
    store = StateStore(spark, f"{folder}/state", compact_after=3)
    for rent in range(1, 8):
        store.write(records(spark, {"rent": rent}))
    kinds = [v.kind for v in store.versions()]
    assert kinds.count("whole") == 2 and [r.rent for r in store.read().collect()] == [7]
    log = RunLog(spark, f"{folder}/log")
    assert log.read().count() == 0
    log.record("watch", T0)
    log.record("watch", T0.replace(hour=5))
    assert high_water(log.read()).first().completed_at.hour == 5


def waiting(spark, *rows):
    base = records(spark, *[r for r, _, _ in rows])
    extra = spark.createDataFrame(
        [(f"r{i:03d}", reasons, p) for i, (_, reasons, p) in enumerate(rows)],
        "listing_id string, reasons array<string>, priority int",
    )
    return base.join(extra, "listing_id")


def test_groups_stand_together(spark):
    districts = ["大安區", "萬華區", "大安區", "新店區", "萬華區"]
    df = waiting(spark, *[({"district": d}, ["新房源"], 0) for d in districts])
    rows, order = O.contiguous_order(df, [F.col("listing_id")])
    assert [r.listing_id for r in rows.orderBy(*order).collect()] == ["r000", "r002", "r001", "r004", "r003"]
    hot, order = O.contiguous_order(df.repartition(5), [F.col("listing_id")])
    assert [r.listing_id for r in hot.orderBy(*order).collect()] == ["r000", "r002", "r001", "r004", "r003"]


def test_priority_before_rank(spark):
    df = waiting(
        spark,
        ({"near_ntu_score": 100}, ["重新上架"], 2),
        ({"near_ntu_score": 100}, ["價格下降 9 -> 8"], 1),
        ({"near_ntu_score": 10}, ["新房源"], 0),
    )
    top = O.watch_top_n(df, 10).orderBy("position").collect()
    assert [r.listing_id for r in top] == ["r002", "r001", "r000"]


def test_watch_groups_then_cuts(spark):
    df = waiting(
        spark,
        ({"near_ntu_score": 90, "district": "大安區"}, ["新房源"], 0),
        ({"near_ntu_score": 80, "district": "萬華區"}, ["新房源"], 0),
        ({"near_ntu_score": 10, "district": "大安區"}, ["新房源"], 0),
    )
    assert [r.listing_id for r in O.watch_top_n(df, 2).orderBy("position").collect()] == ["r000", "r002"]


def test_summary_text(spark):
    df = waiting(
        spark,
        ({"district": "大安區", "near_ntu_score": 9}, ["新房源"], 0),
        ({"district": "大安區", "near_ntu_score": 8}, ["新房源"], 0),
        ({"district": "新店區"}, ["價格下降 9 -> 8", "新增租補標記"], 1),
        ({"district": None, "city": None}, ["重新上架"], 2),
    )
    top = O.watch_top_n(df, 2)
    rows, order = O.order_outbox(df)
    assert O.run_summary(rows, top, order).first().message == (
        "待通知 4 間（新房源 2、價格下降 1、其他更新 1）：大安區2間、新店區1間、未知區1間。"
        "這次依新房源、價格下降、其他更新的順序先傳 2 間：大安區2間。"
    )
    assert [r.candidate for r in O.summary_labels(rows, top, order).orderBy("first_all").collect()] == [2, 1, 1]
    none = df.filter("1 = 0")
    rows, order = O.order_outbox(none)
    assert O.run_summary(rows, O.watch_top_n(none, 2), order).first().message == "待通知 0 間：0間。"


def test_summary_of_many_labels(spark):
    """Texts of ranges of labels, joined in order, are the text of all."""
    rows = spark.range(500).select(
        F.format_string("區%03d", (F.col("id") * 7) % 250).alias("district"), F.lit(None).cast("string").alias("city"),
        F.array(F.lit("新房源")).alias("reasons"), F.col("id").alias("o"), (F.col("id") + 1).alias("position"),
    )
    got = O.run_summary(rows, rows.filter("position <= 60"), ["o"], chunk=16).first()
    names = [f"區{i * 7 % 250:03d}" for i in range(500)]
    first = list(dict.fromkeys(names))
    assert (got.n_candidates, got.n_sending, got.n_new) == (500, 60, 500)
    assert got.message.split("：")[1] == "、".join(f"{x}2間" for x in first) + "。這次依新房源、價格下降、其他更新的順序先傳 60 間"
    assert got.message.split("：")[2] == "、".join(f"{x}1間" for x in first[:60]) + "。"


def test_message(spark):
    import json

    df = waiting(
        spark,
        (
            {
                "address": "和平東路", "image_urls": ["u1", "u2", "u3"], "has_rent_subsidy": True,
                "near_ntu_score": 50, "score_confidence": "low", "score_reason": "r", "description": "d" * 400,
                "first_seen_at": T0, "last_seen_at": T0,
            },
            ["價格下降 9 -> 8"], 1,
        ),
        ({"rent": None, "commute_minutes": 12, "score_method": "google_routes"}, [], 0),
    )
    got = [json.loads(r.m) for r in df.orderBy("listing_id").select(O.message().alias("m")).collect()]
    names = [f["name"] for f in got[0]["fields"]]
    assert names == [
        "重要更新", "地區/地址", "月租/總月租", "坪數", "房型", "樓層", "是否租補", "是否可報稅",
        "是否獨立洗衣機", "垃圾代收", "距台大", "更新時間/首次看到", "其他圖片",
    ]
    value = {f["name"]: f["value"] for f in got[0]["fields"]}
    assert got[0]["title"] == "台北市大安區獨立套房 - 18,000 元" and got[0]["color"] == 0xF2A93B
    assert value["距台大"] == "近似 50/100（低信心；r）" and value["其他圖片"] == "u2\nu3"
    assert value["更新時間/首次看到"] == "2026-07-19 02:20 / 2026-07-19 02:20"
    assert len(got[0]["description"]) == 300 and got[0]["image"] == {"url": "u1"}
    assert got[1]["title"] == "台北市大安區獨立套房" and got[1]["color"] == 0x42A66A and "image" not in got[1]
    assert {f["name"]: f["value"] for f in got[1]["fields"]}["距台大"] == "12 分鐘（Google Routes）"
    hidden = df.select(O.message(show_proximity=False).alias("m")).first().m
    assert "距台大" not in hidden


def test_a_log_of_10_000_versions_is_read_in_a_bounded_number_of_files(folder):
    writer = VersionLog(Files(folder), every=100, keep=1_000)
    for n in range(1, 10_001):
        kind = "whole" if n % 50 == 0 else "step" if n % 7 == 0 else "changes"
        covers = n - 1 if kind == "whole" else 0
        writer.publish(Version(n, kind, None if kind == "step" else f"a{n}", covers, "q", n // 3, f"s{n % 3}"))
    files = Files(folder)
    reader = VersionLog(files, every=100)
    state = reader.latest()
    assert state.number == 10_000 and state.whole.attempt == "a10000" and state.changes == ()
    assert files.reads < 10
    assert [v.number for v in state.streams["q"].values()] == [9_999, 10_000]
    files.reads = 0
    assert [c.number for c in reader.at(9_957).changes] == [9_951, 9_952, 9_953, 9_955, 9_956, 9_957]
    assert files.reads < 120
    gone: list[str] = []
    idle = VersionLog(Files(folder), every=100)
    idle.state = VersionLog(Files(folder), every=100).at(50)  # a reader that last looked long ago
    assert reader.trim(gone.append) == 9_000
    assert "a8999" in gone and "a9000" not in gone and len(gone) == len(set(gone))
    assert reader.trim(gone.append) == 0
    fresh = VersionLog(Files(folder), every=100)
    assert fresh.latest() == reader.latest() and idle.latest() == reader.latest()
    assert fresh.at(9_001).number == 9_001 and fresh.all()[0].number == 9_001
    with pytest.raises(VersionExpired):
        fresh.at(8_999)
    fresh.publish(Version(10_001, "changes", "b"))
    assert reader.latest().changes[-1].attempt == "b"


def test_a_store_without_atomic_names_needs_a_conditional_put(folder):
    taken: dict[str, bytes] = {}
    files = Files(folder, put_if_absent=lambda path, content: taken.setdefault(path, content) is content)
    log = VersionLog(files)
    log.publish(Version(1, "changes", "a"))
    with pytest.raises(VersionTaken):
        log.publish(Version(1, "changes", "b"))
    assert len(taken) == 1
    with pytest.raises(ValueError, match="put_if_absent"):
        Files("mock://bucket/state")


def test_old_snapshots_are_deleted(spark, folder):
    store = StateStore(spark, f"{folder}/state", compact_after=1)
    store.log.every, store.log.keep = 2, 2
    for rent in range(1, 7):
        store.write(records(spark, {"rent": rent}))
    assert [r.rent for r in store.read().collect()] == [6]
    assert len(os.listdir(f"{folder}/state/data")) < 8 and len(store.versions()) < 12


def test_a_view_follows_the_state_without_reading_it(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    view = StateView(store, "pending", pending)
    assert view.refresh().count() == 0
    store.write(records(spark, *[{"rent": i} for i in range(20)]), "whole")
    assert view.refresh().count() == 20

    def ids(rows):
        return sorted(r.listing_id for r in pending(rows).collect())

    draw = random.Random(4)
    for _ in range(6):
        batch = records(spark, *[{"rent": draw.randint(1, 50), "status": draw.choice(["active", "filtered_out"])} for _ in range(4)])
        store.write(upsert(store.read(), batch, F.lit(T0), full=False))
        if draw.random() < 0.5:
            told = pending(store.read()).select(*KEY).limit(3)
            store.write(mark_notified(store.read(), told, F.lit(T0), full=False))
        rows = view.refresh()
        assert ids(rows) == ids(store.read())
        assert not any("/state/data/" in f for f in rows.inputFiles())
    store.compact()
    assert ids(view.refresh()) == ids(store.read())
    view.own.compact()
    assert view.own.read().count() == len(ids(store.read()))
    late = StateView(store, "pending2", pending)
    assert ids(late.refresh()) == ids(store.read())
