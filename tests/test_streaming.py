"""Streams give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listingflow.plans.runs import Rules, assess, backfill, deliver, ingest, watch
from listingflow.sources.store import RunLog, StateStore, high_water
from listingflow.streaming import diff as D
from listingflow.streaming import watch as W

from .fixtures import gazetteer, records
from .test_sources import LINKED_LIST, table

T0 = datetime(2026, 7, 19, 2, 20)


def write_parts(spark, folder, parts, ddl):
    """One file per part, older first."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def finish(query):
    query.awaitTermination()


def test_diff_stream_equals_batch(spark, folder):
    ddl = "key string, seq long, ts timestamp, cost double, flag boolean, active boolean"
    rows = [
        (f"k{i % 3}", i, T0 + timedelta(minutes=i), [None, 0.0, 9.0, 8.0, 12.0][i * 7 % 5], [None, True, False][i % 3 - i % 2], i % 4 != 0)
        for i in range(40)
    ]
    parts = [rows[:15], rows[15:30], rows[30:]]
    stream = write_parts(spark, folder, parts, ddl)
    store = D.last_rows(spark, f"{folder}/state", compact_after=2)
    finish(D.diff_stream(stream, store, f"{folder}/out", f"{folder}/c"))
    got = D.read_changes(spark, f"{folder}/out").select("key", "seq", "previous_cost", "is_new", "dropped", "gained", "relisted")
    batch = D.batch_changes(spark.createDataFrame(rows, ddl)).select(*got.columns)
    assert sorted(got.collect(), key=str) == sorted(batch.collect(), key=str) and got.count() == 40
    assert D.read_changes(spark, f"{folder}/out").select("batch").distinct().count() == 3
    assert {r.key: r.seq for r in store.read().collect()} == {r[0]: r[1] for r in rows}


def test_diff_stream_of_null_keys_late_rows_and_replays(spark, folder):
    ddl = "key string, seq long, ts timestamp, cost double, flag boolean, active boolean"
    first = [(None, 1, T0, 9.0, None, True), ("a", 2, T0 + timedelta(hours=5), 9.0, False, False), ("b", 3, T0, None, None, None)]
    # A row older than the known one, and a hot key in one moment.
    then = [("a", 4, T0, 8.0, True, True), (None, 5, T0, 7.0, True, True), *[("hot", 6 + i, T0, 1_000.0 - i, None, True) for i in range(300)]]
    stream = write_parts(spark, folder, [first, then], ddl)
    store = D.last_rows(spark, f"{folder}/state")
    finish(D.diff_stream(stream, store, f"{folder}/out", f"{folder}/c", ranges=5))
    got = {r.seq: r for r in D.read_changes(spark, f"{folder}/out").collect()}
    assert len(got) == 305 and [s for s, r in got.items() if r.is_new] and got[6].is_new and not got[7].is_new
    assert (got[4].previous_cost, got[4].dropped, got[4].gained, got[4].relisted) == (9.0, True, True, True)
    assert (got[5].previous_cost, got[5].dropped, got[5].gained, got[5].relisted) == (9.0, True, True, False)
    assert sum(r.dropped for r in got.values() if r.key == "hot") == 299
    assert {r.key: r.seq for r in store.read().collect()} == {None: 5, "a": 4, "b": 3, "hot": 305}
    before = store.version()
    finish(D.diff_stream(stream, store, f"{folder}/out", f"{folder}/c", ranges=5))
    assert store.version() == before and D.read_changes(spark, f"{folder}/out").count() == 305


def test_watch_run_end_to_end(spark, folder):
    rules = Rules(max_results=2, proximity=False)
    store, log = StateStore(spark, f"{folder}/state"), RunLog(spark, f"{folder}/log")
    from listingflow.sources.registry import extract_all
    from listingflow.sources.specs import RAKUYA

    found, _ = extract_all(table(spark, ("rakuya", "https://rent.rakuya.com.tw/a", LINKED_LIST)), gazetteer(spark), [RAKUYA])
    first = assess(found, rules)
    ingest(store, first, T0)
    result = watch(store, rules)
    (row,) = result.outbox.collect()
    assert row.listing_id == "77ab01" and row.reasons == ["新房源"] and "14,300 元" in row.message
    assert result.summary.first().message == "待通知 1 間（新房源 1）：大安區1間。"
    deliver(store, result.outbox, T0, log)
    assert watch(store, rules).outbox.count() == 0
    assert high_water(log.read()).first().completed_at == T0
    cheaper = assess(found.withColumn("rent", F.lit(12500)).withColumn("total_monthly_cost", F.lit(None).cast("int")), rules)
    ingest(store, cheaper, T0 + timedelta(hours=1))
    again = watch(store, rules).outbox
    assert again.first().reasons == ["價格下降 14300 -> 12500"]
    # Not delivered, so still pending.
    assert watch(store, rules).outbox.count() == 1
    assert backfill(cheaper, rules).count() == 1


def test_watch_stream_marks_only_what_was_delivered(spark, folder):
    ddl = "listing_id string, rent int, status string"
    stream = write_parts(spark, folder, [[("a", 9, "active"), ("b", 8, "active")], [("a", 7, "active"), ("c", 5, "filtered_out")]], ddl)
    store = StateStore(spark, f"{folder}/state")

    def to_records(batch):
        return batch.select(F.lit("s").alias("source"), "*")

    def run(deliver):
        finish(W.watch_stream(stream, store, f"{folder}/outbox", f"{folder}/check", Rules(), to_records, deliver))

    run(lambda outbox, batch_id: outbox.filter("listing_id = 'a'"))
    rows = {r.listing_id: r for r in store.read().collect()}
    assert rows["a"].rent == 7 and rows["a"].notified_snapshot.rent == 7 and rows["c"].status == "filtered_out"
    assert rows["b"].notified_snapshot is None
    outbox = spark.read.option("basePath", f"{folder}/outbox").json(f"{folder}/outbox/*/*")
    assert sorted((r.batch, r.listing_id, r.reasons[0]) for r in outbox.collect()) == [
        (0, "a", "新房源"), (0, "b", "新房源"), (1, "a", "價格下降 9 -> 7"), (1, "b", "新房源"),
    ]
    before = store.version()
    run(None)  # nothing new has arrived
    assert store.version() == before
    (stream_id,) = {v.stream for v in store.versions() if v.stream}
    assert store.find(stream_id, 1, "marks") and not store.find(stream_id, 2, "rows")


DDL = "listing_id string, rent int, status string"


def as_records(batch):
    return batch.select(F.lit("s").alias("source"), "*")


def test_a_fresh_checkpoint_loses_nothing(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    first = write_parts(spark, f"{folder}/1", [[("a", 9, "active")]], DDL)
    finish(W.watch_stream(first, store, f"{folder}/outbox", f"{folder}/check1", Rules(), as_records))
    second = write_parts(spark, f"{folder}/2", [[("a", 9, "active"), ("b", 8, "active")]], DDL)
    finish(W.watch_stream(second, store, f"{folder}/outbox", f"{folder}/check2", Rules(), as_records))
    assert sorted(r.listing_id for r in store.read().collect()) == ["a", "b"]
    assert len({v.stream for v in store.versions() if v.stream}) == 2


def test_a_replay_after_delivery_announces_the_same(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    stream = write_parts(spark, folder, [[(x, 5, "active") for x in "abcd"]], DDL)
    told = []

    def fails_once(outbox, batch_id):
        told.append(sorted(r.listing_id for r in outbox.collect()))
        if len(told) == 1:
            raise RuntimeError("sent, but not marked")
        return outbox

    def run():
        finish(W.watch_stream(stream, store, f"{folder}/outbox", f"{folder}/check", Rules(max_results=2), as_records, fails_once))

    with pytest.raises(Exception, match="sent, but not marked"):
        run()
    run()
    assert told[0] == told[1] and len(told[0]) == 2
    marked = {r.listing_id for r in store.read().collect() if r.notified_snapshot}
    assert marked == set(told[0])
    steps = [(v.step, v.kind) for v in store.versions()]
    assert steps == [("rows", "changes"), ("outbox", "step"), ("marks", "changes")]


def test_refused_pages_are_kept(spark, folder):
    store = StateStore(spark, f"{folder}/state")
    stream = write_parts(spark, folder, [[("a", 9, "active"), ("b", 9, "refused")]], DDL)

    def split(batch):
        return as_records(batch.filter("status = 'active'")), batch.filter("status = 'refused'").select("listing_id")

    finish(W.watch_stream(stream, store, f"{folder}/outbox", f"{folder}/check", Rules(), split, quarantine=f"{folder}/refused"))
    assert [r.listing_id for r in spark.read.json(f"{folder}/refused").collect()] == ["b"]
    assert [r.listing_id for r in store.read().collect()] == ["a"]


def test_first_seen_and_exact_form(spark, folder):
    ddl = "source string, listing_id string, ts timestamp"
    parts = [[("s", "a", T0), ("s", "a", T0), ("s", "b", T0)], [("s", "a", T0 + timedelta(minutes=5))]]
    stream = write_parts(spark, folder, parts, ddl)
    finish(
        W.first_seen_stream(stream, ["source", "listing_id"], "ts", "1 day").writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
    )
    assert sorted(r.listing_id for r in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b"]
    state = records(spark, {"source": "s", "listing_id": "a"})
    batch = spark.createDataFrame([("s", "a"), ("s", "z")], "source string, listing_id string")
    assert [r.listing_id for r in W.unseen(batch, state).collect()] == ["z"]
