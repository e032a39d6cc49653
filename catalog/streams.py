"""Streaming forms, run to the end of the events table and read back as tables."""

import uuid

from pyspark.sql import functions as F

from listingflow.checkpoint import shared_folder
from listingflow.plans.runs import Rules
from listingflow.sources.store import StateStore
from listingflow.streaming import diff as D
from listingflow.streaming import watch as W

from .state import FLAG_SQL
from .tables import load, query


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _stream(spark, sf):
    schema = load(spark, sf, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    stream = reader.option("maxBytesPerTrigger", 1 << 30).parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(stream, spark, mode="append"):
    """Write to parquet until the input is exhausted, then read the result."""
    folder = _folder(spark)
    done = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


OBS = ("CAST(floor(value * 100) AS DOUBLE) AS cost", f"{FLAG_SQL.format(0)} AS flag", "event_type <> 'error' AS active")


@query(f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, ts, {', '.join(OBS)} FROM events),
    l AS (SELECT *, lag(cost) OVER w AS pc, lag(flag) OVER w AS pf, lag(active) OVER w AS pa, row_number() OVER w = 1 AS is_new
        FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, seq))
    SELECT key, seq, cost, pc AS previous_cost, is_new,
        coalesce(NOT is_new AND pc <> 0 AND cost <> 0 AND cost < pc, FALSE) AS dropped,
        NOT is_new AND coalesce(flag, FALSE) AND pf IS DISTINCT FROM TRUE AS gained, NOT is_new AND active AND NOT pa AS relisted FROM l""")
def stream_diff(spark, sf):
    """Events in three files, older first, as three micro-batches."""
    folder = _folder(spark)
    observed = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", *[F.expr(e) for e in OBS]
    )
    first, last = load(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    borders = [first + (last - first) * i / 3 for i in (1, 2)] if first else []
    parts = [F.lit(True), *[F.col("ts") >= F.lit(b) for b in borders]]
    for i, (since, until) in enumerate(zip(parts, [~p for p in parts[1:]] + [F.lit(True)], strict=True)):
        observed.filter(since & until).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    stream = spark.readStream.schema(observed.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    store = D.last_rows(spark, f"{folder}/state")
    D.diff_stream(stream, store, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return D.read_changes(spark, f"{folder}/out").drop("ts", "stream", "batch")


@query(f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, ts, {', '.join(OBS)} FROM events),
    l AS (SELECT *, lag(cost) OVER w AS pc, lag(flag) OVER w AS pf, lag(active) OVER w AS pa, row_number() OVER w = 1 AS is_new
        FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, seq))
    SELECT key, seq, cost, pc AS previous_cost, is_new,
        coalesce(NOT is_new AND pc <> 0 AND cost <> 0 AND cost < pc, FALSE) AS dropped,
        NOT is_new AND coalesce(flag, FALSE) AND pf IS DISTINCT FROM TRUE AS gained, NOT is_new AND active AND NOT pa AS relisted FROM l""")
def batch_diff(spark, sf):
    observed = load(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), "ts", *[F.expr(e) for e in OBS]
    )
    return D.batch_changes(observed).drop("ts")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf):
    # The horizon spans the table, so each key comes out exactly once.
    firsts = W.first_seen_stream(_stream(spark, sf), ["user_id", "event_type"], "ts", "400 days")
    return _finish(firsts, spark).select("user_id", "event_type")


@query("""
    WITH l AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000 AS gap
        FROM events),
    s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM l),
    g AS (SELECT user_id, n, min(ts) AS started_at, max(ts) + INTERVAL 6 HOURS AS ends_at, count(*) AS observations FROM s GROUP BY ALL)
    SELECT user_id, started_at, ends_at, observations FROM g WHERE ends_at <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, sf):
    return _finish(W.session_stream(_stream(spark, sf), ["user_id"], "ts", "6 hours", "1 hour"), spark)


@query("""
    WITH f AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS listing_id, CAST(floor(value * 100) AS INT) AS rent,
        event_id % 5 = 0 AS bad FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) = 1),
    t AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rent <> 0 THEN greatest(0, (18600 - rent) / 300.0) ELSE 0 END DESC, source, listing_id) AS rn
        FROM f WHERE NOT bad)
    SELECT f.source, f.listing_id, f.rent, CASE WHEN f.bad THEN 'filtered_out' ELSE 'active' END AS status,
        CASE WHEN t.rn <= 20 THEN f.rent END AS told_rent
    FROM f LEFT JOIN t ON t.source = f.source AND t.listing_id = f.listing_id""")
def stream_watch(spark, sf):
    """Events as records: ingested in micro-batches, the best twenty announced and marked."""
    folder = _folder(spark)
    store = StateStore(spark, f"{folder}/state")

    def to_records(batch):
        return batch.select(
            F.col("event_type").alias("source"),
            F.col("user_id").cast("string").alias("listing_id"),
            F.floor(F.col("value") * 100).cast("int").alias("rent"),
            F.when(F.col("event_id") % 5 == 0, "filtered_out").otherwise("active").alias("status"),
            F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("first_seen_at"),
            (-F.col("event_id")).alias("pos"),
        )

    W.watch_stream(
        _stream(spark, sf), store, f"{folder}/outbox", f"{folder}/checkpoint", Rules(max_results=20),
        to_records, deliver=lambda outbox, batch_id: outbox,
    ).awaitTermination()
    return store.read().select(
        "source", "listing_id", "rent", "status", F.col("notified_snapshot.rent").alias("told_rent")
    )


BATCHES, TOP = 3, 20


def _outbox_sql() -> str:
    """State and outbox batch by batch: what every other place of the outbox told is not told again."""
    parts = [f"""e AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS listing_id, CAST(floor(value * 100) AS INT) AS rent,
        event_id // {BATCHES} % 5 <> 0 AS live, CAST(event_id % {BATCHES} AS INT) AS batch FROM events
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id, event_id % {BATCHES} ORDER BY event_id DESC) = 1),
    d0 AS (SELECT source, listing_id, rent, live, CAST(NULL AS INT) AS told, FALSE AS back FROM e WHERE FALSE)"""]
    for b in range(BATCHES):
        parts.append(f"""
    s{b} AS (SELECT coalesce(n.source, o.source) AS source, coalesce(n.listing_id, o.listing_id) AS listing_id,
            CASE WHEN n.source IS NULL THEN o.rent ELSE n.rent END AS rent, coalesce(n.live, o.live) AS live, o.told,
            coalesce(o.back, FALSE) OR coalesce(n.live AND NOT o.live, FALSE) AS back
        FROM (SELECT * FROM e WHERE batch = {b}) n FULL JOIN d{b} o ON o.source = n.source AND o.listing_id = n.listing_id),
    r{b} AS (SELECT *, CASE WHEN told IS NULL THEN '新房源' ELSE concat_ws(';', CASE WHEN told > 0 AND rent <> 0 AND rent < told
            THEN '價格下降 ' || told || ' -> ' || rent END, CASE WHEN back THEN '重新上架' END) END AS reasons FROM s{b} WHERE live),
    p{b} AS (SELECT *, CASE WHEN told IS NULL THEN 0 WHEN starts_with(reasons, '價格下降') THEN 1 ELSE 2 END AS priority FROM r{b} WHERE reasons <> ''),
    o{b} AS (SELECT {b} AS batch, CAST(row_number() OVER (ORDER BY priority, CASE WHEN rent <> 0 THEN greatest(0, (18600 - rent) / 300.0) ELSE 0 END DESC,
            source, listing_id) AS INT) AS position, source, listing_id, CAST(priority AS INT) AS priority, reasons FROM p{b} QUALIFY position <= {TOP}),
    d{b + 1} AS (SELECT s.source, s.listing_id, s.rent, s.live, CASE WHEN o.position IS NULL THEN s.told ELSE s.rent END AS told,
            s.back AND o.position IS NULL AS back FROM s{b} s LEFT JOIN o{b} o ON o.source = s.source AND o.listing_id = s.listing_id AND o.position % 2 = 1)""")
    told = " UNION ALL ".join(f"SELECT batch, 'told' AS kind, position, source, listing_id, priority, reasons, CAST(NULL AS INT) AS told_rent FROM o{b}" for b in range(BATCHES))
    return f"""WITH {','.join(parts)}
    {told} UNION ALL SELECT {BATCHES}, 'state', NULL, source, listing_id, NULL, NULL, told FROM d{BATCHES}"""


@query(_outbox_sql())
def stream_outbox(spark, sf):
    """Events arrive three times; after each the stream resumes, announces, and delivers every other message only."""
    folder = _folder(spark)
    store = StateStore(spark, f"{folder}/state")
    events = load(spark, sf, "events").select("event_id", "user_id", "event_type", "value")

    def to_records(batch):
        return batch.select(
            F.col("event_type").alias("source"),
            F.col("user_id").cast("string").alias("listing_id"),
            F.floor(F.col("value") * 100).cast("int").alias("rent"),
            F.when(F.floor(F.col("event_id") / BATCHES) % 5 == 0, "filtered_out").otherwise("active").alias("status"),
            F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("first_seen_at"),
            (-F.col("event_id")).alias("pos"),
        )

    for b in range(BATCHES):
        events.filter(F.col("event_id") % BATCHES == b).write.mode("append").parquet(f"{folder}/in")
        W.watch_stream(
            spark.readStream.schema(events.schema).parquet(f"{folder}/in"), store, f"{folder}/outbox", f"{folder}/checkpoint",
            Rules(max_results=TOP), to_records, deliver=lambda outbox, _: outbox.filter("position % 2 = 1"),
        ).awaitTermination()
    told = spark.read.schema(f"{W.OUTBOX_DDL}, batch int").option("basePath", f"{folder}/outbox").json(f"{folder}/outbox/stream=*")
    told = told.select("batch", F.lit("told").alias("kind"), "position", "source", "listing_id", "priority", F.array_join("reasons", ";").alias("reasons"))
    state = store.read().select(
        F.lit(BATCHES).alias("batch"), F.lit("state").alias("kind"), "source", "listing_id", F.col("notified_snapshot.rent").alias("told_rent")
    )
    return told.unionByName(state, allowMissingColumns=True)
