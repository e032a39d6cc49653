"""Keyed state and history over events: one key per (event type, user)."""

from pyspark.sql import functions as F

from listingflow.operators import history as H
from listingflow.operators import state as S
from listingflow.operators.dedupe import first_wins
from listingflow.operators.stop_rule import kept_pages
from listingflow.plans.search import catch_up_pages
from listingflow.schema import FLAG_COLUMNS, SNAPSHOT_DDL, conform
from listingflow.sources.store import high_water
from listingflow.streaming.watch import unseen

from .tables import load, query

SPLIT = "2024-01-16"
FLAG_SQL = "CASE (event_id + {0}) % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END"
RECORD = {
    "event_id": "event_id",
    "ts": "ts",
    "source": "event_type",
    "listing_id": "CAST(user_id AS STRING)",
    "rent": "CASE WHEN event_id % 31 = 0 THEN NULL ELSE CAST(floor(value * 100) AS INT) END",
    "total_monthly_cost": "CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN CAST(floor(value * 100) AS INT) + 50 ELSE NULL END",
    **{f: FLAG_SQL.format(i) for i, f in enumerate(FLAG_COLUMNS)},
    "status": "CASE WHEN event_id % 5 = 0 THEN 'filtered_out' ELSE 'active' END",
    "notification_suppressed": "CASE event_id % 23 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "notification_relisted": "CASE WHEN event_id % 19 = 0 THEN TRUE ELSE NULL END",
}
# Snapshot of what was announced, for a third of the stored rows.
SNAP = {
    "rent": "CAST(floor(value * 100) AS INT) + CAST(event_id % 5 - 2 AS INT) * 300",
    "total_monthly_cost": "CASE WHEN event_id % 2 = 0 THEN 0 ELSE NULL END",
    **{f: FLAG_SQL.format(i + 2) for i, f in enumerate(FLAG_COLUMNS)},
    "status": "CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'active' END",
}


def _latest(where: str | None) -> str:
    kept = f"WHERE ts {where} TIMESTAMP '{SPLIT}'" if where else ""
    cols = ", ".join(f"{e} AS {n}" for n, e in RECORD.items())
    snap = ", ".join(f"CASE WHEN event_id % 3 = 0 THEN {e} END AS n_{n}" for n, e in SNAP.items())
    return f"""SELECT {cols}, {snap}, CASE WHEN event_id % 3 = 0 THEN ts END AS told_at FROM events {kept}
        QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1"""


def _rows(spark, sf, before: bool | None):
    """The newest event of each key as a record: of those before the split, after it, or all."""
    part = load(spark, sf, "events")
    if before is not None:
        part = part.filter(F.col("ts") < SPLIT if before else F.col("ts") >= SPLIT)
    last = first_wins(part, ["event_type", "user_id"], [F.desc("ts"), F.desc("event_id")])
    cols = [F.expr(e).alias(n) for n, e in RECORD.items()]
    if before is not False:
        snap = F.struct(*[F.expr(e).alias(n) for n, e in SNAP.items()]).cast(SNAPSHOT_DDL)
        cols += [
            F.when(F.col("event_id") % 3 == 0, snap).alias("notified_snapshot"),
            F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("last_notified_at"),
            F.col("ts").alias("first_seen_at"),
            F.col("ts").alias("last_seen_at"),
        ]
    return conform(last.select(*cols))


NOW = "TIMESTAMP '2024-02-01 00:00:00'"
COST = "coalesce(nullif({0}total_monthly_cost, 0), {0}rent)"
OLD, NEW = COST.format("o."), COST.format("n.")


def _flag_changes(old: str, new: str) -> str:
    labels = ("新增租補標記", "新增可報稅標記", "新增獨立洗衣機資訊", "新增垃圾代收資訊")
    return ", ".join(
        f"CASE WHEN {old}{f} IS DISTINCT FROM TRUE AND {new}{f} THEN '{t}' END"
        for f, t in zip(FLAG_COLUMNS, labels, strict=True)
    )


def _drop(old: str, new: str) -> str:
    return f"CASE WHEN {old} <> 0 AND {new} <> 0 AND {new} < {old} THEN '價格下降 ' || {old} || ' -> ' || {new} END"


CHANGES = f"""concat_ws(';', {_drop(OLD, NEW)}, {_flag_changes('o.', 'n.')},
    CASE WHEN o.status <> 'active' AND n.status = 'active' THEN '重新上架' END)"""
UPSERT = f"""
    WITH o AS ({_latest('<')}), n AS ({_latest('>=')}),
    u AS (SELECT coalesce(n.source, o.source) AS source, coalesce(n.listing_id, o.listing_id) AS listing_id,
        n.source IS NOT NULL AS in_batch, n.source IS NOT NULL AND o.source IS NULL AS is_new,
        CASE WHEN o.source IS NOT NULL THEN o.ts ELSE {NOW} END AS first_seen_at,
        CASE WHEN n.source IS NOT NULL THEN {NOW} ELSE o.ts END AS last_seen_at, o.told_at AS last_notified_at,
        {", ".join(f"CASE WHEN n.source IS NOT NULL THEN n.{c} ELSE o.{c} END AS {c}"
                   for c in ("rent", "total_monthly_cost", *FLAG_COLUMNS, "status"))},
        coalesce(n.notification_suppressed, o.notification_suppressed) AS notification_suppressed,
        CASE WHEN n.source IS NOT NULL AND o.status <> 'active' AND n.status = 'active' THEN TRUE
            ELSE coalesce(n.notification_relisted, o.notification_relisted) END AS notification_relisted,
        {", ".join(f"o.n_{c}" for c in SNAP)},
        CASE WHEN n.source IS NOT NULL AND o.source IS NOT NULL THEN {CHANGES} ELSE '' END AS changes
        FROM o FULL JOIN n ON o.source = n.source AND o.listing_id = n.listing_id)"""
KEYS = ("source", "listing_id")
OUT = (
    *KEYS, "first_seen_at", "last_seen_at", "last_notified_at", "rent", "total_monthly_cost", *FLAG_COLUMNS, "status",
    "notification_suppressed", "notification_relisted",
)


def _upserted(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return S.upsert(_rows(spark, sf, True), _rows(spark, sf, False), now)


@query(UPSERT + f"SELECT {', '.join(OUT)}, is_new, in_batch FROM u")
def upsert_state(spark, sf):
    return _upserted(spark, sf).select(*OUT, "is_new", "in_batch")


@query(UPSERT + "SELECT source, listing_id, changes FROM u WHERE changes <> ''")
def important_changes(spark, sf):
    got = _upserted(spark, sf).filter(F.size("important_changes") > 0)
    return got.select(*KEYS, F.array_join("important_changes", ";").alias("changes"))


U_COST = COST.format("")
SNAP_COST = "CASE WHEN n_total_monthly_cost > 0 THEN n_total_monthly_cost WHEN n_rent > 0 THEN n_rent END"
PENDING = f""", p AS (SELECT *, CASE WHEN n_status IS NULL THEN '新房源' ELSE concat_ws(';', {_drop(f'({SNAP_COST})', U_COST)},
        {_flag_changes('n_', '')}, CASE WHEN n_status <> 'active' OR coalesce(notification_relisted, FALSE) THEN '重新上架' END) END AS reasons
        FROM u WHERE status = 'active' AND NOT coalesce(notification_suppressed, FALSE)),
    w AS (SELECT *, CASE WHEN n_status IS NULL THEN 0 WHEN starts_with(reasons, '價格下降 ') THEN 1 ELSE 2 END AS priority
        FROM p WHERE reasons <> '')"""


@query(UPSERT + PENDING + "SELECT source, listing_id, reasons, priority FROM w")
def pending(spark, sf):
    got = S.pending(_upserted(spark, sf))
    return got.select(*KEYS, F.array_join("reasons", ";").alias("reasons"), "priority")


DELIVERED = "CAST(listing_id AS BIGINT) % 2 = 0"


@query(UPSERT + f""", d AS (SELECT *, {DELIVERED} AND status = 'active' AS sent FROM u)
    SELECT source, listing_id, CASE WHEN sent THEN {NOW} ELSE last_notified_at END AS last_notified_at,
        CASE WHEN sent THEN NULL ELSE notification_relisted END AS notification_relisted,
        CASE WHEN sent THEN rent ELSE n_rent END AS told_rent, CASE WHEN sent THEN status ELSE n_status END AS told_status FROM d""")
def mark_notified(spark, sf):
    state = _upserted(spark, sf).drop("is_new", "important_changes", "in_batch")
    delivered = state.filter(F.expr(DELIVERED) & (F.col("status") == "active"))
    got = S.mark_notified(state, delivered, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return got.select(
        *KEYS,
        "last_notified_at",
        "notification_relisted",
        F.col("notified_snapshot.rent").alias("told_rent"),
        F.col("notified_snapshot.status").alias("told_status"),
    )


@query(f"""
    WITH o AS ({_latest(None)})
    SELECT source, listing_id, CASE WHEN listing_id LIKE '%7' THEN 'inactive' ELSE status END AS status,
        CASE WHEN listing_id LIKE '%7' THEN {NOW} ELSE ts END AS last_seen_at FROM o""")
def mark_status(spark, sf):
    state = _rows(spark, sf, None)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    got = S.mark_status(state, state.filter("listing_id LIKE '%7'"), "inactive", now)
    return got.select(*KEYS, "status", "last_seen_at")


@query(f"""
    WITH o AS ({_latest(None)}) SELECT source, listing_id, concat('{{', {", ".join(
        f"CASE WHEN {i} > 0 THEN ',' ELSE '' END, '\"{c}\":', "
        + (f"'\"' || {c} || '\"'" if c == 'status' else f"coalesce(CAST({c} AS VARCHAR), 'null')")
        for i, c in enumerate(sorted(SNAP)))}, '}}') AS payload FROM o""")
def snapshot_payload(spark, sf):
    rows = _rows(spark, sf, None)
    return rows.select(*KEYS, S.snapshot_json(F.struct(*rows.columns)).alias("payload"))


@query(f"""
    WITH o AS ({_latest(None)}) SELECT source, listing_id, rent AS told_rent, has_rent_subsidy AS told_subsidy,
        status AS told_status, CAST(NULL AS BOOLEAN) AS has_garbage_collection FROM o""")
def schema_evolution(spark, sf):
    old = _rows(spark, sf, None).drop("notified_snapshot", "has_garbage_collection")
    return S.read_evolved(old).select(
        *KEYS,
        F.col("notified_snapshot.rent").alias("told_rent"),
        F.col("notified_snapshot.has_rent_subsidy").alias("told_subsidy"),
        F.col("notified_snapshot.status").alias("told_status"),
        "has_garbage_collection",
    )


@query(f"""
    WITH o AS ({_latest(None)}) SELECT source, listing_id, ts AS last_seen_at FROM o
    ORDER BY ts DESC NULLS LAST, source, listing_id LIMIT 20""")
def recent_scan(spark, sf):
    return S.recent_records(_rows(spark, sf, None), 20).select(*KEYS, "last_seen_at")


@query(f"""
    WITH o AS ({_latest(None)}) SELECT source, listing_id, rent FROM o WHERE source = 'view' AND listing_id IN
        (SELECT CAST(user_id AS VARCHAR) FROM events WHERE value > 50)""")
def keyed_read(spark, sf):
    keys = load(spark, sf, "events").filter("value > 50").select(
        F.lit("view").alias("source"), F.col("user_id").cast("string").alias("listing_id")
    )
    return S.get(_rows(spark, sf, None), keys).select(*KEYS, "rent")


@query(f"""
    WITH o AS ({_latest('<')}), n AS ({_latest('>=')})
    SELECT n.source, n.listing_id FROM n ANTI JOIN (SELECT * FROM o WHERE rent > 1000) q
        ON n.source = q.source AND n.listing_id = q.listing_id""")
def unseen_keys(spark, sf):
    return unseen(_rows(spark, sf, False), _rows(spark, sf, True).filter("rent > 1000")).select(*KEYS)


@query("SELECT event_type AS pipeline, max(ts) AS completed_at FROM events GROUP BY event_type")
def high_water_mark(spark, sf):
    log = load(spark, sf, "events").select(F.col("event_type").alias("pipeline"), F.col("ts").alias("completed_at"))
    return high_water(log)


OBS = "CAST(floor(value * 100) AS INT) AS cost, CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END AS status"
REPLAY = f"""
    WITH e AS (SELECT user_id, event_id, ts, {OBS} FROM events),
    l AS (SELECT *, lag(cost) OVER w AS prev_cost, lag(status) OVER w AS prev_status, row_number() OVER w = 1 AS is_first FROM e
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT *, coalesce(NOT is_first AND prev_cost <> 0 AND cost <> 0 AND cost < prev_cost, FALSE) AS dropped,
        NOT is_first AND status = 'active' AND prev_status <> 'active' AS relisted FROM l)"""


def _observations(spark, sf):
    return load(spark, sf, "events").select(
        "user_id",
        "event_id",
        "ts",
        F.floor(F.col("value") * 100).cast("int").alias("cost"),
        F.when(F.col("event_type") == "error", "inactive").otherwise("active").alias("status"),
    )


@query(REPLAY + """ SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at, count(*) AS observations,
    arg_max(cost, (ts, event_id)) AS last_cost, arg_max(prev_cost, (ts, event_id)) AS previous_cost,
    arg_max(status, (ts, event_id)) AS status, min(cost) AS lowest_cost, count(*) FILTER (dropped) AS price_drops,
    count(*) FILTER (relisted) AS relistings, bool_or(relisted) AS ever_relisted FROM c GROUP BY user_id""")
def history_replay(spark, sf):
    return H.replay(
        _observations(spark, sf), ["user_id"], ["ts", "event_id"], "ts", "cost", "status"
    )


@query(REPLAY + " SELECT user_id, event_id, prev_cost, dropped, relisted FROM c")
def observation_changes(spark, sf):
    rows = H.observation_changes(
        _observations(spark, sf), ["user_id"], ["ts", "event_id"], "cost", "status"
    )
    return rows.select("user_id", "event_id", "prev_cost", "dropped", "relisted")


@query(f"""
    SELECT user_id, event_id, value FROM events WHERE ts <= TIMESTAMP '{SPLIT}'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def version_as_of(spark, sf):
    at = F.lit(f"{SPLIT} 00:00:00").cast("timestamp")
    events = load(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return H.as_of(events, ["user_id"], ["ts", "event_id"], "ts", at).select("user_id", "event_id", "value")


@query("""
    WITH l AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 AS gap FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, 1 + sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS UNBOUNDED PRECEDING) AS session FROM l)
    SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS observations
    FROM s GROUP BY user_id, session""")
def gap_sessions(spark, sf):
    events = load(spark, sf, "events").select("user_id", "ts", "event_id")
    return H.gap_sessions(events, ["user_id"], ["ts", "event_id"], "ts", 6 * 3600)


@query("""
    WITH l AS (SELECT user_id, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last, ts FROM events),
    m AS (SELECT *, greatest(0.0, (epoch_us(ts) - epoch_us(last)) / 60000000.0) AS minutes FROM l)
    SELECT user_id, event_id, CAST(CASE WHEN last IS NULL OR minutes <= 75 THEN 1
        ELSE greatest(1, least(5, greatest(2, ceil((minutes - 15) / 60)))) END AS INT) AS pages FROM m""")
def catch_up(spark, sf):
    events = load(spark, sf, "events").select("user_id", "ts", "event_id")
    rows = H.with_previous(events, ["user_id"], ["ts", "event_id"], ["ts"])
    pages = catch_up_pages(F.col("prev_ts"), F.col("ts"), 60, 15, base_pages=1, max_pages=5)
    return rows.select("user_id", "event_id", pages.alias("pages"))


def page_walk_sql(pages: str, misses: int | str, more: str = "") -> str:
    """The page rule walked page by page: ``pages`` gives search, page, n_parsed and the list of keys shown."""
    return f"""
    WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY search, page) AS i FROM ({pages})),
    w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS search, CAST(NULL AS BIGINT) AS page, CAST(0 AS BIGINT) AS n_parsed,
            CAST(0 AS BIGINT) AS n_new, FALSE AS kept, 0 AS run, TRUE AS over, CAST([] AS VARCHAR[]) AS seen
        UNION ALL
        SELECT i, search, page, n_parsed, n_new, live, run, NOT live OR n_parsed = 0 OR run >= {misses},
            CASE WHEN live THEN list_distinct(list_concat(seen, keys)) ELSE seen END
        FROM (SELECT *, CASE WHEN live AND n_parsed > 0 AND n_new = 0 THEN before + 1 ELSE 0 END AS run
            FROM (SELECT p.*, seen, live, before, CASE WHEN live THEN len([x for x in keys if NOT list_contains(seen, x)]) ELSE 0 END AS n_new
                FROM (SELECT p.i, p.search, p.page, p.n_parsed, p.keys, w.seen, w.search IS DISTINCT FROM p.search OR NOT w.over AS live,
                    CASE WHEN w.search = p.search THEN w.run ELSE 0 END AS before FROM w JOIN p ON p.i = w.i + 1) AS p)))
    SELECT CAST(search AS INT) AS search, CAST(page AS INT) AS page, CAST(n_parsed AS BIGINT) AS n_parsed, n_new, kept{more and ', ' + more}
    FROM w WHERE i > 0"""


def _stop_sql(misses: int) -> str:
    return page_walk_sql(
        """SELECT user_id AS search, CAST(day AS BIGINT) AS page, sum(n) AS n_parsed,
            coalesce(list(DISTINCT event_type || ':' || k) FILTER (n > 0), []) AS keys
        FROM (SELECT user_id, event_type, CAST(floor(value) AS INT) % 40 AS k, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n,
            dense_rank() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE)) - 1 AS day FROM events) GROUP BY ALL""",
        misses,
    )


def _searches(spark, sf, misses):
    events = load(spark, sf, "events").withColumn("day", F.to_date("ts"))
    # Page numbers without gaps: how many active days of the same search came before.
    days = events.select("user_id", "day").distinct()
    numbered = H.running_total(days, ["user_id"], ["day"], F.lit(1), "n").select("user_id", "day", (F.col("n") - 1).cast("int").alias("page"))
    rows = events.join(numbered, ["user_id", "day"]).select(
        F.col("user_id").alias("search"),
        "page",
        F.col("event_type").alias("source"),
        (F.floor("value").cast("int") % 40).alias("k"),
    )
    pages = rows.groupBy("search", "page").agg(F.count_if(F.col("source") != "error").alias("n_parsed"))
    return kept_pages(rows.filter("source <> 'error'"), pages, ["source", "k"], misses)


@query(_stop_sql(1))
def stop_rule(spark, sf):
    return _searches(spark, sf, 1)


@query(_stop_sql(2))
def stop_rule_second_miss(spark, sf):
    return _searches(spark, sf, 2)
