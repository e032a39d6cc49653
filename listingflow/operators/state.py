"""Keyed record state: upsert, change detection, pending set, delivery marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import effective_cost
from ..schema import FLAG_COLUMNS, KEY, RECORD_DDL, SNAPSHOT_DDL, record_schema, snapshot_of

# Kept from the stored row when a record is seen again; every other column is replaced.
KEPT = ("first_seen_at", "last_notified_at", "notified_snapshot")
STICKY = ("notification_suppressed", "notification_relisted")


def _cost(row: str) -> Column:
    return effective_cost(F.col(f"{row}.total_monthly_cost"), F.col(f"{row}.rent"))


def price_drop(old: Column, new: Column) -> Column:
    fell = (old != 0) & (new != 0) & (new < old)
    return F.when(
        fell,
        F.concat(F.lit(f"{V.PRICE_DROP} "), old.cast("string"), F.lit(" -> "), new.cast("string")),
    )


def _gained(old: str, new: str) -> list[Column]:
    return [
        F.when(~F.col(f"{old}.{flag}").eqNullSafe(True) & F.col(f"{new}.{flag}"), F.lit(label))
        for flag, label in V.FLAG_GAINED
    ]


def important_changes(old: str = "old", new: str = "new") -> Column:
    """What changed for the better between two versions of a record, in a fixed order."""
    relisted = ~F.col(f"{old}.status").eqNullSafe("active") & (F.col(f"{new}.status") == "active")
    return F.array_compact(
        F.array(
            price_drop(_cost(old), _cost(new)),
            *_gained(old, new),
            F.when(relisted, F.lit(V.RELISTED)),
        )
    )


def changes_since_notification(record: str = "r", snapshot: str = "r.notified_snapshot") -> Column:
    """The same against what was last announced; a drop that rebounded leaves no trace."""
    old = F.coalesce(
        F.when(F.col(f"{snapshot}.total_monthly_cost") > 0, F.col(f"{snapshot}.total_monthly_cost")),
        F.when(F.col(f"{snapshot}.rent") > 0, F.col(f"{snapshot}.rent")),
    )
    back = (F.col(f"{record}.status") == "active") & (
        ~F.col(f"{snapshot}.status").eqNullSafe("active")
        | F.coalesce(F.col(f"{record}.notification_relisted"), F.lit(False))
    )
    return F.array_compact(
        F.array(
            price_drop(old, _cost(record)),
            *_gained(snapshot, record),
            F.when(back, F.lit(V.RELISTED)),
        )
    )


def upsert(state: DataFrame, batch: DataFrame, now: Column, full: bool = True) -> DataFrame:
    """State after a batch, with ``is_new`` and ``important_changes`` for the batch's keys.

    Both sides have unique keys (run ``first_wins`` on the batch first), so the join on
    (source, listing_id) spreads evenly. With ``full=False`` only the batch's rows come
    back and the state side is reduced to matching keys: that is what an incremental write
    needs, and its cost follows the batch, not the state.
    """
    fields = [f.name for f in record_schema().fields]
    if not full:
        state = state.join(batch.select(*KEY), list(KEY), "left_semi")
    old = state.select(F.struct(*fields).alias("old"))
    new = batch.select(F.struct(*fields).alias("new"))
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in KEY]
    joined = new.join(old, on, "full_outer" if full else "left")
    seen, known = F.col(f"new.{KEY[0]}").isNotNull(), F.col(f"old.{KEY[0]}").isNotNull()
    came_back = seen & known & (F.col("old.status") != "active") & (F.col("new.status") == "active")

    out: list[Column] = []
    for name in fields:
        was, now_is = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name == "first_seen_at":
            value = F.when(known, was).otherwise(F.coalesce(now_is, now))
        elif name == "last_seen_at":
            value = now
        elif name == "last_notified_at":
            value = F.when(known, was).otherwise(now_is)
        elif name == "notified_snapshot":
            value = was
        elif name == "notification_relisted":
            value = F.when(came_back, F.lit(True)).otherwise(F.coalesce(now_is, was))
        elif name in STICKY:
            value = F.coalesce(now_is, was)
        else:
            value = now_is
        out.append(F.when(seen, value).otherwise(was).alias(name))
    changes = F.when(seen & known, important_changes()).otherwise(F.array().cast("array<string>"))
    return joined.select(
        *out,
        (seen & ~known).alias("is_new"),
        changes.alias("important_changes"),
        seen.alias("in_batch"),
    )


def pending(state: DataFrame) -> DataFrame:
    """Active, not suppressed records with something to tell: ``reasons`` and ``priority``.

    Ordered by priority, first seen (nulls first), key: apply ``PENDING_ORDER``.
    """
    live = state.filter(
        (F.col("status") == "active") & ~F.coalesce("notification_suppressed", F.lit(False))
    )
    fields = live.columns
    told = F.col("r.notified_snapshot").isNotNull()
    reasons = F.when(told, changes_since_notification()).otherwise(F.array(F.lit(V.NEW_RECORD)))
    return (
        live.select(F.struct(*fields).alias("r"))
        .withColumn("reasons", reasons)
        .filter(F.size("reasons") > 0)
        .select(
            "r.*",
            "reasons",
            F.when(~told, F.lit(0))
            .when(F.col("reasons")[0].startswith(f"{V.PRICE_DROP} "), F.lit(1))
            .otherwise(F.lit(2))
            .alias("priority"),
        )
    )


PENDING_ORDER = ("priority", "first_seen_at", "source", "listing_id")


def mark_notified(state: DataFrame, delivered: DataFrame, at: Column, full: bool = True) -> DataFrame:
    """Record delivery: time, announced snapshot, relist mark cleared. Unknown keys do nothing."""
    done = delivered.select(*KEY).distinct().withColumn("_sent", F.lit(True))
    joined = state.join(done, list(KEY), "left" if full else "inner")
    sent = F.col("_sent").isNotNull()
    changed = {
        "last_notified_at": F.when(sent, at).otherwise(F.col("last_notified_at")),
        "notified_snapshot": F.when(sent, snapshot_of()).otherwise(F.col("notified_snapshot")),
        "notification_relisted": F.when(sent, F.lit(None).cast("boolean")).otherwise(
            F.col("notification_relisted")
        ),
    }
    return joined.withColumns(changed).select(*state.columns)


def mark_status(state: DataFrame, keys: DataFrame, status: str, now: Column) -> DataFrame:
    """Set the status of many records as one batch through the ordinary upsert."""
    batch = state.join(keys.select(*KEY).distinct(), list(KEY), "left_semi")
    return upsert(state, batch.withColumn("status", F.lit(status)), now)


def snapshot_json(record: Column) -> Column:
    """Announced fields as JSON text, keys sorted, nulls written out."""
    names = sorted(
        ("rent", "total_monthly_cost", "status", *FLAG_COLUMNS)
    )
    return F.to_json(
        F.struct(*[record[n].alias(n) for n in names]), {"ignoreNullFields": "false"}
    )


def read_evolved(stored: DataFrame) -> DataFrame:
    """A table written by an older version: absent columns appear as nulls.

    Only when the snapshot column itself was absent is it filled, for every row, from the
    row's current values: those records count as announced.
    """
    had_snapshot = "notified_snapshot" in stored.columns
    empty = stored.sparkSession.createDataFrame([], RECORD_DDL)
    rows = stored.unionByName(empty, allowMissingColumns=True).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in record_schema().fields]
    )
    if had_snapshot:
        return rows
    return rows.withColumn(
        "notified_snapshot",
        F.coalesce(
            F.col("notified_snapshot"),
            F.struct(
                *[
                    (F.coalesce(n, F.lit("unknown")) if n == "status" else F.col(n)).alias(n)
                    for n in ("rent", "total_monthly_cost", *FLAG_COLUMNS, "status")
                ]
            ).cast(SNAPSHOT_DDL),
        ),
    )


def get(state: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored records for a table of keys."""
    return state.join(keys.select(*KEY).distinct(), list(KEY), "left_semi")


def recent_records(state: DataFrame, limit: int = 20) -> DataFrame:
    """Most recently seen first; ties by key, so the answer is stable."""
    return state.orderBy(
        F.desc_nulls_last("last_seen_at"), F.desc_nulls_last("first_seen_at"), *KEY
    ).limit(limit)
