"""Per-key history over all observations at once.

A window over a whole key would put a hot key's history in one task. Here all observations, sorted by key and
order, are cut into ranges of about equal size, wherever that falls: windows run inside (range, key), and one
row per range carries on what the next range needs (a segmented scan). Only a range's first key can have begun
before it, so what is carried is at most one row a range, whatever the keys. The result equals the one-window form.

Rows that agree in key and order cannot be told apart and stay together; give the order a unique tail.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoint import cut


def in_ranges(df: DataFrame, key: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``_range``: the number of a span of the rows sorted by key and order.

    As many as a shuffle has partitions, if not said otherwise. Written once, since everything read from it must
    see the same borders, also after an executor is lost.
    """
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *key, *order).withColumn("_range", F.spark_partition_id()))


def _carried(rows: DataFrame, edges: DataFrame, key: Sequence[str], value: Column) -> DataFrame:
    """``rows`` with ``_carried``: ``value`` of the range before, for the key that both share, else null.

    ``edges`` has one row a range: ``_range``, ``head`` (its first key) and ``tail`` (its last key).
    """
    whole = Window.orderBy("_range")  # over one row a range
    linked = edges.select(
        F.col("_range").alias("_at"), "head", F.lag("tail").over(whole).alias("before"), F.lag(value).over(whole).alias("_carried")
    ).filter(F.col("head").eqNullSafe(F.col("before")))
    links = linked.select("_at", "_carried", *[F.col(f"head.{k}").alias(f"_of_{k}") for k in key])
    same = [F.col("_range") == F.col("_at"), *[F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key]]
    # At most one row a range, so its size is bounded by their number.
    return rows.join(F.broadcast(links), same, "left").drop("_at", *[f"_of_{k}" for k in key])


def with_previous(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    prefix: str = "prev_",
    ranges: int | None = None,
) -> DataFrame:
    """Add ``prev_<value>`` from the preceding row of the same key, and ``is_first``."""
    return _with_previous(in_ranges(df, key, order, ranges), key, order, values, prefix).drop("_range")


def _with_previous(
    ranged: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "prev_"
) -> DataFrame:
    row, of = F.struct(*values), F.struct(*key)
    edges = ranged.groupBy("_range").agg(
        F.min(of).alias("head"), F.max(of).alias("tail"), F.max_by(row, F.struct(of, *order)).alias("last")
    )
    inner = Window.partitionBy("_range", *key).orderBy(*order)
    out = _carried(ranged.withColumn("_lag", F.lag(row).over(inner)), edges, key, F.col("last"))
    before = F.coalesce("_lag", "_carried")
    return out.select(
        *ranged.columns, *[before[v].alias(f"{prefix}{v}") for v in values], before.isNull().alias("is_first")
    )


def running_total(
    df: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, out: str, ranges: int | None = None
) -> DataFrame:
    """Running sum along a key's history; nulls add nothing."""
    return _running_total(in_ranges(df, key, order, ranges), key, order, value, out).drop("_range")


def _running_total(ranged: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, out: str) -> DataFrame:
    rows = ranged.withColumn("_v", F.coalesce(value, F.lit(0)))
    of = F.struct(*key)
    sums = rows.groupBy("_range", *key).agg(F.sum("_v").alias("_sum"))
    edges = sums.groupBy("_range").agg(
        F.min(of).alias("head"), F.max(of).alias("tail"), F.max_by("_sum", of).alias("_sum")
    )
    # A key that fills whole ranges is the last of each: its sums add up over them.
    upto = Window.partitionBy("tail").orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = edges.withColumn("_upto", F.sum("_sum").over(upto))
    inner = (
        Window.partitionBy("_range", *key)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = _carried(rows.withColumn("_in", F.sum("_v").over(inner)), edges, key, F.col("_upto"))
    return joined.select(*ranged.columns, (F.coalesce("_carried", F.lit(0)) + F.col("_in")).alias(out))


def observation_changes(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    cost: str,
    status: str,
    flag: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Each observation with its previous cost and what it changed (drop, flag, relist)."""
    values = [cost, status] + ([flag] if flag else [])
    rows = with_previous(df, key, order, values, ranges=ranges)
    drop = (F.col(f"prev_{cost}") != 0) & (F.col(cost) != 0) & (F.col(cost) < F.col(f"prev_{cost}"))
    back = ~F.col("is_first") & (F.col(status) == "active") & ~F.col(f"prev_{status}").eqNullSafe("active")
    rows = rows.withColumn("dropped", F.coalesce(drop, F.lit(False))).withColumn("relisted", back)
    if flag:
        rows = rows.withColumn(
            "gained",
            ~F.col("is_first") & F.coalesce(F.col(flag), F.lit(False)) & ~F.col(f"prev_{flag}").eqNullSafe(True),
        )
    return rows


def replay(
    df: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    ts: str,
    cost: str,
    status: str,
    ranges: int | None = None,
) -> DataFrame:
    """Per key, what many runs of upsert would have left: first/last seen, cost, events."""
    rows = observation_changes(df, key, order, cost, status, ranges=ranges)
    return rows.groupBy(*key).agg(
        F.min(ts).alias("first_seen_at"),
        F.max(ts).alias("last_seen_at"),
        F.count("*").alias("observations"),
        F.max_by(cost, F.struct(*order)).alias("last_cost"),
        F.max_by(f"prev_{cost}", F.struct(*order)).alias("previous_cost"),
        F.max_by(status, F.struct(*order)).alias("status"),
        F.min(cost).alias("lowest_cost"),
        F.count_if("dropped").alias("price_drops"),
        F.count_if("relisted").alias("relistings"),
        F.bool_or("relisted").alias("ever_relisted"),
    )


def as_of(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, at: Column) -> DataFrame:
    """The version of each key in force at a time."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.filter(F.col(ts) <= at)
        .groupBy(*key)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_v"))
        .select(*key, "_v.*")
    )


def gap_sessions(
    df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str, gap_seconds: float, ranges: int | None = None
) -> DataFrame:
    """Sessions of activity separated by more than a gap."""
    narrow = df.select(*dict.fromkeys([*key, *order, ts]))
    marked = _with_previous(in_ranges(narrow, key, order, ranges), key, order, [ts])
    micros = [F.unix_micros(F.col(c).cast("timestamp")) for c in (ts, f"prev_{ts}")]
    wide = micros[0] - micros[1] > int(gap_seconds * 1_000_000)
    starts = marked.withColumn("_start", (F.col("is_first") | F.coalesce(wide, F.lit(False))).cast("int"))
    numbered = _running_total(starts, key, order, F.col("_start"), "session")
    return numbered.groupBy(*key, "session").agg(
        F.min(ts).alias("started_at"), F.max(ts).alias("ended_at"), F.count("*").alias("observations")
    )
