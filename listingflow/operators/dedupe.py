"""Two levels of duplicates: the same key (dropped) and the same content (marked)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import effective_cost
from ..functions.text import fingerprint_text
from .skew import attach_facts


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row per key in a stated order.

    Spark prunes each map task to one row per key before the shuffle (window group
    limit), so a key with a third of all rows sends one row per task.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def content_fingerprint() -> Column:
    """24 hex digits over what makes two offers look the same; null if too little is known."""
    cost = effective_cost(F.col("total_monthly_cost"), F.col("rent"))
    known = (
        (F.coalesce("city", F.lit("")) != "")
        & (F.coalesce("district", F.lit("")) != "")
        & (F.coalesce(cost, F.lit(0)) != 0)
        & F.col("area_ping").isNotNull()
    )
    payload = F.concat_ws(
        "|",
        F.col("city"),
        F.col("district"),
        F.substring(fingerprint_text(F.coalesce("address", F.lit(""))), 1, 18),
        cost.cast("string"),
        F.bround("area_ping", 1).cast("string"),
        F.coalesce("room_type", F.lit("")),
        F.substring(fingerprint_text(F.col("title")), 1, 24),
    )
    return F.when(known, F.substring(F.sha2(payload, 256), 1, 24))


def mark_duplicates(
    df: DataFrame,
    fingerprint: str,
    order: Sequence[str],
    eligible: Column | None = None,
) -> DataFrame:
    """Mark every row but the first of each fingerprint; nothing is dropped.

    The first row is found by a pre-aggregated minimum, then looked up again, so a
    fingerprint shared by a third of all rows is never gathered in one place. Null
    fingerprints and rows that are not ``eligible`` neither mark nor get marked.
    """
    counts = F.col(fingerprint).isNotNull()
    if eligible is not None:
        counts = counts & eligible
    keyed = df.withColumn("_fp", F.when(counts, F.col(fingerprint)))
    # A single column keeps the aggregation hashed; a struct needs a sort.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    firsts = (
        keyed.filter("_fp IS NOT NULL")
        .groupBy("_fp")
        .agg(F.min(place).alias("_first"), F.count("*").alias("_n"))
        .filter("_n > 1")
    )
    out = attach_facts(keyed, firsts, ["_fp"])
    duplicate = F.col("_first").isNotNull() & (place != F.col("_first"))
    suppressed = (
        F.col("notification_suppressed") if "notification_suppressed" in df.columns else F.lit(None)
    )
    return out.withColumn("possible_duplicate", duplicate).withColumn(
        "notification_suppressed", F.when(duplicate, F.lit(True)).otherwise(suppressed.cast("boolean"))
    ).drop("_fp", "_first", "_n")
