"""Filling gaps of list records from their detail pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import attach_facts

FILLED = (
    "title", "city", "district", "address", "rent", "total_monthly_cost", "area_ping",
    "room_type", "floor", "has_rent_subsidy", "has_tax_registration",
    "has_independent_washer", "has_garbage_collection",
)


def needs_detail() -> Column:
    def blank(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) == ""

    return (
        F.col("rent").isNull()
        | F.col("area_ping").isNull()
        | blank("district")
        | blank("room_type")
        | (F.length(F.coalesce("description", F.lit(""))) < 40)
    )


def _empty(c: Column, is_text: bool) -> Column:
    return c.isNull() | (c == "") if is_text else c.isNull()


def merge_details(
    records: DataFrame,
    details: DataFrame,
    page: str,
    position: str,
    limit: int | Column = 3,
    candidate: Column | None = None,
    fetched: DataFrame | None = None,
    on: Sequence[str] = ("url",),
) -> DataFrame:
    """Fill nulls and blanks of incomplete records from ``details`` (unique per ``on``).

    At most ``limit`` (a number, or one that follows from ``on``) records per page are enriched, in page order, each
    URL once: that is the rule of the source, not a shortcut. ``fetched`` (``on``) names the detail pages that were
    fetched, with a record or without: each counts against the limit; by default those with one.
    A detail's ``raw`` is kept under ``detail_raw_json`` in the record's. Complete records never
    enter the join.
    """
    wanted = needs_detail() if candidate is None else needs_detail() & candidate
    marked = records.withColumn("_needy", wanted)
    first_use = Window.partitionBy(page, *on).orderBy(position)
    turn = Window.partitionBy(page).orderBy(position)
    found = details.select(
        *on, F.struct(*[F.col(c) for c in details.columns if c not in on]).alias("_d")
    )
    uses = (
        marked.filter("_needy")
        .select(page, position, *on)
        .withColumn("_use", F.row_number().over(first_use))
        .filter("_use = 1")
        .drop("_use")
    )
    if fetched is not None:
        found = fetched.select(*on).distinct().join(found.hint("merge"), list(on), "left")
    found = found.withColumn("_seen", F.lit(True))
    chosen = (
        attach_facts(uses, found, on)
        .filter("_seen")
        .withColumn("_turn", F.row_number().over(turn))
        .filter(F.col("_turn") <= limit)
        .select(page, position, "_d")
    )
    joined = marked.join(chosen.hint("merge"), [page, position], "left")  # its size is a guess, of rows that may be many
    types = dict(records.dtypes)
    have = set(details.columns)
    new: dict[str, Column] = {}
    for c in FILLED:
        if c in types and c in have:
            new[c] = F.when(_empty(F.col(c), types[c] == "string"), F.coalesce(f"_d.{c}", c)).otherwise(
                F.col(c)
            )
    if "description" in have:
        longer = F.length("_d.description") > F.length(F.coalesce("description", F.lit("")))
        new["description"] = F.when(longer, F.col("_d.description")).otherwise(F.col("description"))
    if "image_urls" in have:
        none = F.size(F.coalesce("image_urls", F.array())) == 0
        new["image_urls"] = F.when(
            none & (F.size("_d.image_urls") > 0), F.col("_d.image_urls")
        ).otherwise(F.col("image_urls"))
    if "tags" in have:
        more = F.coalesce(F.col("_d.tags"), F.array().cast("array<string>"))
        new["tags"] = F.concat(
            "tags", F.filter(F.array_distinct(more), lambda t: ~F.array_contains(F.col("tags"), t))
        )
    if "raw" in have and "raw" in types:
        own = F.regexp_replace(F.coalesce("raw", F.lit("{}")), r"\s*\}\s*\z", "")
        gap = F.when(F.trim(own) == "{", F.lit("")).otherwise(F.lit(","))
        whole = F.concat(own, gap, F.lit('"detail_raw_json":'), F.col("_d.raw"), F.lit("}"))
        new["raw"] = F.coalesce(whole, F.col("raw"))
    return joined.withColumns(new).select(*records.columns)
