"""What to announce, in which order, and how it reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions import text as X
from ..functions import vocabulary as V
from ..functions.numbers import effective_cost
from ..functions.text import blank_to_null
from .score import rank_score
from .skew import attach_facts

KEY = ("source", "listing_id")
SUMMARY_CHUNK = 10_000  # labels whose part of a summary's text one task writes


def group_label() -> Column:
    return F.coalesce(
        blank_to_null(F.col("district")), blank_to_null(F.col("city")), F.lit(V.UNKNOWN_GROUP)
    )


def contiguous_order(
    df: DataFrame,
    inner: Sequence[Column],
    within: Sequence[str] = (),
    label: Column | None = None,
) -> tuple[DataFrame, list[str]]:
    """Columns to sort by so that groups stand together, in order of first appearance.

    ``inner`` are ascending sort values (negate for descending) with a unique tail. A group
    first appears where its smallest ``inner`` does, so a pre-aggregated minimum per group
    replaces a numbering of all rows: no step needs the whole order in one place.
    """
    named = df.withColumn("_label", label if label is not None else group_label()).withColumn(
        "_inner", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(inner)])
    )
    group = [*within, "_label"]
    heads = named.groupBy(*group).agg(F.min("_inner").alias("_head"))
    return attach_facts(named, heads, group), [*within, "_head", "_inner"]


def _rank_inner(max_rent: int) -> list[Column]:
    # Ties keep the order of the pending set: first seen (nulls first), then key.
    return [
        -rank_score(max_rent),
        F.coalesce(F.unix_micros("first_seen_at"), F.lit(-(1 << 62))),
        F.col("source"),
        F.col("listing_id"),
    ]


def order_outbox(pending: DataFrame, max_rent: int = 18_600) -> tuple[DataFrame, list[str]]:
    """Priority, then rank, groups contiguous per priority: rows and the columns to sort by."""
    return contiguous_order(pending, _rank_inner(max_rent), ("priority",))


def watch_top_n(pending: DataFrame, limit: int, max_rent: int = 18_600) -> DataFrame:
    """Order first, then cut: the watch rule. ``position`` starts at 1.

    Places are found on keys and sort values alone; only the rows that made it are looked up whole.
    """
    inner = _rank_inner(max_rent)
    narrow = pending.select(
        *KEY, "priority", group_label().alias("_label"), *[c.alias(f"_o{i}") for i, c in enumerate(inner)]
    )
    rows, order = contiguous_order(narrow, [F.col(f"_o{i}") for i in range(len(inner))], ("priority",), F.col("_label"))
    places = _number(rows.orderBy(*order).limit(limit), order).select(*KEY, "position")
    return pending.join(places, list(KEY)).select(*pending.columns, "position").orderBy("position")


def announce(pending: DataFrame, limit: int, max_rent: int = 18_600) -> tuple[DataFrame, DataFrame]:
    """What :func:`watch_top_n` gives, and the run's summary, from one reading of the pending set.

    Keys, reasons, places and sort values are computed once and written; both results work on those,
    and the few rows that made it are looked up whole.
    """
    inner = _rank_inner(max_rent)
    narrow = cut(
        pending.select(*KEY, "priority", "reasons", "city", "district", *[c.alias(f"_o{i}") for i, c in enumerate(inner)])
    )
    rows, order = contiguous_order(narrow, [F.col(f"_o{i}") for i in range(len(inner))], ("priority",))
    few = cut(_number(rows.orderBy(*order).limit(limit), order).select(*KEY, "city", "district", "position"))
    top = pending.join(few.select(*KEY, "position"), list(KEY)).select(*pending.columns, "position").orderBy("position")
    return top, run_summary(rows, few, order)


def backfill_top_n(matched: DataFrame, limit: int, max_rent: int = 18_600) -> DataFrame:
    """Cut by rank first, then group the survivors: the backfill rule."""
    inner = _rank_inner(max_rent)
    best = matched.orderBy(*inner).limit(limit)
    rows, order = contiguous_order(best, inner)
    return _number(rows, order).drop("_label", "_inner", "_head")


def _number(few: DataFrame, order: Sequence[str]) -> DataFrame:
    """Positions for a result already cut to a small number of rows."""
    from pyspark.sql import Window

    return few.withColumn("position", F.row_number().over(Window.orderBy(*order)))


# --- counts and texts ----------------------------------------------------------------


def district_counts(df: DataFrame, order: Sequence[str], label: Column | None = None) -> DataFrame:
    """Rows per group label with the place of its first appearance."""
    return (
        df.withColumn("label", label if label is not None else group_label())
        .groupBy("label")
        .agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first_at"))
    )


def source_counts(records: DataFrame, max_rent: int) -> DataFrame:
    """Records per source, and those of them whose cost is known and within ``max_rent``."""
    cost = effective_cost(F.col("total_monthly_cost"), F.col("rent"))
    return records.groupBy("source").agg(
        F.count("*").alias("n_records"), F.count_if(cost <= max_rent).alias("n_affordable")
    )


def event_counts(df: DataFrame) -> DataFrame:
    """One row: new, price drops, other updates."""
    new = F.array_contains("reasons", V.NEW_RECORD)
    drop = F.exists("reasons", lambda r: r.startswith(f"{V.PRICE_DROP} "))
    return df.agg(
        F.count_if(new).alias("n_new"),
        F.count_if(~new & drop).alias("n_drop"),
        F.count_if(~new & ~drop).alias("n_other"),
    )


def event_text(n_new: Column, n_drop: Column, n_other: Column) -> Column:
    def part(label: str, n: Column) -> Column:
        return F.when(n > 0, F.concat(F.lit(f"{label} "), n.cast("string")))

    return F.concat_ws(
        "、",
        part(V.NEW_RECORD, n_new),
        part(V.PRICE_DROP, n_drop),
        part(V.OTHER_UPDATE, n_other),
    )


def summary_labels(candidates: DataFrame, sending: DataFrame, order: Sequence[str], sending_order: Sequence[str] = ("position",)) -> DataFrame:
    """One row per group label: where it first stands among candidates and among those sent, and its counts."""
    new = F.array_contains("reasons", V.NEW_RECORD)
    drop = F.exists("reasons", lambda r: r.startswith(f"{V.PRICE_DROP} "))
    every = candidates.select(
        group_label().alias("label"),
        F.struct(*order).alias("first_all"),
        F.lit(1).alias("candidate"),
        new.cast("int").alias("new"),
        (~new & drop).cast("int").alias("drop"),
    )
    sent = sending.select(
        group_label().alias("label"), F.struct(*sending_order).alias("first_sent"), F.lit(1).alias("sent")
    )
    return (
        every.unionByName(sent, allowMissingColumns=True)
        .groupBy("label")
        .agg(
            F.min("first_all").alias("first_all"),
            F.min("first_sent").alias("first_sent"),
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidate", "sent", "new", "drop")],
        )
    )


def _label_text(labels: DataFrame, first: str, n: str, chunk: int) -> DataFrame:
    """One row, ``text``: labels and counts in order of ``first``. Ranges of about ``chunk`` labels are texts
    of their own, written in their tasks; only these texts meet."""
    held = labels.filter(F.col(n) > 0).select(first, F.concat("label", F.col(n).cast("string"), F.lit("間")).alias("part"))
    ranges = max(1, -(-held.count() // chunk))
    dealt = held.repartitionByRange(ranges, first).withColumn("range", F.spark_partition_id())
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(first, "part"))), lambda x: x["part"]), "、")
    texts = dealt.groupBy("range").agg(parts.alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "text"))), lambda x: x["text"]), "、")
    return texts.agg(F.coalesce(blank_to_null(whole), F.lit("0間")).alias("text"))


def run_summary(
    candidates: DataFrame,
    sending: DataFrame,
    order: Sequence[str],
    sending_order: Sequence[str] = ("position",),
    chunk: int = SUMMARY_CHUNK,
) -> DataFrame:
    """One row: the counts of a run and the sentence that announces them.

    The sentence names every label, so it is as long as there are labels; it is put together from texts of
    about ``chunk`` labels each. :func:`summary_labels` has the labels as rows.
    """
    labels = cut(summary_labels(candidates, sending, order, sending_order))

    def total(n: str) -> Column:
        return F.coalesce(F.sum(n), F.lit(0))

    both = labels.agg(
        total("candidate").alias("n_candidates"),
        total("sent").alias("n_sending"),
        total("new").alias("n_new"),
        total("drop").alias("n_drop"),
        (total("candidate") - total("new") - total("drop")).alias("n_other"),
    )
    for name, first, n in (("all_text", "first_all", "candidate"), ("sent_text", "first_sent", "sent")):
        # One row beside one row.
        both = both.withColumn("_one", F.lit(1)).join(
            _label_text(labels, first, n, chunk).select(F.lit(1).alias("_one"), F.col("text").alias(name)), "_one"
        ).drop("_one")
    events = event_text(F.col("n_new"), F.col("n_drop"), F.col("n_other"))
    suffix = F.when(events != "", F.concat(F.lit("（"), events, F.lit("）"))).otherwise("")
    whole = F.concat(
        F.lit("待通知 "),
        F.col("n_candidates").cast("string"),
        F.lit(" 間"),
        suffix,
        F.lit("："),
        F.col("all_text"),
        F.lit("。"),
    )
    rest = F.concat(
        F.lit("這次依新房源、價格下降、其他更新的順序先傳 "),
        F.col("n_sending").cast("string"),
        F.lit(" 間："),
        F.col("sent_text"),
        F.lit("。"),
    )
    return both.select(
        "n_candidates",
        "n_sending",
        "n_new",
        "n_drop",
        "n_other",
        F.when(F.col("n_candidates") > F.col("n_sending"), F.concat(whole, rest))
        .otherwise(whole)
        .alias("message"),
    )


# --- one message per record ----------------------------------------------------------


def proximity_text() -> Column:
    labels = F.lit("近似")
    for level, label in reversed(V.CONFIDENCE_LABELS):
        labels = F.when(F.col("score_confidence") == level, F.lit(label)).otherwise(labels)
    reason = X.strip(F.coalesce("score_reason", F.lit("")))
    return (
        F.when(
            F.col("commute_minutes").isNotNull(),
            F.concat(
                F.col("commute_minutes").cast("string"),
                F.lit(" 分鐘"),
                F.when(F.col("score_method") == "google_routes", F.lit("（Google Routes）")).otherwise(""),
            ),
        )
        .when(
            F.col("near_ntu_score").isNotNull(),
            F.concat(
                F.lit("近似 "),
                F.col("near_ntu_score").cast("string"),
                F.lit("/100（"),
                labels,
                F.when(reason != "", F.concat(F.lit("；"), reason)).otherwise(""),
                F.lit("）"),
            ),
        )
        .otherwise(V.UNKNOWN)
    )


def message(
    zone: str = "UTC", show_proximity: Column | bool = True, title_chars: int = 120, images: int = 3, changes: int = 5
) -> Column:
    """The record as a JSON message: title, ordered fields, conditional parts, colour.

    Records hold whole values; what a message shows of them is cut here: ``title_chars`` of the title,
    ``images`` of the images, ``changes`` of the reasons.
    """
    shown = F.substring("title", 1, title_chars)
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    changed = F.size(reasons) > 0
    rent = X.money(F.col("rent"))
    title = F.when(F.col("rent").isNotNull(), F.concat(shown, F.lit(" - "), rent)).otherwise(shown)
    show = F.lit(show_proximity) if isinstance(show_proximity, bool) else show_proximity
    more = F.slice("image_urls", 2, images - 1)

    def field(name: str, value: Column, inline: bool) -> Column:
        return F.struct(
            F.lit(name).alias("name"), value.alias("value"), F.lit(inline).alias("inline")
        )

    def known(c: str) -> Column:
        return F.coalesce(blank_to_null(F.col(c)), F.lit(V.UNKNOWN))

    fields = F.array_compact(
        F.array(
            F.when(changed, field("重要更新", F.array_join(F.slice(reasons, 1, changes), "\n"), False)),
            field("地區/地址", X.location_text(F.col("city"), F.col("district"), F.col("address")), False),
            field("月租/總月租", F.concat(rent, F.lit(" / "), X.money(F.col("total_monthly_cost"))), True),
            field("坪數", X.number_with_unit(F.col("area_ping"), " 坪"), True),
            field("房型", known("room_type"), True),
            field("樓層", known("floor"), True),
            field("是否租補", X.flag_mark(F.col("has_rent_subsidy")), True),
            field("是否可報稅", X.flag_mark(F.col("has_tax_registration")), True),
            field("是否獨立洗衣機", X.flag_mark(F.col("has_independent_washer")), True),
            field("垃圾代收", X.flag_mark(F.col("has_garbage_collection")), True),
            F.when(show, field("距台大", proximity_text(), True)),
            field(
                "更新時間/首次看到",
                F.concat(
                    X.time_text(F.col("last_seen_at"), zone),
                    F.lit(" / "),
                    X.time_text(F.col("first_seen_at"), zone),
                ),
                False,
            ),
            F.when(F.size(more) > 0, field("其他圖片", F.array_join(more, "\n"), False)),
        )
    )
    image = F.when(F.size("image_urls") > 0, F.struct(F.col("image_urls")[0].alias("url")))
    return F.to_json(
        F.struct(
            F.substring(title, 1, 256).alias("title"),
            F.col("url"),
            F.substring(
                F.coalesce(
                    blank_to_null(F.col("classifier_summary")), F.col("description"), F.lit("")
                ),
                1,
                300,
            ).alias("description"),
            fields.alias("fields"),
            F.struct(F.concat_ws(" | ", "source", "listing_id").alias("text")).alias("footer"),
            F.when(changed, F.lit(V.COLOUR_CHANGED)).otherwise(F.lit(V.COLOUR_NEW)).alias("color"),
            image.alias("image"),
        )
    )
