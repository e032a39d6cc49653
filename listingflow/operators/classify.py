"""Keyword classification, reason-collecting filter, status routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedupe import first_wins
from ..functions import vocabulary as V
from ..functions.numbers import effective_cost
from ..functions.text import (
    blank_to_null,
    classification_text,
    contains_any,
    female_only,
    normalize_spelling,
    short_summary,
    words_found,
)
from ..sources.walk import names_women_only

LABEL_FIELDS = (
    "is_suite",
    *(
        "has_rent_subsidy",
        "has_tax_registration",
        "has_independent_washer",
        "has_garbage_collection",
    ),
    "red_flags",
    "summary",
    "score_reason",
)


def add_female_only(records: DataFrame, raw: str = "raw", out: str = "female_only") -> DataFrame:
    """By the record's words, or by a value under a gender-like key of its payload, at any depth."""
    return records.withColumn(out, female_only(classification_text()) | names_women_only(F.col(raw)))


def keyword_classification(text: Column, is_female_only: Column | None = None) -> Column:
    """struct(is_suite, four flags, red_flags, summary, score_reason) from a text.

    The flags differ in which evidence wins: a shared washer loses to a private one, while
    a denied garbage service, subsidy or tax registration wins over its affirmation.
    """
    red = words_found(text, V.EXCLUDED_WORDS)
    if is_female_only is not None:
        red = F.concat(red, F.when(is_female_only, F.array(F.lit("限女"))).otherwise(F.array()))
    yes, no = F.lit(True), F.lit(False)
    return F.struct(
        (contains_any(text, V.SUITE_WORDS) & ~contains_any(text, V.EXCLUDED_WORDS)).alias("is_suite"),
        F.when(contains_any(text, V.SUBSIDY_DENIED), no)
        .when(contains_any(text, V.SUBSIDY_WORDS), yes)
        .alias("has_rent_subsidy"),
        F.when(contains_any(text, V.TAX_DENIED), no)
        .when(contains_any(text, V.TAX_WORDS), yes)
        .alias("has_tax_registration"),
        F.when(contains_any(text, V.WASHER_WORDS), yes)
        .when(contains_any(text, V.WASHER_SHARED), no)
        .alias("has_independent_washer"),
        F.when(contains_any(text, V.GARBAGE_DENIED), no)
        .when(contains_any(text, V.GARBAGE_WORDS), yes)
        .alias("has_garbage_collection"),
        red.alias("red_flags"),
        short_summary(text).alias("summary"),
        F.lit("keyword fallback").alias("score_reason"),
    )


def classify(records: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Add ``classification``: external labels where given, the keyword rules elsewhere.

    ``labels`` has ``source, listing_id`` and the fields of the classification struct. Of labels that
    repeat a key one counts, the first by its fields, so that no record is multiplied.
    """
    marked = add_female_only(records).withColumn("_text", classification_text())
    rules = keyword_classification(F.col("_text"), F.col("female_only"))
    if labels is None:
        return marked.withColumn("classification", rules).drop("_text")
    fields = F.struct(*LABEL_FIELDS)
    once = first_wins(labels, ["source", "listing_id"], [F.to_json(fields, {"ignoreNullFields": "false"})])
    given = once.select("source", "listing_id", fields.alias("_label"))
    return (
        marked.join(given, ["source", "listing_id"], "left")
        .withColumn("classification", F.coalesce("_label", rules))
        .drop("_label", "_text")
    )


def apply_classification(records: DataFrame) -> DataFrame:
    """Fill what the record does not say; never override what it does."""
    c = lambda n: F.col(f"classification.{n}")
    red_tags = F.transform(c("red_flags"), lambda w: F.concat(F.lit("red_flag:"), w))
    return records.withColumns(
        {
            "has_rent_subsidy": F.coalesce("has_rent_subsidy", c("has_rent_subsidy")),
            "has_tax_registration": F.coalesce("has_tax_registration", c("has_tax_registration")),
            "has_independent_washer": F.coalesce("has_independent_washer", c("has_independent_washer")),
            "has_garbage_collection": F.coalesce("has_garbage_collection", c("has_garbage_collection")),
            "room_type": F.when(
                (F.coalesce("room_type", F.lit("")) == "") & c("is_suite"), F.lit("套房")
            ).otherwise(F.col("room_type")),
            "tags": F.concat(
                "tags", F.filter(red_tags, lambda t: ~F.array_contains(F.col("tags"), t))
            ),
            "classifier_summary": F.coalesce(
                F.col("classifier_summary"), blank_to_null(c("summary"))
            ),
            "classifier_score_reason": F.coalesce(
                blank_to_null(c("score_reason")), F.col("classifier_score_reason")
            ),
        }
    )


def allowed_place(
    city: Column, district: Column, allowlist: dict[str, set[str]]
) -> Column:
    """Membership in ``{city: districts}`` where ``*`` allows the whole city."""
    ok = F.lit(False)
    for name, districts in allowlist.items():
        inside = F.lit(True) if "*" in districts else district.isin(*sorted(districts))
        ok = F.when(city == name, inside).otherwise(ok)
    return F.coalesce(city.isNotNull() & district.isNotNull() & ok, F.lit(False))


def allowed_places(records: DataFrame, allowlist: DataFrame, out: str = "place_ok") -> DataFrame:
    """The same test against an allow-list table ``(city, district)``, of any size.

    Spark broadcasts the list if its statistics allow, else shuffles. A wildcard row
    stands for every district of its city; the list is unique per (city, district).
    """
    exact = allowlist.filter("district <> '*'").distinct()
    wild = allowlist.filter("district = '*'").select("city").distinct()
    city, district = normalize_spelling(F.col("city")), normalize_spelling(F.col("district"))
    return (
        records.withColumn("_city", blank_to_null(city))
        .withColumn("_district", blank_to_null(district))
        .join(
            exact.select(
                F.col("city").alias("_city"),
                F.col("district").alias("_district"),
                F.lit(True).alias("_exact"),
            ),
            ["_city", "_district"],
            "left",
        )
        .join(wild.select(F.col("city").alias("_city"), F.lit(True).alias("_wild")), "_city", "left")
        .withColumn(
            out,
            F.col("_district").isNotNull()
            & (F.coalesce("_exact", F.lit(False)) | F.coalesce("_wild", F.lit(False))),
        )
        .drop("_city", "_district", "_exact", "_wild")
    )


def reject_reasons(
    place_ok: Column,
    max_rent: int = 18_600,
    min_area: float = 6.0,
    suite_only: bool = True,
    exclude_female_only: bool = True,
) -> Column:
    """Every reason a record fails, in a fixed order; empty means it passes.

    Reads the record columns, ``female_only`` and ``match_text`` (see ``route``).
    """
    text = F.col("match_text")
    room = F.coalesce("room_type", F.lit(""))
    cost = effective_cost(F.col("total_monthly_cost"), F.col("rent"))
    area = F.col("area_ping")
    unknown = F.lit(V.UNKNOWN)

    def place(c: str) -> Column:
        return F.coalesce(blank_to_null(normalize_spelling(F.col(c))), unknown)

    checks = [
        F.when(
            ~place_ok, F.concat(F.lit("地區不符: "), place("city"), F.lit(" "), place("district"))
        ),
        F.when(contains_any(text, V.EXCLUDED_WORDS), F.lit("排除房型/用途")),
    ]
    if exclude_female_only:
        checks.append(F.when(F.col("female_only"), F.lit("限女/女性限定")))
    checks.append(F.when(F.contains(room, F.lit("雅房")), F.lit("雅房")))
    if suite_only:
        checks.append(
            F.when(
                ~F.contains(room, F.lit("套房")) & ~contains_any(text, V.SUITE_WORDS),
                F.lit("不是明確套房"),
            )
        )
    checks.append(
        F.when(cost.isNull(), F.lit("租金未知")).when(
            cost > max_rent, F.concat(F.lit(f"租金超過 {max_rent}: "), cost.cast("string"))
        )
    )
    checks.append(
        F.when(area.isNull(), F.lit("坪數未知")).when(
            area < min_area, F.concat(F.lit(f"坪數小於 {min_area}: "), area.cast("string"))
        )
    )
    return F.array_compact(F.array(*checks))


def route(records: DataFrame, reasons: Column) -> DataFrame:
    """Rejected records stay in the table, with their reasons and status."""
    return (
        records.withColumn("match_text", classification_text())
        .withColumn("filter_reasons", reasons)
        .withColumn(
            "status", F.when(F.size("filter_reasons") == 0, F.lit("active")).otherwise("filtered_out")
        )
        .drop("match_text")
    )


def recent(records: DataFrame, max_age_days: int | Column, age: str = "update_age_days") -> DataFrame:
    """Drop only records known to be too old."""
    return records.filter(F.col(age).isNull() | (F.col(age) <= max_age_days))
