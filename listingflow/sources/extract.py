"""Pages to records: structure in one Python pass, meaning in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cluster import for_pages
from ..functions import numbers as N
from ..functions import text as X
from ..functions import urls as U
from ..functions import vocabulary as V
from ..functions.text import blank_to_null
from ..operators.dedupe import first_wins
from ..operators.gazetteer import Gazetteer, PlaceTable, address_in_text
from .dom import CANDIDATE_DDL, CARD, DETAIL, JSONLD, STATE, arrow_page_reader
from .pages import page_errors
from .specs import SourceSpec


def page_candidates(pages: DataFrame, spec: SourceSpec) -> DataFrame:
    """One row per possible record of each page. Only columns the parser needs go to Python."""
    for_pages(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "source", F.col("url").alias("page_url"), "html").mapInArrow(
        arrow_page_reader(spec.page_rules()),
        f"page_id {kind}, source string, page_url string, {CANDIDATE_DDL}",
    )


def _first(values: Column, parse) -> Column:
    """First item, in key order, that parses."""
    return F.try_element_at(F.filter(F.transform(values, parse), lambda v: v.isNotNull()), F.lit(1))


def _flags(text: Column) -> dict[str, Column]:
    return {
        "has_rent_subsidy": X.tri_state(text, V.SUBSIDY_WORDS, V.PAGE_SUBSIDY_DENIED),
        "has_tax_registration": X.tri_state(text, V.TAX_WORDS, V.PAGE_TAX_DENIED),
        "has_independent_washer": X.tri_state(text, V.PAGE_WASHER_WORDS, V.WASHER_SHARED),
        "has_garbage_collection": X.tri_state(text, V.GARBAGE_WORDS, V.GARBAGE_DENIED),
    }


def generic_records(found: DataFrame, spec: SourceSpec, gazetteer: Gazetteer | PlaceTable) -> DataFrame:
    """Candidates of an ordinary source to records; ``valid`` marks those with a listing signal."""
    text, url = F.col("text"), F.col("url")
    is_object = F.col("strategy").isin(JSONLD, STATE)
    low, high = spec.area_bounds
    titled = (
        found.withColumn(
            "title", F.coalesce(blank_to_null(F.col("title")), blank_to_null(X.short_title(text)))
        )
        .withColumn(
            "place_text",
            F.when(
                is_object, F.concat_ws("\n", F.coalesce("address", F.lit("")), "title", "text")
            ).otherwise(text),
        )
        .withColumn("raw_text", X.clean(text))
        .withColumn("room_text", F.when(is_object, F.concat_ws("\n", F.coalesce("room", F.lit("")), text)).otherwise(text))
        .withColumn("floor", N.floor_text(text))
        .withColumn("given_price", _first(F.col("prices"), lambda v: N.bounded_int(v, 1_000, spec.max_rent)))
        .withColumn("text_rent", N.rent_in_text(text, spec.max_rent))
        .withColumn("given_area", _first(F.col("areas"), lambda v: N.bounded_float(v, low, high)))
        .withColumn("text_area", N.area_in_text(text, low, high))
        .withColumn(
            "fee",
            F.coalesce(
                _first(
                    F.col("fees"),
                    lambda v: F.when(
                        N.bounded_int(v, 1_000, 300_000) <= spec.max_fee, N.bounded_int(v, 1_000, 300_000)
                    ),
                ),
                N.fee_in_text(text, spec.max_fee),
            ),
        )
    )
    placed = gazetteer.add_place(titled, "place_text", "city", "district")
    told = (
        F.coalesce("given_price", "text_rent").isNotNull()
        | F.coalesce("given_area", "text_area").isNotNull()
        | F.coalesce("city", "district", "address").isNotNull()
    )
    # A place in the text alone is asked for only where nothing else is a signal.
    asked = placed.withColumn("_asked", F.when(is_object & ~told, text))
    staged = gazetteer.add_place(asked, "_asked", out="text_place").drop("_asked")
    signal = told | F.col("text_place.district").isNotNull()
    kept = staged.withColumn(
        "valid",
        (F.trim(text) != "")
        & F.col("title").isNotNull()
        & U.is_detail_url(url, spec.detail_url_patterns)
        & (~is_object | signal),
    )
    rent = F.coalesce("given_price", "text_rent")
    own_id = F.coalesce(
        _first(F.col("ids"), lambda v: blank_to_null(F.regexp_extract(v, r"[A-Za-z0-9][A-Za-z0-9_-]{3,}", 0))),
        U.id_from_url(url, spec.detail_url_patterns),
    )
    flags = _flags(text)
    labels = F.array_compact(
        F.array(*[F.when(c, F.lit(t)) for t, c in zip(V.FLAG_TAGS, flags.values(), strict=True)])
    )
    city, district = F.col("place.city"), F.col("place.district")
    floor = F.col("floor")
    restriction = F.coalesce(
        X.gender_snippet(F.col("raw_text")),
        F.substring(
            F.try_element_at(
                F.filter("gender", lambda v: X.gender_snippet(v).isNotNull()), F.lit(1)
            ),
            1,
            120,
        ),
    )
    audit = F.struct(
        _parser_name().alias("parser"),
        F.col("page_url"),
        url.alias("canonical_url"),
        own_id.alias("source_listing_id"),
        N.rent_in_text(F.col("raw_text"), spec.max_rent).alias("rent_monthly"),
        F.col("fee").alias("management_fee"),
        N.layout(F.col("raw_text")).alias("layout"),
        N.total_floor(floor).alias("total_floor"),
        X.updated_text(F.col("raw_text")).alias("updated_at_text"),
        X.listed_text(F.col("raw_text")).alias("listed_at_text"),
        N.update_age_days(F.col("raw_text")).alias("update_age_days"),
        restriction.alias("gender_restriction"),
        F.try_parse_json("payload").alias("raw_payload"),
    )
    return kept.select(
        *_position(spec),
        F.coalesce(
            own_id,
            U.canonical_id(F.lit(spec.name), F.when(is_object, F.concat(url, "title")).otherwise(url)),
        ).alias("listing_id"),
        url.alias("url"),
        F.col("title"),
        city.alias("city"),
        district.alias("district"),
        F.coalesce("address", address_in_text(F.col("place_text"), city, district)).alias("address"),
        rent.alias("rent"),
        N.total_cost(rent, F.col("fee")).alias("total_monthly_cost"),
        F.coalesce("given_area", "text_area").alias("area_ping"),
        N.room_type(F.col("room_text"), N.ROOM_RULES).alias("room_type"),
        floor.alias("floor"),
        F.col("raw_text").alias("description"),
        F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), labels)).alias("tags"),
        *[c.alias(n) for n, c in flags.items()],
        F.coalesce("images", F.array().cast("array<string>")).alias("image_urls"),
        N.update_age_days(F.col("raw_text")).alias("update_age_days"),
        F.to_json(audit).alias("raw"),
    )


def portal_records(found: DataFrame, spec: SourceSpec, gazetteer: Gazetteer | PlaceTable) -> DataFrame:
    """Candidates of the portal with numeric ids: its own precedence and bounds."""
    text = F.col("text")
    jsonld, state, card = (F.col("strategy") == s for s in (JSONLD, STATE, CARD))
    kind = F.substring_index(U.query_value(F.col("page_url"), "kind"), "-", 1)
    page_room = F.lit(None).cast("string")
    for value, label in V.PORTAL_ROOM_BY_KIND:
        page_room = F.when(X.strip(kind) == value, F.lit(label)).otherwise(page_room)
    room_text = F.when(state, F.concat_ws("\n", F.coalesce("room", F.lit("")), text)).otherwise(text)
    own_id = F.coalesce(
        F.when(state, _first(F.col("ids"), lambda v: blank_to_null(F.regexp_extract(v, r"\d{4,}", 0)))),
        U.portal_id(F.coalesce("url", F.lit(""))),
    )
    staged = (
        found.withColumn("own_id", own_id)
        .withColumn(
            "url",
            F.coalesce(
                F.col("url"),
                F.concat(F.lit(f"{U.PORTAL_DETAIL_BASE}/rent-detail-"), "own_id", F.lit(".html")),
            ),
        )
        .withColumn("text_room", N.room_type(room_text, N.PORTAL_ROOM_RULES))
        .withColumn("page_room", page_room)
        .withColumn(
            "given_price", _first(F.col("prices"), lambda v: N.bounded_int(v, 1_000, spec.max_rent))
        )
        .withColumn("text_rent", F.when(~jsonld, N.rent_in_text(text, spec.max_rent)))
    )
    located = F.coalesce("city", "district", "address").isNotNull()
    suite = F.contains(text, F.lit("套房"))
    kept = staged.withColumn(
        "valid",
        F.when(jsonld, suite)
        .when(
            state,
            F.col("url").isNotNull()
            & (F.trim(text) != "")
            & (F.coalesce("text_room", "page_room").isNotNull() | suite)
            & (F.coalesce("given_price", "text_rent").isNotNull() | located),
        )
        .otherwise((text != "") & (suite | F.col("page_room").isNotNull())),
    )
    kept = (
        kept.withColumn("jsonld_text", F.concat_ws("\n", F.coalesce("address", F.lit("")), text))
        .withColumn("named_city", X.normalize_spelling(F.col("city")))
        .withColumn("named", X.normalize_spelling(F.col("district")))
    )
    kept = gazetteer.add_place_of_page(kept, "page_url", "page_place")
    kept = gazetteer.add_place_longest_first(kept, "text", "page_url", out="from_page")
    kept = gazetteer.add_place_longest_first(kept, "jsonld_text", out="from_jsonld")
    kept = gazetteer.add_city_of(kept.withColumn("scope", F.coalesce("named_city", "page_place.city")), "named", "scope", "owner")
    place = (
        F.when(jsonld, F.col("from_jsonld"))
        .when(card, F.col("from_page"))
        .when(
            F.col("named").isNotNull(),
            F.struct(F.coalesce("owner", "scope").alias("city"), F.col("named").alias("district")),
        )
        .when(
            F.col("named_city").isNotNull(),
            F.struct(F.col("named_city").alias("city"), F.col("from_page.district").alias("district")),
        )
        .otherwise(F.col("from_page"))
    )
    fee = F.when(
        state,
        F.coalesce(
            _first(
                F.col("fees"),
                lambda v: F.when(
                    N.bounded_int(v, 1_000, 200_000) <= spec.max_fee, N.bounded_int(v, 1_000, 200_000)
                ),
            ),
            N.fee_in_text(text, spec.max_fee),
        ),
    )
    done = kept.withColumn("place", place).withColumn("fee", fee)
    city, district = F.col("place.city"), F.col("place.district")
    rent = F.coalesce("given_price", "text_rent")
    deep = F.array_join("gender_deep", " / ")
    audit = F.struct(
        _parser_name().alias("parser"),
        F.col("page_url"),
        F.col("fee").alias("management_fee"),
        F.when(state, blank_to_null(deep)).alias("gender_restriction"),
        F.when(jsonld, F.try_parse_json("payload")).alias("jsonld"),
    )
    floor_given = F.when(
        F.col("all_floor").isNotNull() & ~F.contains("floor", F.lit("/")),
        F.concat("floor", F.lit("/"), "all_floor", F.lit("F")),
    ).otherwise(F.col("floor"))
    empty = F.array().cast("array<string>")
    title = F.coalesce(
        blank_to_null(F.col("title")),
        F.when(~jsonld, blank_to_null(X.short_title(text, skip_numeric=False))),
        F.lit("591 房源"),
    )
    return done.select(
        *_position(spec),
        F.coalesce("own_id", U.canonical_id(F.lit(spec.name), F.col("url"))).alias("listing_id"),
        F.col("url"),
        title.alias("title"),
        city.alias("city"),
        district.alias("district"),
        F.when(card, address_in_text(text, city, district, 40, portal=True))
        .otherwise(F.col("address"))
        .alias("address"),
        rent.alias("rent"),
        N.total_cost(rent, F.col("fee")).alias("total_monthly_cost"),
        F.coalesce(
            F.when(state, _first(F.col("areas"), lambda v: N.bounded_float(v, 1, 100))),
            N.area_in_text(text, *spec.area_bounds),
        ).alias("area_ping"),
        F.coalesce(F.col("text_room"), F.when(~jsonld, F.col("page_room"))).alias("room_type"),
        F.when(state, floor_given).when(card, N.floor_text(text, V.PORTAL_FLOOR)).alias("floor"),
        F.when(jsonld, F.coalesce("description", F.lit(""))).otherwise(text).alias("description"),
        F.when(state, F.coalesce("tags", empty)).otherwise(empty).alias("tags"),
        *[F.lit(None).cast("boolean").alias(n) for n in _flags(text)],
        F.coalesce("images", empty).alias("image_urls"),
        N.update_age_days(text, day_words="前").alias("update_age_days"),
        F.to_json(audit).alias("raw"),
    )


def _parser_name() -> Column:
    names = {JSONLD: "jsonld", STATE: "embedded_state", CARD: "anchor_card", DETAIL: "detail_text"}
    out = F.lit(None).cast("string")
    for strategy, name in names.items():
        out = F.when(F.col("strategy") == strategy, F.lit(name)).otherwise(out)
    return out


def _position(spec: SourceSpec) -> list[Column]:
    return [
        F.lit(spec.ordinal).alias("source_ord"),
        F.col("page_id"),
        F.col("strategy"),
        F.col("pos"),
        F.lit(spec.name).alias("source"),
        F.lit("active").alias("status"),
        F.coalesce("valid", F.lit(False)).alias("valid"),
    ]


def page_records(readable: DataFrame, spec: SourceSpec, gazetteer: Gazetteer | PlaceTable) -> DataFrame:
    """Records per page, each key once per page, in the order strategy, position.

    A page's page-text record counts only if nothing else was found on it.
    """
    return records_of(page_candidates(readable, spec), spec, gazetteer)


def records_of(found: DataFrame, spec: SourceSpec, gazetteer: Gazetteer | PlaceTable) -> DataFrame:
    """The same from candidates that were read already."""
    build = portal_records if spec.kind == "portal" else generic_records
    rows = build(gazetteer.prepared(found), spec, gazetteer)
    # A page is one HTML value, so its records are a small group. Whether a candidate is
    # valid is decided from many derived columns; filtering only after the window keeps that
    # test from being pushed down and repeated inside them.
    on_page = Window.partitionBy("page_id")
    rows = (
        rows.withColumn("_best", F.min(F.when(F.col("valid"), F.col("strategy"))).over(on_page))
        .filter(F.col("valid") & ((F.col("strategy") != DETAIL) | (F.col("_best") == DETAIL)))
        .drop("_best", "valid")
    )
    return first_wins(rows, ["page_id", "source", "listing_id"], [F.col("strategy"), F.col("pos")])


def _quarantine(own: DataFrame, readable: DataFrame, rows: DataFrame) -> DataFrame:
    """Refused pages, and pages without a record."""
    empty = readable.join(rows.select("page_id").distinct(), "page_id", "left_anti").select(
        "source",
        "url",
        F.lit("EMPTY_RESULT").alias("code"),
        F.lit("no listings parsed from rendered HTML").alias("message"),
    )
    refused = own.filter("code IS NOT NULL").select("source", "url", "code", "message")
    return refused.unionByName(empty)


def extract_records(pages: DataFrame, spec: SourceSpec, gazetteer: Gazetteer | PlaceTable) -> tuple[DataFrame, DataFrame]:
    """Records and quarantine of one source's pages (``page_id, url, html[, status]``).

    The first occurrence of a key wins, in the order page, strategy, position.
    """
    own = page_errors(pages.withColumn("source", F.lit(spec.name)))
    readable = own.filter("code IS NULL")
    # As a value, not a filter: a filter would be pushed below the dealing of pages to tasks, and its test with it.
    markup = F.when(F.col("code").isNull(), F.coalesce("html", F.lit("")))
    rows = page_records(own.withColumn("html", markup), spec, gazetteer)
    records = first_wins(rows, ["source", "listing_id"], [F.col("page_id"), F.col("strategy"), F.col("pos")])
    return records, _quarantine(own, readable, rows)


def preview(records: DataFrame, source: str, limit: int = 3) -> DataFrame:
    """First records of one source with cost and place; touches no state."""
    return (
        records.filter(F.col("source") == source)
        .orderBy("page_id", "strategy", "pos")
        .limit(limit)
        .select(
            F.coalesce(N.effective_cost(F.col("total_monthly_cost"), F.col("rent")), F.lit(0)).alias("cost"),
            "area_ping",
            F.concat_ws("", "city", "district").alias("location"),
            "room_type",
            "title",
            "url",
        )
    )
