"""Proximity from the one strongest piece of evidence, and the linear rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.numbers import effective_cost
from ..functions.text import contains_any, context_text, normalize_location
from .skew import attach_facts

CONFLICT = "__conflict__"


def _evidence(score: Column, method: str, basis: Column, confidence: Column | str, reason: Column) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, str) else confidence
    return F.struct(
        score.cast("int").alias("score"),
        F.lit(method).alias("method"),
        basis.alias("basis"),
        confidence.alias("confidence"),
        reason.alias("reason"),
    )


def best_rule(text: Column, rules: Sequence[tuple], guard=None) -> Column:
    """struct(basis, label, score) of the highest-scoring rule with a term in the text.

    Rules are tried from the highest score down, the earlier one first on a tie, so one
    pass of branches finds the maximum and no join or sort is needed.
    """
    ordered = sorted(enumerate(rules), key=lambda r: (-r[1][3], r[0]))
    out = None
    for _, rule in reversed(ordered):
        basis, label, terms, score = rule[:4]
        hit = contains_any(text, terms)
        if guard is not None:
            hit = guard(rule) & hit
        value = F.struct(
            F.lit(basis).alias("basis"), F.lit(label).alias("label"), F.lit(score).alias("score")
        )
        out = F.when(hit, value) if out is None else F.when(hit, value).otherwise(out)
    return out


def best_road(text: Column, city: Column, district: Column, rules=V.ROAD_RULES) -> Column:
    def guard(rule) -> Column:
        unknown = F.coalesce(district, F.lit("")) == ""
        return unknown | district.isin(*rule[4])

    here = (F.coalesce(city, F.lit("")) == "") | (city == V.TARGET_CITY)
    return F.when(here, best_rule(text, rules, guard))


def best_station(text: Column, rules=V.STATION_RULES) -> Column:
    return best_rule(text, rules)


def _explicit(text: Column, names: Sequence[str]) -> Column:
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.contains(text, F.lit(name)), F.lit(name)).otherwise(out)
    return out


def add_evidence(
    df: DataFrame,
    address: Column,
    context: Column,
    city: str,
    district: str,
    out: str,
    roads=V.ROAD_RULES,
    stations=V.STATION_RULES,
    bases=V.DISTRICT_BASES,
    cities: Sequence[str] = V.EXPLICIT_CITIES,
) -> DataFrame:
    """Add struct(score, method, basis, confidence, reason) over normalised texts.

    Address road, context road, address station, context station, district base, unknown:
    the first that applies decides alone, so repeated advertising words add nothing. The
    steps are separate projections, so each intermediate value is computed once.
    """
    c = F.col
    districts = list(dict.fromkeys(d for _, d, _ in bases))
    texts = df.withColumns({"_address": address, "_context": context})
    places = texts.withColumns(
        {
            "_city": F.coalesce(_explicit(c("_address"), cities), F.translate(city, "臺", "台")),
            "_district": F.coalesce(_explicit(c("_address"), districts), c(district)),
            "_said_city": _explicit(c("_context"), cities),
            "_said_district": _explicit(c("_context"), districts),
        }
    )
    city_clash = F.coalesce((c("_said_city") != c("_city")) & (c("_city") != ""), F.lit(False))
    district_clash = F.coalesce(
        (c("_said_district") != c("_district")) & (c("_district") != ""), F.lit(False)
    )
    scoped = places.withColumns(
        {
            "_context_city": F.when(city_clash, F.lit(CONFLICT))
            .when(district_clash, c("_city"))
            .otherwise(F.coalesce("_said_city", "_city")),
            "_context_district": F.when(city_clash | district_clash, F.lit(CONFLICT)).otherwise(
                F.coalesce("_said_district", "_district")
            ),
        }
    )
    base = F.lit(None).cast("int")
    for place_city, place_district, score in bases:
        here = (c("_city") == place_city) & (c("_district") == place_district)
        base = F.when(here, F.lit(score)).otherwise(base)
    found = scoped.withColumns(
        {
            "_road": best_road(c("_address"), c("_city"), c("_district"), roads),
            "_hint": best_road(c("_context"), c("_context_city"), c("_context_district"), roads),
            "_station": best_station(c("_address"), stations),
            "_near": best_station(c("_context"), stations),
            "_base": base,
            "_detailed": c("_address").rlike(r"(?U)(?:\d+|[xX])(?:巷|弄|號)"),
        }
    )

    def capped(rule: str, off: int) -> Column:
        return F.least(F.lit(78), F.greatest(F.lit(0), c(f"{rule}.score") - off))

    chosen = (
        F.when(
            c("_road").isNotNull(),
            _evidence(
                F.when(c("_detailed"), c("_road.score")).otherwise(c("_road.score") - 2),
                "address_road",
                F.concat(F.lit("road:"), "_road.basis"),
                F.when(c("_detailed"), F.lit("high")).otherwise("medium"),
                F.concat(F.lit("地址符合台大周邊路段："), "_road.label"),
            ),
        )
        .when(
            c("_hint").isNotNull(),
            _evidence(
                capped("_hint", 18),
                "context_road",
                F.concat(F.lit("context_road:"), "_hint.basis"),
                "low",
                F.concat(F.lit("標題或描述提到台大周邊路段："), "_hint.label", F.lit("（未由地址確認）")),
            ),
        )
        .when(
            c("_station").isNotNull(),
            _evidence(
                c("_station.score"),
                "mrt_station",
                c("_station.basis"),
                "medium",
                F.concat(F.lit("地址明確提到捷運"), "_station.label"),
            ),
        )
        .when(
            c("_near").isNotNull(),
            _evidence(
                capped("_near", 12),
                "mrt_station",
                c("_near.basis"),
                "low",
                F.concat(F.lit("標題或描述提到捷運"), "_near.label", F.lit("（未由地址確認）")),
            ),
        )
        .when(
            c("_base").isNotNull(),
            _evidence(
                c("_base"),
                "district",
                F.concat(F.lit("district:"), "_city", F.lit("/"), "_district"),
                "low",
                F.concat(F.lit("僅能依行政區粗估："), "_city", "_district"),
            ),
        )
        .otherwise(
            _evidence(
                F.lit(None).cast("int"),
                "unknown",
                F.lit("unknown:insufficient_location"),
                "none",
                F.lit("地址、明確捷運站與可用行政區資料皆不足"),
            )
        )
    )
    return found.select(*df.columns, chosen.alias(out))


def minutes_score(minutes: Column) -> Column:
    return (
        F.when(minutes <= 15, 100)
        .when(minutes <= 25, 85)
        .when(minutes <= 35, 70)
        .when(minutes <= 50, 50)
        .when(minutes.isNotNull(), 30)
    )


def route_origin() -> Column:
    """The address as a route origin: city and district are added unless it names them."""
    address = F.col("address")
    city = F.translate("city", "臺", "台")
    plain = F.translate(address, "臺", "台")
    return F.concat(
        F.when((city != "") & ~F.contains(plain, city), city).otherwise(""),
        F.when((F.col("district") != "") & ~F.contains(address, F.col("district")), F.col("district")).otherwise(""),
        address,
    )


def add_proximity(
    records: DataFrame, commute: DataFrame | None = None, enabled: bool = True
) -> DataFrame:
    """Score and evidence columns; measured minutes (``origin, minutes``) override the cascade.

    Only records with an address are looked up, and each distinct origin once: the
    look-up shuffles one row per origin, not one per record.
    """
    if not enabled:
        return records.withColumns(
            {
                "near_ntu_score": F.lit(None).cast("int"),
                "commute_minutes": F.lit(None).cast("int"),
                **{
                    f"score_{n}": F.lit(None).cast("string")
                    for n in ("method", "basis", "confidence", "reason")
                },
            }
        )
    out = add_evidence(
        records,
        normalize_location(F.coalesce("address", F.lit(""))),
        normalize_location(context_text()),
        "city",
        "district",
        "_e",
    )
    if commute is not None:
        measured = commute.filter("minutes IS NOT NULL").select(
            F.col("origin").alias("_origin"), F.col("minutes").cast("int").alias("_minutes")
        )  # one row per origin
        with_origin = out.withColumn(
            "_origin", F.when(F.coalesce("address", F.lit("")) != "", route_origin())
        )
        minutes = F.col("_minutes")
        out = (
            attach_facts(with_origin, measured, ["_origin"])
            .withColumn(
                "_e",
                F.when(
                    minutes.isNotNull(),
                    _evidence(
                        minutes_score(minutes),
                        "google_routes",
                        F.lit("google_routes:transit_to_ntu_main_campus"),
                        "high",
                        F.concat(
                            F.lit("Google Routes 大眾運輸估算 "), minutes.cast("string"), F.lit(" 分鐘")
                        ),
                    ),
                ).otherwise(F.col("_e")),
            )
            .withColumn("commute_minutes", F.coalesce(minutes, F.col("commute_minutes")))
            .drop("_origin", "_minutes", "_n")
        )
    return out.withColumns(
        {
            "near_ntu_score": F.col("_e.score"),
            "score_method": F.col("_e.method"),
            "score_basis": F.col("_e.basis"),
            "score_confidence": F.col("_e.confidence"),
            "score_reason": F.col("_e.reason"),
        }
    ).drop("_e")


def rank_score(max_rent: int = 18_600) -> Column:
    """Linear desirability; unknown parts add nothing."""
    cost = effective_cost(F.col("total_monthly_cost"), F.col("rent"))

    def bonus(flag: str, points: float) -> Column:
        return F.when(F.col(flag), F.lit(points)).otherwise(0.0)

    return (
        F.coalesce(F.col("near_ntu_score").cast("double"), F.lit(0.0))
        + F.when((cost != 0) & cost.isNotNull(), F.greatest(F.lit(0.0), (F.lit(max_rent) - cost) / F.lit(300.0)))
        .otherwise(0.0)
        + F.when(F.col("area_ping").isNotNull(), F.least(F.lit(15.0), F.col("area_ping"))).otherwise(0.0)
        + bonus("has_rent_subsidy", 12.0)
        + bonus("has_tax_registration", 8.0)
        + bonus("has_independent_washer", 10.0)
        + bonus("has_garbage_collection", 5.0)
        + F.when(F.col("commute_minutes") <= 15, F.lit(15.0)).otherwise(0.0)
    )
