"""Number columns read out of text, and cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import blank_to_null, clean, contains_any, narrow_digits, squeeze



def _wide(pattern: str) -> str:
    """A pattern that takes full-width digits too, so that only what it finds is narrowed, not the whole text."""
    return pattern.replace(r"[\d", "[0-9０-９").replace(r"\d", "[0-9０-９]").replace(r"\D", "[^0-9０-９]")


def _digits(c: Column, pattern: str) -> Column:
    """What the pattern's group finds, in plain digits."""
    return narrow_digits(F.regexp_extract(c, _wide(pattern), 1))


def _as_long(c: Column) -> Column:
    return blank_to_null(F.replace(c, F.lit(","), F.lit(""))).try_cast("bigint")


def first_int(c: Column) -> Column:
    """First run of digits and thousands separators, as a number."""
    return _as_long(_digits(c, r"(\d[\d,]*)"))


def bounded_int(c: Column, low: int, high: int) -> Column:
    n = first_int(c)
    return F.when(n.between(low, high), n.cast("int"))


def first_float(c: Column) -> Column:
    return blank_to_null(_digits(c, r"(\d+(?:\.\d+)?)")).try_cast("double")


def bounded_float(c: Column, low: float, high: float) -> Column:
    n = first_float(c)
    return F.when(n.between(low, high), n)


def _matches(c: Column, patterns: tuple[str, ...], low: int, high: int) -> Column:
    found = F.concat(*[F.regexp_extract_all(c, F.lit(_wide(p)), 1) for p in patterns])
    return F.filter(F.transform(found, lambda n: _as_long(narrow_digits(n))), lambda n: n.between(low, high))


def rent_in_text(c: Column, high: int, low: int = 3_000, gap: int = 12, pick: str = "max") -> Column:
    """Labelled or suffixed amounts within bounds; the largest, or the smallest for forums."""
    values = _matches(c, (V.LABELLED_RENT % gap, V.SUFFIXED_RENT), low, high)
    return (F.array_max if pick == "max" else F.array_min)(values).cast("int")


def fee_in_text(c: Column, high: int) -> Column:
    return F.array_max(_matches(c, (V.LABELLED_FEE, V.SUFFIXED_FEE), 0, high)).cast("int")


def total_cost(rent: Column, fee: Column) -> Column:
    return F.coalesce(rent + fee, rent)


def effective_cost(total: Column, rent: Column) -> Column:
    """Total if known, else rent; a stored 0 counts as not known."""
    return F.coalesce(F.when(total != 0, total), rent)


def area_in_text(c: Column, low: float | None, high: float | None, units: str = "坪") -> Column:
    n = blank_to_null(_digits(c, rf"(\d+(?:\.\d+)?)(?U:\s*)(?:{units})")).try_cast("double")
    return n if low is None else F.when(n.between(low, high), n)


def room_type(c: Column, rules: tuple[tuple[tuple[str, ...], str], ...]) -> Column:
    """First rule, in order, one of whose words occurs."""
    out = F.lit(None).cast("string")
    for words, label in reversed(rules):
        out = F.when(contains_any(c, words), F.lit(label)).otherwise(out)
    return out


# Room types in the order they are tried, per kind of source.
ROOM_RULES = (
    (("獨立套房", "獨套"), "獨立套房"),
    (("分租套房", "分套"), "分租套房"),
    (("套房",), "套房"),
    (("雅房",), "雅房"),
    (("整層住家", "整層"), "整層住家"),
    (("車位",), "車位"),
    (("店面",), "店面"),
    (("辦公",), "辦公"),
)
PORTAL_ROOM_RULES = (
    (("獨立套房",), "獨立套房"),
    (("分租套房",), "分租套房"),
    (("獨套",), "獨立套房"),
    (("分套",), "分租套房"),
    (("套房",), "套房"),
)
FORUM_ROOM_RULES = (*PORTAL_ROOM_RULES, (("雅房",), "雅房"))


def layout(c: Column) -> Column:
    return squeeze(F.coalesce(*[blank_to_null(F.regexp_extract(c, p, 1)) for p in V.LAYOUTS]))


def floor_text(c: Column, pattern: str = V.FLOOR) -> Column:
    return F.upper(squeeze(blank_to_null(F.regexp_extract(c, pattern, 1))))


def total_floor(floor: Column) -> Column:
    return F.regexp_replace(blank_to_null(F.regexp_extract(floor, r"\A[^/]*/(.*)\z", 1)), "[樓F]", "")


def update_age_days(c: Column, day_words: str = "內|前") -> Column:
    """Days since the last update as stated in the text; null when not stated."""
    suffix = f"(?:{day_words})?" if "|" in day_words else day_words
    days = _as_long(_digits(c, rf"(\d+)(?U:\s*)天{suffix}更新"))
    return (
        F.when(contains_any(c, ("新上架", "剛剛更新", "今天更新", "今日更新")), F.lit(0))
        .when(c.rlike(r"(?U)\d+\s*(?:分鐘|小時)(?:內|前)?更新"), F.lit(0))
        .when(days.isNotNull(), days)
        .when(contains_any(c, ("昨日更新", "昨天更新")), F.lit(1))
        .cast("int")
    )


def price_like(c: Column, low: int = 3_000, high: int = 80_000) -> Column:
    return bounded_int(c, low, high)


def to_bool(c: Column) -> Column:
    """Permissive flag text; anything else is null."""
    t = F.lower(clean(c.cast("string")))
    return F.when(t.isin("1", "true", "yes", "on"), F.lit(True)).when(
        t.isin("0", "false", "no", "off"), F.lit(False)
    )


def _positive_json(payload: Column, key: str) -> Column:
    value = F.try_variant_get(payload, f"$.{key}", "string")
    number = F.floor(value.try_cast("double")).cast("int")
    is_bool = F.try_variant_get(payload, f"$.{key}", "variant").isNotNull() & (
        F.lower(value).isin("true", "false")
    )
    return F.when(~is_bool & (number > 0), number)


def snapshot_cost(payload: Column) -> Column:
    """Positive cost from a snapshot payload: total first, then rent; flags are not numbers."""
    return F.coalesce(_positive_json(payload, "total_monthly_cost"), _positive_json(payload, "rent"))


def iso_timestamp(c: Column) -> Column:
    """ISO text to a UTC timestamp; text without a zone is taken as UTC; invalid is null.

    A whole date is required: a bare time or year would depend on the day of the run.
    """
    t = F.trim(c)
    zoned = F.when(t.rlike(r"\A\d{4}-\d{2}-\d{2}\z"), F.concat(t, F.lit("T00:00:00Z"))).otherwise(
        F.when(t.rlike(r"[T ]\d{2}[^T ]*(?:[Zz]|[+-]\d{2}(?::?\d{2})?)\z"), t).otherwise(F.concat(t, F.lit("Z")))
    )
    return F.when(t.rlike(r"\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}|\z)"), F.try_to_timestamp(zoned))


def duration_minutes(c: Column) -> Column:
    """``"90.5s"`` to whole minutes, at least one; half minutes go to the even neighbour."""
    seconds = F.floor(
        blank_to_null(F.regexp_extract(c, r"\A(\d+(?:\.\d+)?)s\z", 1)).try_cast("double")
    )
    return F.when(seconds.isNotNull(), F.greatest(F.lit(1), F.bround(seconds / 60).cast("int")))
