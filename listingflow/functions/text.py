"""Text columns: cleaning, tri-state keyword flags, snippets and display values."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V

SPACE = r"(?U)\s+"
# What ``(?U)\s`` takes, one by one.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it.

    Also when the result is filtered on: a filter pushed below a projection repeats the
    expression it tests, and a plain repeated reference would be repeated with it.
    """
    return F.transform(F.array(value), body)[0]


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.btrim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def squeeze(c: Column) -> Column:
    """Remove all white space."""
    return F.regexp_replace(c, SPACE, "")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def words_found(c: Column, words: Sequence[str]) -> Column:
    """The listed words that occur, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(c, F.lit(w)), F.lit(w)) for w in words]))


def tri_state(c: Column, positive: Sequence[str], negative: Sequence[str]) -> Column:
    """false if any denial occurs, else true if any affirmation does, else null."""
    return F.when(contains_any(c, negative), F.lit(False)).when(
        contains_any(c, positive), F.lit(True)
    )


def short_title(c: Column, skip_numeric: bool = True, limit: int = 120) -> Column:
    """First line or sentence worth showing, else the whole text, cut to ``limit``."""
    lines = F.transform(F.split(c, "[\n。]"), clean)

    def keep(line: Column) -> Column:
        ok = F.length(line) >= 4
        if skip_numeric:
            ok = ok & ~line.rlike(r"(?U)\A[\d,./坪元月樓F\s|]+\z")
        return ok

    first = F.try_element_at(F.filter(lines, keep), F.lit(1))
    return F.substring(F.coalesce(first, clean(c)), 1, limit)


def short_summary(c: Column, limit: int = 160) -> Column:
    return F.substring(clean(c), 1, limit)


def normalize_spelling(c: Column) -> Column:
    """Common spelling variants of place names."""
    return F.replace(F.replace(strip(c), F.lit("臺"), F.lit("台")), F.lit("峨嵋鄉"), F.lit("峨眉鄉"))


# Full-width ASCII block (U+FF01..U+FF5E) and the ideographic space.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def narrow(c: Column) -> Column:
    """Full-width ASCII to plain ASCII."""
    return F.translate(c, _WIDE, _NARROW)


def narrow_digits(c: Column) -> Column:
    return F.translate(c, "０１２３４５６７８９", "0123456789")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Full compatibility normalisation, for text with more than full-width ASCII in it."""
    return texts.str.normalize("NFKC")


def normalize_location(c: Column, full_nfkc: bool = False) -> Column:
    """Address text in one spelling: width, 臺/台, road typo, section digits, no separators.

    Full-width ASCII is narrowed on the JVM; ``full_nfkc`` sends the text through a
    vectorised UDF instead, which also folds rarer compatibility characters.
    """
    base = nfkc(c) if full_nfkc else narrow(c)
    t = F.replace(F.translate(base, "臺", "台"), F.lit("汀洲路"), F.lit("汀州路"))
    for chinese, digit in zip(*V.SECTION_DIGITS, strict=True):
        t = F.replace(t, F.lit(f"{chinese}段"), F.lit(f"{digit}段"))
    t = F.replace(t, F.lit("十段"), F.lit("10段"))
    return F.regexp_replace(t, r"(?U)[\s\-–—_/]+", "")


def fingerprint_text(c: Column) -> Column:
    t = F.regexp_replace(c, r"(?U)[^\w\x{4e00}-\x{9fff}]", "")
    for word in V.FINGERPRINT_NOISE:
        t = F.replace(t, F.lit(word), F.lit(""))
    return t


def female_only(c: Column) -> Column:
    t = squeeze(c)
    return t.rlike("|".join((*V.FEMALE_ONLY_PATTERNS, V.FEMALE_ONLY_BRACKET)))


def female_only_value(c: Column) -> Column:
    """A value stored under a gender-like key: neutral words win, then exact or text match."""
    t = F.lower(squeeze(c))
    return (
        (t != "")
        & ~contains_any(t, V.GENDER_NEUTRAL_WORDS)
        & (t.isin(*V.FEMALE_VALUES) | female_only(c))
    )


def gender_snippet(c: Column, limit: int = 120) -> Column:
    t = squeeze(c)
    hits = [blank_to_null(F.regexp_extract(t, p, 0)) for p in V.FEMALE_ONLY_PATTERNS]
    return F.substring(F.coalesce(*hits), 1, limit)


def first_match(c: Column, patterns: Iterable[str], group: int = 0) -> Column:
    return F.coalesce(*[blank_to_null(F.regexp_extract(c, p, group)) for p in patterns])


def updated_text(c: Column) -> Column:
    return first_match(c, V.UPDATED_TEXTS)


def listed_text(c: Column) -> Column:
    return first_match(c, V.LISTED_TEXTS)


def first_key(obj: Column, keys: Sequence[str]) -> Column:
    """First non-blank value of the keys of a JSON object (a variant), trimmed."""
    return F.coalesce(*[blank_to_null(strip(F.try_variant_get(obj, f"$.{k}", "string"))) for k in keys])


def labelled_field(c: Column, labels: Sequence[str]) -> Column:
    """Value of the earliest line that reads ``label: value``; label order breaks a tie."""
    alternatives = "|".join(labels)
    lines = F.transform(F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    pattern = rf"(?U)\A(?:{alternatives})\s*[:：]\s*(.+)\z"
    hit = F.try_element_at(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(1))
    return strip(blank_to_null(F.regexp_extract(hit, pattern, 1)))


def classification_text(prefix: str = "") -> Column:
    """All words a record carries, one part per line, blanks dropped."""
    c = lambda n: F.col(f"{prefix}{n}")
    parts = [c(n) for n in ("title", "city", "district", "address", "room_type", "description")]
    parts.append(F.array_join(c("tags"), " "))
    return F.concat_ws("\n", *[blank_to_null(p) for p in parts])


def context_text(prefix: str = "") -> Column:
    """Advertising copy only: no structured location."""
    c = lambda n: F.col(f"{prefix}{n}")
    parts = [c("title"), c("room_type"), c("description"), F.array_join(c("tags"), " ")]
    return F.concat_ws("\n", *[blank_to_null(p) for p in parts])


def string_list(c: Column) -> Column:
    """null to [], JSON array text to its items, any other text to one item."""
    return (
        F.when(c.isNull(), F.array().cast("array<string>"))
        .otherwise(F.coalesce(F.from_json(c, "array<string>"), F.array(c)))
    )


def redact(c: Column, secret: str | None = None) -> Column:
    t = F.replace(c, F.lit(secret), F.lit(V.REDACTED_WEBHOOK)) if secret else c
    return F.regexp_replace(t, V.WEBHOOK_PATTERN, V.REDACTED_WEBHOOK)


# --- display -------------------------------------------------------------------------


def money(c: Column) -> Column:
    return F.coalesce(F.concat(F.format_number(c, 0), F.lit(" 元")), F.lit(V.UNKNOWN))


def plain_number(c: Column) -> Column:
    """Six significant digits, trailing zeros dropped (values from 1e-4 to 1e6)."""
    size = F.abs(c)
    branches = F.when(c == 0, F.lit("0"))
    for power in range(-3, 6):
        branches = branches.when(size < 10.0**power, F.format_string(f"%.{6 - power}f", c))
    text = branches.otherwise(F.format_string("%.0f", c))
    trimmed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(c.isNotNull(), trimmed)


def number_with_unit(c: Column, suffix: str = "") -> Column:
    return F.coalesce(F.concat(plain_number(c), F.lit(suffix)), F.lit(V.UNKNOWN))


def flag_mark(c: Column) -> Column:
    return F.when(c, F.lit("✅")).when(~c, F.lit("❌")).otherwise(F.lit(V.UNKNOWN))


def time_text(c: Column, zone: str = "UTC") -> Column:
    local = F.from_utc_timestamp(c, zone) if zone != "UTC" else c
    return F.coalesce(F.date_format(local, "yyyy-MM-dd HH:mm"), F.lit(V.UNKNOWN))


def location_text(city: Column, district: Column, address: Column) -> Column:
    return F.coalesce(blank_to_null(strip(F.concat_ws("", city, district, address))), F.lit(V.UNKNOWN))
