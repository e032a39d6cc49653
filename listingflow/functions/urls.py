"""URL columns: resolve, canonicalise, identify."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V
from .text import blank_to_null, strip

_PARTS = r"\A(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?\z"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _PARTS, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    # The form encoding of the JVM differs from RFC 3986 in two characters.
    return F.replace(
        F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")
    )


def query_pairs(query_text: Column) -> Column:
    """``a=1&b`` to an array of (key, value), decoded; a bare key has an empty value."""
    return F.transform(
        F.filter(F.split(query_text, "&"), lambda x: x != ""),
        lambda x: F.struct(
            _decode(F.substring_index(x, "=", 1)).alias("key"),
            _decode(F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, r"\A[^=]*=", "")).otherwise(""))
            .alias("value"),
        ),
    )


def _pairs_text(pairs: Column) -> Column:
    """Pairs to query text; repeated keys come together where the key first appears."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)))
    return F.array_join(
        F.transform(grouped, lambda p: F.concat(_encode(p["key"]), F.lit("="), _encode(p["value"]))),
        "&",
    )


def build_url(url: Column, new_path: Column, query_text: Column, fragment: Column | None = None) -> Column:
    out = F.concat(
        F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""),
        F.when(host(url) != "", F.concat(F.lit("//"), host(url))).otherwise(""),
        new_path,
        F.when(query_text != "", F.concat(F.lit("?"), query_text)).otherwise(""),
    )
    if fragment is not None:
        out = F.concat(out, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return out


def canonical_url(url: Column) -> Column:
    """Without tracking parameters, fragment and trailing slash; other parameters kept in order."""
    kept = F.filter(
        query_pairs(query(url)),
        lambda p: ~(F.lower(p["key"]).isin(*V.TRACKING_KEYS) | F.lower(p["key"]).startswith("utm_")),
    )
    short = F.regexp_replace(path(url), "/+\\z", "")
    return build_url(url, F.coalesce(blank_to_null(short), path(url)), _pairs_text(kept))


def set_query(url: Column, key: Column | str, value: Column, drop: Sequence[str] = ()) -> Column:
    """Replace one query parameter (appended if absent when the value is not null), drop others."""
    key = F.lit(key) if isinstance(key, str) else key
    pairs = F.filter(query_pairs(query(url)), lambda p: ~p["key"].isin(*drop)) if drop else query_pairs(
        query(url)
    )
    replaced = F.when(
        F.exists(pairs, lambda p: p["key"] == key),
        F.transform(
            pairs,
            lambda p: F.struct(
                p["key"].alias("key"),
                F.when(p["key"] == key, value).otherwise(p["value"]).alias("value"),
            ),
        ),
    ).otherwise(F.concat(pairs, F.array(F.struct(key.alias("key"), value.alias("value")))))
    text = _pairs_text(F.when(value.isNull(), pairs).otherwise(replaced))
    return build_url(url, path(url), text, _part(url, 5))


def query_value(url: Column, key: str) -> Column:
    """First non-blank value of a query parameter, decoded."""
    hit = F.filter(query_pairs(query(url)), lambda p: (p["key"] == key) & (p["value"] != ""))
    return F.try_element_at(hit, F.lit(1))["value"]


def resolve_url(base: Column, href: Column) -> Column:
    """A link as written on a page to an absolute URL."""
    link = strip(href)
    own_path = path(link)
    base_dir = F.split(path(base), "/")
    base_dir = F.when(F.element_at(base_dir, -1) != "", F.slice(base_dir, 1, F.size(base_dir) - 1)).otherwise(
        base_dir
    )
    raw = F.when(own_path.startswith("/"), F.split(own_path, "/")).otherwise(
        F.concat(base_dir, F.split(own_path, "/"))
    )
    n = F.size(raw)
    segments = F.filter(raw, lambda x, i: (x != "") | (i == 0) | (i == n - 1))
    walked = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        )
        .when(x == ".", acc)
        .otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.array_join(
        F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(walked, F.array(F.lit("")))).otherwise(
            walked
        ),
        "/",
    )
    joined = F.coalesce(blank_to_null(joined), F.lit("/"))
    same_page = own_path == ""
    relative = build_url(
        base,
        F.when(same_page, path(base)).otherwise(joined),
        F.when(same_page & (query(link) == ""), query(base)).otherwise(query(link)),
        _part(link, 5),
    )
    return (
        F.when(link == "", base)
        .when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(scheme(link) != "", link)
        .otherwise(relative)
    )


def page_link(base: str, href: str) -> str:
    """``resolve_url`` and then ``canonical_url`` for one link, inside the page-parsing tasks.

    A link without a scheme but with a host is taken as https. Parameters keep their order, with
    repeated ones beside their first; tracking ones, the fragment and closing slashes go.
    """
    link = href.strip().strip("'\"")
    if plain := _PLAIN_LINK.fullmatch(link):  # the common case, without the library's general rules
        origin, whole, asked = plain.groups("")
        if origin or (own := _ORIGIN.match(base)):
            short = (origin or own[0]) + (whole.rstrip("/") or whole)
            return f"{short}?{kept}" if asked and (kept := _kept_short(asked)) else short
    address, _ = urldefrag(urljoin("https://" if link[:2] == "//" else base, link))
    front, _, asked = address.partition("?")
    kind, origin, whole = re.match(r"([^:/]*:)?(//[^/]*)?(.*)", front, re.DOTALL).groups("")
    short = f"{kind.lower()}{origin}{whole.rstrip('/') or whole}"
    return f"{short}?{kept}" if (kept := _kept(asked)) else short


# Links of which nothing has to be resolved or decoded: no part of the path starts with a dot or is empty.
_PLAIN_LINK = re.compile(r"(https?://[\w.:-]+)?((?:/[\w-][\w.-]*)+/?)(?:\?([\w.=&-]{0,200}))?", re.ASCII)
_ORIGIN = re.compile(r"https?://[\w.:-]+(?=[/?#]|\Z)", re.ASCII)


def join_plain(base: str, link: str) -> str | None:
    """``urljoin`` of a link that is plain; None of others."""
    plain = _PLAIN_LINK.fullmatch(link)
    if not plain or link[-1] == "?" or not (plain[1] or (own := _ORIGIN.match(base))):
        return None
    return link if plain[1] else own[0] + link


def _kept(asked: str) -> str:
    """The parameters of a link that don't only track the visitor."""
    values: dict[str, list[str]] = {}
    for key, value in parse_qsl(asked, keep_blank_values=True):
        if not _tracks(key.lower()):
            values.setdefault(key, []).append(value)
    return urlencode(values, doseq=True)


_kept_short = lru_cache(4_096)(_kept)


def _tracks(key: str) -> bool:
    return key.startswith("utm_") or key in V.TRACKING_KEYS


def canonical_id(source: Column, url: Column) -> Column:
    """Fallback record id: a hash of the URL under the source's name."""
    return F.concat(source, F.lit(":"), F.substring(F.sha2(strip(url), 256), 1, 24))


def is_detail_url(url: Column, patterns: Sequence[str]) -> Column:
    return (url != "") & url.rlike("|".join(f"(?:{p})" for p in patterns))


def id_from_url(url: Column, patterns: Sequence[str]) -> Column:
    """All groups of a pattern joined, else an id parameter, else the last path part of four letters or more."""
    found = []
    for pattern in patterns:
        groups = [F.regexp_extract(url, pattern, i + 1) for i in range(re.compile(pattern).groups)]
        if groups:  # a pattern without groups names no id
            found.append(blank_to_null(F.array_join(F.filter(F.array(*groups), lambda g: g != ""), "_")))
    params = [query_value(url, k) for k in ("id", "case", "caseId", "houseId", "houseid")]
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    last = F.try_element_at(parts, F.lit(-1))
    tail = F.when(F.length(last) >= 4, F.regexp_replace(last, r"(?U)\W+", "_"))
    return F.coalesce(*found, *params, tail)


PORTAL_HOST = "rent.591.com.tw"
PORTAL_DETAIL_BASE = f"https://{PORTAL_HOST}"


def numeric_path_id(url: Column) -> Column:
    own = (host(url) == "") | host(url).endswith(PORTAL_HOST)
    return F.when(own, blank_to_null(F.regexp_extract(path(url), r"\A/?(\d{4,})/?\z", 1)))


def portal_id(url: Column) -> Column:
    groups = [
        blank_to_null(F.regexp_extract(url, p, 1))
        for p in (r"/rent-detail-(\d+)\.html", r"/home/(\d+)", r"[?&]id=(\d+)")
    ]
    return F.coalesce(*groups, numeric_path_id(url))


def status_code_name(status: Column) -> Column:
    """HTTP status of a refused page to its error code."""
    return (
        F.when(status == 429, F.lit("HTTP_RATE_LIMITED"))
        .when(status == 401, F.lit("LOGIN_REQUIRED"))
        .when(status == 403, F.lit("HTTP_FORBIDDEN"))
    )
