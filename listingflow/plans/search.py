"""Which pages to look at next: search plan, page URLs, catch-up depth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.urls import PORTAL_DETAIL_BASE, query_value, set_query


def search_plan(
    allowlist: DataFrame,
    gazetteer: DataFrame,
    kinds: Sequence[int] = (2, 3),
    base: str = f"{PORTAL_DETAIL_BASE}/list",
    max_searches: int | None = None,
) -> DataFrame:
    """One search per selected place and kind: ``ord, city, district, kind, url``.

    ``allowlist`` is ``(city, district)`` where ``*`` selects the whole city with one search
    per kind. Rows come in gazetteer order (``ord``, then kind order). More than
    ``max_searches``, where given, is an error, checked by counting one row beyond it.
    """
    wild = allowlist.filter("district = '*'").select("city").distinct()
    whole = (
        gazetteer.join(wild, "city", "left_semi")
        .groupBy("city", "region_id")
        .agg(F.min("ord").alias("ord"))
        .select("ord", "city", F.lit(None).cast("string").alias("district"), "region_id",
                F.lit(None).cast("int").alias("section_id"))
    )
    chosen = allowlist.filter("district <> '*'").distinct()
    single = gazetteer.join(chosen, ["city", "district"], "left_semi").select(
        "ord", "city", "district", "region_id", "section_id"
    )
    kind_list = F.array(
        *[F.struct(F.lit(i).alias("kind_ord"), F.lit(k).alias("kind")) for i, k in enumerate(kinds)]
    )
    plan = (
        whole.unionByName(single)
        .select("*", F.explode(kind_list).alias("k"))
        .select(
            "ord",
            "k.kind_ord",
            "city",
            "district",
            "k.kind",
            F.concat(
                F.lit(f"{base}?kind="),
                F.col("k.kind").cast("string"),
                F.lit("&region="),
                F.col("region_id").cast("string"),
                F.when(
                    F.col("section_id").isNotNull(),
                    F.concat(F.lit("&section="), F.col("section_id").cast("string")),
                ).otherwise(""),
            ).alias("url"),
        )
    )
    if max_searches is not None:
        n = plan.limit(max_searches + 1).count()
        if n > max_searches:
            raise ValueError(
                f"the selection needs more than {max_searches} searches: "
                "select whole cities ('*') or fewer districts"
            )
    return plan.orderBy("ord", "kind_ord")


def section_urls(url: Column) -> Column:
    """``section=2-3-4`` (or with commas) to one URL per section, the page offset dropped."""
    tokens = F.filter(
        F.transform(F.split(F.coalesce(query_value(url, "section"), F.lit("")), "[-,]"), strip),
        lambda t: t != "",
    )
    return F.when(F.size(tokens) <= 1, F.array(url)).otherwise(
        F.transform(tokens, lambda t: set_query(url, "section", t, drop=("firstRow",)))
    )


def offset_pages(url: Column, max_pages: Column | int, page_size: int = 30) -> Column:
    """Page 0 without an offset, then ``firstRow=page·size``."""
    n = F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: set_query(
            url,
            "firstRow",
            F.when(i > 0, (i * page_size).cast("string")),
            drop=("firstRow",),
        ),
    )


def numbered_pages(url: Column, max_pages: Column | int, param: str = "page") -> Column:
    """Page 1 without a number, then ``page=2`` and so on; a single page stays as written."""
    n = F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    return F.when(n <= 1, F.array(url)).otherwise(
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: set_query(
                url, param, F.when(i > 0, (i + 1).cast("string")), drop=(param,)
            ),
        )
    )


def catch_up_pages(
    last: Column,
    now: Column,
    interval: float = 60,
    grace: float = 15,
    base_pages: int = 1,
    max_pages: int = 2,
) -> Column:
    """Pages per search after a pause: enough to cover the runs that were missed."""
    micros = [F.unix_micros(c.cast("timestamp")) for c in (last, now)]
    minutes = F.greatest(F.lit(0.0), (micros[1] - micros[0]) / F.lit(60_000_000.0))
    missed = F.greatest(F.lit(2), F.ceil((minutes - grace) / F.lit(float(interval))))
    depth = F.greatest(F.lit(base_pages), F.least(F.lit(max_pages), missed))
    return (
        F.when(last.isNull() | (minutes <= interval + grace), F.lit(base_pages)).otherwise(depth).cast("int")
    )
