"""Searches of all sources in one run: details, recency, the page rule and refusals, each by its source's settings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions import urls as U
from ..operators.classify import recent
from ..operators.dedupe import first_wins
from ..operators.gazetteer import Gazetteer, PlaceTable
from ..operators.merge import merge_details
from ..operators.stop_rule import kept_pages
from .registry import EXTRACTORS, Extractor, read_once
from .specs import SPECS, SourceSpec

#: What places a record on its page, and is no part of a detail.
PLACES = ("source", "url", "page_id", "strategy", "pos", "source_ord")


def measured(df: DataFrame) -> DataFrame:
    """One side of a join, which Spark is not to broadcast for the size it expects.

    It guesses from the files a table began as, and knows nothing of markup made longer, of lists taken apart or of what
    Python returns: sides of hundreds of MB passed as a few, and were put together in the driver.
    """
    return df.hint("merge")


def by_source(specs: Sequence[SourceSpec], value: Callable[[SourceSpec], Column]) -> Column:
    """The value of the row's source; null for other sources."""
    return F.coalesce(*[F.when(F.col("source") == s.name, value(s)) for s in specs])


def _refused(pages: DataFrame, message: Column) -> DataFrame:
    return pages.filter("code IS NOT NULL").select("source", F.col("page_url").alias("url"), "code", message.alias("message"))


def collect_all(
    pages: DataFrame,
    gazetteer: Gazetteer | PlaceTable,
    specs: Sequence[SourceSpec] = SPECS,
    detail_pages: DataFrame | None = None,
    extractors: dict[str, Extractor] = EXTRACTORS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records, quarantine and page counts of the searches of all sources.

    ``pages``: page_id, source, search, page, url, html[, status]. Incomplete records are filled from
    ``detail_pages`` (page_id, source, url, html[, status]), records known to be too old are left out, and pages beyond
    the point where a search stopped showing anything new do not count. A page that is refused ends its
    source and no other: no later page or search of it counts, and only that refusal is reported. Sources whose pages are
    records themselves (``paged`` is false) have neither searches nor details: their columns search and page are ignored.

    Both tables are read once, by one Python pass each; every later step is one job over all sources: their settings are
    values of the row's source, and a search is its source's place and its number. The driver sees at most a row a source.
    """
    read = cut(read_once(pages, specs, extractors, ("search", "page")))
    seen, found = _parts(read)
    present = {r["source"] for r in seen.select("source").distinct().collect()}  # at most one per spec
    used = [s for s in specs if s.name in present] or list(specs)[:1]
    paged = [s for s in used if extractors[s.kind].paged]
    rows = cut(_built(found, used, gazetteer, extractors))
    is_paged = F.col("source").isin(*[s.name for s in paged])
    if not paged:
        kept = seen.filter("1 = 0").select("source", "search", "page", *[F.lit(0).cast("long").alias(c) for c in ("n_parsed", "n_new")])
        records = rows.join(measured(seen.select("source", "page_id", "search", "page")), ["source", "page_id"])
        return _unique(records), _refused(seen, F.col("message")), kept.withColumn("kept", F.lit(True))

    readable = seen.filter(is_paged & F.col("code").isNull()).select("source", "page_id", "search", "page", "page_url")
    counts = rows.groupBy("source", "page_id").agg(F.count("*").alias("n_parsed"))
    shown = readable.join(measured(counts), ["source", "page_id"], "left").na.fill(0, ["n_parsed"])
    numbered = readable.drop("page_url")
    filled, skipped = rows.filter(is_paged), None
    if detail_pages is not None and any(s.detail_limit for s in paged):
        filled, skipped = _filled(filled, detail_pages, gazetteer, [s for s in paged if s.detail_limit], extractors)
    fresh = recent(filled, by_source(paged, lambda s: F.lit(s.max_age_days))).join(measured(numbered), ["source", "page_id"])

    # Searches run source by source; what one source showed is nothing to another, as the key names the source.
    search = F.struct(by_source(paged, lambda s: F.lit(s.ordinal)).alias("ordinal"), "source", "search")
    misses = by_source(paged, lambda s: F.lit(s.stop_after_misses))
    walked = kept_pages(
        fresh.withColumn("search", search), shown.withColumn("_misses", misses).withColumn("search", search),
        ["source", "listing_id"], F.col("_misses"), with_end=True,
    )
    kept = cut(walked.select("search.source", "search.search", "page", "n_parsed", "n_new", "kept", "ended"))

    # A refused page is met if it is its search's first, or if the search went on after the page before.
    before = kept.select("source", "search", (F.col("page") + 1).alias("page"), (F.col("kept") & ~F.col("ended")).alias("_on"))
    blocked = seen.filter(is_paged & F.col("code").isNotNull())
    met = blocked.join(measured(before), ["source", "search", "page"], "left").filter("page = 0 OR _on")
    ends = {r["source"]: r["at"] for r in met.groupBy("source").agg(F.min(F.struct("search", "page")).alias("at")).collect()}
    kinds = dict(seen.dtypes)
    end = F.coalesce(
        F.lit(None).cast(f"struct<search:{kinds['search']},page:{kinds['page']}>"),
        *[
            F.when(F.col("source") == name, F.struct(*[F.lit(at[c]).cast(kinds[c]).alias(c) for c in ("search", "page")]))
            for name, at in sorted(ends.items())
        ],
    )
    place = F.struct("search", "page")
    counts_still = end.isNull() | (place < end)
    kept = kept.drop("ended").filter(counts_still)

    # Refusals that were met, pages of posts that were refused, and searches whose first page shows nothing.
    told = seen.filter(~is_paged | (place == end))
    empty = (
        readable.filter((F.col("page") == 0) & counts_still)
        .join(measured(rows.select("source", "page_id").distinct()), ["source", "page_id"], "left_anti")
        .select(
            "source", F.col("page_url").alias("url"), F.lit("EMPTY_RESULT").alias("code"),
            F.lit("no listings parsed from rendered HTML").alias("message"),
        )
    )
    refused = _refused(told, F.col("message")).unionByName(empty)
    if skipped is not None:
        refused = refused.unionByName(skipped)
    live = fresh.join(measured(kept.filter("kept").select("source", "search", "page")), ["source", "search", "page"], "left_semi")
    if len(paged) < len(used):
        own = seen.filter(~is_paged).select("source", "page_id", "search", "page")
        live = live.unionByName(rows.filter(~is_paged).join(measured(own), ["source", "page_id"]))
    return _unique(live), refused, kept


def _parts(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    return read.filter("is_page"), read.filter("NOT is_page").drop("is_page", "code", "message", "search", "page")


def _built(found: DataFrame, specs: Sequence[SourceSpec], gazetteer: Gazetteer | PlaceTable, extractors: dict[str, Extractor]) -> DataFrame:
    rows = [extractors[s.kind].build(found.filter(F.col("source") == s.name), s, gazetteer) for s in specs]
    return reduce(DataFrame.unionByName, rows)


def _unique(records: DataFrame) -> DataFrame:
    order = [F.col(c) for c in ("source_ord", "search", "page", "page_id", "strategy", "pos")]
    return first_wins(records, ["source", "listing_id"], order)


def _filled(
    rows: DataFrame, detail_pages: DataFrame, gazetteer: Gazetteer | PlaceTable, specs: Sequence[SourceSpec], extractors: dict[str, Extractor]
) -> tuple[DataFrame, DataFrame]:
    """Records filled from the detail pages of their own source, and the detail pages that were refused."""
    fetched, found = _parts(cut(read_once(detail_pages, specs, extractors)))
    good = fetched.filter("code IS NULL")
    details = first_wins(_built(found, specs, gazetteer, extractors), ["source", "page_id"], [F.col("strategy"), F.col("pos")])
    names = [c for c in details.columns if c not in PLACES]
    by_url = details.join(measured(good.select("source", "page_id", F.col("page_url").alias("_at"))), ["source", "page_id"]).select(
        "source", F.col("_at").alias("url"), *names
    )
    filled = merge_details(
        rows.withColumns({"_position": F.struct("strategy", "pos"), "_page": F.struct("source", "page_id")}),
        first_wins(by_url, ["source", "url"], [F.col("listing_id")]),
        "_page",
        "_position",
        by_source(specs, lambda s: F.lit(s.detail_limit)),
        F.coalesce(by_source(specs, lambda s: U.is_detail_url(F.col("url"), s.detail_url_patterns)), F.lit(False)),
        fetched=good.select("source", F.col("page_url").alias("url")),
        on=("source", "url"),
    )
    return filled.drop("_position", "_page"), _refused(fetched, F.concat(F.lit("detail skipped: "), "message"))


def collect_source(
    pages: DataFrame, spec: SourceSpec, gazetteer: Gazetteer | PlaceTable, detail_pages: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`collect_all` of one source's pages, which need not name it."""
    own = F.lit(spec.name)
    details = None if detail_pages is None else detail_pages.withColumn("source", own)
    records, refused, kept = collect_all(pages.withColumn("source", own), gazetteer, [spec], details)
    return records, refused, kept.drop("source")
