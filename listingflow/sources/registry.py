"""All sources together: one pass reads every page by its own source's rules; records come in source order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..cluster import for_pages
from ..operators.dedupe import first_wins
from ..operators.gazetteer import Gazetteer, PlaceTable
from .dom import CANDIDATE_DDL, page_reader
from .extract import records_of
from .forum import POST_DDL, post_records, read_posts
from .pages import page_errors
from .specs import SPECS, SourceSpec

Frames = Iterator[pd.DataFrame]


@dataclass(frozen=True)
class Extractor:
    """What a kind of source does with its pages.

    ``reader(spec)`` turns frames of (page_id, source, page_url, html) into frames of (page_id, page_url) and
    any of the columns in ``columns``; it runs in the page pass. ``build`` turns what was read into records.
    """

    reader: Callable[[SourceSpec], Callable[[Frames], Frames]]
    build: Callable[[DataFrame, SourceSpec, Gazetteer | PlaceTable], DataFrame]
    columns: str
    empty_is_refused: bool = True
    paged: bool = True  # its pages are searches' pages, not records


def _posts(spec: SourceSpec) -> Callable[[Frames], Frames]:
    def read(frames: Frames) -> Frames:
        for found in read_posts(f.rename(columns={"page_url": "url"}) for f in frames):
            yield found.rename(columns={"url": "page_url"})

    return read


def _forum(read: DataFrame, spec: SourceSpec, gazetteer: Gazetteer | PlaceTable) -> DataFrame:
    return post_records(read.drop("url").withColumnRenamed("page_url", "url"), gazetteer, spec)


_LINKED = Extractor(lambda spec: page_reader(spec.page_rules()), records_of, CANDIDATE_DDL)
EXTRACTORS: dict[str, Extractor] = {
    "generic": _LINKED,
    "portal": _LINKED,
    "forum": Extractor(_posts, _forum, POST_DDL, empty_is_refused=False, paged=False),
}


def read_once(
    pages: DataFrame, specs: Sequence[SourceSpec], extractors: dict[str, Extractor] = EXTRACTORS, carried: Sequence[str] = ()
) -> DataFrame:
    """One scan and one Python pass over all pages of the specs' sources.

    A row per page (``is_page``, with its refusal code, message and the ``carried`` columns) and the rows its source's reader gives.
    A refused page's markup does not reach Python.
    """
    for_pages(pages.sparkSession)
    coded = page_errors(pages.filter(F.col("source").isin(*[s.name for s in specs])))
    kind = pages.schema["page_id"].dataType.simpleString()
    parts: dict[str, str] = {}
    for s in specs:
        for field in extractors[s.kind].columns.split(", "):
            name, _, type_ = field.partition(" ")
            if parts.setdefault(name, type_) != type_:
                raise ValueError(f"two kinds of source give {name} different types")
    own = ["page_id", "source", "page_url"]
    columns = [*own, "is_page", "code", "message", *carried, *parts]
    schema = f"page_id {kind}, source string, page_url string, is_page boolean, code string, message string, "
    schema += ", ".join(f"{n} {t}" for n, t in ({c: pages.schema[c].dataType.simpleString() for c in carried} | parts).items())
    readers = {s.name: extractors[s.kind].reader(s) for s in specs}

    def shaped(frame: pd.DataFrame) -> pd.DataFrame:
        whole = frame.reindex(columns=columns).astype(object)
        return whole.where(whole.notna(), None)

    def read(frames: Frames) -> Frames:
        for frame in frames:
            yield shaped(frame.assign(is_page=True))
            for source, pages_of in frame[frame["html"].notna()].groupby("source", sort=False):
                for found in readers[source](iter([pages_of[[*own, "html"]].reset_index(drop=True)])):
                    if len(found):
                        yield shaped(found.assign(source=source, is_page=False))

    html = F.when(F.col("code").isNull(), F.coalesce("html", F.lit("")))
    asked = coded.select("page_id", "source", F.col("url").alias("page_url"), "code", "message", *carried, html.alias("html"))
    return asked.mapInPandas(read, schema)


def extract_all(
    pages: DataFrame,
    gazetteer: Gazetteer | PlaceTable,
    specs: Sequence[SourceSpec] = SPECS,
    extractors: dict[str, Extractor] = EXTRACTORS,
) -> tuple[DataFrame, DataFrame]:
    """Records and quarantine of ``pages(page_id, source, url, html[, status])``.

    What the pass reads is written once, without markup; each source's column rules then work on its own
    rows. A source without pages costs nothing. A new source is a spec with a kind, and an extractor for
    that kind.
    """
    read = cut(read_once(pages, specs, extractors))
    seen = read.filter("is_page")
    found = read.filter("NOT is_page").drop("is_page", "code", "message")
    present = {r["source"] for r in seen.select("source").distinct().collect()}  # at most one per spec
    used = [s for s in specs if s.name in present] or list(specs)[:1]
    rows = reduce(
        DataFrame.unionByName,
        [extractors[s.kind].build(found.filter(F.col("source") == s.name), s, gazetteer) for s in used],
    )
    refused = seen.filter("code IS NOT NULL").select("source", F.col("page_url").alias("url"), "code", "message")
    tells = [s.name for s in used if extractors[s.kind].empty_is_refused]
    if tells:
        good = seen.filter(F.col("code").isNull() & F.col("source").isin(*tells))
        empty = good.join(rows.select("page_id").distinct(), "page_id", "left_anti").select(
            "source",
            F.col("page_url").alias("url"),
            F.lit("EMPTY_RESULT").alias("code"),
            F.lit("no listings parsed from rendered HTML").alias("message"),
        )
        refused = refused.unionByName(empty)
    order = [F.col(c) for c in ("source_ord", "page_id", "strategy", "pos")]
    return first_wins(rows, ["source", "listing_id"], order), refused
