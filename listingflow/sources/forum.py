"""Forum posts to records, and forum index pages to links."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..functions import urls as U
from ..functions import vocabulary as V
from ..functions.text import blank_to_null, contains_any
from ..operators.gazetteer import Gazetteer, bracket_area
from .dom import Outline
from .specs import FORUM, SourceSpec

POST_DDL = "meta_title string, page_title string, body string, images array<string>"
_DROPPED = ("article-metaline", "article-metaline-right", "push")


def _post(html: str) -> dict | None:
    page = Outline(html)
    main = next((i for i, a in enumerate(page.attrs) if a.get("id") == "main-content"), None)
    if main is None:
        return None

    def dropped(i: int) -> bool:
        while i > main:
            span_f2 = page.names[i] == "span" and page.has_class(i, "f2")
            if span_f2 or any(page.has_class(i, c) for c in _DROPPED):
                return True
            i = page.parents[i]
        return False

    span = range(page.text_from[main], page.text_to[main])
    body = "\n".join(page.strings[s] for s in span if not dropped(page.owners[s]))
    spans = page.find("span")
    tags = [i for i in spans if page.has_class(i, "article-meta-tag")]
    values = [i for i in spans if page.has_class(i, "article-meta-value")]
    meta = {page.text(t, ""): page.text(v) for t, v in reversed(list(zip(tags, values, strict=False)))}
    title = page.find("title")
    links = [page.attrs[i]["href"].strip() for i in page.find("a") if "href" in page.attrs[i]]
    images = []
    for link in links:
        # Links inside dropped nodes are gone before images are collected.
        link = "https:" + link if link.startswith("//") else link
        if link.startswith("http") and link not in images and (
            re.search(r"\.(jpg|jpeg|png|webp)(?:\?|$)", link, re.I) or "imgur.com" in link
        ):
            images.append(link)
    return {
        "meta_title": meta.get("標題"),
        "page_title": page.text(title[0]).replace(" - 批踢踢實業坊", "") if title else None,
        "body": body,
        "images": images,
    }


def read_posts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
            post = _post(html)
            if post is not None:
                rows.append((page_id, url, *post.values()))
        yield pd.DataFrame(
            rows, columns=["page_id", "url", "meta_title", "page_title", "body", "images"]
        )


def _read_index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for page_id, url, html in zip(pdf["page_id"], pdf["url"], pdf["html"], strict=True):
            page = Outline(html)
            anchors = page.find("a")
            entries = [i for i in page.find("div") if page.has_class(i, "r-ent")]
            for pos, entry in enumerate(entries):
                heads = [i for i in range(entry + 1, page.last[entry]) if page.has_class(i, "title")]
                found = page.within(heads[0], anchors) if heads else []
                if found and page.attrs[found[0]].get("href"):
                    link = urljoin(url, page.attrs[found[0]]["href"])
                    rows.append((page_id, pos, "entry", link, page.text(found[0])))
            for i in anchors:
                wide = page.has_class(i, "btn") and page.has_class(i, "wide")
                if wide and "上頁" in page.text(i, "") and page.attrs[i].get("href"):
                    rows.append((page_id, -1, "previous", urljoin(url, page.attrs[i]["href"]), None))
                    break
        yield pd.DataFrame(rows, columns=["page_id", "pos", "kind", "url", "title"])


def index_links(pages: DataFrame) -> DataFrame:
    """Post links worth following (notices and other places left out), and the previous page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    links = pages.select("page_id", "url", "html").mapInPandas(
        _read_index, f"page_id {kind}, pos int, kind string, url string, title string"
    )
    return links.filter(
        (F.col("kind") == "previous")
        | (~F.contains("title", F.lit("公告")) & relevant_title(F.col("title")))
    )


def relevant_title(title: Column) -> Column:
    name = X.normalize_spelling(title)
    return bracket_area(name).isNotNull() | (
        F.contains(name, F.lit(V.FORUM_CITY)) & contains_any(name, V.FORUM_TITLE_WORDS)
    )


def own_words(body: Column) -> Column:
    """Lines up to the signature."""
    lines = F.filter(
        F.transform(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), X.strip),
        lambda x: x != "",
    )
    ends = F.transform(lines, lambda x: x.startswith("--") | x.startswith("※ 發信站:"))
    stop = F.array_position(ends, True)
    return F.array_join(
        F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines), "\n"
    )


def forum_records(pages: DataFrame, gazetteer: Gazetteer, spec: SourceSpec = FORUM) -> DataFrame:
    """Posts (``page_id, url, html``) to records; wanted and exchange posts are rejected."""
    kind = pages.schema["page_id"].dataType.simpleString()
    posts = pages.select("page_id", "url", "html").mapInPandas(
        read_posts, f"page_id {kind}, url string, {POST_DDL}"
    )
    return post_records(posts, gazetteer, spec)


def post_records(posts: DataFrame, gazetteer: Gazetteer, spec: SourceSpec = FORUM) -> DataFrame:
    """The same from posts that were read already: ``page_id, url`` and the post's parts."""
    body = F.col("body")
    worded = (
        posts.withColumn("body", own_words(body))
        .withColumn(
            "title",
            F.coalesce(
                blank_to_null(F.col("meta_title")), blank_to_null(F.col("page_title")), F.col("url")
            ),
        )
        .withColumn("text", F.concat_ws("\n", "title", "body"))
    )
    staged = gazetteer.add_place_on_board(worded, "text")
    text = F.col("text")
    wanted = contains_any(text, V.FORUM_WANTED_WORDS) & ~F.contains(text, F.lit("出租"))
    kept = staged.filter(~wanted & F.col("place.district").isNotNull())
    rent = N.rent_in_text(text, spec.max_rent, gap=8, pick="min")
    fee = N.fee_in_text(body, spec.max_fee)
    district = F.col("place.district")
    line = F.try_element_at(
        F.filter(F.split(body, "\n"), lambda x: F.contains(x, district) & (F.length(x) <= 120)), F.lit(1)
    )
    tags = [F.when(contains_any(body, words), F.lit(tag)) for tag, words in V.FORUM_TAGS]
    own_id = blank_to_null(F.regexp_extract("url", r"/([^/]+)\.html\z", 1))
    return kept.select(
        F.lit(spec.ordinal).alias("source_ord"),
        F.col("page_id"),
        F.lit(0).alias("strategy"),
        F.lit(0).alias("pos"),
        F.lit(spec.name).alias("source"),
        F.lit("active").alias("status"),
        F.coalesce(own_id, U.canonical_id(F.lit(spec.name), F.col("url"))).alias("listing_id"),
        F.col("url"),
        F.col("title"),
        F.col("place.city").alias("city"),
        district.alias("district"),
        F.coalesce(X.labelled_field(body, V.FORUM_ADDRESS_LABELS), line).alias("address"),
        rent.alias("rent"),
        N.total_cost(rent, fee).alias("total_monthly_cost"),
        N.area_in_text(text, *spec.area_bounds, units="坪|p|P").alias("area_ping"),
        N.room_type(text, N.FORUM_ROOM_RULES).alias("room_type"),
        X.labelled_field(body, V.FORUM_FLOOR_LABELS).alias("floor"),
        body.alias("description"),
        F.array_compact(F.array(*tags)).alias("tags"),
        *[
            F.lit(None).cast("boolean").alias(n)
            for n in (
                "has_rent_subsidy",
                "has_tax_registration",
                "has_independent_washer",
                "has_garbage_collection",
            )
        ],
        F.col("images").alias("image_urls"),
        F.lit(None).cast("int").alias("update_age_days"),
        F.to_json(F.struct(F.col("url").alias("source_url"), fee.alias("management_fee"))).alias("raw"),
    )
