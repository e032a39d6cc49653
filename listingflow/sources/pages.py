"""Fetched pages as a table: refusals, access walls and URL policy, before any parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import contains_any, let
from ..functions.urls import host, path, query, scheme, status_code_name
from ..operators.skew import attach_facts


def read_pages(spark: SparkSession, location: str, partitions: int | None = None) -> DataFrame:
    """The pages; ``partitions`` deals them out anew, for tables whose files are too few or too large."""
    pages = spark.read.parquet(location)
    return pages.repartition(partitions) if partitions else pages


def worst_status(responses: DataFrame, page: str = "page_id") -> DataFrame:
    """One row per page: its worst refusal (429, then 403, then 401), null if none."""
    severity = F.when(F.col("status") == 429, 0).when(F.col("status") == 403, 1).when(
        F.col("status") == 401, 2
    )
    worst = F.min_by(F.when(severity.isNotNull(), F.col("status")), severity)
    return responses.groupBy(page).agg(worst.alias("status"))


def visible_text(html: Column) -> Column:
    """Text between tags, each run of tags one blank; scripts, styles and comments left out."""
    bare = F.regexp_replace(
        html,
        r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->",
        "<i>",
    )
    return F.trim(F.regexp_replace(bare, r"\s*(?:<[^>]*>\s*)+", " "))


def access_wall(text: Column) -> Column:
    """Error code if lower-cased page text asks the visitor to prove or identify themselves."""
    return (
        F.when(contains_any(text, V.CAPTCHA_WORDS), F.lit("CAPTCHA_DETECTED"))
        .when(contains_any(text, V.LOGIN_WORDS), F.lit("LOGIN_REQUIRED"))
        .when(contains_any(text, V.RATE_WORDS), F.lit("HTTP_RATE_LIMITED"))
        .when(contains_any(text, V.FORBIDDEN_WORDS), F.lit("HTTP_FORBIDDEN"))
    )


def _may_be_wall(raw: Column) -> Column:
    """Cheap necessary test on lower-cased markup: all words of some marker occur somewhere."""
    markers = (*V.CAPTCHA_WORDS, *V.LOGIN_WORDS, *V.RATE_WORDS, *V.FORBIDDEN_WORDS)
    tests = [
        reduce(lambda a, b: a & b, [F.contains(raw, F.lit(part)) for part in marker.split(" ")])
        for marker in markers
    ]
    return reduce(lambda a, b: a | b, tests)


def page_errors(pages: DataFrame) -> DataFrame:
    """Add ``code`` and ``message``: null for pages worth parsing.

    Tags are stripped only from pages whose markup contains the words of a marker at all.
    """
    refused = (
        status_code_name(F.col("status")) if "status" in pages.columns else F.lit(None).cast("string")
    )
    visible = let(
        F.lower("html"),
        lambda raw: F.when(_may_be_wall(raw), F.lower(visible_text(F.col("html")))),
    )
    coded = pages.withColumn("code", F.coalesce(refused, let(visible, access_wall)))
    if "status" not in pages.columns:
        return coded.withColumn("message", F.col("code"))
    said = F.concat(F.lit("HTTP "), F.col("status").cast("string"))
    return coded.withColumn("message", F.when(refused.isNotNull(), said).otherwise(F.col("code")))


def url_policy(urls: DataFrame, policies: DataFrame, url: str = "url") -> DataFrame:
    """Add ``policy_code``: null if the URL may be fetched.

    ``policies`` holds one row per origin: ``origin, state`` (``rules``, ``absent`` or
    ``unavailable``) and ``rules array<struct<prefix:string, allow:boolean>>``. No row or an
    unavailable policy denies; an absent one allows; else the first rule whose prefix fits
    decides, and nothing fitting allows.
    """
    u = F.col(url)
    target = F.coalesce(F.when(path(u) != "", path(u)), F.lit("/"))
    target = F.when(query(u) != "", F.concat(target, F.lit("?"), query(u))).otherwise(target)
    with_origin = urls.withColumn("_origin", F.concat(scheme(u), F.lit("://"), host(u)))
    known = policies.select(
        F.col("origin").alias("_origin"), F.col("state").alias("_state"), F.col("rules").alias("_rules")
    )
    # One host may hold a third of all pages; the policies are a table of their own, so it is joined as it is.
    joined = attach_facts(with_origin, known, ["_origin"])
    fitting = F.filter("_rules", lambda r: target.startswith(r["prefix"]))
    allowed = F.coalesce(F.try_element_at(fitting, F.lit(1))["allow"], F.lit(True))
    return joined.withColumn(
        "policy_code",
        F.when(F.coalesce("_state", F.lit("unavailable")) == "unavailable", F.lit("ROBOTS_UNAVAILABLE"))
        .when(F.col("_state") == "absent", F.lit(None))
        .when(~allowed, F.lit("ROBOTS_DISALLOWED")),
    ).drop("_origin", "_state", "_rules")


def quarantine_counts(quarantine: DataFrame) -> DataFrame:
    return quarantine.groupBy("source", "code").agg(F.count("*").alias("n"))
