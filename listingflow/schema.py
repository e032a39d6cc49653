"""Record, snapshot and dimension schemas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ("source", "listing_id")

# Tri-state attributes: true / false / not mentioned (null).
FLAG_COLUMNS = (
    "has_rent_subsidy",
    "has_tax_registration",
    "has_independent_washer",
    "has_garbage_collection",
)

# What was last announced for a record; changes are measured against this.
SNAPSHOT_FIELDS = ("rent", "total_monthly_cost", *FLAG_COLUMNS, "status")

SNAPSHOT_DDL = (
    "struct<rent:int,total_monthly_cost:int,has_rent_subsidy:boolean,"
    "has_tax_registration:boolean,has_independent_washer:boolean,"
    "has_garbage_collection:boolean,status:string>"
)

RECORD_DDL = f"""
source string, listing_id string, url string, title string,
city string, district string, address string,
rent int, total_monthly_cost int, area_ping double, room_type string, floor string,
description string, tags array<string>,
has_rent_subsidy boolean, has_tax_registration boolean,
has_independent_washer boolean, has_garbage_collection boolean,
near_ntu_score int, commute_minutes int, image_urls array<string>,
first_seen_at timestamp, last_seen_at timestamp, last_notified_at timestamp,
notified_snapshot {SNAPSHOT_DDL},
status string,
notification_suppressed boolean, notification_relisted boolean,
dedupe_fingerprint string, possible_duplicate boolean, filter_reasons array<string>,
score_method string, score_basis string, score_confidence string, score_reason string,
classifier_summary string, classifier_score_reason string,
update_age_days int, raw string
"""



def record_schema() -> T.StructType:
    return T.StructType.fromDDL(RECORD_DDL)


# Column names, in order, readable without a session.
RECORD_COLUMNS = tuple(
    part.split()[0] for part in re.sub(r"<[^>]*>", "", RECORD_DDL).split(",")
)

RUN_LOG_DDL = "pipeline string, completed_at timestamp"
GAZETTEER_DDL = "city string, region_id int, district string, section_id int, ord int"


def conform_columns(df: DataFrame) -> list[Column]:
    """The record columns of ``df``; absent ones become typed nulls.

    Arrays, status and description get their non-null defaults.
    """
    have = set(df.columns)
    cols: list[Column] = []
    for field in record_schema().fields:
        col = (F.col(field.name) if field.name in have else F.lit(None)).cast(field.dataType)
        if field.name in ("tags", "image_urls"):
            col = F.coalesce(col, F.array().cast(field.dataType))
        elif field.name == "description":
            col = F.coalesce(col, F.lit(""))
        elif field.name == "status":
            col = F.coalesce(col, F.lit("unknown"))
        cols.append(col.alias(field.name))
    return cols


def conform(df: DataFrame) -> DataFrame:
    """Project to the record schema, whatever columns a table has."""
    return df.select(*conform_columns(df))


def snapshot_of(prefix: str = "") -> Column:
    """The announced view of a record: the seven fields changes are diffed on."""
    return F.struct(*[F.col(f"{prefix}{name}").alias(name) for name in SNAPSHOT_FIELDS])
