"""Small hand-made inputs shared by the tests."""

from pyspark.sql import functions as F

from listingflow.operators.gazetteer import Gazetteer
from listingflow.schema import GAZETTEER_DDL, conform, record_schema

PLACES = [
    ("台北市", 1, "大安區", 5),
    ("台北市", 1, "文山區", 12),
    ("台北市", 1, "松山區", 4),
    ("台北市", 1, "萬華區", 6),
    ("台北市", 1, "中正區", 1),
    ("台北市", 1, "大同區", 2),
    ("基隆市", 2, "中正區", 15),
    ("新北市", 3, "新店區", 34),
    ("新北市", 3, "永和區", 37),
    ("桃園市", 6, "桃園區", 73),
    ("桃園市", 6, "中壢區", 67),
    ("桃園市", 6, "龜山區", 76),
    ("桃園市", 6, "蘆竹區", 79),
    ("桃園市", 6, "楊梅區", 71),
    ("台中市", 8, "大安區", 117),
    ("台中市", 8, "西屯區", 104),
    ("台中市", 8, "東區", 99),
    ("台南市", 15, "東區", 207),
    ("高雄市", 17, "苓雅區", 245),
    ("高雄市", 17, "鼓山區", 247),
]


def gazetteer_table(spark):
    rows = [(c, r, d, s, i) for i, (c, r, d, s) in enumerate(PLACES)]
    return spark.createDataFrame(rows, GAZETTEER_DDL)


def gazetteer(spark):
    return Gazetteer.from_table(gazetteer_table(spark), legacy=[(26, 256, "東沙")])


BASE = {
    "source": "fixture",
    "listing_id": "pending-1",
    "url": "https://example.com/pending-1",
    "title": "台北市大安區獨立套房",
    "city": "台北市",
    "district": "大安區",
    "rent": 18000,
    "total_monthly_cost": 18000,
    "area_ping": 8.0,
    "room_type": "獨立套房",
    "description": "",
    "tags": [],
    "image_urls": [],
    "status": "active",
    "raw": "{}",
}


def records(spark, *changes):
    names = [f.name for f in record_schema().fields]
    rows = []
    for i, change in enumerate(changes):
        row = {**BASE, "listing_id": f"r{i:03d}", **change}
        rows.append(tuple(row.get(n) for n in names))
    return conform(spark.createDataFrame(rows, record_schema()))


def one(spark, text, expression, **columns):
    """Value of an expression over a one-row table with column ``t``."""
    names = ["t", *columns]
    schema = ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(text, *columns.values())], schema)
    return df.select(expression(F.col("t")).alias("v")).first().v
