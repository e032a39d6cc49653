"""Loading, and the listing-shaped view of orders that most queries read.

The view's columns are SQL expressions both engines understand; they only shape the input.
What a query computes is written twice: with the library here, by hand in its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.cluster import ship
from listingflow.operators.gazetteer import Gazetteer

QUERIES: dict[str, object] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt (by the keys, if any) to as many tasks as ``spark.listingflow.partitions`` says; where it is
    unset, to four for each core, and no fewer than a shuffle's.

    A table may be one file of one row group, which a single task would read, and work on all that follows.
    """
    spark = df.sparkSession
    wanted = spark.conf.get("spark.listingflow.partitions", None)
    few = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(int(wanted or few), *keys)


K = "o_orderkey"
LISTING = {
    "source": "o_orderpriority",
    "listing_id": f"CAST({K} AS STRING)",
    "url": f"concat('https://homes.example.com/list/', CAST({K} AS STRING))",
    "title": f"""concat(n_name, CASE {K} % 5 WHEN 0 THEN ' 獨立套房' WHEN 1 THEN ' 分租套房'
        WHEN 2 THEN ' 採光房' WHEN 3 THEN ' 雅房' ELSE ' 1房1衛' END,
        CASE WHEN {K} % 11 = 0 THEN ' 限女生' ELSE '' END)""",
    "city": f"CASE WHEN {K} % 59 = 0 THEN NULL ELSE r_name END",
    "district": f"CASE WHEN {K} % 53 = 0 THEN NULL ELSE n_name END",
    "address": f"""CASE {K} % 6 WHEN 0 THEN concat('台北市大安區羅斯福路四段', CAST({K} % 200 AS STRING), '號')
        WHEN 1 THEN '臺北市大安區新生南路3段' WHEN 2 THEN '捷運公館站3號出口'
        WHEN 3 THEN '新北市永和區竹林路１２巷' ELSE NULL END""",
    "rent": f"CASE WHEN {K} % 37 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 20) AS INT) END",
    "total_monthly_cost": f"""CASE WHEN {K} % 9 = 0 THEN 0 WHEN {K} % 2 = 0
        THEN CAST(floor(o_totalprice / 20) AS INT) + 500 ELSE NULL END""",
    "area_ping": f"CASE WHEN {K} % 41 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS DOUBLE) / 2 + 1 END",
    "room_type": f"""CASE {K} % 7 WHEN 0 THEN '獨立套房' WHEN 1 THEN '' WHEN 2 THEN '雅房'
        WHEN 3 THEN '整層住家' ELSE NULL END""",
    "floor": f"CASE WHEN {K} % 3 = 0 THEN NULL ELSE concat(CAST({K} % 9 AS STRING), '/12F') END",
    "description": f"""concat(CASE {K} % 8 WHEN 0 THEN '可租補 ' WHEN 1 THEN '不可租補 ' WHEN 2 THEN '可報稅 '
        WHEN 3 THEN '不能報稅 ' WHEN 4 THEN '捷運萬隆 ' ELSE '' END,
        CASE {K} % 10 WHEN 0 THEN '獨洗 ' WHEN 1 THEN '共用洗衣機 ' WHEN 2 THEN '溫州街 ' ELSE '' END,
        CASE {K} % 13 WHEN 0 THEN '垃圾代收' WHEN 1 THEN '自行倒垃圾' WHEN 2 THEN '無垃圾代收' ELSE '' END)""",
    "has_rent_subsidy": f"CASE {K} % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "has_tax_registration": f"CASE {K} % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "has_independent_washer": f"CASE {K} % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "has_garbage_collection": f"CASE {K} % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END",
    "near_ntu_score": f"CASE WHEN {K} % 17 = 0 THEN NULL ELSE CAST({K} % 101 AS INT) END",
    "commute_minutes": f"CASE WHEN {K} % 3 = 0 THEN CAST({K} % 60 AS INT) ELSE NULL END",
    "status": "CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'inactive' ELSE 'filtered_out' END",
    "first_seen_at": f"CASE WHEN {K} % 29 = 0 THEN NULL ELSE o_orderdate END",
    "last_seen_at": "o_orderdate",
    "raw": f"""CASE {K} % 12 WHEN 0 THEN '{{"gender":"女性"}}' WHEN 1 THEN '{{"a":[{{"性別":"男女不限"}}]}}'
        WHEN 2 THEN '{{"b":{{"條件":["限女"]}}}}' WHEN 3 THEN '{{"c":"女性"}}' ELSE '{{}}' END""",
}

_FROM = (
    " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
    " JOIN region ON n_regionkey = r_regionkey"
)
L_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in LISTING.items()) + _FROM
# Words a record carries, as the classification reads them (no tags in this view).
TEXT_SQL = (
    "concat_ws(chr(10), nullif(title, ''), nullif(city, ''), nullif(district, ''), "
    "nullif(address, ''), nullif(room_type, ''), nullif(description, ''))"
)


def listings(spark: SparkSession, sf: str) -> DataFrame:
    return customers_orders(spark, sf).select(*[F.expr(e).alias(n) for n, e in LISTING.items()])


def customers_orders(spark: SparkSession, sf: str) -> DataFrame:
    t = {n: load(spark, sf, n) for n in ("orders", "customer", "nation", "region")}
    return dealt(
        t["orders"]
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )


def places(spark: SparkSession, sf: str) -> DataFrame:
    """region × nation as a gazetteer."""
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("city"),
        F.col("r_regionkey").alias("region_id"),
        F.col("n_name").alias("district"),
        F.col("n_nationkey").alias("section_id"),
        F.col("n_nationkey").alias("ord"),
    )


def gazetteer(spark: SparkSession, sf: str) -> Gazetteer:
    return Gazetteer.from_table(places(spark, sf))


PLACES_SQL = (
    "SELECT r_name AS city, r_regionkey AS region_id, n_name AS district, n_nationkey AS section_id, "
    "n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey"
)


def like_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def sql_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"
