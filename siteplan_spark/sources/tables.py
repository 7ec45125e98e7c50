"""Parquet tables with declared schemas (no inference job per read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS: dict[str, str] = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, "
              "value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def read_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """One table, optionally projected: only the named columns are decoded."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


# --- stand-ins: the domain's concepts expressed over the tables above ------------------

def _latlon(key: str, a: int, a0: int, b: int, b0: int) -> tuple[Column, Column]:
    k = F.col(key).cast("bigint")
    lat = F.lit(25.0) + ((k * a + a0) % 24000).cast("double") / 1000.0
    lon = F.lit(-124.0) + ((k * b + b0) % 57000).cast("double") / 1000.0
    return lat, lon


def population_points(spark: SparkSession, folder: str) -> DataFrame:
    """customer as weighted points: id, area (nation), group (region), lat, lon, weight."""
    lat, lon = _latlon("c_custkey", 7919, 0, 104729, 0)
    nation = read_table(spark, folder, "nation", "n_nationkey", "n_regionkey")
    return (
        read_table(spark, folder, "customer")
        .select(F.col("c_custkey").alias("point_id"), F.col("c_nationkey").alias("area"),
                lat.alias("lat"), lon.alias("lon"),
                (F.lit(1) + F.col("c_custkey") % 97).cast("bigint").alias("weight"),
                F.col("c_acctbal").alias("balance"),
                F.col("c_mktsegment").alias("segment"))
        .join(nation.select(F.col("n_nationkey").alias("area"),
                            F.col("n_regionkey").alias("region")), "area")
    )


POINTS_SQL = """points AS (
  SELECT c_custkey AS point_id, c_nationkey AS area, n_regionkey AS region,
         25.0e0 + CAST((CAST(c_custkey AS BIGINT) * 7919) % 24000 AS DOUBLE) / 1000.0e0 AS lat,
         -124.0e0 + CAST((CAST(c_custkey AS BIGINT) * 104729) % 57000 AS DOUBLE) / 1000.0e0 AS lon,
         CAST(1 + c_custkey % 97 AS BIGINT) AS weight, c_acctbal AS balance,
         c_mktsegment AS segment
  FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """supplier as sites: site_id, area, lat, lon."""
    lat, lon = _latlon("s_suppkey", 6101, 17, 15485863, 29)
    return read_table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_nationkey").alias("area"),
        lat.alias("lat"), lon.alias("lon"), F.col("s_acctbal").alias("balance"))


SITES_SQL = """sites AS (
  SELECT s_suppkey AS site_id, s_nationkey AS area,
         25.0e0 + CAST((CAST(s_suppkey AS BIGINT) * 6101 + 17) % 24000 AS DOUBLE) / 1000.0e0 AS lat,
         -124.0e0 + CAST((CAST(s_suppkey AS BIGINT) * 15485863 + 29) % 57000 AS DOUBLE) / 1000.0e0 AS lon,
         s_acctbal AS balance
  FROM supplier)"""


def units(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem as capacity observations under a site.

    A unit is one order line position; a repeated (order, line) pair gives the unit
    alternative connectors. A reported power can be missing or an anomalous zero.
    """
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    return read_table(spark, folder, "lineitem").select(
        F.concat_ws(":", order, line).alias("unit_key"),
        order.alias("unit_order"), line.alias("unit_line"),
        F.col("l_suppkey").alias("site_id"),
        F.col("l_returnflag").alias("network"), F.col("l_linestatus").alias("connector"),
        (line % 3).cast("string").alias("level"),
        (F.lit(1) + (order % 7 == 0).cast("int")).alias("ports"),
        (order % 4).cast("int").alias("connector_count"),
        F.when(order % 101 == 0, F.lit(0.0)).when(order % 5 == 0, F.lit(None))
         .otherwise(F.col("l_quantity")).alias("power"),
        F.when(F.col("l_returnflag") == "R", "T").otherwise("E").alias("status"),
        F.when(F.col("l_linestatus") == "O", "public").otherwise("private").alias("access"),
        F.col("l_extendedprice").alias("price"))


UNITS_SQL = """units AS (
  SELECT l_orderkey || ':' || l_linenumber AS unit_key, l_orderkey AS unit_order,
         l_linenumber AS unit_line, l_suppkey AS site_id, l_returnflag AS network,
         l_linestatus AS connector, CAST(l_linenumber % 3 AS VARCHAR) AS level,
         1 + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS ports,
         CAST(l_orderkey % 4 AS INTEGER) AS connector_count,
         CASE WHEN l_orderkey % 101 = 0 THEN 0.0e0 WHEN l_orderkey % 5 = 0 THEN NULL
              ELSE l_quantity END AS power,
         CASE WHEN l_returnflag = 'R' THEN 'T' ELSE 'E' END AS status,
         CASE WHEN l_linestatus = 'O' THEN 'public' ELSE 'private' END AS access,
         l_extendedprice AS price
  FROM lineitem)"""

#: Great-circle kilometres between aliases p and s, for the comparison SQL.
HAVERSINE_KM_SQL = (
    "2.0e0 * 6371.0088e0 * asin(sqrt(least(1.0e0, greatest(0.0e0, "
    "pow(sin(radians(s.lat - p.lat) / 2.0e0), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) "
    "* pow(sin(radians(s.lon - p.lon) / 2.0e0), 2)))))"
)
