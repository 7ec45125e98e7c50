"""Queries over supply: the ladder, capacity, roll-ups, and the joins they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.functions import clean as C
from siteplan_spark.operators import quality as Q
from siteplan_spark.operators import ranking as W
from siteplan_spark.operators import reconcile as RC
from siteplan_spark.operators import supply as S
from siteplan_spark.plans.registry import query
from siteplan_spark.sources.readers import read_parameters
from siteplan_spark.sources.tables import UNITS_SQL, read_table, units

HIERARCHY = [["network", "connector", "level"], ["connector", "level"], ["level"]]
MIN_N = 1_000

_MEDIANS = f"""{UNITS_SQL},
obs AS (SELECT * FROM units WHERE connector_count > 0),
valid AS (SELECT * FROM obs WHERE power > 0),
med AS (
  SELECT 'network|connector|level' AS grouping, network, connector, level,
         count(*) AS n, median(power) AS m FROM valid GROUP BY network, connector, level
  UNION ALL SELECT 'connector|level', NULL, connector, level, count(*), median(power)
  FROM valid GROUP BY connector, level
  UNION ALL SELECT 'level', NULL, NULL, level, count(*), median(power) FROM valid GROUP BY level)"""

_RESOLVED = f"""{_MEDIANS},
defaults(connector, level, default_value) AS (VALUES ('O', '0', 7.2e0), ('F', '0', 1.4e0), ('O', '1', 9.6e0)),
res AS (
  SELECT u.*, CASE WHEN power > 0 THEN power ELSE coalesce(a.m, b.m, c.m, d.default_value) END AS resolved,
    CASE WHEN power > 0 THEN 'reported' WHEN coalesce(a.m, b.m, c.m) IS NOT NULL
      THEN 'empirical_fallback' WHEN d.default_value IS NOT NULL THEN 'type_default'
      ELSE 'unresolved' END AS source,
    CASE WHEN power > 0 THEN NULL
         WHEN a.m IS NOT NULL THEN 'network=' || u.network || '+connector=' || u.connector || '+level=' || u.level
         WHEN b.m IS NOT NULL THEN 'connector=' || u.connector || '+level=' || u.level
         WHEN c.m IS NOT NULL THEN 'level=' || u.level END AS fallback_group
  FROM obs u
  LEFT JOIN med a ON a.grouping = 'network|connector|level' AND a.n >= {MIN_N}
    AND a.network = u.network AND a.connector = u.connector AND a.level = u.level
  LEFT JOIN med b ON b.grouping = 'connector|level' AND b.n >= {MIN_N}
    AND b.connector = u.connector AND b.level = u.level
  LEFT JOIN med c ON c.grouping = 'level' AND c.n >= {MIN_N} AND c.level = u.level
  LEFT JOIN defaults d ON d.connector = u.connector AND d.level = u.level)"""

_UNIT = f"""{_RESOLVED},
unit AS (
  SELECT unit_order, unit_line, min(site_id) AS site_id, min(level) AS level, max(ports) AS ports,
    CASE WHEN max(ports) > 1 THEN NULL ELSE max(resolved) END AS capacity,
    CASE WHEN max(ports) > 1 THEN 'multi_port_unresolved'
         WHEN max(resolved) IS NOT NULL THEN 'single_port_connector_maximum'
         ELSE 'unresolved' END AS basis,
    CASE max(CASE source WHEN 'reported' THEN 0 WHEN 'empirical_fallback' THEN 1
             WHEN 'type_default' THEN 2 ELSE 3 END)
      WHEN 0 THEN 'reported' WHEN 1 THEN 'empirical_fallback' WHEN 2 THEN 'type_default'
      ELSE 'unresolved' END AS source,
    CAST(count(DISTINCT connector) AS INTEGER) AS standards,
    count(DISTINCT connector) > 1 AND max(ports) = 1 AS is_multi_connector,
    bool_or(status = 'E' AND access = 'public') AS is_public
  FROM res GROUP BY unit_order, unit_line)"""


def observations(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).where("connector_count > 0")


def default_table(spark: SparkSession) -> DataFrame:
    return read_parameters(spark, [
        {"connector": "O", "level": "0", "default_value": 7.2, "justification": "stand-in"},
        {"connector": "F", "level": "0", "default_value": 1.4, "justification": "stand-in"},
        {"connector": "O", "level": "1", "default_value": 9.6, "justification": "stand-in"}],
        "connector string,level string,default_value double")


def resolved(spark: SparkSession, d: str, min_n: int = MIN_N) -> DataFrame:
    return S.resolve_ladder(observations(spark, d), "power", HIERARCHY, default_table(spark),
                            ["connector", "level"], min_n)


def unit_table(spark: SparkSession, d: str) -> DataFrame:
    flagged = C.status_flags(resolved(spark, d), "status", "access").withColumn(
        "_pub", F.col("is_public_operational").cast("int"))
    # a unit is public when any of its observations is; max over a 0/1 flag
    tagged = flagged.withColumn("_not_pub", 1 - F.col("_pub"))
    return S.unit_capacity(tagged, ["unit_order", "unit_line"], "resolved", "connector_count",
                           "ports", "source", "level", "connector",
                           keep=["site_id", "_not_pub"]).withColumn(
        "is_public", F.col("_not_pub") == 0).drop("_not_pub")


@query("empirical_medians", f"""
WITH {_MEDIANS}
SELECT grouping, network, connector, level, CAST(n AS BIGINT) AS sample_size,
       round(m, 4) AS median, n >= {MIN_N} AS usable FROM med""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = S.empirical_medians(observations(spark, d), HIERARCHY, "power", MIN_N)
    return m.select("grouping", "network", "connector", "level", "sample_size",
                    F.round("median", 4).alias("median"), "usable")


@query("median_table_report", f"""
WITH {_MEDIANS}
SELECT grouping, CASE grouping WHEN 'level' THEN 'level=' || level
  WHEN 'connector|level' THEN 'connector=' || connector || '+level=' || level
  ELSE 'network=' || network || '+connector=' || connector || '+level=' || level END AS peer_group,
  CAST(n AS BIGINT) AS sample_size, round(m, 3) AS median, n >= {MIN_N} AS usable FROM med""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.median_table(S.empirical_medians(observations(spark, d), HIERARCHY, "power", MIN_N))


@query("resolve_ladder", f"""
WITH {_RESOLVED}
SELECT source, fallback_group, CAST(count(*) AS BIGINT) AS n, round(sum(resolved), 2) AS power,
       CAST(sum(CASE WHEN power = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_anomalies
FROM res GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d).groupBy("source", "fallback_group").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("resolved"), 2).alias("power"),
        F.sum(F.col("is_zero_anomaly").cast("int")).alias("zero_anomalies"))


@query("ladder_tally", f"""
WITH {_RESOLVED}
SELECT source, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / CAST((SELECT count(*) FROM res) AS DOUBLE), 6) AS share
FROM res GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return S.ladder_tally(resolved(spark, d)).select("source", "n",
                                                     F.round("share", 6).alias("share"))


@query("unit_capacity", f"""
WITH {_UNIT}
SELECT unit_order, unit_line, site_id, level, ports, capacity, basis, source, standards,
       is_multi_connector FROM unit""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return unit_table(spark, d).select(
        "unit_order", "unit_line", "site_id", "level", "ports", "capacity", "basis", "source",
        "standards", "is_multi_connector")


@query("site_capacity", f"""
WITH {_UNIT}
SELECT site_id, CAST(count(*) AS BIGINT) AS unit_count, CAST(sum(ports) AS BIGINT) AS ports,
  round(sum(coalesce(capacity, 0)), 2) AS capacity,
  CAST(sum(CASE WHEN capacity IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS units_unresolved,
  CAST(sum(CASE WHEN is_public THEN 1 ELSE 0 END) AS BIGINT) AS public_units,
  CAST(sum(CASE WHEN is_public THEN ports ELSE 0 END) AS BIGINT) AS public_ports,
  round(sum(CASE WHEN is_public THEN coalesce(capacity, 0) ELSE 0 END), 2) AS public_capacity,
  round(sum(CASE WHEN source = 'reported' THEN coalesce(capacity, 0) ELSE 0 END)
        / sum(coalesce(capacity, 0)), 6) AS reported_capacity_share
FROM unit GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = S.site_capacity(unit_table(spark, d), "site_id", "is_public")
    return C.publish_round(s, {"capacity": 2, "public_capacity": 2,
                               "reported_capacity_share": 6})


@query("site_ports_by_level", f"""
WITH {_UNIT}
SELECT site_id, level, CAST(sum(ports) AS BIGINT) AS ports,
       CAST(sum(CASE WHEN is_public THEN ports ELSE 0 END) AS BIGINT) AS public_ports
FROM unit GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = S.ports_by_level(unit_table(spark, d), "site_id", "is_public")
    return m.select("site_id", "public_ports_by_level", F.explode("ports_by_level")
                    .alias("level", "ports")).select(
        "site_id", "level", "ports", F.coalesce(F.try_element_at(
            "public_ports_by_level", F.col("level")), F.lit(0)).alias("public_ports"))


@query("site_compatible_by_standard", f"""
WITH {_UNIT},
per AS (SELECT unit_order, unit_line, connector, max(resolved) AS v FROM res GROUP BY 1, 2, 3)
SELECT site_id, connector AS standard, round(sum(v), 2) AS compatible_capacity,
       round(sum(CASE WHEN is_public THEN v ELSE 0 END), 2) AS public_compatible_capacity
FROM per JOIN unit USING (unit_order, unit_line) WHERE v IS NOT NULL GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = S.compatible_by_standard(unit_table(spark, d), "site_id", "is_public")
    return C.publish_round(s, {"compatible_capacity": 2, "public_compatible_capacity": 2})


@query("qualifying_sites", f"""
WITH {_UNIT}
SELECT site_id FROM unit WHERE is_public AND level IN ('1', '2') GROUP BY 1 HAVING sum(ports) > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = S.ports_by_level(unit_table(spark, d), "site_id", "is_public")
    return S.qualifying_sites(m, "public_ports_by_level", ["1", "2"]).select("site_id")


@query("capacity_overstatement", f"""
WITH {_UNIT}
SELECT round((SELECT sum(resolved) FROM res WHERE ports = 1), 2) AS summed_alternatives,
       round((SELECT sum(capacity) FROM unit), 2) AS maximum_rule""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = resolved(spark, d).where("ports = 1").agg(
        F.round(F.sum("resolved"), 2).alias("summed_alternatives"))
    u = unit_table(spark, d).agg(F.round(F.sum("capacity"), 2).alias("maximum_rule"))
    return r.join(u)


@query("station_capacity", f"""
WITH {_UNIT}
SELECT site_id, round(sum(coalesce(capacity, 0)), 2) AS capacity, CAST(count(*) AS BIGINT) AS units
FROM unit GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.publish_round(S.station_capacity(unit_table(spark, d), "site_id"), {"capacity": 2})


@query("site_rollup", f"""
WITH {UNITS_SQL},
u AS (SELECT site_id, count(*) AS n, sum(CASE WHEN status = 'E' AND access = 'public' THEN 1 ELSE 0 END)
      AS p FROM units GROUP BY 1)
SELECT s_nationkey AS site, CAST(count(DISTINCT s_suppkey) AS BIGINT) AS station_count,
  CAST(count(DISTINCT s_suppkey % 7) AS BIGINT) AS network_count,
  CAST(sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS BIGINT) AS public_stations,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS unit_count,
  CAST(coalesce(sum(p), 0) AS BIGINT) AS public_unit_count
FROM supplier LEFT JOIN u ON u.site_id = s_suppkey GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    st = read_table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("station"), (F.col("s_suppkey") % 7).alias("network"),
        (F.col("s_acctbal") > 0).alias("is_public"))
    site = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("station"), F.col("s_nationkey").alias("site"))
    flags = C.status_flags(units(spark, d), "status", "access")
    counts = flags.groupBy(F.col("site_id").alias("station")).agg(
        F.count(F.lit(1)).alias("unit_count"),
        F.sum(F.col("is_public_operational").cast("int")).alias("public_unit_count"))
    return S.site_rollup(site, st, counts, "site", "station", "network", "is_public")


@query("group_all_sum", """
SELECT o_orderstatus, o_orderpriority, c_nationkey, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority",
                   "o_totalprice")
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        "o_orderstatus", "o_orderpriority", "c_nationkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))


@query("supply_by_area", f"""
WITH {UNITS_SQL},
h AS (SELECT c_nationkey AS area, count(*) AS households FROM customer GROUP BY 1),
u AS (SELECT s_nationkey AS area, units.* FROM units JOIN supplier ON s_suppkey = site_id
      WHERE status = 'E' AND access = 'public')
SELECT area, level, CAST(sum(ports) AS BIGINT) AS ports,
       CAST(count(DISTINCT site_id) AS BIGINT) AS stations_at_level,
       round(sum(ports) * 1000.0e0 / any_value(households), 4) AS ports_per_1k
FROM u JOIN h USING (area) GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_nationkey").alias("area"))
    u = C.status_flags(units(spark, d), "status", "access").where("is_public_operational").join(
        s, "site_id")
    h = read_table(spark, d, "customer", "c_nationkey").groupBy(
        F.col("c_nationkey").alias("area")).agg(F.count(F.lit(1)).alias("households"))
    return S.supply_by_area(u, "area", "site_id", "level", "ports", h).select(
        "area", "level", "ports", "stations_at_level",
        F.round("ports_per_1k", 4).alias("ports_per_1k"))


_RECON = """p AS (SELECT o_orderkey AS k,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey % 4 AS INTEGER) END AS a,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 3 AS INTEGER) END AS b FROM orders),
  ch AS (SELECT l_orderkey AS k, count(*) AS n, max(CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END) AS lg
         FROM lineitem GROUP BY 1),
  j AS (SELECT p.k, coalesce(n, 0) AS n, coalesce(lg, 0) AS lg, a + b AS reported FROM p LEFT JOIN ch USING (k)),
  cl AS (SELECT *, CASE WHEN reported = n THEN 'reconciles' WHEN n = 0 THEN 'no_unit_records'
    WHEN reported IS NULL THEN 'missing_station_aggregate' WHEN lg = 1 THEN 'legacy_charging_level'
    ELSE 'upstream_count_mismatch' END AS class FROM j)"""


@query("reconcile_counts", f"""
WITH {_RECON}
SELECT class, CAST(count(*) AS BIGINT) AS n,
       round(count(*) / CAST((SELECT count(*) FROM cl) AS DOUBLE), 6) AS rate FROM cl GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    parents = read_table(spark, d, "orders", "o_orderkey", "o_custkey").select(
        k.alias("k"), F.when(k % 11 != 0, (F.col("o_custkey") % 4).cast("int")).alias("a"),
        F.when(k % 11 != 0, (k % 3).cast("int")).alias("b"))
    children = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(
        F.col("l_orderkey").alias("k"), "l_linenumber")
    return S.reconciliation_tally(S.reconcile_counts(
        parents, children, "k", ["a", "b"], F.col("l_linenumber") == 7))


@query("inner_equi_join", f"""
WITH {UNITS_SQL}
SELECT level, connector, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(s_nationkey) AS BIGINT) AS check_sum
FROM units JOIN supplier ON s_suppkey = site_id GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(
        F.col("s_suppkey").alias("site_id"), "s_nationkey")
    return units(spark, d).join(s, "site_id").groupBy("level", "connector").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s_nationkey").alias("check_sum"))


@query("left_join_assignment", """
SELECT c_custkey, o_orderkey, o_orderpriority FROM customer
LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey")
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_orderpriority").where("o_orderstatus = 'P'")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "o_orderkey", "o_orderpriority")


@query("join_to_preaggregate", """
WITH u AS (SELECT l_orderkey, count(*) AS n, sum(l_linenumber) AS s FROM lineitem GROUP BY 1)
SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders_n, CAST(coalesce(sum(n), 0) AS BIGINT) AS items,
       CAST(coalesce(sum(s), 0) AS BIGINT) AS lines
FROM orders LEFT JOIN u ON l_orderkey = o_orderkey GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("s"))
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey")
    return o.join(u, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(
        "o_custkey").agg(F.count(F.lit(1)).alias("orders_n"),
                         F.coalesce(F.sum("n"), F.lit(0)).alias("items"),
                         F.coalesce(F.sum("s"), F.lit(0)).alias("lines"))


@query("lookup_with_suffix", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN NULL
       ELSE CAST(c_nationkey AS VARCHAR) END AS code,
       CASE WHEN c_custkey % 3 = 0 THEN 'exact' WHEN c_custkey % 3 = 1 THEN 'suffixed'
       ELSE 'unresolved' END AS lookup FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    table = read_table(spark, d, "nation").select(
        F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("state"),
        F.concat(F.col("n_name"), F.lit(" County")).alias("name"),
        F.col("n_nationkey").cast("string").alias("code"))
    k = F.col("c_custkey") % 3
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey").join(
        read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat(F.lit(" r"), F.col("n_regionkey").cast("string")).alias("state"),
        F.when(k == 0, F.concat(F.col("n_name"), F.lit(" County"))).when(
            k == 1, F.col("n_name")).otherwise(F.lit("Elsewhere")).alias("name"))
    return RC.lookup_with_suffix(c, table, "state", "name", "code").select(
        "c_custkey", "code", "lookup")


@query("duplicate_profile", """
WITH g AS (SELECT l_returnflag, l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS distinct_rows,
  CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS rows_in_duplicate_groups,
  CAST(sum(n - 1) AS BIGINT) AS redundant_rows, CAST(max(n) AS BIGINT) AS largest_group
FROM g GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber")
    return Q.duplicate_profile(rows, ["l_orderkey", "l_linenumber"], ["l_returnflag"])


@query("identifiability_report", """
WITH g AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS distinct_rows,
  CAST(sum(n - 1) AS BIGINT) AS redundant_rows, false AS has_identifier,
  sum(n - 1) = 0 AS rows_are_distinct, sum(n - 1) = 0 AS dedup_is_safe FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    return Q.identifiability_report(rows, rows.columns).select(
        "rows", "distinct_rows", "redundant_rows", "has_identifier", "rows_are_distinct",
        "dedup_is_safe")


@query("first_and_last_row_per_key", """
SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority,
       arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS last_priority
FROM orders GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderdate",
                   "o_orderkey")
    key, order = ["o_custkey"], ["o_orderdate", "o_orderkey"]
    first = W.first_per_key(o, key, order, ["o_orderpriority"]).withColumnRenamed(
        "o_orderpriority", "first_priority")
    last = W.last_per_key(o, key, order, ["o_orderpriority"]).withColumnRenamed(
        "o_orderpriority", "last_priority")
    return first.join(last, "o_custkey")


@query("identical_unit_reports", f"""
WITH {UNITS_SQL}
SELECT network, CAST(count(*) AS BIGINT) AS rows,
       CAST(sum(CASE WHEN connector_count = 1 THEN 1 ELSE 0 END) AS BIGINT) AS as_expected,
       CAST(sum(CASE WHEN connector_count > 1 THEN 1 ELSE 0 END) AS BIGINT) AS above,
       CAST(sum(CASE WHEN connector_count < 1 THEN 1 ELSE 0 END) AS BIGINT) AS below
FROM units GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Q.count_drift(units(spark, d), "connector_count", 1, ["network"])


@query("conditional_coverage", f"""
WITH {UNITS_SQL}
SELECT 'power' AS measure, CAST(sum(CASE WHEN connector_count > 0 THEN 1 ELSE 0 END) AS BIGINT) AS present,
  CAST(sum(CASE WHEN connector_count > 0 AND power > 0 THEN 1 ELSE 0 END) AS BIGINT) AS reported,
  CAST(sum(connector_count) AS BIGINT) AS weight_present,
  CAST(sum(CASE WHEN power > 0 THEN connector_count ELSE 0 END) AS BIGINT) AS weight_reported,
  round(sum(CASE WHEN connector_count > 0 AND power > 0 THEN 1 ELSE 0 END)
    / CAST(sum(CASE WHEN connector_count > 0 THEN 1 ELSE 0 END) AS DOUBLE), 6) AS row_coverage,
  round(sum(CASE WHEN power > 0 THEN connector_count ELSE 0 END)
    / CAST(sum(connector_count) AS DOUBLE), 6) AS weight_coverage FROM units""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.publish_round(
        Q.conditional_coverage(units(spark, d), {"power": ("connector_count", "power")}),
        {"row_coverage": 6, "weight_coverage": 6})
