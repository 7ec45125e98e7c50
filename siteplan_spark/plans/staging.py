"""Queries over sources, casts, filters and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.functions import clean as C
from siteplan_spark.operators import access as A
from siteplan_spark.operators import ledger as L
from siteplan_spark.operators import ranking as W
from siteplan_spark.operators.access import freshness
from siteplan_spark.plans.registry import query
from siteplan_spark.sources import readers as R
from siteplan_spark.sources.sinks import geojson_feature
from siteplan_spark.sources.tables import (
    POINTS_SQL, SITES_SQL, UNITS_SQL, population_points, read_table, sites, units)


# --- sources ------------------------------------------------------------------------------

@query("explode_nested", """
SELECT o_orderkey, CAST(i AS INTEGER) AS record_ordinal, o_orderpriority AS priority,
       o_orderkey || ':' || i AS record_key
FROM orders, UNNEST(range(0, o_orderkey % 4)) AS t(i)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    nested = o.select("o_orderkey", F.expr(
        "CASE WHEN o_orderkey % 4 > 0 THEN transform(sequence(1, cast(o_orderkey % 4 AS int)), "
        "x -> named_struct('priority', o_orderpriority)) END AS units"))
    return R.explode_nested(nested, "o_orderkey", "units").select(
        "o_orderkey", "record_ordinal", F.col("child.priority").alias("priority"), "record_key")


@query("explode_map_measures", """
SELECT event_id, 'k' AS measure, CAST(json_extract(props, '$.k') AS BIGINT) AS n
FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", "event_id", "props").select(
        "event_id", F.transform_values(F.from_json("props", "map<string, bigint>"),
                                       lambda _k, v: F.struct(v.alias("n"))).alias("m"))
    return R.explode_map_measures(e, "m")


@query("html_table_rows", """
SELECT c_custkey, 1 AS row_no, c_name AS area, CAST(c_nationkey AS VARCHAR) AS n FROM customer
UNION ALL SELECT c_custkey, 2, 'Total', CAST(c_nationkey + 1 AS VARCHAR) FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    html = c.select("c_custkey", F.format_string(
        "<p>x</p><TABLE class='a'><tr><th>Area</th><th>Count</th></tr><tr><td> <b>%s</b></td>"
        "<td>%d</td></tr>\n<tr><td>Total</td><td>%d</td></tr></TABLE><table><tr><td>z</td></tr>"
        "</table>", "c_name", "c_nationkey", F.col("c_nationkey") + 1).alias("html"))
    return R.html_table_rows(html, "c_custkey", "html").select(
        "c_custkey", "row_no", F.col("cells")["Area"].alias("area"),
        F.col("cells")["Count"].alias("n"))


@query("html_pages_without_tables", """
SELECT CAST(count(*) AS BIGINT) AS pages,
       CAST(count(*) FILTER (WHERE lower(html) LIKE '%<table%') AS BIGINT) AS with_rows
FROM pages""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "pages", "page_id", "html")
    found = R.html_table_rows(p, "page_id", "html").select("page_id").distinct()
    return p.agg(F.count(F.lit(1)).alias("pages")).join(
        found.agg(F.count(F.lit(1)).alias("with_rows")))


@query("json_records_text", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS kind,
       '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS props,
       '' AS note
FROM events""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", "event_id", "event_type", "props")
    doc = e.select(F.array(F.struct(
        F.col("event_type").alias("kind"), "event_id",
        F.lit(None).cast("string").alias("note"),
        F.from_json("props", "struct<k: bigint>").alias("props"))).alias("records"))
    return R.flatten_records(doc, "records")


@query("merge_column_batches", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment, true AS complete FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    wide = R.merge_column_batches([c.select("c_custkey", "c_name"),
                                   c.select("c_custkey", "c_nationkey"),
                                   c.select("c_custkey", "c_mktsegment")], ["c_custkey"])
    return wide.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment",
                       (F.col("_batches") == 3).alias("complete"))


@query("geoid_from_parts", """
SELECT lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0')
       AS geoid, CAST(count(*) AS BIGINT) AS n
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = population_points(spark, d).select(
        F.lpad(F.col("region").cast("string"), 2, "0").alias("state"),
        F.lpad(F.col("area").cast("string"), 3, "0").alias("county"))
    return p.groupBy(R.geoid_from_parts("state", "county").alias("geoid")).agg(
        F.count(F.lit(1)).alias("n"))


@query("union_tagged", """
SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS parent, 'nation' AS kind FROM nation
UNION ALL SELECT r_name, '', 'region' FROM region
UNION ALL SELECT c_name, CAST(c_nationkey AS VARCHAR), 'customer' FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation").select(
        F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("parent"))
    r = read_table(spark, d, "region").select(F.col("r_name").alias("name"))
    c = read_table(spark, d, "customer").select(
        F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("parent"))
    return R.union_tagged([n, r, c], {"kind": ["nation", "region", "customer"]})


@query("rename_declared_key", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CAST(o_custkey AS VARCHAR)
       WHEN 'F' THEN o_orderpriority END AS source_geography_id FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey",
                   "o_orderpriority")
    return R.rename_declared_key(o, {"O": "o_custkey", "F": "o_orderpriority"},
                                 "o_orderstatus").select("o_orderkey", "source_geography_id")


@query("keyed_reference", """
SELECT CAST(p_partkey AS VARCHAR) AS key, round(CAST(p_size AS DOUBLE) * 1e-6, 8) AS value
FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_size").select(
        F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("GEOID"),
        F.concat(F.col("p_size").cast("string"), F.lit("  ")).alias("ALAND"))
    return R.keyed_reference(p, "GEOID", "ALAND", 1e-6).select(
        "key", F.round("value", 8).alias("value"))


@query("ratio_crosswalk", """
WITH e AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS source, CAST(c_custkey % 7 AS VARCHAR) AS target,
         (c_custkey % 10) / 16.0e0 AS w FROM customer
  UNION ALL
  SELECT CAST(c_nationkey AS VARCHAR), CAST(c_custkey % 7 AS VARCHAR), 0.25e0 FROM customer)
SELECT source, target, round(sum(w), 4) AS weight FROM e GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey").select(F.to_json(
        F.create_map(F.col("c_nationkey").cast("string"), F.array(
            F.struct((F.col("c_custkey") % 7).cast("string").alias("geoid"),
                     ((F.col("c_custkey") % 10) / 16.0).alias("res_ratio")),
            F.struct((F.col("c_custkey") % 7).cast("string").alias("geoid"),
                     F.lit(0.25).alias("res_ratio"))))).alias("j"))
    return R.read_ratio_crosswalk(c, "j").select("source", "target",
                                                 F.round("weight", 4).alias("weight"))


@query("population_points_loaded", """
SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 6, '0')
       AS point_id, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS source_id,
       CAST(1 + c_custkey % 97 AS BIGINT) AS population
FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = read_table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("STATEFP"),
        F.when(k % 11 == 0, "bad").otherwise(F.lpad(k.cast("string"), 6, "0")).alias("TRACT"),
        (F.lit(1) + k % 97).cast("string").alias("POP"),
        F.when(k % 13 == 0, "n/a").otherwise("35.5").alias("LAT"), F.lit("-80").alias("LON"))
    return R.load_population_points(raw, {"STATEFP": 2, "TRACT": 6}, "POP", "LAT", "LON").select(
        "point_id", "source_id", "population")


@query("freshness_flags", """
SELECT o_orderkey,
       round((epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(o_orderdate)) / 86400.0e0, 4)
         AS age_days,
       (epoch(TIMESTAMP '2001-08-02 00:00:00') - epoch(o_orderdate)) / 86400.0e0 > 14
         AS is_stale
FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return freshness(o, "o_orderdate", "2001-08-02 00:00:00").select(
        "o_orderkey", F.round("age_days", 4).alias("age_days"), "is_stale")


@query("geojson_features", f"""
WITH {SITES_SQL}
SELECT site_id, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || CAST(lon AS VARCHAR)
       || ',' || CAST(lat AS VARCHAR) || ']}},"properties":{{"site_id":' || site_id
       || ',"area":' || area || '}}}}' AS feature FROM sites""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select(
        "site_id", geojson_feature("lat", "lon", ["site_id", "area"]).alias("feature"))


@query("column_projected_read", """
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines
FROM lineitem GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem", "l_returnflag", "l_linenumber").groupBy(
        "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


@query("parameter_sweep", """
WITH p(threshold) AS (SELECT 1000.0e0 + i * 1500.0e0 FROM range(0, 6) t(i)),
n AS (SELECT s_nationkey, s_acctbal FROM supplier)
SELECT threshold, CAST(sum(CASE WHEN s_acctbal > threshold THEN 1 ELSE 0 END) AS BIGINT) AS above
FROM n, p GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    grid = W.parameter_grid(spark, 1000.0, 8500.0, 1500.0)
    # one histogram over the grid, summed from the top
    rows = read_table(spark, d, "supplier", "s_acctbal").withColumn("one", F.lit(1))
    curve = A.sensitivity_curve(rows, "s_acctbal", "one", 1000.0, 8500.0, 1500.0)
    return grid.join(curve, "threshold", "left").select(
        "threshold", F.coalesce("points_beyond", F.lit(0)).alias("above"))


# --- casts and codes -----------------------------------------------------------------------

@query("stage_typed", """
SELECT CAST(o_orderkey AS BIGINT) AS order_id,
       TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS INTEGER)
         AS customer,
       TRY_CAST(CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE)
         AS price
FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice").select(
        k.cast("string").alias("Order"),
        F.when(k % 9 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("Cust"),
        F.when(k % 10 == 0, "").otherwise(F.col("o_totalprice").cast("string")).alias("Price"))
    return C.stage_typed(raw, {"order_id": ("Order", "bigint"), "customer": ("Cust", "int"),
                               "price": ("Price", "double")})


@query("parse_grouped_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL
       ELSE CAST(floor(o_totalprice) AS BIGINT) END AS n FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = read_table(spark, d, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", F.when(k % 7 == 0, F.when(k % 2 == 0, "").otherwise("n/a")).otherwise(
            F.format_number(F.floor("o_totalprice"), 0)).alias("t"))
    return raw.select("o_orderkey", C.parse_grouped_number("t").alias("n"))


@query("parse_us_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END
       AS day FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, "13/45/2000").otherwise(
            F.date_format("o_orderdate", "M/d/yyyy")).alias("t"))
    return raw.select("o_orderkey", C.parse_us_date("t").alias("day"))


@query("extract_label_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END
       AS day FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    label = (F.when(k % 6 == 0, F.when(k % 4 == 0, "Snapshot").otherwise("Snapshot (2/30/2001)"))
             .otherwise(F.concat(F.lit("Snapshot ("), F.date_format(
                 "o_orderdate", "MM/dd/yyyy"), F.lit(")"))))
    raw = read_table(spark, d, "orders", "o_orderkey", "o_orderdate").select(
        "o_orderkey", label.alias("t"))
    return raw.select("o_orderkey", C.extract_label_date("t").alias("day"))


@query("null_if_jam", """
SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN NULL ELSE c_acctbal END AS income
FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = read_table(spark, d, "customer", "c_custkey", "c_acctbal").select(
        "c_custkey", F.when(k % 5 == 0, "-666666666").when(k % 5 == 1, " ").otherwise(
            F.col("c_acctbal").cast("string")).alias("t"))
    return raw.select("c_custkey", C.null_if_jam("t").alias("income"))


@query("is_missing", """
SELECT CAST(sum(CASE WHEN c_custkey % 6 < 4 THEN 1 ELSE 0 END) AS BIGINT) AS missing,
       CAST(count(*) AS BIGINT) AS n FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    raw = read_table(spark, d, "customer", "c_custkey", "c_name").select(
        F.when(k == 0, " N/A ").when(k == 1, "NaN").when(k == 2, "").when(k > 3, F.col("c_name"))
        .alias("t"))
    return raw.agg(F.sum(F.when(C.is_missing("t"), 1).otherwise(0)).alias("missing"),
                   F.count(F.lit(1)).alias("n"))


@query("status_flags_rollup", f"""
WITH {UNITS_SQL}
SELECT site_id, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN status = 'E' THEN 1 ELSE 0 END) AS BIGINT) AS operational,
       CAST(sum(CASE WHEN access = 'public' THEN 1 ELSE 0 END) AS BIGINT) AS public_rows,
       CAST(sum(CASE WHEN status = 'E' AND access = 'public' THEN 1 ELSE 0 END) AS BIGINT) AS both
FROM units GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    flagged = C.status_flags(units(spark, d), "status", "access")
    n = lambda c: F.sum(F.col(c).cast("int"))
    return flagged.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), n("is_operational").alias("operational"),
        n("is_public").alias("public_rows"), n("is_public_operational").alias("both"))


@query("decode_list_field", """
SELECT c_mktsegment AS connector, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT c_mktsegment FROM customer WHERE c_custkey % 3 <> 2
  UNION ALL SELECT 'X' FROM customer WHERE c_custkey % 3 <> 2) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    raw = read_table(spark, d, "customer", "c_custkey", "c_mktsegment").select(
        F.when(k == 0, F.concat(F.lit('["'), "c_mktsegment", F.lit('","X"]')))
        .when(k == 1, F.concat(F.lit(" "), "c_mktsegment", F.lit(" X "))).otherwise(" ").alias("t"))
    return raw.select(F.explode(C.decode_list_field("t")).alias("connector")).groupBy(
        "connector").agg(F.count(F.lit(1)).alias("n"))


@query("map_enum_grain", """
SELECT CASE l_returnflag WHEN 'A' THEN 'native_tract' WHEN 'N' THEN 'county_anchored'
       ELSE 'state_total_only' END AS grain, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    grain = C.map_enum("l_returnflag", {"A": "native_tract", "N": "county_anchored"},
                       "state_total_only")
    return read_table(spark, d, "lineitem", "l_returnflag").groupBy(grain.alias("grain")).agg(
        F.count(F.lit(1)).alias("n"))


@query("stamp_provenance", """
SELECT s_suppkey, '2026-01-01T00:00:00Z' AS computed_at,
       '{"orders":"2001","units":"v3"}' AS source_vintages FROM supplier""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.stamp_provenance(read_table(spark, d, "supplier", "s_suppkey"),
                              "2026-01-01T00:00:00Z", {"units": "v3", "orders": "2001"})


@query("normalise_zip", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE substr(
  regexp_replace(c_name, '[^0-9]', '', 'g'), 1, 5) END AS zip FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    raw = read_table(spark, d, "customer", "c_custkey", "c_name").select(
        "c_custkey", F.when(F.col("c_custkey") % 4 == 0, "12-3").otherwise(F.col("c_name"))
        .alias("t"))
    return raw.select("c_custkey", C.normalise_zip("t").alias("zip"))


@query("normalise_taxonomy", """
SELECT CASE l_returnflag WHEN 'A' THEN 'CCS' WHEN 'N' THEN 'J1772' ELSE l_returnflag END
       AS normalised,
       CASE l_returnflag WHEN 'A' THEN 'dc' WHEN 'N' THEN 'ac' ELSE 'unknown' END AS family,
       CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    table = R.read_parameters(spark, [
        {"raw": "A", "normalised": "CCS", "display": "CCS", "family": "dc",
         "justification": "stand-in code"},
        {"raw": "N", "normalised": "J1772", "display": "SAE J1772", "family": "ac",
         "justification": "stand-in code"}],
        "raw string,normalised string,display string,family string")
    counted = read_table(spark, d, "lineitem", "l_returnflag").groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"))
    return C.normalise_taxonomy(counted, "l_returnflag", table).select(
        "normalised", "family", "n")


@query("valid_positive_flags", f"""
WITH {UNITS_SQL}
SELECT network, CAST(count(power) FILTER (WHERE power > 0) AS BIGINT) AS valid,
       CAST(sum(CASE WHEN power = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_anomalies,
       CAST(count(*) AS BIGINT) AS n FROM units GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).groupBy("network").agg(
        F.count(C.valid_positive("power")).alias("valid"),
        F.sum(C.is_zero_anomaly("power").cast("int")).alias("zero_anomalies"),
        F.count(F.lit(1)).alias("n"))


@query("unpivot_measures", """
WITH w AS (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 3 AS INTEGER) AS a_n,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS a_kw,
  CAST(l_partkey % 2 AS INTEGER) AS b_n,
  CASE WHEN l_partkey % 4 = 0 THEN 0.0e0 ELSE l_quantity * 2 END AS b_kw FROM lineitem),
r AS (SELECT 'A' AS measure, a_n AS n, a_kw AS power FROM w
      UNION ALL SELECT 'B', b_n, b_kw FROM w)
SELECT measure, n, CAST(count(*) AS BIGINT) AS rows_n,
       CAST(sum(CASE WHEN power > 0 THEN 1 ELSE 0 END) AS BIGINT) AS reported,
       CAST(sum(CASE WHEN power = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_anomalies,
       round(sum(power), 2) AS power FROM r GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").select(
        "l_orderkey", (F.col("l_orderkey") % 3).cast("int").alias("a_n"),
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity")).alias("a_kw"),
        (F.col("l_partkey") % 2).cast("int").alias("b_n"),
        F.when(F.col("l_partkey") % 4 == 0, 0.0).otherwise(F.col("l_quantity") * 2).alias("b_kw"))
    rows = C.unpivot_measures(w, ["l_orderkey"], {"A": ("a_n", "a_kw"), "B": ("b_n", "b_kw")})
    return rows.groupBy("measure", "n").agg(
        F.count(F.lit(1)).alias("rows_n"), F.sum(F.col("has_reported").cast("int")).alias("reported"),
        F.sum(F.col("is_zero_anomaly").cast("int")).alias("zero_anomalies"),
        F.round(F.sum("power"), 2).alias("power"))


@query("connector_sum_flag", """
SELECT CAST(count(*) AS BIGINT) AS n,
  CAST(sum(CASE WHEN (l_orderkey % 3) + (l_partkey % 2) > l_linenumber % 2 + 1 THEN 1 ELSE 0 END)
    AS BIGINT) AS multi FROM lineitem""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").select(
        (F.col("l_orderkey") % 3).alias("a"), (F.col("l_partkey") % 2).alias("b"),
        (F.col("l_linenumber") % 2 + 1).alias("ports"))
    return w.agg(F.count(F.lit(1)).alias("n"),
                 F.sum(C.is_multi_interface(["a", "b"], "ports").cast("int")).alias("multi"))


@query("coalesce_zero", """
SELECT l_returnflag, CAST(sum(CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE l_linenumber END) AS BIGINT)
       AS n FROM lineitem GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "lineitem", "l_returnflag", "l_orderkey", "l_linenumber").select(
        "l_returnflag", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_linenumber")).alias("x"))
    return w.groupBy("l_returnflag").agg(F.sum(C.coalesce_zero("x")).alias("n"))


@query("equity_population", f"""
WITH {POINTS_SQL}
SELECT area, CAST(sum(weight) AS BIGINT) AS population,
       round(sum(weight * (point_id % 8) / 8.0e0), 4) AS equity_population,
       round(sum(weight * (point_id % 8) / 8.0e0) / sum(weight), 6) AS equity_share
FROM points GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = population_points(spark, d).withColumn("low", (F.col("point_id") % 8) / 8.0)
    g = p.groupBy("area").agg(
        F.sum("weight").alias("population"),
        F.sum(C.share_of_population("low", "weight")).alias("_e"))
    return g.select("area", "population", F.round("_e", 4).alias("equity_population"),
                    F.round(C.population_share("_e", "population"), 6).alias("equity_share"))


@query("place_labels", """
WITH g AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT k, CASE WHEN k % 5 = 0 THEN NULL WHEN n <= 1 THEN 'County ' || k || ', R' || (k % 5)
  WHEN n = 2 THEN 'County ' || k || ', R' || (k % 5) || ' and 1 nearby county'
  ELSE 'County ' || k || ', R' || (k % 5) || ' and ' || (n - 1) || ' nearby counties' END AS place,
  CASE WHEN k % 5 = 0 THEN 'Area ' || lpad(CAST(k AS VARCHAR), 2, '0')
       ELSE 'County ' || k || ', R' || (k % 5) END AS label
FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "supplier", "s_nationkey").groupBy(
        F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumns({
        "county": F.concat(F.lit("County "), F.col("k").cast("string")),
        "state": F.when(F.col("k") % 5 == 0, "").otherwise(
            F.concat(F.lit("R"), (F.col("k") % 5).cast("string")))})
    return g.select("k", C.place_label("county", "state", "n").alias("place"),
                    C.area_label(C.place_label("county", "state"), "k").alias("label"))


@query("scoped_labels", """
SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Gaps nationally'
       ELSE 'Gaps in ' || r_name END AS label
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation").join(
        read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    scope = F.when(F.col("n_nationkey") % 3 != 0, F.col("r_name"))
    return n.select("n_nationkey",
                    C.scoped_label(F.lit("Gaps"), scope, "nationally").alias("label"))


@query("sorted_map_json", """
SELECT s_suppkey, '{"a":' || s_nationkey || ',"b":' || (s_suppkey % 7) || '}' AS j
FROM supplier""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", "s_suppkey", "s_nationkey")
    return s.select("s_suppkey", C.sorted_map_json(F.create_map(
        F.lit("b"), F.col("s_suppkey") % 7, F.lit("a"), F.col("s_nationkey").cast("bigint")))
        .alias("j"))


@query("match_vintage_by_rounding", """
WITH ours AS (SELECT c_nationkey AS k, count(*) * 37 AS n FROM customer GROUP BY 1),
pub AS (SELECT k, 'v1' AS vintage, CAST(floor((n + 50) / 100.0) * 100 AS BIGINT) AS n FROM ours
        UNION ALL SELECT k, 'v2', CAST(floor((n + 50) / 100.0) * 100 AS BIGINT) + k % 2 * 100
        FROM ours)
SELECT vintage, CAST(sum(CASE WHEN pub.n = floor((ours.n + 50) / 100.0) * 100 THEN 1 ELSE 0 END)
       AS BIGINT) AS matching_keys, CAST(count(*) AS BIGINT) AS compared_keys
FROM pub JOIN ours USING (k) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    ours = read_table(spark, d, "customer", "c_nationkey").groupBy(
        F.col("c_nationkey").alias("k")).agg((F.count(F.lit(1)) * 37).alias("n"))
    base = ours.select("k", C.round_to_hundreds("n").alias("n"))
    pub = base.withColumn("vintage", F.lit("v1")).unionByName(
        base.select("k", (F.col("n") + F.col("k") % 2 * 100).alias("n"),
                    F.lit("v2").alias("vintage")))
    return C.match_vintage_by_rounding(ours, pub, "k")


@query("scalar_scores", """
WITH x AS (SELECT c_custkey AS id, CAST(c_custkey % 50 AS DOUBLE) AS v,
  CAST(c_custkey % 37 AS DOUBLE) AS r, CAST(c_custkey % 6 AS DOUBLE) AS ports,
  CAST(c_custkey % 41 AS DOUBLE) AS demand FROM customer)
SELECT id, round(abs(v - r) / (v + r + 1), 6) AS movement,
  round(least(1.0e0, greatest(0.0e0, r / (r + greatest(v, 1.0e0)))), 6) AS width,
  round(CASE WHEN demand > 0 THEN ports * 1000 / demand END, 6) AS per_1k,
  coalesce(demand > 0 AND ports * 1000 / nullif(demand, 0) >= 130.5e0, false) AS saturated,
  round(v * 0.3e0 + r * 0.7e0, 6) AS blended,
  CAST(trunc(v * 0.9e0) AS BIGINT) AS low, CAST(trunc(r * 1.1e0) AS BIGINT) AS high,
  round(CASE WHEN demand > 0 THEN ln(greatest(v, 0) / demand + 1) END, 6) AS log_density,
  round(CASE WHEN demand > 0 THEN (v + r) / demand END, 6) AS share,
  round(CASE WHEN demand > 0 THEN (v * 2.5e0 + r * 7.0e0) / demand END, 6) AS binned
FROM x""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    x = read_table(spark, d, "customer", "c_custkey").select(
        k.alias("id"), (k % 50).cast("double").alias("v"), (k % 37).cast("double").alias("r"),
        (k % 6).cast("double").alias("ports"), (k % 41).cast("double").alias("demand"))
    band = C.tolerance_band("v", "r", 0.1)
    return x.select(
        "id", F.round(C.movement("v", "r"), 6).alias("movement"),
        F.round(C.relative_interval_width("r", "v"), 6).alias("width"),
        F.round(C.ports_per_1k("ports", "demand"), 6).alias("per_1k"),
        C.is_saturated("ports", "demand", 130.5).alias("saturated"),
        F.round(C.blend("v", "r", 0.3), 6).alias("blended"),
        band["low"].alias("low"), band["high"].alias("high"),
        F.round(C.log_density("v", "demand"), 6).alias("log_density"),
        F.round(C.share(["v", "r"], "demand"), 6).alias("share"),
        F.round(C.binned_mean(["v", "r"], [2.5, 7.0], "demand"), 6).alias("binned"))


@query("degradation_share", """
SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus <> 'F' THEN 1.0e0 ELSE 0.0e0 END), 6)
       AS degraded FROM orders GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders", "o_orderpriority", "o_orderstatus").groupBy(
        "o_orderpriority").agg(F.round(C.degradation_share("o_orderstatus", "F"), 6)
                               .alias("degraded"))


@query("publish_round", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       round(l_extendedprice / 7.0e0, 3) AS per_week, round(l_tax / 3.0e0, 4) AS tax
FROM lineitem""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                   "l_extendedprice", "l_tax")
    return C.publish_round(
        w.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                 (F.col("l_extendedprice") / 7.0).alias("per_week"),
                 (F.col("l_tax") / 3.0).alias("tax")), {"per_week": 3, "tax": 4})


# --- filters and ledgers ------------------------------------------------------------------

@query("drop_total_rows", """
SELECT c_mktsegment AS k, CAST(count(*) AS BIGINT) AS n FROM customer
WHERE c_mktsegment NOT IN ('BUILDING') AND c_custkey % 10 <> 3 GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_mktsegment", "c_custkey").select(
        F.when(F.col("c_custkey") % 10 == 3, "").when(
            F.col("c_mktsegment") == "BUILDING", "Total").otherwise(F.col("c_mktsegment"))
        .alias("k"))
    return c.where(~F.col("k").isin("Total", "United States", "") & F.col("k").isNotNull()) \
        .groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("public_operational_filter", f"""
WITH {UNITS_SQL}
SELECT site_id, CAST(count(*) AS BIGINT) AS n FROM units
WHERE status = 'E' AND access = 'public' GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.status_flags(units(spark, d), "status", "access").where(
        "is_public_operational").groupBy("site_id").agg(F.count(F.lit(1)).alias("n"))


def _order_rules() -> list[L.Rule]:
    return [L.Rule("cancelled", "status P", F.col("o_orderstatus") == "P"),
            L.Rule("before_1996", "too old", F.col("o_orderdate") < F.lit("1996-01-01")
                   .cast("timestamp_ntz")),
            L.Rule("low_priority", "priority 5", F.col("o_orderpriority") == "5-LOW")]


_ORDER_CASE = """CASE WHEN o_orderstatus = 'P' THEN 'cancelled'
  WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'before_1996'
  WHEN o_orderpriority = '5-LOW' THEN 'low_priority' ELSE 'included' END"""


@query("classify_first_match", f"""
SELECT o_orderkey, {_ORDER_CASE} AS reason FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderdate",
                   "o_orderpriority")
    kept, out = L.classify_first_match(o, _order_rules())
    return kept.withColumn("reason", F.lit(L.INCLUDED)).unionByName(out).select(
        "o_orderkey", "reason")


@query("exclusion_ledger", f"""
SELECT {_ORDER_CASE} AS reason, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS weight
FROM orders GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return L.exclusion_ledger(o, _order_rules(), F.round(F.col("o_totalprice") * 100)
                              .cast("bigint")).select("reason", "n", "weight")


@query("merge_ledgers", f"""
WITH a AS (SELECT *, {_ORDER_CASE} AS r FROM orders),
b AS (SELECT CASE WHEN r <> 'included' THEN r WHEN o_custkey % 3 = 0 THEN 'no_area'
      ELSE 'included' END AS reason FROM a)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    kept, _out = L.classify_first_match(o, _order_rules())
    second = [L.Rule("no_area", "cannot be placed", F.col("o_custkey") % 3 == 0)]
    return L.merge_ledgers(L.exclusion_ledger(o, _order_rules()),
                           L.exclusion_ledger(kept, second)).select("reason", "n")


@query("ledger_balance", f"""
SELECT CAST(count(*) AS BIGINT) AS retrieved,
  CAST(sum(CASE WHEN {_ORDER_CASE} = 'included' THEN 1 ELSE 0 END) AS BIGINT) AS included,
  CAST(sum(CASE WHEN {_ORDER_CASE} <> 'included' THEN 1 ELSE 0 END) AS BIGINT) AS excluded,
  true AS balanced FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    return L.is_balanced(L.exclusion_ledger(o, _order_rules()), o)


@query("latest_snapshot", """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders
WHERE o_orderstatus = 'F' GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderstatus", "o_orderpriority").withColumn(
        "flag", F.when(F.col("o_orderstatus") == "F", "True").otherwise("false"))
    return L.latest_snapshot(o, "flag", "o_orderstatus").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query("source_observation_ledger", """
WITH t AS (SELECT CASE WHEN o_orderstatus <> 'F' THEN 'superseded_snapshot'
  WHEN o_orderpriority = '5-LOW' THEN 'not_target' WHEN o_custkey % 17 = 0 THEN 'unresolvable'
  WHEN o_orderpriority = '1-URGENT' THEN 'hybrid' ELSE 'included' END AS reason, c_nationkey AS area
  FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT area, CAST(sum(CASE WHEN reason = 'included' THEN 1 ELSE 0 END) AS BIGINT) AS included,
  CAST(sum(CASE WHEN reason = 'hybrid' THEN 1 ELSE 0 END) AS BIGINT) AS hybrid,
  CAST(sum(CASE WHEN reason NOT IN ('included', 'hybrid') THEN 1 ELSE 0 END) AS BIGINT) AS other
FROM t GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    rules = [L.Rule("superseded_snapshot", "not latest", F.col("o_orderstatus") != "F"),
             L.Rule("not_target", "other drivetrain", F.col("o_orderpriority") == "5-LOW"),
             L.Rule("unresolvable", "no geography", F.col("o_custkey") % 17 == 0),
             L.Rule("hybrid", "plug-in hybrid", F.col("o_orderpriority") == "1-URGENT")]
    r = L.disposition(rules)
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    tagged = rows.select(F.col("c_nationkey").alias("area"), r.alias("reason"))
    return tagged.groupBy("area").agg(
        n(F.col("reason") == "included").alias("included"),
        n(F.col("reason") == "hybrid").alias("hybrid"),
        n(~F.col("reason").isin("included", "hybrid")).alias("other"))


@query("geography_resolution", """
WITH t AS (SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN 'unknown_jurisdiction'
  WHEN c_mktsegment = 'FURNITURE' THEN 'out_of_jurisdiction'
  WHEN c_nationkey < 20 THEN 'placed' ELSE 'unresolved' END AS k FROM customer)
SELECT CAST(count(*) AS BIGINT) AS retrieved,
  CAST(sum(CASE WHEN k = 'placed' THEN 1 ELSE 0 END) AS BIGINT) AS placed,
  CAST(sum(CASE WHEN k = 'unresolved' THEN 1 ELSE 0 END) AS BIGINT) AS unresolved,
  CAST(sum(CASE WHEN k = 'out_of_jurisdiction' THEN 1 ELSE 0 END) AS BIGINT) AS out_of_jurisdiction,
  CAST(sum(CASE WHEN k = 'unknown_jurisdiction' THEN 1 ELSE 0 END) AS BIGINT) AS unknown_jurisdiction,
  sum(CASE WHEN k IN ('unresolved', 'unknown_jurisdiction') THEN 1 ELSE 0 END) = 0 AS licenses_zero
FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        F.col("c_nationkey").alias("area"),
        F.when(F.col("c_mktsegment") == "MACHINERY", " ").when(
            F.col("c_mktsegment") == "FURNITURE", "XX").otherwise("WA").alias("state"))
    valid = read_table(spark, d, "nation", "n_nationkey").where("n_nationkey < 20").select(
        F.col("n_nationkey").alias("area"))
    return L.geography_resolution(c, "area", "state", "WA", valid)


@query("station_reject_reasons", """
SELECT CASE WHEN l_orderkey % 6 = 0 THEN 'no_date' WHEN l_orderkey % 6 = 1 THEN 'bad_date'
  WHEN l_partkey % 5 = 0 THEN 'no_coordinates' ELSE 'included' END AS reason,
  CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") % 6
    rows = read_table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_shipdate").select(
        F.when(k == 0, "").when(k == 1, "2020-13-01").otherwise(
            F.date_format("l_shipdate", "yyyy-MM-dd")).alias("opened"),
        F.when(F.col("l_partkey") % 5 != 0, "33.1").alias("lat"))
    rules = [L.Rule("no_date", "no open date", F.trim("opened") == ""),
             L.Rule("bad_date", "unparseable", F.try_to_date("opened", "yyyy-MM-dd").isNull()),
             L.Rule("no_coordinates", "no position", F.col("lat").try_cast("double").isNull())]
    return L.exclusion_ledger(rows, rules).select("reason", "n")


@query("event_window", """
SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-06-01' AND o_orderdate < TIMESTAMP '1999-06-01' GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders", "o_custkey", "o_orderdate").where(
        W.event_window("o_orderdate", "1997-06-01", 24)).groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"))


@query("duplicate_exact_rows", """
WITH li AS (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 10 = 0),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn,
  count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM li)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(copies AS BIGINT) AS copies,
       rn > 1 AS is_repeat FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                      "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = rows.unionByName(rows.where("l_orderkey % 10 = 0"))  # identical rows
    return L.flag_duplicates(rows, ["l_orderkey", "l_linenumber"],
                             ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copies", "is_repeat")


@query("valid_pair_rules", """
SELECT CASE WHEN c_custkey % 9 = 0 THEN 'unusable_zip' WHEN c_nationkey % 5 = 4
  THEN 'outside_state' ELSE 'included' END AS reason, CAST(count(*) AS BIGINT) AS n
FROM customer GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        F.when(F.col("c_custkey") % 9 == 0, "99").otherwise("98101-1234").alias("zip"),
        F.concat((F.col("c_nationkey") % 5).cast("string"), F.lit("0001")).alias("tract"))
    rules = [L.Rule("unusable_zip", "no five digits", C.normalise_zip("zip").isNull()),
             L.Rule("outside_state", "not in the jurisdiction", F.col("tract").startswith("4"))]
    return L.exclusion_ledger(c, rules).select("reason", "n")
