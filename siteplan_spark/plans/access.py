"""Queries over distances: nearest joins, gaps, clusters, the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.functions import geo as G
from siteplan_spark.functions.clean import publish_round
from siteplan_spark.operators import access as A
from siteplan_spark.operators import ranking as W
from siteplan_spark.operators import spatial as SP
from siteplan_spark.plans.registry import query
from siteplan_spark.sources.readers import decode_polylines
from siteplan_spark.sources.sinks import encode_polylines
from siteplan_spark.sources.tables import (
    HAVERSINE_KM_SQL, POINTS_SQL, SITES_SQL, population_points, read_table, sites)

LEVEL = 8  # grid level of the stand-in cells

_NEAREST = f"""{POINTS_SQL}, {SITES_SQL},
pairs AS (SELECT p.point_id, s.site_id, {HAVERSINE_KM_SQL} AS km FROM points p CROSS JOIN sites s),
near AS (SELECT point_id, min(km) AS km, arg_min(site_id, (km, site_id)) AS nearest_id
         FROM pairs GROUP BY 1),
dist AS (SELECT points.*, near.km, near.nearest_id, (point_id % 8) / 8.0e0 AS low
         FROM points JOIN near USING (point_id))"""


def cell_sql(lat: str, lon: str, level: int = LEVEL) -> str:
    n = 1 << level
    return (f"({level << 56} + (CAST(least({n - 1}, floor(({lon} + 180.0e0) / 360.0e0 * {n})) AS BIGINT) << 28)"
            f" + CAST(least({n - 1}, floor((sin(radians({lat})) + 1.0e0) / 2.0e0 * {n})) AS BIGINT))")


def parent_sql(cell: str, level: int, up: int) -> str:
    d = level - up
    return (f"({up << 56} + ((({cell} >> 28) & 268435455) >> {d} << 28)"
            f" + (({cell} & 268435455) >> {d}))")


def distances(spark: SparkSession, d: str) -> DataFrame:
    near = SP.nearest_join(population_points(spark, d), sites(spark, d), "site_id")
    return near.withColumns({"km": F.col("distance_m") / 1000.0,
                             "low": (F.col("point_id") % 8) / 8.0})


@query("nearest_join", f"""
WITH {_NEAREST}
SELECT point_id, area, nearest_id, round(km, 6) AS km FROM dist""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return distances(spark, d).select("point_id", "area", "nearest_id",
                                      F.round("km", 6).alias("km"))


@query("access_gap_curve", f"""
WITH {_NEAREST}, t(threshold) AS (SELECT 50.0e0 + i * 25.0e0 FROM range(0, 15) x(i))
SELECT region, threshold, CAST(sum(CASE WHEN km > threshold THEN weight ELSE 0 END) AS BIGINT)
       AS population_beyond, CAST(sum(CASE WHEN km > threshold THEN 1 ELSE 0 END) AS BIGINT)
       AS points_beyond FROM dist, t GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.sensitivity_curve(distances(spark, d), "km", "weight", 50.0, 400.0, 25.0,
                               ["region"])


@query("access_gap", f"""
WITH {_NEAREST}, r AS (SELECT region, km, row_number() OVER (PARTITION BY region ORDER BY km) - 1 AS i,
                       count(*) OVER (PARTITION BY region) AS n FROM dist),
m AS (SELECT region, km FROM r WHERE i = n // 2)
SELECT d.region, CAST(sum(weight) AS BIGINT) AS population_total,
  CAST(sum(CASE WHEN d.km > 100.5e0 THEN weight ELSE 0 END) AS BIGINT) AS population_in_gap,
  CAST(count(*) AS BIGINT) AS points_total,
  CAST(sum(CASE WHEN d.km > 100.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS points_in_gap,
  round(sum(CASE WHEN d.km > 100.5e0 THEN weight ELSE 0 END) / CAST(sum(weight) AS DOUBLE), 6) AS share_in_gap,
  round(any_value(m.km), 6) AS median_distance
FROM dist d JOIN m ON m.region = d.region GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(A.access_gap(distances(spark, d), "km", "weight", 100.5, ["region"]),
                         {"share_in_gap": 6, "median_distance": 6})


@query("gap_at_threshold_scoped", f"""
WITH {_NEAREST}
SELECT CAST(sum(CASE WHEN km > 150.5e0 THEN weight ELSE 0 END) AS BIGINT) AS population,
  CAST(sum(CASE WHEN km > 150.5e0 THEN 1 ELSE 0 END) AS BIGINT) AS points,
  round(sum(CASE WHEN km > 150.5e0 THEN weight * low ELSE 0 END), 4) AS equity_population,
  round(sum(CASE WHEN km > 150.5e0 THEN weight ELSE 0 END) / CAST(sum(weight) AS DOUBLE), 6) AS share
FROM dist WHERE region = 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = A.gap_at_threshold(distances(spark, d), "km", "weight", "low", 150.5,
                           F.col("region") == 2)
    return publish_round(g, {"equity_population": 4, "share": 6})


_GAP_CELLS = f"""{_NEAREST},
gc AS (SELECT {cell_sql('lat', 'lon')} AS cell, CAST(sum(weight) AS BIGINT) AS population,
  sum(weight * low) AS equity, count(*) AS points, sum(km * weight) / sum(weight) AS km
  FROM dist WHERE km > 100.5e0 GROUP BY 1)"""


def _gap_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = G.with_cell(distances(spark, d), "lat", "lon", LEVEL)
    return A.gap_cells(rows, "cell", "km", "weight", "low", 100.5)


@query("gap_cells", f"""
WITH {_GAP_CELLS}
SELECT cell, population, round(equity, 4) AS equity, CAST(points AS BIGINT) AS points,
       round(km, 5) AS km FROM gc""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(_gap_cells(spark, d), {"equity": 4, "km": 5})


@query("gap_cells_rolled_up", f"""
WITH {_GAP_CELLS}
SELECT {parent_sql('cell', LEVEL, LEVEL - 2)} AS cell, CAST(sum(population) AS BIGINT) AS population,
  round(sum(equity), 4) AS equity, CAST(sum(points) AS BIGINT) AS points,
  round(sum(km * population) / sum(population), 5) AS km FROM gc GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    parent = G.cell_parent("cell", LEVEL, LEVEL - 2)
    return publish_round(A.rollup_gap_cells(_gap_cells(spark, d), parent),
                         {"equity": 4, "km": 5})


@query("focus_and_context", f"""
WITH {_GAP_CELLS}, top AS (SELECT cell FROM gc ORDER BY population DESC, cell LIMIT 100),
t AS (SELECT gc.*, CASE WHEN top.cell IS NULL THEN 'context' ELSE 'focus' END AS side
      FROM gc LEFT JOIN top USING (cell))
SELECT side, {parent_sql('cell', LEVEL, LEVEL - 2)} AS parent,
  CAST(sum(population) AS BIGINT) AS population, CAST(sum(points) AS BIGINT) AS points,
  round(sum(km * population) / sum(population), 5) AS km FROM t GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    _, rolled = A.focus_and_context(_gap_cells(spark, d), "population", "cell", 100,
                                    G.cell_parent("cell", LEVEL, LEVEL - 2))
    return publish_round(rolled, {"km": 5})


@query("focus_summary", f"""
WITH {_GAP_CELLS}, top AS (SELECT cell, population FROM gc ORDER BY population DESC, cell LIMIT 100)
SELECT CAST((SELECT min(population) FROM top) AS BIGINT) AS cutoff,
       CAST((SELECT count(*) FROM top) AS BIGINT) AS focus_cells,
       round((SELECT sum(population) FROM top) / CAST((SELECT sum(population) FROM gc) AS DOUBLE), 6)
         AS population_share""")
def _(spark: SparkSession, d: str) -> DataFrame:
    summary, _ = A.focus_and_context(_gap_cells(spark, d), "population", "cell", 100,
                                     G.cell_parent("cell", LEVEL, LEVEL - 2))
    return publish_round(summary, {"population_share": 6})


@query("top_gap_regions", f"""
WITH {_NEAREST}
SELECT area, CAST(sum(weight) AS BIGINT) AS weight FROM dist WHERE km > 100.5e0 GROUP BY 1
ORDER BY weight DESC, area LIMIT 6""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.top_groups(distances(spark, d).where("km > 100.5"), "area", "weight", 6)


@query("attach_access_two_levels", f"""
WITH {POINTS_SQL}, {SITES_SQL},
pairs AS (SELECT p.point_id, s.site_id, s.balance, {HAVERSINE_KM_SQL} AS km
          FROM points p CROSS JOIN sites s)
SELECT point_id, round(min(km), 6) AS km_any,
       round(min(CASE WHEN balance > 5000 THEN km END), 6) AS km_fast FROM pairs GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = population_points(spark, d).select("point_id", "lat", "lon")
    s = sites(spark, d)
    both = SP.nearest_join(p, s, "site_id", out="_any", id_out="_i")
    both = SP.nearest_join(both, s.where("balance > 5000"), "site_id", out="_fast", id_out="_j")
    return both.select("point_id", F.round(F.col("_any") / 1000.0, 6).alias("km_any"),
                       F.round(F.col("_fast") / 1000.0, 6).alias("km_fast"))


@query("distance_band_join", f"""
WITH {POINTS_SQL}, {SITES_SQL},
pairs AS (SELECT p.point_id, s.site_id, {HAVERSINE_KM_SQL} AS km FROM points p CROSS JOIN sites s)
SELECT point_id, site_id, round(km, 6) AS km FROM pairs WHERE km <= 120.5e0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = population_points(spark, d).select("point_id", "lat", "lon")
    s = sites(spark, d).select("site_id", "lat", "lon")
    near = SP.distance_band_join(p, s, 120_500.0)
    # half up like round(), without a decimal number for each pair
    return near.selectExpr("point_id", "site_id", "distance_m / 1000.0D * 1e6D AS v").selectExpr(
        "point_id", "site_id", "(rint(v) + IF(v - rint(v) = 0.5D, 1.0D, 0.0D)) / 1e6D AS km")


@query("haversine_pairs", f"""
WITH {POINTS_SQL}, {SITES_SQL}
SELECT p.point_id, s.site_id, round({HAVERSINE_KM_SQL}, 6) AS km
FROM points p JOIN sites s ON s.site_id = p.point_id % 50""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = population_points(spark, d).select("point_id", "lat", "lon")
    s = sites(spark, d).select("site_id", F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    return p.join(s, F.col("site_id") == F.col("point_id") % 50).select(
        "point_id", "site_id", F.round(G.haversine_km("lat", "lon", "slat", "slon"), 6)
        .alias("km"))


# --- polylines ------------------------------------------------------------------------------

_V = [(0.0, 0.0), (0.3, 0.2), (0.5, -0.1), (0.9, 0.4)]
_POLY = f"""{SITES_SQL},
v AS (SELECT site_id, i, lat + CASE i WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.3e0 WHEN 2 THEN 0.5e0 ELSE 0.9e0 END AS lat,
  lon + CASE i WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.2e0 WHEN 2 THEN -0.1e0 ELSE 0.4e0 END AS lon
  FROM sites, range(0, 4) t(i)),
seg AS (SELECT a.site_id, a.i AS segment, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
        FROM v a JOIN v b ON b.site_id = a.site_id AND b.i = a.i + 1)"""


def polylines(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).select("site_id", F.array(*[
        F.struct((F.col("lat") + a).alias("lat"), (F.col("lon") + o).alias("lon"))
        for a, o in _V]).alias("vertices"))


@query("polyline_segments", f"""
WITH {_POLY}
SELECT s.site_id, CAST(s.segment AS INTEGER) AS segment,
       round({HAVERSINE_KM_SQL.replace('s.lat', 's.lat2').replace('p.lat', 's.lat1').replace('s.lon', 's.lon2').replace('p.lon', 's.lon1')}, 6) AS km
FROM seg s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return SP.polyline_segments(polylines(spark, d), "site_id", "vertices").select(
        "site_id", "segment", F.round(F.col("length_m") / 1000.0, 6).alias("km"))


@query("wkb_polylines", f"""
WITH {_POLY}
SELECT site_id || '#0' AS feature, CAST(segment AS INTEGER) AS segment, round(lat1, 9) AS lat1, round(lon1, 9) AS lon1,
  round(lat2, 9) AS lat2, round(lon2, 9) AS lon2 FROM seg WHERE site_id % 3 < 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # written as binary geometries with a road class, read back without the local streets
    lines = encode_polylines(polylines(spark, d), "site_id", "vertices")
    k = F.col("feature").cast("bigint") % 3
    roads = lines.withColumn("road", F.when(k == 0, "S1100").when(k == 1, "S1200")
                             .otherwise("S1400"))
    feats, _counts = decode_polylines(roads, "feature", "geometry", "road")
    return publish_round(SP.polyline_segments(feats, "feature", "vertices").drop("length_m"),
                         {c: 9 for c in ("lat1", "lon1", "lat2", "lon2")})


_SEG_T = """least(1.0e0, greatest(0.0e0, ((p.lon - g.lon1) * cos(radians(p.lat)) * (g.lon2 - g.lon1) * cos(radians(p.lat))
  + (p.lat - g.lat1) * (g.lat2 - g.lat1)) / (pow((g.lon2 - g.lon1) * cos(radians(p.lat)), 2) + pow(g.lat2 - g.lat1, 2))))"""
_SEG_NEAR = f"""{POINTS_SQL}, {_POLY},
f AS (SELECT p.point_id, p.weight, p.lat, p.lon, g.lat1 + {_SEG_T} * (g.lat2 - g.lat1) AS slat,
      g.lon1 + {_SEG_T} * (g.lon2 - g.lon1) AS slon, g.lat1, g.lon1, g.lat2, g.lon2
      FROM points p CROSS JOIN seg g),
n AS (SELECT point_id, any_value(weight) AS weight,
  min({HAVERSINE_KM_SQL.replace('s.lat', 'slat').replace('s.lon', 'slon').replace('p.lat', 'lat').replace('p.lon', 'lon')}) AS km,
  min(least({HAVERSINE_KM_SQL.replace('s.lat', 'lat1').replace('s.lon', 'lon1').replace('p.lat', 'lat').replace('p.lon', 'lon')},
            {HAVERSINE_KM_SQL.replace('s.lat', 'lat2').replace('s.lon', 'lon2').replace('p.lat', 'lat').replace('p.lon', 'lon')})) AS vkm
  FROM f GROUP BY 1)"""


def road_distances(spark: SparkSession, d: str) -> DataFrame:
    segs = SP.polyline_segments(polylines(spark, d), "site_id", "vertices").withColumn(
        "segment_id", F.col("site_id") * 10 + F.col("segment"))
    near = SP.nearest_segment_join(population_points(spark, d), segs, "segment_id")
    return near.withColumn("km", F.col("distance_m") / 1000.0)


@query("nearest_segment_join", f"""
WITH {_SEG_NEAR} SELECT point_id, round(km, 6) AS km FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return road_distances(spark, d).select("point_id", F.round("km", 6).alias("km"))


@query("road_proximity_sweep", f"""
WITH {_SEG_NEAR}, t(threshold) AS (SELECT 20.0e0 + i * 20.0e0 FROM range(0, 6) x(i))
SELECT threshold, CAST(sum(CASE WHEN km > threshold THEN weight ELSE 0 END) AS BIGINT) AS population_beyond,
       CAST(sum(CASE WHEN km > threshold THEN 1 ELSE 0 END) AS BIGINT) AS points_beyond
FROM n, t GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.sensitivity_curve(road_distances(spark, d), "km", "weight", 20.0, 120.0, 20.0)


_ROAD_CELLS = _SEG_NEAR.replace("f AS (SELECT", f"""oc AS (SELECT DISTINCT {cell_sql('lat', 'lon')} AS cell FROM points),
cp AS (SELECT cell AS point_id, 1 AS weight, ((cell >> 28 & 268435455) + 0.5e0) / 256 * 360 - 180 AS lon,
  degrees(asin(((cell & 268435455) + 0.5e0) / 256 * 2 - 1)) AS lat FROM oc),
f AS (SELECT""", 1).replace("FROM points p CROSS JOIN seg g", "FROM cp p CROSS JOIN seg g")


def cell_roads(spark: SparkSession, d: str) -> DataFrame:
    segs = SP.polyline_segments(polylines(spark, d), "site_id", "vertices").withColumn(
        "segment_id", F.col("site_id") * 10 + F.col("segment"))
    cells = G.with_cell(population_points(spark, d), "lat", "lon", LEVEL)
    return SP.road_proximity(cells, segs, "segment_id", LEVEL, 40.0)


@query("road_proximity", f"""
WITH {_ROAD_CELLS} SELECT point_id AS cell, round(km, 6) AS distance_km, km <= 40.0e0 AS within_road FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(cell_roads(spark, d), {"distance_km": 6})


@query("road_sensitivity", f"""
WITH {_ROAD_CELLS}, t(threshold_km) AS (VALUES (10.0e0), (20.0e0), (40.0e0), (80.0e0), (160.0e0), (320.0e0))
SELECT threshold_km, CAST(sum(CASE WHEN km <= threshold_km THEN 1 ELSE 0 END) AS BIGINT) AS cells FROM n, t GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return SP.road_sensitivity(cell_roads(spark, d), (10.0, 20.0, 40.0, 80.0, 160.0, 320.0))


@query("compare_distance_methods", f"""
WITH {_SEG_NEAR}
SELECT round(avg(vkm - km), 6) AS mean_error, round(median(vkm - km), 6) AS median_error,
       round(quantile_cont(vkm - km, 0.99), 6) AS p99_error, round(max(vkm - km), 6) AS max_error,
       CAST(sum(CASE WHEN (vkm <= 60.5e0) <> (km <= 60.5e0) THEN 1 ELSE 0 END) AS BIGINT) AS flips,
       round(CAST(sum(CASE WHEN vkm <= 60.5e0 AND km <= 60.5e0 THEN 1 ELSE 0 END) AS DOUBLE)
         / sum(CASE WHEN vkm <= 60.5e0 OR km <= 60.5e0 THEN 1 ELSE 0 END), 6) AS selection_jaccard
FROM n""")
def _(spark: SparkSession, d: str) -> DataFrame:
    verts = polylines(spark, d).select("site_id", F.posexplode("vertices").alias("i", "v")).select(
        (F.col("site_id") * 10 + F.col("i")).alias("vertex"), "v.lat", "v.lon")
    both = SP.nearest_join(road_distances(spark, d).select("point_id", "lat", "lon", "km"),
                           verts, "vertex", out="_v", id_out="_vid")
    rows = both.select("point_id", "km", (F.col("_v") / 1000.0).alias("vkm"))
    return publish_round(SP.compare_distance_methods(rows, "vkm", "km", 60.5), {
        "mean_error": 6, "median_error": 6, "p99_error": 6, "max_error": 6,
        "selection_jaccard": 6})


# --- clustering -----------------------------------------------------------------------------

_EPS_KM = 40.0
_CLUSTERS = f"""{POINTS_SQL},
e AS (SELECT p.point_id AS a, s.point_id AS b FROM points p JOIN points s
      ON abs(p.lat - s.lat) < 0.5e0 AND p.point_id <> s.point_id AND {HAVERSINE_KM_SQL} <= {_EPS_KM}e0),
reach(a, b) AS (SELECT point_id, point_id FROM points UNION
                SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
lab AS (SELECT a AS id, min(b) AS cluster FROM reach GROUP BY 1)"""


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return SP.cluster_points(population_points(spark, d), "point_id", eps_m=_EPS_KM * 1000.0)


@query("cluster_points", f"""
WITH RECURSIVE {_CLUSTERS}
SELECT id, cluster FROM lab""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d).select("id", "cluster")


def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    members = clusters(spark, d).select(F.col("id").alias("point_id"), "cluster").join(
        population_points(spark, d), "point_id")
    return SP.cluster_diagnostics(members, "cluster", "lat", "lon", "segment")


@query("diameter_bands", f"""
WITH RECURSIVE {_CLUSTERS},
m AS (SELECT cluster, points.* FROM lab JOIN points ON point_id = id),
di AS (SELECT p.cluster, count(DISTINCT p.point_id) AS size, max({HAVERSINE_KM_SQL}) * 1000 AS m FROM m p JOIN m s ON s.cluster = p.cluster GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS clusters, CAST(sum(CASE WHEN size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS singletons, CAST(max(size) AS BIGINT) AS max_size,
  CAST(sum(CASE WHEN size > 1 AND m > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS wider_than_5000, CAST(sum(CASE WHEN size > 1 AND m > 20000 THEN 1 ELSE 0 END) AS BIGINT) AS wider_than_20000,
  CAST(sum(CASE WHEN size > 1 AND m > 10000 THEN 1 ELSE 0 END) AS BIGINT) AS suspicious FROM di""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return SP.diameter_bands(diagnostics(spark, d), (5_000.0, 20_000.0), 10_000.0)


@query("suspicious_clusters", f"""
WITH RECURSIVE {_CLUSTERS},
m AS (SELECT cluster, points.* FROM lab JOIN points ON point_id = id),
di AS (SELECT p.cluster, count(DISTINCT p.point_id) AS size, max({HAVERSINE_KM_SQL}) AS km FROM m p JOIN m s ON s.cluster = p.cluster GROUP BY 1)
SELECT cluster, CAST(size AS BIGINT) AS size, round(km * 1000, 3) AS diameter_m FROM di WHERE size > 1 AND km > 10
ORDER BY round(km * 1000, 3) DESC, cluster LIMIT 25""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rounded = diagnostics(spark, d).withColumn("diameter_m", F.round("diameter_m", 3))
    return SP.suspicious_clusters(rounded, "cluster", 25, 10_000.0).select(
        "cluster", "size", "diameter_m")


@query("cluster_centroids", f"""
WITH RECURSIVE {_CLUSTERS}
SELECT cluster, CAST(count(*) AS BIGINT) AS cluster_size, round(avg(lat), 6) AS lat,
       round(avg(lon), 6) AS lon FROM lab JOIN points ON point_id = id GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clusters(spark, d).groupBy("cluster").agg(
        F.max("cluster_size").alias("cluster_size"), F.round(F.max("cluster_lat"), 6).alias("lat"),
        F.round(F.max("cluster_lon"), 6).alias("lon"))


@query("cluster_diagnostics", f"""
WITH RECURSIVE {_CLUSTERS},
m AS (SELECT cluster, points.* FROM lab JOIN points ON point_id = id),
sz AS (SELECT cluster, count(*) AS size, count(DISTINCT segment) AS networks FROM m GROUP BY 1),
di AS (SELECT p.cluster, max({HAVERSINE_KM_SQL}) AS km FROM m p JOIN m s ON s.cluster = p.cluster GROUP BY 1)
SELECT cluster, CAST(size AS BIGINT) AS size, CAST(networks AS BIGINT) AS networks,
       round(km * 1000, 3) AS diameter_m FROM sz JOIN di USING (cluster)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics(spark, d).withColumn("diameter_m", F.round("diameter_m", 3))


# --- grid -----------------------------------------------------------------------------------

@query("grid_cells", f"""
WITH {POINTS_SQL}, c AS (SELECT *, {cell_sql('lat', 'lon')} AS cell FROM points)
SELECT point_id, cell, {parent_sql('cell', LEVEL, LEVEL - 3)} AS parent,
  round(((cell >> 28) & 268435455) / 256.0e0 * 360 - 180 + 0.5e0 / 256 * 360, 6) AS cell_lon,
  round(degrees(asin(((cell & 268435455) + 0.5e0) / 256 * 2 - 1)), 6) AS cell_lat FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = G.with_cell(population_points(spark, d), "lat", "lon", LEVEL)
    return p.select("point_id", "cell", G.cell_parent("cell", LEVEL, LEVEL - 3).alias("parent"),
                    F.round(G.cell_lon("cell", LEVEL), 6).alias("cell_lon"),
                    F.round(G.cell_lat("cell", LEVEL), 6).alias("cell_lat"))


@query("k_ring_join", f"""
WITH {POINTS_SQL}, c AS (SELECT DISTINCT {cell_sql('lat', 'lon')} AS cell FROM points),
o AS (SELECT x, y FROM range(-1, 2) a(x), range(-1, 2) b(y)),
r AS (SELECT cell, cell + (x << 28) * 1 + y AS covered FROM c, (SELECT x, y FROM o) q)
SELECT r.cell AS candidate, CAST(count(*) AS BIGINT) AS covered
FROM (SELECT cell, cell + x * 268435456 + y AS covered FROM c, o) r
WHERE r.covered IN (SELECT cell FROM c) GROUP BY 1""".replace(
    "r AS (SELECT cell, cell + (x << 28) * 1 + y AS covered FROM c, (SELECT x, y FROM o) q)",
    "z AS (SELECT 1)"))
def _(spark: SparkSession, d: str) -> DataFrame:
    from siteplan_spark.operators.siting import coverage_edges
    cells = G.with_cell(population_points(spark, d), "lat", "lon", LEVEL).select(
        "cell").distinct()
    return coverage_edges(cells, LEVEL).groupBy("candidate").agg(
        F.count(F.lit(1)).alias("covered"))


@query("bounding_box", f"""
WITH {POINTS_SQL}
SELECT region, round(min(lat) - 0.5e0, 4) AS south, round(max(lat) + 0.5e0, 4) AS north,
       round(min(lon) - 0.5e0, 4) AS west, round(max(lon) + 0.5e0, 4) AS east
FROM points GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = A.bbox(population_points(spark, d), "lat", "lon", 0.5, ["region"])
    return b.select("region", *[F.round(c, 4).alias(c) for c in
                                               ("south", "north", "west", "east")])


@query("supply_by_cell", f"""
WITH {SITES_SQL}, u AS (SELECT l_suppkey AS site_id, count(*) AS ports FROM lineitem
  WHERE l_returnflag <> 'R' AND l_linestatus = 'O' GROUP BY 1)
SELECT {cell_sql('lat', 'lon')} AS cell, CAST(count(DISTINCT site_id) AS BIGINT) AS stations,
       CAST(sum(ports) AS BIGINT) AS ports FROM sites JOIN u USING (site_id) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = read_table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus").where(
        "l_returnflag <> 'R' AND l_linestatus = 'O'").groupBy(
        F.col("l_suppkey").alias("site_id")).agg(F.count(F.lit(1)).alias("ports"))
    return G.with_cell(sites(spark, d), "lat", "lon", LEVEL).join(u, "site_id").groupBy(
        "cell").agg(F.count(F.lit(1)).alias("stations"), F.sum("ports").alias("ports"))


@query("rollup_to_parent", f"""
WITH {POINTS_SQL},
c AS (SELECT {cell_sql('lat', 'lon')} AS cell, CAST(area AS VARCHAR) AS county, segment AS tier,
      weight AS demand, weight * 3 AS population, CAST(point_id % 40 AS DOUBLE) AS km,
      CAST(point_id % 10 AS DOUBLE) / 10 AS anchored FROM points),
p AS (SELECT *, {parent_sql('cell', LEVEL, LEVEL - 2)} AS parent FROM c),
l AS (SELECT parent, county, sum(demand) AS w FROM p GROUP BY 1, 2),
b AS (SELECT parent, arg_min(county, (-w, county)) AS county, count(*) AS labels FROM l GROUP BY 1)
SELECT p.parent, CAST(sum(demand) AS BIGINT) AS demand, CAST(sum(population) AS BIGINT) AS population,
  round(sum(km * population) / sum(population), 5) AS km,
  round(sum(anchored * demand) / sum(demand), 5) AS anchored, CAST(count(*) AS BIGINT) AS children,
  CASE WHEN min(tier) = max(tier) THEN min(tier) END AS tier, any_value(b.county) AS county,
  CAST(any_value(b.labels) AS BIGINT) AS labels
FROM p JOIN b USING (parent) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = G.with_cell(population_points(spark, d), "lat", "lon", LEVEL).select(
        G.cell_parent("cell", LEVEL, LEVEL - 2).alias("parent"),
        F.col("area").cast("string").alias("county"), F.col("segment").alias("tier"),
        F.col("weight").alias("demand"), (F.col("weight") * 3).alias("population"),
        (F.col("point_id") % 40).cast("double").alias("km"),
        ((F.col("point_id") % 10) / 10.0).alias("anchored"))
    out = A.rollup_to_parent(c, "parent", ["demand", "population"],
                             {"km": "population", "anchored": "demand"},
                             ("county", "demand"), "tier")
    return publish_round(out, {"km": 5, "anchored": 5})


@query("distinct_area_count", f"""
WITH {POINTS_SQL}
SELECT CAST(count(DISTINCT {cell_sql('lat', 'lon')}) AS BIGINT) AS places,
       CAST(count(*) AS BIGINT) AS rows FROM points""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.with_cell(population_points(spark, d), "lat", "lon", LEVEL).agg(
        F.countDistinct("cell").alias("places"), F.count(F.lit(1)).alias("rows"))


@query("distinct_pairs_sorted", """
SELECT DISTINCT n_regionkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_nationkey").distinct()
    n = read_table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_regionkey", "n_name").orderBy("n_name", "n_regionkey")


@query("label_leaders", """
SELECT c_mktsegment, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1
ORDER BY 2 DESC, 1 LIMIT 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return A.label_leaders(read_table(spark, d, "customer", "c_mktsegment", "c_acctbal"),
                           "c_mktsegment", "c_acctbal", 3)


@query("percentile_reasons", f"""
WITH {POINTS_SQL},
a AS (SELECT area, sum(weight) AS demand, count(*) AS n, sum(point_id % 3) AS eq FROM points GROUP BY 1),
x AS (SELECT area, demand, n % 3 AS ports, CAST(n % 30 AS DOUBLE) AS km, eq,
      CASE WHEN area % 4 = 0 THEN 'A' ELSE 'B' END AS tier FROM a),
r AS (SELECT *, (rank() OVER (ORDER BY demand) - 1) / CAST(count(*) OVER () AS DOUBLE) AS dp,
      (rank() OVER (ORDER BY km) - 1) / CAST(count(*) OVER () AS DOUBLE) AS kp,
      (rank() OVER (ORDER BY eq) - 1) / CAST(count(*) OVER () AS DOUBLE) AS ep FROM x),
w AS (SELECT area, 0 AS i, dp AS w, CASE WHEN dp >= 0.9e0 THEN 'Among the highest estimated EV demand in the state'
        ELSE 'Above-average estimated EV demand' END AS t FROM r WHERE dp >= 0.6e0
  UNION ALL SELECT area, 1, 0.55e0, 'No public fast charging here today' FROM r WHERE ports = 0
  UNION ALL SELECT area, 2, 0.72e0, 'Existing fast charging is thin for the demand' FROM r
    WHERE ports <> 0 AND demand / nullif(ports, 0) > 500
  UNION ALL SELECT area, 3, kp, 'Nearest fast charging is ' || CAST(CAST(km AS INTEGER) AS VARCHAR) || ' km away' FROM r WHERE kp >= 0.7e0
  UNION ALL SELECT area, 4, ep, CASE WHEN ep >= 0.9e0 THEN 'Reaches one of the largest underserved populations here'
        ELSE 'Reaches an above-average underserved population' END FROM r WHERE ep >= 0.6e0
  UNION ALL SELECT area, 5, 0.4e0, 'Local registration data supports the estimate' FROM r WHERE tier = 'A')
SELECT r.area, round(any_value(dp), 6) AS demand_percentile,
  coalesce(arg_min(t, (-w, i)), 'Meets the screening criteria') AS headline,
  coalesce(string_agg(t, '; ' ORDER BY -w, i), '') AS reasons
FROM r LEFT JOIN w ON w.area = r.area GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = population_points(spark, d).groupBy("area").agg(
        F.sum("weight").alias("demand"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("point_id") % 3).alias("eq"))
    x = a.select("area", "demand", (F.col("n") % 3).alias("ports"),
                 (F.col("n") % 30).cast("double").alias("km"), "eq",
                 F.when(F.col("area") % 4 == 0, "A").otherwise("B").alias("tier"))
    for value, name in (("demand", "dp"), ("km", "kp"), ("eq", "ep")):
        x = W.percentile_below(x, [], value, name)
    return W.ranked_reasons(x, "demand", "ports", "km", "eq", "tier", ("dp", "kp", "ep")).select(
        "area", F.round("dp", 6).alias("demand_percentile"), "headline",
        F.concat_ws("; ", "reasons").alias("reasons"))
