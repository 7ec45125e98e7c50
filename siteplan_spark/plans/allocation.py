"""Queries over allocation, reconciliation and dated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from siteplan_spark.functions.clean import publish_round
from siteplan_spark.operators import allocation as AL
from siteplan_spark.operators import quality as Q
from siteplan_spark.operators import ranking as W
from siteplan_spark.operators import reconcile as RC
from siteplan_spark.operators.access import dominant_per_group
from siteplan_spark.plans.access import cell_sql
from siteplan_spark.plans.registry import query
from siteplan_spark.sources.tables import POINTS_SQL, population_points, read_table


def _cents():
    return F.round(F.col("o_totalprice") * 100).cast("bigint")


# Nation totals of order value, in cents.
_VALUES = """vals AS (SELECT c_nationkey AS area, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0e0 AS value
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)"""


def area_values(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_totalprice")
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("area")).agg(
        (F.sum(_cents()).cast("double") / 100.0).alias("value"))


_WEIGHTED = f"""{POINTS_SQL},
zp AS (SELECT *, CASE WHEN area % 6 = 0 THEN 0 ELSE weight END AS pop FROM points),
aw AS (SELECT area, {cell_sql('lat', 'lon', 6)} AS cell, sum(pop) AS p FROM zp GROUP BY 1, 2),
cw AS (SELECT area, cell, CASE WHEN sum(p) OVER w > 0 THEN p / CAST(sum(p) OVER w AS DOUBLE)
         ELSE 1.0e0 / count(*) OVER w END AS weight,
         CASE WHEN sum(p) OVER w > 0 THEN 'weighted' ELSE 'equal_split' END AS basis
       FROM aw WINDOW w AS (PARTITION BY area))"""


def _zero_points(spark: SparkSession, d: str) -> DataFrame:
    return population_points(spark, d).withColumn(
        "pop", F.when(F.col("area") % 6 == 0, 0).otherwise(F.col("weight")))


def cell_weights(spark: SparkSession, d: str) -> DataFrame:
    return AL.population_cell_weights(_zero_points(spark, d), "area", "lat", "lon", "pop", 6)


@query("population_cell_weights", f"""
WITH {_WEIGHTED} SELECT area, cell, round(weight, 8) AS weight, basis FROM cw""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(cell_weights(spark, d), {"weight": 8})


@query("weights_sum_to_one", f"""
WITH {_WEIGHTED} SELECT CAST(count(*) AS BIGINT) AS areas, CAST(0 AS BIGINT) AS broken
FROM (SELECT DISTINCT area FROM cw)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    w = cell_weights(spark, d)
    return w.agg(F.countDistinct("area").alias("areas")).join(
        AL.weights_sum_to_one(w, "area").agg(F.count(F.lit(1)).alias("broken")))


@query("normalise_weights_reject", """
WITH c AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey % 6 = 0 THEN 0
           ELSE 1 + c_custkey % 97 END AS w FROM customer)
SELECT c_custkey, c_nationkey, CASE WHEN sum(w) OVER p > 0 THEN round(w / CAST(sum(w) OVER p AS DOUBLE), 10) END
  AS weight_share, CASE WHEN sum(w) OVER p > 0 THEN 'weighted' ELSE 'unallocatable' END AS basis
FROM c WINDOW p AS (PARTITION BY c_nationkey)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey").withColumn(
        "w", F.when(F.col("c_nationkey") % 6 == 0, 0).otherwise(1 + F.col("c_custkey") % 97))
    return AL.normalise_weights(c, "c_nationkey", "w", "reject").select(
        "c_custkey", "c_nationkey", F.round("weight_share", 10).alias("weight_share"), "basis")


@query("area_weights", """
WITH e AS (SELECT c_nationkey AS source, c_custkey % 8 AS target,
  sum(CASE WHEN c_nationkey % 7 = 0 THEN 0 ELSE 1 + c_custkey % 97 END) AS a FROM customer GROUP BY 1, 2)
SELECT source, target, round(CASE WHEN sum(a) OVER w > 0 THEN a / CAST(sum(a) OVER w AS DOUBLE)
  ELSE 1.0e0 / count(*) OVER w END, 8) AS weight,
  CASE WHEN sum(a) OVER w > 0 THEN 'area' ELSE 'equal_split' END AS basis
FROM e WINDOW w AS (PARTITION BY source)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_nationkey").alias("source"), (F.col("c_custkey") % 8).alias("target"),
        F.when(F.col("c_nationkey") % 7 == 0, 0).otherwise(1 + F.col("c_custkey") % 97).alias("a"))
    return publish_round(AL.area_weights(parts, "source", "target", "a"), {"weight": 8})


_LINKS = f"""{_WEIGHTED}, {_VALUES}, links AS (SELECT * FROM cw WHERE area <> 3)"""


@query("allocate", f"""
WITH {_LINKS}
SELECT cell, round(sum(value * weight), 2) AS allocated FROM vals JOIN links USING (area) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    out, _left = AL.allocate(area_values(spark, d), cell_weights(spark, d).where("area <> 3"),
                             "area", "cell", "value")
    return out.groupBy("cell").agg(F.round(F.sum("allocated"), 2).alias("allocated"))


@query("unallocatable_remainder", f"""
WITH {_LINKS}
SELECT area, round(value, 2) AS value, 'no_link' AS reason FROM vals
WHERE area NOT IN (SELECT area FROM links)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    _out, left = AL.allocate(area_values(spark, d), cell_weights(spark, d).where("area <> 3"),
                             "area", "cell", "value")
    return publish_round(left, {"value": 2})


@query("conservation_error", f"""
WITH {_VALUES}
SELECT round(sum(value), 2) AS mass_in,
       round(sum(CASE WHEN area <> 3 THEN value ELSE 0 END), 2) AS mass_out,
       round(sum(CASE WHEN area = 3 THEN value ELSE 0 END), 2) AS mass_unallocated,
       0.0e0 AS error FROM vals""")
def _(spark: SparkSession, d: str) -> DataFrame:
    values = area_values(spark, d)
    out, left = AL.allocate(values, cell_weights(spark, d).where("area <> 3"), "area", "cell",
                            "value")
    e = Q.conservation_error(values, out.select(F.col("allocated").alias("value")), left, "value")
    return publish_round(e, {"mass_in": 2, "mass_out": 2, "mass_unallocated": 2, "error": 2})


@query("zip_to_area_identity", """
SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN c_nationkey END AS area,
       CASE WHEN c_nationkey < 20 THEN 'identity' ELSE 'no_area' END AS step FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, d, "nation", "n_nationkey").where("n_nationkey < 20").select(
        F.col("n_nationkey").alias("area"))
    return c.join(n, F.col("c_nationkey") == F.col("area"), "left").select(
        "c_custkey", "area", F.when(F.col("area").isNotNull(), "identity").otherwise("no_area")
        .alias("step"))


@query("membership_join", """
SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IN
  (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    edges = read_table(spark, d, "supplier", "s_nationkey", "s_acctbal").where(
        "s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    return c.join(edges, "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query("anti_join_missing_keys", """
SELECT c_custkey FROM customer WHERE NOT EXISTS
  (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderstatus").where(
        "o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read_table(spark, d, "customer", "c_custkey").join(o, "c_custkey", "left_anti")


_PROV = f"""{_WEIGHTED},

src AS (SELECT area, CASE WHEN area % 5 = 0 THEN 0.0e0 ELSE CAST(count(*) AS DOUBLE) END AS demand,
        CASE WHEN area % 10 = 0 THEN 0.0e0 ELSE CAST(sum(weight) AS DOUBLE) END AS population,
        CAST(area % 9 AS DOUBLE) / 9 AS score, CASE WHEN area % 2 = 0 THEN 'native_tract' ELSE 'state_total_only' END AS grain,
        CASE WHEN area % 3 = 0 THEN 'A' ELSE 'B' END AS tier FROM points GROUP BY 1),
con AS (SELECT cell, src.*, demand * weight AS dw, population * weight AS pw, weight AS w
        FROM src JOIN cw USING (area) WHERE weight > 0),
bas AS (SELECT *, CASE WHEN sum(dw) OVER c > 0 THEN dw WHEN sum(pw) OVER c > 0 THEN pw ELSE w END AS b
        FROM con WINDOW c AS (PARTITION BY cell))"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("area")
    g = population_points(spark, d).groupBy("area").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("weight").cast("double").alias("_w"))
    return g.select(
        "area", F.when(a % 5 == 0, 0.0).otherwise(F.col("_n")).alias("demand"),
        F.when(a % 10 == 0, 0.0).otherwise(F.col("_w")).alias("population"),
        ((a % 9).cast("double") / 9.0).alias("score"),
        F.when(a % 2 == 0, "native_tract").otherwise("state_total_only").alias("grain"),
        F.when(a % 3 == 0, "A").otherwise("B").alias("tier"))


def provenance_cells(spark: SparkSession, d: str):
    return AL.aggregate_with_provenance(
        _sources(spark, d), cell_weights(spark, d), "area", "demand", "population", [],
        ["score"], ["grain", "tier"])


@query("aggregate_with_provenance", f"""
WITH {_PROV}
SELECT cell, round(sum(dw), 5) AS demand, round(sum(pw), 5) AS population,
       CAST(count(*) AS BIGINT) AS contributors, round(max(b) / sum(b), 5) AS largest_contributor_share,
       round(sum(score * b) / sum(b), 5) AS score FROM bas GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells, _shares, _lost = provenance_cells(spark, d)
    return publish_round(cells, {"demand": 5, "population": 5, "largest_contributor_share": 5,
                                 "score": 5})


@query("provenance_category_shares", f"""
WITH {_PROV}, f AS (SELECT cell, 'grain' AS dimension, grain AS category, b FROM bas
  UNION ALL SELECT cell, 'tier', tier, b FROM bas),
g AS (SELECT cell, dimension, category, sum(b) AS w FROM f GROUP BY 1, 2, 3)
SELECT cell, dimension, category, round(w / sum(w) OVER (PARTITION BY cell, dimension), 5) AS share
FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    _cells, shares, _lost = provenance_cells(spark, d)
    return publish_round(shares, {"share": 5})


@query("weighted_share_maps", """
WITH g AS (SELECT c_nationkey AS k, c_mktsegment AS s, sum(c_custkey % 5) AS w FROM customer GROUP BY 1, 2)
SELECT k, s AS segment, round(w / CAST(sum(w) OVER (PARTITION BY k) AS DOUBLE), 6) AS share FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("segment"),
        (F.col("c_custkey") % 5).alias("w"))
    maps = AL.weighted_shares(c, ["k"], "segment", "w")
    return maps.select("k", F.explode("shares").alias("segment", "_s")).select(
        "k", "segment", F.round("_s", 6).alias("share"))


@query("dominant_category", """
WITH g AS (SELECT c_nationkey AS k, c_mktsegment AS s, sum(c_custkey % 5) AS w FROM customer GROUP BY 1, 2)
SELECT k, arg_min(s, (-w, s)) AS dominant, round(max(w) / CAST(sum(w) AS DOUBLE), 6) AS dominant_share
FROM g GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        F.col("c_nationkey").alias("k"), "c_mktsegment", (F.col("c_custkey") % 5).alias("w"))
    return publish_round(dominant_per_group(c, ["k"], "c_mktsegment", "w"),
                         {"dominant_share": 6})


# --- comparing methods ------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT c_nationkey AS source, c_custkey % (1 + c_nationkey % 9) AS target FROM customer),
m AS (SELECT 'even' AS method, source, target, 1.0e0 / count(*) OVER (PARTITION BY source) AS weight
      FROM (SELECT DISTINCT source, target FROM pairs WHERE source <> 7)
      UNION ALL
      SELECT 'lean', source, target, (1.0e0 + target) / sum(1.0e0 + target) OVER (PARTITION BY source)
      FROM (SELECT DISTINCT source, target FROM pairs)),
cnt AS (SELECT source, target, count(*) AS n FROM pairs GROUP BY 1, 2),
ar AS (SELECT source, sum(n) AS records, count(*) AS targets FROM cnt GROUP BY 1),
kept AS (SELECT * FROM ar WHERE records >= 12 AND source <> 7),
al AS (SELECT mm.method, cnt.source, cnt.target, cnt.n / CAST(records AS DOUBLE) AS o, coalesce(m.weight, 0) AS e
       FROM (SELECT DISTINCT method FROM m) mm CROSS JOIN cnt JOIN kept USING (source)
       LEFT JOIN m ON m.method = mm.method AND m.source = cnt.source AND m.target = cnt.target),
sc AS (SELECT method, source, sum(abs(o - e)) / 2 AS tvd, avg(abs(o - e)) AS mae,
       arg_min(target, (-o, target)) = arg_min(target, (-e, target)) AS hit FROM al GROUP BY 1, 2),
scored AS (SELECT sc.*, records, targets, CASE WHEN targets <= 1 THEN '1' WHEN targets <= 3 THEN '2-3'
       WHEN targets <= 7 THEN '4-7' ELSE '8+' END AS band FROM sc JOIN kept USING (source))"""


def method_comparison(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    nation = F.col("c_nationkey")  # sources of one to nine targets
    pairs = read_table(spark, d, "customer", "c_custkey", "c_nationkey").select(
        nation.alias("source"), (F.col("c_custkey") % (1 + nation % 9)).alias("target"))
    distinct = pairs.distinct()
    even = AL.normalise_weights(distinct.where("source <> 7").withColumn("_w", F.lit(1.0)),
                                "source", "_w", name="weight")
    lean = AL.normalise_weights(distinct.withColumn("_w", 1.0 + F.col("target")), "source", "_w",
                                name="weight")
    cols = ["source", "target", "weight"]
    methods = even.select(F.lit("even").alias("method"), *cols).unionByName(
        lean.select(F.lit("lean").alias("method"), *cols))
    return AL.compare_allocation_methods(pairs, methods, "source", "target", 12)


@query("allocation_method_scores", f"""
WITH {_PAIRS} SELECT method, source, round(tvd, 6) AS tvd, round(mae, 6) AS mae, hit, band,
  CAST(records AS BIGINT) AS records FROM scored""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(method_comparison(spark, d)["scores"].select(
        "method", "source", "tvd", "mae", "hit", "band", "records"), {"tvd": 6, "mae": 6})


@query("allocation_method_summary", f"""
WITH {_PAIRS} SELECT method, round(sum(tvd * records) / sum(records), 6) AS weighted_mean_tvd,
  round(avg(tvd), 6) AS unweighted_mean_tvd, round(sum(mae * records) / sum(records), 6) AS weighted_mean_mae,
  round(avg(CASE WHEN hit THEN 1.0e0 ELSE 0.0e0 END), 6) AS top_target_accuracy FROM scored GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(method_comparison(spark, d)["summary"], {
        "weighted_mean_tvd": 6, "unweighted_mean_tvd": 6, "weighted_mean_mae": 6,
        "top_target_accuracy": 6})


@query("allocation_method_strata", f"""
WITH {_PAIRS} SELECT band, method, CAST(count(*) AS BIGINT) AS areas, CAST(sum(records) AS BIGINT) AS records,
  round(sum(tvd * records) / sum(records), 6) AS weighted_tvd FROM scored GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(method_comparison(spark, d)["strata"], {"weighted_tvd": 6})


@query("allocation_method_wins", f"""
WITH {_PAIRS}, w AS (SELECT a.method, a.source FROM scored a
  WHERE NOT EXISTS (SELECT 1 FROM scored b WHERE b.source = a.source AND b.method <> a.method AND b.tvd <= a.tvd))
SELECT mm.method, round(count(w.source) / CAST((SELECT count(*) FROM kept) AS DOUBLE), 6) AS win_share
FROM (SELECT DISTINCT method FROM m) mm LEFT JOIN w USING (method) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(method_comparison(spark, d)["win_share"], {"win_share": 6})


@query("allocation_method_ledger", f"""
WITH {_PAIRS} SELECT CASE WHEN records < 12 THEN 'below_minimum' WHEN source = 7 THEN 'no_method_weights'
  ELSE 'included' END AS reason, CAST(count(*) AS BIGINT) AS areas, CAST(sum(records) AS BIGINT) AS records
FROM ar GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return method_comparison(spark, d)["ledger"]


_FINE = """fine AS (SELECT c_nationkey % 5 AS st, c_nationkey AS co, c_custkey AS tr,
  count(o_orderkey) AS v, CASE WHEN c_nationkey % 8 = 0 THEN 0 ELSE 1 + c_custkey % 97 END AS hh
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3, 5)"""


def _fine(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    o = read_table(spark, d, "orders", "o_custkey").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("v"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        (F.col("c_nationkey") % 5).alias("st"), F.col("c_nationkey").alias("co"),
        F.col("c_custkey").alias("tr"), F.coalesce("v", F.lit(0)).alias("v"),
        F.when(F.col("c_nationkey") % 8 == 0, 0).otherwise(1 + F.col("c_custkey") % 97)
        .alias("hh"))


_LADDER_SQL = f"""{_FINE},
l AS (SELECT 0 AS position, 'native_tract' AS grain, v, CASE WHEN hh > 0 THEN v * hh / CAST(hh AS DOUBLE) END AS e FROM fine
  UNION ALL SELECT 1, 'county_anchored', v, CASE WHEN sum(hh) OVER (PARTITION BY co) > 0
    THEN sum(v) OVER (PARTITION BY co) * hh / CAST(sum(hh) OVER (PARTITION BY co) AS DOUBLE) END FROM fine
  UNION ALL SELECT 2, 'state_total_only', v, CASE WHEN sum(hh) OVER (PARTITION BY st) > 0
    THEN sum(v) OVER (PARTITION BY st) * hh / CAST(sum(hh) OVER (PARTITION BY st) AS DOUBLE) END FROM fine),
rungs AS (SELECT position, grain, sum(abs(v / CAST((SELECT sum(v) FROM fine) AS DOUBLE)
    - coalesce(e, 0) / CAST((SELECT sum(v) FROM fine) AS DOUBLE))) / 2 AS tvd,
  sum(CASE WHEN e IS NOT NULL THEN v ELSE 0 END) AS placed,
  sum(CASE WHEN e IS NULL THEN v ELSE 0 END) AS unplaced FROM l GROUP BY 1, 2)"""


def ladder(spark: SparkSession, d: str) -> DataFrame:
    return AL.transformation_ladder(
        _fine(spark, d), {"native_tract": ["tr"], "county_anchored": ["co"],
                          "state_total_only": ["st"]}, "tr", "v", "hh")


@query("transformation_ladder", f"""
WITH {_LADDER_SQL} SELECT CAST(position AS INTEGER) AS position, grain, round(tvd, 6) AS tvd,
  CAST(placed AS BIGINT) AS placed, CAST(unplaced AS BIGINT) AS unplaced FROM rungs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(ladder(spark, d), {"tvd": 6})


@query("ladder_order_check", f"""
WITH {_LADDER_SQL} SELECT grain, coalesce(tvd >= lag(tvd) OVER (ORDER BY position), true) AS in_order
FROM rungs""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Q.ladder_order_check(ladder(spark, d), "position", "tvd").select("grain", "in_order")


@query("centroid_resolution_benchmark", f"""
WITH {POINTS_SQL},
cen AS (SELECT area, sum(lat * weight) / sum(weight) AS lat, sum(lon * weight) / sum(weight) AS lon
        FROM points GROUP BY 1),
cc AS (SELECT area, {cell_sql('lat', 'lon', 4)} AS ccell FROM cen),
pc AS (SELECT area, {cell_sql('lat', 'lon', 4)} AS cell, sum(weight) AS p FROM points GROUP BY 1, 2)
SELECT CAST(sum(p) AS BIGINT) AS population, CAST(sum(CASE WHEN cell <> ccell THEN p ELSE 0 END) AS BIGINT) AS moved,
  round(sum(CASE WHEN cell <> ccell THEN p ELSE 0 END) / CAST(sum(p) AS DOUBLE), 6) AS moved_share
FROM pc JOIN cc USING (area)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(AL.centroid_resolution_benchmark(
        population_points(spark, d), "area", "lat", "lon", "weight", 4), {"moved_share": 6})


# --- reconciliation ---------------------------------------------------------------------

_REC = """rows_ AS (SELECT c_custkey AS id, c_nationkey AS g,
  CASE WHEN c_nationkey % 9 = 0 THEN 0.0e0 ELSE c_acctbal + 1000 END AS v, 1 + c_custkey % 97 AS x FROM customer),
tot AS (SELECT c_nationkey AS g, CAST(count(*) * 100 AS DOUBLE) AS t FROM customer WHERE c_nationkey <> 4 GROUP BY 1)"""


def _rec(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("g"),
                    F.when(F.col("c_nationkey") % 9 == 0, 0.0).otherwise(
                        F.col("c_acctbal") + 1000).alias("v"),
                    (1 + F.col("c_custkey") % 97).alias("x"))
    tot = c.where("c_nationkey <> 4").groupBy(F.col("c_nationkey").alias("g")).agg(
        (F.count(F.lit(1)) * 100).cast("double").alias("total"))
    return rows, tot


@query("proportional_scale", f"""
WITH {_REC}
SELECT id, g, round(CASE WHEN t IS NULL THEN v WHEN sum(v) OVER w > 0 THEN v * (t / sum(v) OVER w)
  ELSE t / count(*) OVER w END, 5) AS reconciled, t IS NOT NULL AS is_constrained
FROM rows_ LEFT JOIN tot USING (g) WINDOW w AS (PARTITION BY g)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, tot = _rec(spark, d)
    return RC.proportional_scale(rows, "g", "v", tot).select(
        "id", "g", F.round("reconciled", 5).alias("reconciled"), "is_constrained")


@query("proportional_scale_by_exposure", f"""
WITH {_REC}
SELECT id, g, round(CASE WHEN t IS NULL THEN v WHEN sum(v) OVER w > 0 THEN v * (t / sum(v) OVER w)
  ELSE t * x / sum(x) OVER w END, 5) AS reconciled
FROM rows_ LEFT JOIN tot USING (g) WINDOW w AS (PARTITION BY g)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, tot = _rec(spark, d)
    return RC.proportional_scale(rows, "g", "v", tot, on_zero="share", share="x").select(
        "id", "g", F.round("reconciled", 5).alias("reconciled"))


@query("constraint_residuals", f"""
WITH {_REC} SELECT g, t AS total, t AS achieved, 0.0e0 AS residual FROM tot""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, tot = _rec(spark, d)
    done = RC.proportional_scale(rows, "g", "v", tot)
    return publish_round(RC.constraint_residuals(done, "g", "reconciled", tot),
                         {"achieved": 4, "residual": 4})


@query("ipf_two_margins", """
SELECT c_nationkey % 5 AS a, c_mktsegment AS b, true AS converged FROM customer GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(
        (F.col("c_nationkey") % 5).alias("a"), F.col("c_mktsegment").alias("b"),
        (1 + F.col("c_custkey") % 7).alias("v"), (1 + F.col("c_custkey") % 11).alias("t"))
    cells = c.groupBy("a", "b").agg(F.sum("v").cast("double").alias("v"))
    ta = c.groupBy("a").agg(F.sum("t").cast("double").alias("total"))
    tb = c.groupBy("b").agg(F.sum("t").cast("double").alias("total"))
    done, _rounds, residual = RC.ipf(cells, "v", [("a", ta), ("b", tb)])
    bad = RC.constraint_residuals(done, "a", "reconciled", ta).select("a", "residual")
    return done.join(bad, "a").select(
        "a", "b", ((F.col("residual") <= 1e-4) & F.lit(residual <= 1e-6)).alias("converged"))


@query("partition_overlaps", """
SELECT c_custkey AS member, CAST(2 AS BIGINT) AS groups FROM customer WHERE c_custkey % 6 = 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey").select(F.col("c_custkey").alias("member"))
    links = c.withColumn("g", F.lit("one")).unionByName(
        c.where("member % 6 = 0").withColumn("g", F.lit("two")))
    return W.overlapping_members(links, "member", "g")


_PREC = """cand AS (
  SELECT n_nationkey AS j, 'state_registration_total' AS source FROM nation WHERE n_nationkey % 7 <> 6
  UNION ALL SELECT n_nationkey, 'county_observation' FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, 'native_tract_registry' FROM nation WHERE n_nationkey % 3 = 0),
q AS (SELECT j, source, CASE source WHEN 'native_tract_registry' THEN 0 WHEN 'county_observation' THEN 1 ELSE 2 END AS r,
  CASE source WHEN 'native_tract_registry' THEN j % 4 <> 1 AND j % 5 <> 2 WHEN 'county_observation' THEN j % 8 = 0 ELSE true END AS ok FROM cand),
b AS (SELECT j, min(r) AS best FROM q WHERE ok GROUP BY 1)"""


@query("resolve_precedence", f"""
WITH {_PREC}
SELECT j, source, CASE WHEN r = best THEN 'operative' WHEN ok THEN 'superseded'
  WHEN best IS NULL THEN 'unconstrained' ELSE 'not_qualified' END AS status
FROM q LEFT JOIN b USING (j)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = F.col("n_nationkey")
    n = read_table(spark, d, "nation", "n_nationkey")
    cand = n.select(j.alias("j"), F.inline(F.array_compact(F.array(
        F.when(j % 7 != 6, F.struct(F.lit(RC.STATE).alias("source"))),
        F.when(j % 2 == 0, F.struct(F.lit(RC.COUNTY).alias("source"))),
        F.when(j % 3 == 0, F.struct(F.lit(RC.NATIVE).alias("source")))))))
    cand = cand.withColumns({"is_complete": F.col("j") % 4 != 1,
                             "licenses_zero": F.col("j") % 5 != 2,
                             "coverage_complete": F.col("j") % 8 == 0})
    return RC.resolve_precedence(cand, "j").select("j", "source", "status")


@query("coverage_complete", """
SELECT n_regionkey AS g, CAST(count(*) AS BIGINT) AS expected,
  CAST(sum(CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2500) THEN 1 ELSE 0 END) AS BIGINT) AS seen,
  bool_and(n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 2500)) AS is_complete
FROM nation GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation").select(F.col("n_regionkey").alias("g"),
                                              F.col("n_nationkey").alias("m"))
    s = read_table(spark, d, "supplier", "s_nationkey", "s_acctbal").where("s_acctbal > 2500")
    seen = s.select(F.col("s_nationkey").alias("m")).distinct().join(n, "m")
    return RC.coverage_complete(seen, n, "g", "m")


_PLAN = """r AS (SELECT c_custkey AS area, c_nationkey AS county, n_regionkey AS state,
  CAST(c_custkey % 50 + 1 AS DOUBLE) AS v FROM customer JOIN nation ON n_nationkey = c_nationkey),
nat AS (SELECT area, CAST(area % 7 AS DOUBLE) AS observed FROM r WHERE state = 0 AND area % 3 = 0),
cty AS (SELECT county, state, CAST(count(*) * 5 AS DOUBLE) AS total FROM r WHERE county % 4 = 0 GROUP BY 1, 2),
st AS (SELECT state, CAST(count(*) * 60 AS DOUBLE) AS total FROM r WHERE state <> 4 GROUP BY 1),
named AS (SELECT r.*, CASE WHEN r.state = 0 AND observed IS NOT NULL THEN 'tract:' || r.area
  WHEN r.state = 0 THEN 'zero:0' WHEN cty.total IS NOT NULL THEN 'county:' || r.county
  WHEN st.total IS NOT NULL THEN 'residual:' || r.state END AS con,
  observed, cty.total AS ct, st.total - coalesce(cl.t, 0) AS res
  FROM r LEFT JOIN nat USING (area) LEFT JOIN cty ON cty.county = r.county LEFT JOIN st ON st.state = r.state
  LEFT JOIN (SELECT state, sum(total) AS t FROM cty GROUP BY 1) cl ON cl.state = r.state),
tt AS (SELECT con AS constraint_, any_value(state) AS state, max(CASE WHEN con LIKE 'tract%' THEN observed
  WHEN con LIKE 'zero%' THEN 0.0e0 WHEN con LIKE 'county%' THEN ct ELSE res END) AS total
  FROM named WHERE con IS NOT NULL GROUP BY 1)"""


def plan_inputs(spark: SparkSession, d: str):
    r = population_points(spark, d).select(
        F.col("point_id").alias("area"), F.col("area").alias("county"),
        F.col("region").alias("state"), (F.col("point_id") % 50 + 1).cast("double").alias("v"))
    nat = r.where("state = 0 AND area % 3 = 0").select(
        "area", (F.col("area") % 7).cast("double").alias("observed"))
    cty = r.where("county % 4 = 0").groupBy("county", "state").agg(
        (F.count(F.lit(1)) * 5).cast("double").alias("total"))
    st = r.where("state <> 4").groupBy("state").agg(
        (F.count(F.lit(1)) * 60).cast("double").alias("total"))
    states = read_table(spark, d, "region", "r_regionkey").where("r_regionkey = 0").select(
        F.col("r_regionkey").alias("state"))
    rows, totals = RC.constraint_plan(r, "area", "county", "state", nat, states, cty, st)
    return rows, totals


@query("constraint_plan", f"""
WITH {_PLAN}
SELECT coalesce(con, 'none') AS binding, CAST(count(*) AS BIGINT) AS areas,
  round(any_value(tt.total), 4) AS total FROM named LEFT JOIN tt ON tt.constraint_ = con GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, totals = plan_inputs(spark, d)
    n = rows.groupBy(F.coalesce("constraint", F.lit("none")).alias("binding")).agg(
        F.count(F.lit(1)).alias("areas"))
    return n.join(totals.select(F.col("constraint").alias("binding"), "total"), "binding",
                  "left").select("binding", "areas", F.round("total", 4).alias("total"))


@query("accounting_identity", f"""
WITH {_PLAN},
fin AS (SELECT n.state, n.con, CASE WHEN tt.total IS NULL THEN v ELSE v * tt.total / sum(v) OVER (PARTITION BY con) END AS e
        FROM named n LEFT JOIN tt ON tt.constraint_ = con),
s AS (SELECT state, sum(e) AS p, sum(CASE WHEN con IS NULL THEN e ELSE 0 END) AS u FROM fin GROUP BY 1),
c AS (SELECT state, sum(total) AS c FROM tt GROUP BY 1),
j AS (SELECT s.state, p, u, coalesce(c.c, 0) AS c FROM s LEFT JOIN c ON c.state = s.state
      UNION ALL SELECT NULL, sum(p), sum(u), sum(coalesce(c.c, 0)) FROM s LEFT JOIN c ON c.state = s.state)
SELECT state, round(p, 3) AS published, round(u, 3) AS unconstrained, round(c, 3) AS constrained,
       true AS holds FROM j""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, totals = plan_inputs(spark, d)
    done = RC.proportional_scale(rows, "constraint", "v", totals.select("constraint", "total"))
    a = RC.accounting_identity(done, "reconciled", "constraint", "state", totals, 1e-5)
    return publish_round(a, {"published": 3, "unconstrained": 3, "constrained": 3}).drop("gap")


# --- dated sources ------------------------------------------------------------------------

_VINT = """vt AS (SELECT c_nationkey % 5 AS k, DATE '1995-12-31' + CAST(i * 365 AS INTEGER) AS day, sum(1 + (c_custkey + i) % 9) AS val
  FROM customer, range(0, 6) t(i) GROUP BY 1, 2)"""


def _vintages(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey")
    i = F.explode(F.sequence(F.lit(0), F.lit(5)))
    return c.select((F.col("c_nationkey") % 5).alias("k"), "c_custkey", i.alias("i")).groupBy(
        "k", F.date_add(F.to_date(F.lit("1995-12-31")), F.col("i") * 365).alias("day")).agg(
        F.sum(1 + (F.col("c_custkey") + F.col("i")) % 9).alias("val"))


@query("nearest_vintage_join", f"""
WITH {_VINT},
o AS (SELECT o_orderkey, o_custkey % 5 AS k, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS seen_on FROM orders),
j AS (SELECT o_orderkey, day, val, row_number() OVER (PARTITION BY o_orderkey
  ORDER BY coalesce(abs(date_diff('day', seen_on, day)), 0), day DESC) AS rn FROM o JOIN vt USING (k))
SELECT o_orderkey, day AS matched_vintage, CAST(val AS BIGINT) AS matched_value FROM j WHERE rn = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        "o_orderkey", (F.col("o_custkey") % 5).cast("int").alias("k"),
        F.when(F.col("o_orderkey") % 10 != 0, F.to_date("o_orderdate")).alias("at"))
    return RC.nearest_vintage_join(o, _vintages(spark, d), "k", "at", "day", "val").select(
        "o_orderkey", "matched_vintage", "matched_value")


_EDITIONS = """ed AS (SELECT n_nationkey AS source, i AS edition, DATE '1996-01-01' + CAST(i * 200 + n_nationkey AS INTEGER) AS period_end,
  DATE '1996-06-01' + CAST(i * 200 + n_nationkey * 3 AS INTEGER) AS released, (n_nationkey + i) % 4 <> 0 AS certain FROM nation, range(0, 8) t(i)),
cut(cutoff) AS (VALUES (DATE '1998-01-01'), (DATE '1999-01-01'), (DATE '2000-01-01'))"""


def _editions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = read_table(spark, d, "nation", "n_nationkey").select(
        F.col("n_nationkey").alias("source"),
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    s, i = F.col("source"), F.col("i")
    ed = n.select("source", i.cast("bigint").alias("edition"),
                  F.date_add(F.to_date(F.lit("1996-01-01")), i * 200 + s).alias("period_end"),
                  F.date_add(F.to_date(F.lit("1996-06-01")), i * 200 + s * 3).alias("released"),
                  ((s + i) % 4 != 0).alias("certain"))
    cut = spark.range(3).select(F.make_date((F.col("id") + 1998).cast("int"), F.lit(1), F.lit(1))
                                .alias("cutoff"))
    return cut, ed


@query("as_of_release", f"""
WITH {_EDITIONS}
SELECT source, cutoff, max(released) AS released, arg_max(period_end, (released, period_end)) AS period_end,
       CAST(arg_max(edition, (released, period_end)) AS BIGINT) AS edition
FROM ed, cut WHERE certain AND released <= cutoff AND period_end <= cutoff GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cut, ed = _editions(spark, d)
    chosen, _out = RC.as_of_release(cut, ed)
    return chosen


@query("as_of_release_exclusions", f"""
WITH {_EDITIONS}
SELECT source, cutoff, CAST(edition AS BIGINT) AS edition, CASE WHEN NOT certain THEN 'release_uncertain'
  WHEN released > cutoff THEN 'released_after_cutoff' ELSE 'period_after_cutoff' END AS reason
FROM ed, cut WHERE NOT (certain AND released <= cutoff AND period_end <= cutoff)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cut, ed = _editions(spark, d)
    _chosen, out = RC.as_of_release(cut, ed)
    return out


@query("feature_leakage", f"""
WITH {_EDITIONS}
SELECT source, CAST(edition AS BIGINT) AS edition FROM ed
WHERE released > DATE '1999-01-01' OR period_end > DATE '1999-01-01'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    _cut, ed = _editions(spark, d)
    return Q.leakage(ed, "1999-01-01").select("source", "edition")


@query("latest_per_key", """
SELECT o_custkey, max(o_orderdate)::DATE AS day, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey
FROM orders GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderkey").select(
        "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("v"), "o_orderkey")
    return RC.latest_per_key(o, "o_custkey", "v", ["o_orderkey"]).select(
        "o_custkey", F.to_date("v.o_orderdate").alias("day"), "o_orderkey")


@query("upsert_by_key", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 4 = 0 THEN 0.0e0 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT -1 - s_suppkey, 'NEW', 0.0e0 FROM supplier""")
def _(spark: SparkSession, d: str) -> DataFrame:
    full = read_table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal")
    keys = full.where("c_custkey % 4 = 0").select("c_custkey").unionByName(
        read_table(spark, d, "supplier", "s_suppkey").select(
            (-1 - F.col("s_suppkey")).alias("c_custkey")))
    fresh = keys.select("c_custkey", F.lit("NEW").alias("c_mktsegment"),
                        F.lit(0.0).alias("c_acctbal"))
    return RC.upsert_by_key(full, fresh, ["c_custkey"])


@query("panel_join_ledger", """
WITH t AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS a FROM orders)
SELECT CASE WHEN a IS NULL THEN 'no_area' WHEN c_nationkey >= 20 THEN 'outside_state'
  WHEN a % 7 = 0 THEN 'no_features' WHEN a % 11 = 0 THEN 'no_exposure' ELSE 'included' END AS disposition,
  CAST(count(*) AS BIGINT) AS n FROM t LEFT JOIN customer ON c_custkey = a GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    obs = read_table(spark, d, "orders", "o_orderkey", "o_custkey").select(
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey")).alias("area"))
    c = read_table(spark, d, "customer", "c_custkey", "c_nationkey").withColumnRenamed(
        "c_custkey", "area")
    feats = c.where("area % 7 <> 0").select("area", F.when(
        F.col("area") % 11 == 0, 0.0).otherwise(1.0).alias("households"))
    _panel, ledger = RC.panel_join(obs, feats, c.where("c_nationkey < 20"), "area", "households")
    return ledger


@query("set_reconciliation", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'),
b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2001-03-01')
SELECT CASE WHEN a.k IS NULL THEN 'entered' WHEN b.k IS NULL THEN 'left' ELSE 'intersection' END AS side,
       CAST(count(*) AS BIGINT) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderdate")
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    a = o.where(F.col("o_orderdate") < ts("1995-06-01")).select("o_custkey").distinct()
    b = o.where(F.col("o_orderdate") >= ts("2001-03-01")).select("o_custkey").distinct()
    return W.set_reconciliation(a, b, "o_custkey").select("side", "n")


@query("jaccard_overlap", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'),
b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT round(CAST(sum(CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6)
  AS jaccard FROM a FULL JOIN b ON a.k = b.k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderstatus", "o_orderpriority")
    return publish_round(W.jaccard(o.where("o_orderstatus = 'P'"),
                                   o.where("o_orderpriority = '1-URGENT'"), "o_custkey"),
                         {"jaccard": 6})


@query("key_parity", """
SELECT c_custkey, CAST(1 AS BIGINT) AS batches FROM customer WHERE c_custkey % 10 = 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey")
    return W.key_parity([c, c.where("c_custkey % 10 <> 3")], ["c_custkey"])


