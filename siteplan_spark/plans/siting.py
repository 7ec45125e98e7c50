"""Queries over candidates, selections and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.functions import geo as G
from siteplan_spark.functions.clean import blend, publish_round
from siteplan_spark.operators import siting as ST
from siteplan_spark.operators import spatial as SP
from siteplan_spark.plans.access import cell_sql
from siteplan_spark.plans.registry import query
from siteplan_spark.session import cut_lineage
from siteplan_spark.sources.tables import POINTS_SQL, SITES_SQL, population_points, sites

LEVEL = 6
SATURATION = 450.5
_N = 1 << LEVEL

_COL, _ROW = "((cell >> 28) & 268435455)", "(cell & 268435455)"
_CELLS = f"""{POINTS_SQL}, {SITES_SQL},
pc AS (SELECT region, {cell_sql('lat', 'lon', LEVEL)} AS cell, count(*) AS demand, sum(CASE WHEN point_id % 4 = 0 THEN 0 ELSE weight END) AS population,
       sum(point_id % 5) AS equity_population FROM points GROUP BY 1, 2),
sc AS (SELECT {cell_sql('lat', 'lon', LEVEL)} AS cell, count(*) AS ports FROM sites GROUP BY 1),
cells AS (SELECT pc.*, coalesce(ports, 0) AS existing_ports, ({_COL} + {_ROW}) % 6 <> 0 AS within_road
          FROM pc LEFT JOIN sc USING (cell)),
tag AS (SELECT *, CASE WHEN population < 1 THEN 'uninhabited' WHEN NOT within_road THEN 'beyond_primary_secondary_roads'
  WHEN demand > 0 AND existing_ports * 1000.0e0 / demand >= {SATURATION}e0 THEN 'already_saturated' ELSE 'included' END AS reason FROM cells),
cand AS (SELECT * FROM tag WHERE reason = 'included'),
edge AS (SELECT a.region, a.cell AS candidate, b.cell AS covered, b.demand, b.population, b.equity_population, b.existing_ports
  FROM cand a JOIN cand b ON b.region = a.region
   AND abs(((a.cell >> 28) & 268435455) - ((b.cell >> 28) & 268435455)) <= 1
   AND abs((a.cell & 268435455) - (b.cell & 268435455)) <= 1)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    p = G.with_cell(population_points(spark, d), "lat", "lon", LEVEL)
    pc = p.groupBy("region", "cell").agg(
        F.count(F.lit(1)).alias("demand"),
        F.sum(F.when(F.col("point_id") % 4 == 0, 0).otherwise(F.col("weight"))).alias("population"),
        F.sum(F.col("point_id") % 5).alias("equity_population"))
    sc = G.with_cell(sites(spark, d), "lat", "lon", LEVEL).groupBy("cell").agg(
        F.count(F.lit(1)).alias("existing_ports"))
    return pc.join(sc, "cell", "left").withColumn(
        "existing_ports", F.coalesce("existing_ports", F.lit(0)))


def roads(spark: SparkSession, d: str) -> DataFrame:
    near = (G.cell_column("cell") + G.cell_row("cell")) % 6 != 0
    return cells(spark, d).select("region", "cell", near.alias("within_road"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    road = c.select("region", "cell", ((G.cell_column("cell") + G.cell_row("cell")) % 6 != 0)
                    .alias("within_road"))
    kept, _ledger = ST.build_candidates(c, SATURATION, road, key=["region", "cell"])
    return kept


def problem(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = cut_lineage(candidates(spark, d))  # joined to itself below
    return c, ST.coverage_edges(c, LEVEL, 1, by=["region"])


def greedy_sql(steps: int, value: str = "demand", extra: str = "", edge: str = "edge") -> str:
    """The greedy rule unrolled: one common table per step."""
    parts = [f"{_CELLS}{extra}", "cov0 AS (SELECT region, cell AS covered FROM cand LIMIT 0)"]
    for i in range(1, steps + 1):
        parts.append(f"""pick{i} AS (SELECT region, arg_min(candidate, (-g, candidate)) AS candidate, max(g) AS gain FROM (
  SELECT e.region, e.candidate, CAST(sum(CAST({value} AS DECIMAL(38,12))) AS DOUBLE) AS g FROM {edge} e
  WHERE NOT EXISTS (SELECT 1 FROM cov{i - 1} c WHERE c.region = e.region AND c.covered = e.covered)
  GROUP BY 1, 2) GROUP BY 1)""")
        parts.append(f"""cov{i} AS (SELECT * FROM cov{i - 1} UNION SELECT e.region, e.covered FROM {edge} e
  JOIN pick{i} p ON p.region = e.region AND p.candidate = e.candidate)""")
    picks = " UNION ALL ".join(
        f"SELECT region, CAST({i} AS INTEGER) AS step, candidate, gain FROM pick{i} WHERE gain > 0"
        for i in range(1, steps + 1))
    return ",\n".join([*parts, f"sel AS ({picks})"])


_GREEDY = greedy_sql(4)


def selection(spark: SparkSession, d: str, c: DataFrame, e: DataFrame,
              budget: int = 4, **kw) -> DataFrame:
    return ST.greedy_max_coverage(c, e, budget, {"demand": 1.0}, ["region"], key="cell", **kw)


@query("exclude_reasons", f"""
WITH {_CELLS} SELECT reason, CAST(count(*) AS BIGINT) AS n FROM tag GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    _kept, ledger = ST.build_candidates(cells(spark, d), SATURATION, roads(spark, d),
                                        key=["region", "cell"])
    return ledger.select("reason", "n")


@query("build_candidates", f"""
WITH {_CELLS} SELECT region, cell, CAST(demand AS BIGINT) AS demand, CAST(population AS BIGINT) AS population,
  CAST(existing_ports AS BIGINT) AS existing_ports, false AS road_data_unavailable FROM cand""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("region", "cell", "demand", "population",
                                       "existing_ports", "road_data_unavailable")


@query("coverage_sets", f"""
WITH {_CELLS} SELECT region, candidate, CAST(count(*) AS BIGINT) AS cells FROM edge GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    _c, e = problem(spark, d)
    return e.groupBy("region", "candidate").agg(F.count(F.lit(1)).alias("cells"))


@query("greedy_max_coverage", f"""
WITH {_GREEDY} SELECT region, step, candidate, gain FROM sel""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return selection(spark, d, *problem(spark, d))


@query("greedy_distributed_rounds", f"""
WITH {greedy_sql(8)} SELECT region, step, candidate, gain FROM sel""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # a budget of several rounds
    return selection(spark, d, *problem(spark, d), budget=8)


_SCORES = f"""{_GREEDY},
cv AS (SELECT DISTINCT e.region, e.covered, demand, population, equity_population, existing_ports
       FROM edge e JOIN sel USING (region, candidate)),
so AS (SELECT region, sum(population) AS population_served, sum(demand) AS demand_covered,
  sum(equity_population) AS equity_coverage, sum(CASE WHEN existing_ports <= 0 THEN demand ELSE 0 END) AS accessibility_improvement
  FROM cv GROUP BY 1),
ns AS (SELECT region, count(*) AS sites FROM sel GROUP BY 1)"""


@query("score_selection", f"""
WITH {_SCORES} SELECT region, CAST(population_served AS BIGINT) AS population_served,
  CAST(demand_covered AS BIGINT) AS demand_covered, CAST(equity_coverage AS BIGINT) AS equity_coverage,
  CAST(accessibility_improvement AS DOUBLE) AS accessibility_improvement, CAST(sites AS BIGINT) AS sites,
  round(demand_covered / CAST(sites AS DOUBLE), 6) AS estimated_utilisation,
  round(demand_covered / CAST(sites AS DOUBLE), 6) AS cost_efficiency FROM so JOIN ns USING (region)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c, e = problem(spark, d)
    s = ST.score_selection(selection(spark, d, c, e), c, e, ["region"])
    return publish_round(s, {"estimated_utilisation": 6, "cost_efficiency": 6})


@query("selection_table", f"""
WITH {_GREEDY} SELECT sel.region, step, candidate, gain, CAST(demand AS BIGINT) AS demand,
  CAST(existing_ports AS BIGINT) AS existing_ports FROM sel JOIN cand ON cand.region = sel.region AND cell = candidate""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c, e = problem(spark, d)
    s = selection(spark, d, c, e).join(
        c.withColumnRenamed("cell", "candidate"), ["region", "candidate"])
    return s.select("region", "step", "candidate", "gain", "demand", "existing_ports")


@query("baseline_portfolios", f"""
WITH {_CELLS}, l AS (SELECT 'baseline_population_weighted' AS portfolio, region, cell, population AS v FROM cand
  UNION ALL SELECT 'baseline_demand_only', region, cell, demand FROM cand
  UNION ALL SELECT 'baseline_existing_network_proximity', region, cell, existing_ports FROM cand
  UNION ALL SELECT 'baseline_random', region, cell, CAST('0x' || substr(md5('7:' || cell), 1, 13) AS BIGINT) FROM cand)
SELECT portfolio, region, cell AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY portfolio, region ORDER BY v DESC, cell) AS rn FROM l)
WHERE rn <= 4""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ST.baseline_portfolios(candidates(spark, d), 4, ["region"], 7)


_CROSS = f"""{_GREEDY},
l AS (SELECT 'baseline_population_weighted' AS portfolio, region, cell, population AS v FROM cand
  UNION ALL SELECT 'baseline_demand_only', region, cell, demand FROM cand
  UNION ALL SELECT 'baseline_existing_network_proximity', region, cell, existing_ports FROM cand
  UNION ALL SELECT 'baseline_random', region, cell, CAST('0x' || substr(md5('7:' || cell), 1, 13) AS BIGINT) FROM cand),
pf AS (SELECT portfolio, region, cell AS candidate FROM (SELECT *, row_number() OVER (PARTITION BY portfolio, region ORDER BY v DESC, cell) AS rn FROM l) WHERE rn <= 4
  UNION ALL SELECT 'greedy', region, candidate FROM sel),
cv AS (SELECT DISTINCT portfolio, e.region, e.covered, demand, population, equity_population, existing_ports
       FROM edge e JOIN pf USING (region, candidate)),
so AS (SELECT portfolio, region, sum(population) AS p, sum(demand) AS dm, sum(equity_population) AS eq,
  sum(CASE WHEN existing_ports <= 0 THEN demand ELSE 0 END) AS ac FROM cv GROUP BY 1, 2),
ns AS (SELECT portfolio, region, CAST(count(*) AS DOUBLE) AS n FROM pf GROUP BY 1, 2),
lo AS (SELECT portfolio, region, 'population_served' AS objective, CAST(p AS DOUBLE) AS score FROM so
  UNION ALL SELECT portfolio, region, 'demand_covered', dm FROM so UNION ALL SELECT portfolio, region, 'equity_coverage', eq FROM so
  UNION ALL SELECT portfolio, region, 'accessibility_improvement', ac FROM so
  UNION ALL SELECT portfolio, region, 'estimated_utilisation', dm / n FROM so JOIN ns USING (portfolio, region)
  UNION ALL SELECT portfolio, region, 'cost_efficiency', dm / n FROM so JOIN ns USING (portfolio, region)),
rel AS (SELECT *, CASE WHEN max(score) OVER w > 0 THEN score / max(score) OVER w ELSE 1 END AS relative FROM lo WINDOW w AS (PARTITION BY region, objective))"""


def cross_table(spark: SparkSession, d: str) -> DataFrame:
    c, e = problem(spark, d)
    base = ST.baseline_portfolios(c, 4, ["region"], 7)
    mine = selection(spark, d, c, e).select(F.lit("greedy").alias("portfolio"), "region",
                                            "candidate")
    return ST.cross_objective_table(mine.unionByName(base), c, e, ["region"])


@query("cross_objective_table", f"""
WITH {_CROSS} SELECT portfolio, region, objective, round(score, 4) AS score, round(relative, 6) AS relative,
  relative < 0.95e0 AS is_tradeoff FROM rel""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(cross_table(spark, d), {"score": 4, "relative": 6})


@query("selection_shortfall", f"""
WITH {_CROSS}, o AS (SELECT region, portfolio, dm FROM so)
SELECT r.region, CAST(b.dm AS BIGINT) AS heuristic, CAST(r.dm AS BIGINT) AS reference,
  round(CASE WHEN r.dm > 0 THEN (r.dm - coalesce(b.dm, 0)) / CAST(r.dm AS DOUBLE) ELSE 0 END, 6) AS shortfall
FROM o r JOIN o b ON b.region = r.region AND b.portfolio = 'baseline_demand_only' WHERE r.portfolio = 'greedy'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c, e = problem(spark, d)
    base = ST.baseline_portfolios(c, 4, ["region"], 7).where("portfolio = 'baseline_demand_only'")
    h = ST.score_selection(base, c, e, ["region"])
    r = ST.score_selection(selection(spark, d, c, e), c, e, ["region"])
    return publish_round(ST.selection_shortfall(h, r, ["region"], "demand_covered"),
                         {"shortfall": 6})


_SPREAD = """,
tot AS (SELECT region, sum(demand) AS ps, sum(equity_population) AS ss FROM cand GROUP BY 1),
wide AS (SELECT e.region * 100 + s * 10 + i AS region, candidate, covered, demand, equity_population,
  CASE WHEN s = 0 THEN CASE WHEN ps > 0 THEN demand / CAST(ps AS DOUBLE) ELSE 0 END ELSE CASE WHEN ss > 0 THEN equity_population / CAST(ss AS DOUBLE) ELSE 0 END END * (1.0e0 - i / 4.0e0)
  + CASE WHEN s = 1 THEN CASE WHEN ps > 0 THEN demand / CAST(ps AS DOUBLE) ELSE 0 END ELSE CASE WHEN ss > 0 THEN equity_population / CAST(ss AS DOUBLE) ELSE 0 END END * (i / 4.0e0) AS v
  FROM edge e JOIN tot USING (region), range(2) a(s), range(5) b(i))"""


@query("epsilon_sweep", f"""
WITH {greedy_sql(4, 'v', _SPREAD, 'wide')},
cv AS (SELECT DISTINCT w.region, w.covered, demand, equity_population FROM wide w JOIN sel USING (region, candidate)),
ag AS (SELECT region // 100 AS region, region // 10 % 10 AS s, region % 10 AS level, sum(demand) AS pc, sum(equity_population) AS sc FROM cv GROUP BY ALL),
fl AS (SELECT *, CASE WHEN s = 0 THEN sc ELSE pc END AS f FROM ag),
tp AS (SELECT region, s, f AS ceiling FROM fl WHERE level = 4)
SELECT CAST(region AS INTEGER) AS region, CASE WHEN s = 0 THEN 'primary' ELSE 'secondary' END AS sense, CAST(level AS INTEGER) AS level, CAST(pc AS BIGINT) AS primary_covered,
  CAST(sc AS BIGINT) AS secondary_covered, CAST(ceiling AS BIGINT) AS ceiling, level / 4.0e0 AS epsilon, level / 4.0e0 * ceiling AS floor, f >= level / 4.0e0 * ceiling - 1e-9 AS feasible
FROM fl JOIN tp USING (region, s)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c, e = problem(spark, d)
    return ST.epsilon_sweep(c, e, 4, "demand", "equity_population", 5, ["region"])


@query("epsilon_gaps")
def _(spark: SparkSession, d: str) -> DataFrame:
    c, e = problem(spark, d)
    sweep = ST.epsilon_sweep(c, e, 4, "demand", "equity_population", 5, ["region"])
    return ST.with_gaps(sweep, c, e, 4, "demand", "equity_population", ["region"])


_SCALED = f""",
vs(s, f) AS (VALUES (0, 1.0e0), (1, 0.95e0), (2, 1.05e0)),
kept AS (SELECT region * 10 + s AS region, cell, demand * f AS d FROM cells, vs WHERE population >= 1 AND within_road
  AND NOT (demand * f > 0 AND existing_ports * 1000.0e0 / (demand * f) >= {SATURATION}e0)),
near AS (SELECT a.region, a.cell AS candidate, b.cell AS covered, b.d FROM kept a JOIN kept b ON b.region = a.region
   AND abs(((a.cell >> 28) & 268435455) - ((b.cell >> 28) & 268435455)) <= 1
   AND abs((a.cell & 268435455) - (b.cell & 268435455)) <= 1)"""


@query("perturbation_overlap", f"""
WITH {greedy_sql(4, 'd', _SCALED, 'near')},
ps AS (SELECT region // 10 AS region, region % 10 AS s, candidate FROM sel),
pr AS (SELECT DISTINCT region, b.s FROM cells, (VALUES (1), (2)) b(s)),
u AS (SELECT pr.region, pr.s, candidate, max(CASE WHEN ps.s = 0 THEN 1 ELSE 0 END) AS b, max(CASE WHEN ps.s = pr.s THEN 1 ELSE 0 END) AS x
  FROM pr LEFT JOIN ps ON ps.region = pr.region AND ps.s IN (0, pr.s) GROUP BY ALL)
SELECT CAST(region AS INTEGER) AS region, CASE s WHEN 1 THEN 'low' ELSE 'high' END AS scenario,
  round(CASE WHEN count(candidate) > 0 THEN sum(b * x) / CAST(count(candidate) AS DOUBLE) ELSE 1 END, 6) AS jaccard FROM u GROUP BY ALL""")
def _(spark: SparkSession, d: str) -> DataFrame:
    total, half = 1000.0, 50.0  # a published total and the half-width of its rounding
    moved = {"low": (total - half) / total, "high": (total + half) / total}
    found = ST.perturbation_overlap(cells(spark, d), moved, 4, SATURATION, LEVEL, roads(spark, d),
                                    ["region"])
    return publish_round(found, {"jaccard": 6})


@query("clustering_sensitivity", f"""
WITH RECURSIVE {_CELLS},
e2 AS (SELECT p.site_id AS a, s.site_id AS b FROM sites p JOIN sites s ON p.site_id <> s.site_id
   AND 2.0e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2.0e0), 2) + cos(radians(p.lat)) * cos(radians(s.lat))
   * pow(sin(radians(s.lon - p.lon) / 2.0e0), 2))) <= 90.5e0),
reach(a, b) AS (SELECT site_id, site_id FROM sites UNION SELECT reach.a, e2.b FROM reach JOIN e2 ON e2.a = reach.b),
lab AS (SELECT a AS site_id, min(b) AS cluster FROM reach GROUP BY 1),
cen AS (SELECT cluster, avg(lat) AS lat, avg(lon) AS lon FROM lab JOIN sites USING (site_id) GROUP BY 1),
mv AS (SELECT {cell_sql('cen.lat', 'cen.lon', LEVEL)} AS cell, count(*) AS ports FROM lab JOIN cen USING (cluster) GROUP BY 1),
dm AS (SELECT cell, sum(demand) AS demand FROM pc GROUP BY 1),
fl AS (SELECT dm.cell, coalesce(sc.ports, 0) * 1000.0e0 / demand >= {SATURATION}e0 AS a, coalesce(mv.ports, 0) * 1000.0e0 / demand >= {SATURATION}e0 AS b
       FROM dm LEFT JOIN sc ON sc.cell = dm.cell LEFT JOIN mv ON mv.cell = dm.cell)
SELECT CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS saturation_flips,
  round(sum(CASE WHEN NOT a AND NOT b THEN 1 ELSE 0 END) / CAST(sum(CASE WHEN NOT a OR NOT b THEN 1 ELSE 0 END) AS DOUBLE), 6) AS candidate_jaccard
FROM fl""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d)
    base = G.with_cell(s, "lat", "lon", LEVEL).groupBy("cell").agg(
        F.count(F.lit(1)).alias("existing_ports"))
    moved = SP.cluster_points(s, "site_id", eps_m=90_500.0).select(
        G.cell_of("cluster_lat", "cluster_lon", LEVEL).alias("cell")).groupBy("cell").agg(
        F.count(F.lit(1)).alias("existing_ports"))
    demand = G.with_cell(population_points(spark, d), "lat", "lon", LEVEL).groupBy("cell").agg(
        F.count(F.lit(1)).alias("demand"))
    return publish_round(ST.clustering_sensitivity(base, moved, demand, SATURATION),
                         {"candidate_jaccard": 6})


_SUPPLY = f""",

e2 AS (SELECT p.site_id AS a, s.site_id AS b FROM sites p JOIN sites s ON p.site_id <> s.site_id
   AND 2.0e0 * 6371.0088e0 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2.0e0), 2) + cos(radians(p.lat)) * cos(radians(s.lat))
   * pow(sin(radians(s.lon - p.lon) / 2.0e0), 2))) <= 90.5e0),
reach(a, b) AS (SELECT site_id, site_id FROM sites UNION SELECT reach.a, e2.b FROM reach JOIN e2 ON e2.a = reach.b),
lab AS (SELECT a AS site_id, min(b) AS cluster FROM reach GROUP BY 1),
cen AS (SELECT cluster, avg(lat) AS lat, avg(lon) AS lon FROM lab JOIN sites USING (site_id) GROUP BY 1),
mv AS (SELECT {cell_sql('cen.lat', 'cen.lon', LEVEL)} AS cell, count(*) AS ports FROM lab JOIN cen USING (cluster) GROUP BY 1),
al AS (SELECT cell, sum(demand) AS demand, sum(population) AS population, sum(equity_population) AS equity FROM pc GROUP BY 1),
ap AS (SELECT al.*, 0 AS s, coalesce(ports, 0) AS ports FROM al LEFT JOIN sc ON sc.cell = al.cell
  UNION ALL SELECT al.*, 1, coalesce(ports, 0) FROM al LEFT JOIN mv ON mv.cell = al.cell),
sa AS (SELECT *, coalesce(demand > 0 AND ports * 1000.0e0 / demand >= {SATURATION}e0, false) AS full_ FROM ap),
kp AS (SELECT * FROM sa WHERE population >= 1 AND ({_COL} + {_ROW}) % 6 <> 0 AND NOT full_),
near AS (SELECT a.s AS region, a.cell AS candidate, b.cell AS covered, b.demand AS d, b.equity FROM kp a JOIN kp b ON b.s = a.s
   AND abs(((a.cell >> 28) & 268435455) - ((b.cell >> 28) & 268435455)) <= 1
   AND abs((a.cell & 268435455) - (b.cell & 268435455)) <= 1)"""


@query("supply_conditions", f"""
WITH RECURSIVE {greedy_sql(6, 'd', _SUPPLY, 'near')},
ns AS (SELECT a.s, count(*) AS n, sum(CASE WHEN b.cell IS NOT NULL THEN 1 ELSE 0 END) AS both_, (SELECT count(*) FROM kp WHERE s = 0) AS n0
  FROM kp a LEFT JOIN kp b ON b.cell = a.cell AND b.s = 0 GROUP BY 1),
fl AS (SELECT a.s, sum(CASE WHEN a.full_ <> b.full_ THEN 1 ELSE 0 END) AS changes FROM sa a JOIN sa b ON b.cell = a.cell AND b.s = 0 GROUP BY 1),
st AS (SELECT region AS s, candidate, q FROM sel, (VALUES (2), (4), (6)) v(q) WHERE step <= q),
ov AS (SELECT a.s, a.q, count(*) AS n, sum(CASE WHEN b.s = 0 THEN 1 ELSE 0 END) AS both_, (SELECT count(*) FROM st z WHERE z.s = 0 AND z.q = a.q) AS n0
  FROM st a LEFT JOIN st b ON b.s = 0 AND b.q = a.q AND b.candidate = a.candidate GROUP BY 1, 2),
ob AS (SELECT region AS s, sum(d) AS d, sum(equity) AS e FROM (SELECT DISTINCT n.region, n.covered, d, equity FROM near n JOIN st ON st.s = n.region AND st.q = 4 AND st.candidate = n.candidate) GROUP BY 1)
SELECT CASE fl.s WHEN 0 THEN 'own_place' ELSE 'cluster_centroid' END AS condition, CAST(n AS BIGINT) AS candidates, round(both_ / CAST(n + n0 - both_ AS DOUBLE), 6) AS candidate_jaccard,
  CAST(changes AS BIGINT) AS saturation_changes,
  (SELECT round(max(both_ / CAST(n + n0 - both_ AS DOUBLE)), 6) FROM ov WHERE ov.s = fl.s AND q = 2) AS overlap_2,
  (SELECT round(max(both_ / CAST(n + n0 - both_ AS DOUBLE)), 6) FROM ov WHERE ov.s = fl.s AND q = 4) AS overlap_4,
  (SELECT round(max(both_ / CAST(n + n0 - both_ AS DOUBLE)), 6) FROM ov WHERE ov.s = fl.s AND q = 6) AS overlap_6,
  CAST(d - (SELECT d FROM ob WHERE s = 0) AS BIGINT) AS demand_delta, CAST(e - (SELECT e FROM ob WHERE s = 0) AS BIGINT) AS equity_delta
FROM fl JOIN ns ON ns.s = fl.s JOIN ob ON ob.s = fl.s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = sites(spark, d)
    base = G.with_cell(s, "lat", "lon", LEVEL).select(F.lit("own_place").alias("condition"), "cell")
    moved = SP.cluster_points(s, "site_id", eps_m=90_500.0).select(
        F.lit("cluster_centroid").alias("condition"),
        G.cell_of("cluster_lat", "cluster_lon", LEVEL).alias("cell"))
    supply = base.unionByName(moved).groupBy("condition", "cell").agg(
        F.count(F.lit(1)).alias("existing_ports"))
    p = G.with_cell(population_points(spark, d), "lat", "lon", LEVEL)
    whole = p.groupBy("cell").agg(
        F.count(F.lit(1)).alias("demand"),
        F.sum(F.when(F.col("point_id") % 4 == 0, 0).otherwise(F.col("weight"))).alias("population"),
        F.sum(F.col("point_id") % 5).alias("equity_population"))
    near = whole.select("cell", ((G.cell_column("cell") + G.cell_row("cell")) % 6 != 0)
                        .alias("within_road"))
    found = ST.compare_supply_conditions(whole, supply, ["own_place", "cluster_centroid"],
                                         SATURATION, LEVEL, [2, 4, 6], near)
    return publish_round(found, {c: 6 for c in found.columns if "jaccard" in c or "overlap" in c})


@query("blended_ranking", f"""
WITH {_CELLS} SELECT region, cell, round(demand * 0.6e0 + equity_population * 0.4e0, 4) AS score FROM cand""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("region", "cell", F.round(blend(
        "demand", "equity_population", 0.6), 4).alias("score"))
