"""Queries over features, models, scores and uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.functions import features as FT
from siteplan_spark.functions.clean import publish_round
from siteplan_spark.operators import demand as D
from siteplan_spark.operators import ranking as W
from siteplan_spark.operators import surface as SF
from siteplan_spark.operators import uncertainty as U
from siteplan_spark.plans.registry import query
from siteplan_spark.sources.tables import population_points, read_table

# --- features ---------------------------------------------------------------------------

_VARS = FT.survey_variables()


def _v(name: str) -> str:
    """The stand-in survey count of a variable: a rule on the customer key."""
    i = _VARS.index(name)
    return f"CAST((c_custkey * {i + 3}) % {50 + i} AS DOUBLE)"


def _s(names) -> str:
    return "(" + " + ".join(_v(n) for n in names) + ")"


def _share(parts: str, total: str) -> str:
    return f"round(CASE WHEN {total} > 0 THEN {parts} / {total} END, 6)"


def _binned(names, mids) -> str:
    return "(" + " + ".join(f"{_v(n)} * {m!r}e0" for n, m in zip(names, mids, strict=True)) + ")"


_INCOME = f"CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE {_v(FT.MEDIAN_INCOME)} END"


@query("compute_features", f"""
SELECT c_custkey AS geoid, {_v(FT.POPULATION)} AS population, {_v(FT.HOUSEHOLDS)} AS households,
  round(CASE WHEN c_custkey % 7 > 0 THEN ln({_v(FT.POPULATION)} / (c_custkey % 7) + 1) END, 6) AS log_population_density_km2,
  round(({_INCOME}) / 1000.0e0, 6) AS median_household_income_k,
  {_share(_s(FT.INCOME_HIGH), _v(FT.INCOME_TOTAL))} AS income_share_over_100k,
  {_share(_s(FT.INCOME_LOW), _v(FT.INCOME_TOTAL))} AS income_share_under_35k,
  {_share(_v(FT.OWNER_OCCUPIED), _v(FT.HOUSEHOLDS))} AS owner_occupied_share,
  {_share(_s(FT.SINGLE_FAMILY), _v(FT.STRUCTURES_TOTAL))} AS single_family_share,
  {_share(_s(FT.MULTIFAMILY), _v(FT.STRUCTURES_TOTAL))} AS multifamily_share,
  {_share(_s(FT.NO_VEHICLE), _v(FT.VEHICLES_TOTAL))} AS zero_vehicle_household_share,
  {_share(_binned(FT.VEHICLE_BINS, FT.VEHICLE_MIDPOINTS), _v(FT.VEHICLES_TOTAL))} AS vehicles_per_household,
  {_share(_v(FT.DROVE_ALONE), _v(FT.WORKERS_TOTAL))} AS drove_alone_share,
  {_share(_v(FT.PUBLIC_TRANSIT), _v(FT.WORKERS_TOTAL))} AS public_transit_share,
  {_share(_v(FT.WORKED_FROM_HOME), _v(FT.WORKERS_TOTAL))} AS worked_from_home_share,
  {_share(_binned(FT.COMMUTE_BINS, FT.COMMUTE_MIDPOINTS), _v(FT.COMMUTE_TOTAL))} AS mean_commute_minutes,
  {_share(_s(FT.BACHELORS_PLUS), _v(FT.EDUCATION_TOTAL))} AS bachelors_plus_share
FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = {n: F.expr(f"CAST((c_custkey * {i + 3}) % {50 + i} AS string)")
            for i, n in enumerate(_VARS)}
    text[FT.MEDIAN_INCOME] = F.when(F.col("c_custkey") % 10 == 0, "-666666666").otherwise(
        text[FT.MEDIAN_INCOME])
    staged = read_table(spark, d, "customer", "c_custkey").select(
        F.col("c_custkey").alias("geoid"), *[c.alias(n) for n, c in text.items()],
        (F.col("c_custkey") % 7).cast("double").alias("land_area_km2"))
    return publish_round(FT.compute_features(staged), {n: 6 for n in FT.feature_columns()})


# --- areas: customers as fine areas, their nation as the coarse group ---------------------

_AREAS = """areas AS (SELECT c_custkey AS id, c_nationkey AS g, n_regionkey AS st,
  CAST(1 + c_custkey % 97 AS DOUBLE) AS hh, CAST(c_custkey % 23 AS DOUBLE) AS x1,
  c_acctbal / 1000.0e0 AS x2, CAST(coalesce(n, 0) AS DOUBLE) AS cnt
  FROM customer JOIN nation ON n_nationkey = c_nationkey
  LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""


def areas(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "orders", "o_custkey").groupBy(
        F.col("o_custkey").alias("point_id")).agg(F.count(F.lit(1)).alias("_n"))
    return population_points(spark, d).join(n, "point_id", "left").select(
        F.col("point_id").alias("id"), F.col("area").alias("g"), F.col("region").alias("st"),
        F.col("weight").cast("double").alias("hh"),
        (F.col("point_id") % 23).cast("double").alias("x1"),
        (F.col("balance") / 1000.0).alias("x2"),
        F.coalesce("_n", F.lit(0)).cast("double").alias("cnt"))


@query("impute_upper_median", f"""
WITH {_AREAS}, m AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE x1 END AS x1,
  CASE WHEN id % 5 = 0 THEN NULL ELSE x2 END AS x2 FROM areas),
r1 AS (SELECT x1, row_number() OVER (ORDER BY x1) - 1 AS i, count(*) OVER () AS n FROM m WHERE x1 IS NOT NULL),
r2 AS (SELECT x2, row_number() OVER (ORDER BY x2) - 1 AS i, count(*) OVER () AS n FROM m WHERE x2 IS NOT NULL)
SELECT id, coalesce(x1, (SELECT x1 FROM r1 WHERE i = n // 2)) AS x1,
       coalesce(x2, (SELECT x2 FROM r2 WHERE i = n // 2)) AS x2,
       CAST(CASE WHEN x1 IS NULL THEN 1 ELSE 0 END + CASE WHEN x2 IS NULL THEN 1 ELSE 0 END AS INTEGER)
         AS imputed_count FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d).select("id", F.when(F.col("id") % 7 != 0, F.col("x1")).alias("x1"),
                               F.when(F.col("id") % 5 != 0, F.col("x2")).alias("x2"))
    filled, _medians = D.impute_upper_median(a, ["x1", "x2"])
    return filled.select("id", "x1", "x2", "imputed_count")


@query("constant_rate_baselines", f"""
WITH {_AREAS} SELECT id, round(hh * (SELECT sum(cnt) / sum(hh) FROM areas), 6) AS by_households,
  round((x1 + 1) * (SELECT sum(cnt) / sum(x1 + 1) FROM areas), 6) AS by_population FROM areas""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d).withColumn("pop", F.col("x1") + 1)
    h = D.constant_rate(a, "cnt", "hh").withColumnRenamed("rate", "rh")
    p = D.constant_rate(a, "cnt", "pop").withColumnRenamed("rate", "rp")
    return a.join(F.broadcast(h)).join(F.broadcast(p)).select(
        "id", F.round(F.col("hh") * F.col("rh"), 6).alias("by_households"),
        F.round(F.col("pop") * F.col("rp"), 6).alias("by_population"))


# ridge with one feature, in closed form
_RIDGE = f"""{_AREAS},
t AS (SELECT g AS held, count(*) AS n, sum(x1) AS sx, sum(x1 * x1) AS sxx, sum(hh) AS w, sum(hh * x1) AS wx,
  sum(hh * x1 * x1) AS wxx, sum(hh * ln(cnt / hh + 1)) AS wy, sum(hh * x1 * ln(cnt / hh + 1)) AS wxy
  FROM areas GROUP BY 1),
a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sxx) AS sxx, sum(w) AS w, sum(wx) AS wx, sum(wxx) AS wxx,
  sum(wy) AS wy, sum(wxy) AS wxy FROM t),
o AS (SELECT held, a.n - t.n AS n, a.sx - t.sx AS sx, a.sxx - t.sxx AS sxx, a.w - t.w AS w, a.wx - t.wx AS wx,
  a.wxx - t.wxx AS wxx, a.wy - t.wy AS wy, a.wxy - t.wxy AS wxy FROM t, a
  UNION ALL SELECT -1, n, sx, sxx, w, wx, wxx, wy, wxy FROM a),
p AS (SELECT held, sx / n AS m, sqrt(sxx / n - (sx / n) * (sx / n)) AS s, w, wx, wxx, wy, wxy FROM o),
b AS (SELECT held, m, s, (wx / w - m) / s AS zbar, wy / w AS ybar,
  ((wxy - wx * wy / w) / s) / ((wxx - wx * wx / w) / (s * s) + 1.0e0) AS beta FROM p)"""
_RIDGE_HAT = "greatest(0.0e0, exp(ybar + beta * ((x1 - m) / s - zbar)) - 1) * hh"


@query("ridge_log_rate", f"""
WITH {_RIDGE} SELECT id, round({_RIDGE_HAT}, 5) AS predicted FROM areas, b WHERE held = -1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d)
    return D.fit_counts(D.ridge_log_rate(), a, ["x1"], "cnt", "hh")(a).select(
        "id", F.round("predicted", 5).alias("predicted"))


@query("poisson_rate", f"""
WITH {_AREAS}, r AS (SELECT g % 2 AS b, sum(cnt) / sum(hh) AS rate FROM areas GROUP BY 1)
SELECT id, round(rate * hh, 3) AS predicted FROM areas JOIN r ON b = g % 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    # one indicator feature: the fitted rate of each side is its own mean
    a = areas(spark, d).withColumn("odd", (F.col("g") % 2).cast("double"))
    return D.fit_counts(D.poisson_rate(), a, ["odd"], "cnt", "hh")(a).select(
        "id", F.round("predicted", 3).alias("predicted"))


@query("boosted_rate")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d)
    return D.fit_counts(D.boosted_rate(), a, ["x1", "x2"], "cnt", "hh")(a).select(
        "id", "predicted")


# a single split in closed form: the score of a side moves by step * (its counts / fitted - 1)
@query("boosted_rate_indicator", f"""
WITH RECURSIVE {_AREAS}, side AS (SELECT g % 2 AS b, sum(cnt) AS c, sum(hh) AS e FROM areas GROUP BY 1),
boost(b, i, f) AS (SELECT b, 0, (SELECT ln(sum(c) / sum(e)) FROM side) FROM side
  UNION ALL SELECT boost.b, i + 1, f + 0.06e0 * (c / (e * exp(f)) - 1) FROM boost JOIN side ON side.b = boost.b WHERE i < 200)
SELECT id, round(exp(f) * hh, 4) AS predicted FROM areas JOIN boost ON b = g % 2 AND i = 200""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d).withColumn("odd", (F.col("g") % 2).cast("double"))
    return D.fit_counts(D.boosted_rate(), a, ["odd"], "cnt", "hh")(a).select(
        "id", F.round("predicted", 4).alias("predicted"))


_ST_RIDGE = _RIDGE.replace("SELECT g AS held", "SELECT st AS held")


def _poisson_folds(steps: int) -> str:
    """Reweighted least squares of every fold, one common table a step."""
    parts = ["""p0 AS MATERIALIZED (SELECT held, ln(sum(cnt) / sum(hh)) AS b0, 0.0e0 AS b1,
  1e-6 * sum(hh) * var_pop(x1) AS pen FROM areas, (SELECT DISTINCT st AS held FROM areas) h WHERE st <> held GROUP BY 1)"""]
    for i in range(steps):
        parts.append(f"""p{i + 1} AS MATERIALIZED (SELECT held, (t0 - s1 * (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1)) / s0 AS b0,
  (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1, pen FROM (
  SELECT held, any_value(pen) AS pen, sum(w) AS s0, sum(w * x1) AS s1, sum(w * x1 * x1) + any_value(pen) AS s2,
    sum(w * (eta - 1) + cnt) AS t0, sum((w * (eta - 1) + cnt) * x1) AS t1
  FROM (SELECT held, pen, x1, cnt, b0 + b1 * x1 AS eta, hh * exp(b0 + b1 * x1) AS w FROM p{i} JOIN areas ON st <> held)
  GROUP BY 1))""")
    return ",\n".join(parts)


_LOGO = f"""{_ST_RIDGE},
{_poisson_folds(12)},
rest AS (SELECT held, sum(cnt) / sum(hh) AS rate FROM areas JOIN (SELECT DISTINCT st AS held FROM areas) h ON st <> held GROUP BY 1),
hat AS (SELECT 'ridge_log_rate' AS estimator, st, cnt, {_RIDGE_HAT} AS p FROM areas JOIN b ON held = st
  UNION ALL SELECT 'poisson_glm', st, cnt, exp(b0 + b1 * x1) * hh FROM areas JOIN p12 ON held = st
  UNION ALL SELECT 'exposure_share', st, cnt, rate * hh FROM areas JOIN rest ON held = st),
tot AS (SELECT st, sum(cnt) + 10 AS t FROM areas GROUP BY 1),
modes AS (SELECT estimator, st, cnt, 'raw' AS mode, p FROM hat
         UNION ALL SELECT estimator, st, cnt, 'reconciled', p * t / sum(p) OVER (PARTITION BY estimator, st) FROM hat JOIN tot USING (st)),
sc AS (SELECT estimator, st, mode, sum(abs(cnt - p)) / sum(cnt) AS wape, avg(abs(cnt - p)) AS mae,
  sum(cnt) AS total FROM modes GROUP BY 1, 2, 3)"""


def fold_scores(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d)
    tot = a.groupBy("st").agg((F.sum("cnt") + 10).alias("total"))
    return D.leave_one_group_out(a, "st", ["x1"], "cnt", "hh", [
        D.baseline_rate(), D.ridge_log_rate(), D.poisson_rate()], tot)


@query("leave_one_group_out", f"""
WITH {_LOGO} SELECT estimator, st, mode, round(wape, 5) AS wape, round(mae, 5) AS mae FROM sc""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fold_scores(spark, d).select("estimator", "st", "mode", F.round("wape", 5).alias("wape"),
                                        F.round("mae", 5).alias("mae"))


_BASE = f"""{_AREAS},
gt AS (SELECT g, sum(cnt) AS c, sum(hh) AS e FROM areas GROUP BY 1),
hat AS (SELECT areas.*, hh * ((SELECT sum(c) FROM gt) - c) / ((SELECT sum(e) FROM gt) - e) AS p
        FROM areas JOIN gt USING (g)),
sc AS (SELECT 'exposure_share' AS estimator, 'raw' AS mode, g, count(*) AS n, sum(cnt) AS total,
  CASE WHEN sum(cnt) > 0 THEN sum(abs(cnt - p)) / sum(cnt) END AS wape, avg(abs(cnt - p)) AS mae,
  CASE WHEN var_pop(cnt) > 0 THEN 1 - sum((cnt - p) * (cnt - p)) / (var_pop(cnt) * count(*)) END AS r2
  FROM hat GROUP BY 3)"""


def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    hat = D.baseline_held_out(areas(spark, d), "g", "cnt", "hh")
    return D.error_metrics(hat, "cnt", "predicted", ["g"]).withColumns({
        "estimator": F.lit("exposure_share"), "mode": F.lit("raw")})


@query("baseline_held_out_metrics", f"""
WITH {_BASE} SELECT g, CAST(n AS BIGINT) AS n, total AS observed_total, round(wape, 5) AS wape,
  round(mae, 5) AS mae, round(r2, 5) AS r_squared FROM sc""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(baseline_scores(spark, d).drop("estimator", "mode"),
                         {"wape": 5, "mae": 5, "r_squared": 5})


@query("aggregate_excluding", f"""
WITH {_LOGO}, ag AS (SELECT estimator, mode, sum(wape * total) / sum(total) AS wape_all,
  sum(CASE WHEN st <> 1 THEN wape * total END) / sum(CASE WHEN st <> 1 THEN total END) AS wape_kept FROM sc GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY wape_all, estimator) AS ra,
  row_number() OVER (PARTITION BY mode ORDER BY wape_kept, estimator) AS rk FROM ag)
SELECT estimator, mode, round(wape_all, 6) AS wape_all, round(wape_kept, 6) AS wape_kept, CAST(ra AS INTEGER) AS rank_all,
  CAST(rk AS INTEGER) AS rank_kept, max(ra <> rk) OVER (PARTITION BY mode) AS order_changes FROM rk""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(D.aggregate_excluding(fold_scores(spark, d), "st", ["1"]),
                         {"wape_all": 6, "wape_kept": 6})


@query("select_estimator", """
WITH a AS (SELECT 'e' || n_nationkey AS estimator, (n_nationkey * 7 % 11) / 200.0e0 + 0.3e0 AS weighted_wape,
  CAST(n_nationkey % 4 AS INTEGER) AS rank FROM nation)
SELECT estimator, round(weighted_wape, 6) AS weighted_wape, rank FROM a
WHERE weighted_wape <= (SELECT min(weighted_wape) FROM a) + 0.0101e0
ORDER BY rank, weighted_wape, estimator LIMIT 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    n = read_table(spark, d, "nation", "n_nationkey")
    agg = n.select(F.concat(F.lit("e"), k.cast("string")).alias("estimator"),
                   ((k * 7 % 11) / 200.0 + 0.3).alias("weighted_wape"))
    ranks = n.select(F.concat(F.lit("e"), k.cast("string")).alias("estimator"),
                     (k % 4).cast("int").alias("rank"))
    return publish_round(D.select_estimator(agg, ranks, 0.0101), {"weighted_wape": 6})


@query("weighted_coarse_features", f"""
WITH {_AREAS} SELECT st, round(sum(x1 * hh) / sum(hh), 6) AS x1, round(sum(x2 * hh) / sum(hh), 6) AS x2,
  sum(hh) AS hh FROM areas GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(D.weighted_coarse_features(areas(spark, d), "st", ["x1", "x2"], "hh"),
                         {"x1": 6, "x2": 6})


@query("historical_surface", f"""
WITH {_AREAS}, c AS (SELECT st, sum(hh) AS e, sum(cnt) * 2 AS t FROM areas GROUP BY 1)
SELECT id, round(t * hh / e, 5) AS reconciled FROM areas JOIN c USING (st)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d)
    counts = a.groupBy("st").agg((F.sum("cnt") * 2).alias("cnt"))
    done = D.historical_surface(a.drop("cnt"), counts, "st", ["x1"], "hh", "cnt",
                                D.baseline_rate())
    return done.select("id", F.round("reconciled", 5).alias("reconciled"))


def _ridge_two(sets: str, extra: bool) -> str:
    """SQL for (held, b0, b1, b2) of the ridge on x1, and on x2 too where ``extra``; ``sets`` gives
    the pairs (held, training row)."""
    x2 = "x2" if extra else "0.0e0"
    return f"""SELECT held, ybar - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM (
  SELECT held, ybar, m1, m2, (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) AS b1,
         (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) AS b2 FROM (
    SELECT held, sum(hh * y) / sum(hh) AS ybar, sum(hh * x1) / sum(hh) AS m1, sum(hh * z) / sum(hh) AS m2,
      sum(hh * x1 * x1) - sum(hh * x1) * sum(hh * x1) / sum(hh) + var_pop(x1) AS a11,
      sum(hh * x1 * z) - sum(hh * x1) * sum(hh * z) / sum(hh) AS a12,
      sum(hh * z * z) - sum(hh * z) * sum(hh * z) / sum(hh) + {'var_pop(z)' if extra else '1.0e0'} AS a22,
      sum(hh * x1 * y) - sum(hh * x1) * sum(hh * y) / sum(hh) AS c1,
      sum(hh * z * y) - sum(hh * z) * sum(hh * y) / sum(hh) AS c2
    FROM (SELECT held, hh, x1, {x2} AS z, ln(cnt / hh + 1) AS y FROM {sets}) GROUP BY held))"""


def _ablation(label: str, extra: bool) -> str:
    line = "b0 + b1 * x1" + (" + b2 * x2" if extra else "")
    folds = "areas JOIN (SELECT DISTINCT st AS held FROM areas) h ON st <> held"
    whole = "(SELECT -1 AS held, * FROM areas)"
    hat = f"greatest(0.0e0, exp({line}) - 1) * hh"
    return f"""SELECT '{label}' AS features, round(weighted_wape, 5) AS weighted_wape, round(in_sample_wape, 5) AS in_sample_wape
  FROM (SELECT sum(abs(cnt - {hat})) / sum(cnt) AS weighted_wape FROM areas JOIN ({_ridge_two(folds, extra)}) ON held = st),
       (SELECT sum(abs(cnt - {hat})) / sum(cnt) AS in_sample_wape FROM areas, ({_ridge_two(whole, extra)}))"""


# errors weighted by counts add up to the error of all rows together
@query("supply_ablation", f"""
WITH {_AREAS} {_ablation('without', False)} UNION ALL {_ablation('with', True)}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    done = D.supply_ablation(areas(spark, d), "st", ["x1"], ["x2"], "cnt", "hh",
                             D.ridge_log_rate())
    return publish_round(done, {"weighted_wape": 5, "in_sample_wape": 5})


_TIMES = " + ".join(f"CASE WHEN u >= {p!r}e0 THEN 1 ELSE 0 END" for p in D._POISSON_STEPS)
_BOOTSTRAP = f"""{_AREAS},
dr AS (SELECT r, x1, hh, ln(cnt / hh + 1) AS y, CAST({_TIMES} AS DOUBLE) AS t FROM (
  SELECT *, CAST('0x' || substr(md5('20260101:' || r || ':' || id), 1, 8) AS BIGINT) / 4294967296.0e0 AS u
  FROM areas, range(40) AS q(r))),
mo AS (SELECT r, sum(t * x1) / sum(t) AS m, sum(t * x1 * x1) / sum(t) AS q, sum(t * hh) AS w, sum(t * hh * x1) AS wx,
  sum(t * hh * x1 * x1) AS wxx, sum(t * hh * y) AS wy, sum(t * hh * x1 * y) AS wxy FROM dr GROUP BY 1),
fi AS (SELECT r, (wxy - wx * wy / w) / (wxx - wx * wx / w + q - m * m) AS b1, w, wx, wy FROM mo),
pr AS (SELECT id, greatest(0.0e0, exp((wy - b1 * wx) / w + b1 * x1) - 1) * hh AS p FROM areas, fi)"""


@query("bootstrap_spread", f"""
WITH {_BOOTSTRAP} SELECT id, round((quantile_cont(p, 0.9) - quantile_cont(p, 0.1)) / 2, 6) AS half_width FROM pr GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d)
    return publish_round(D.bootstrap_spread(a, a, ["x1"], "cnt", "hh", "id"), {"half_width": 6})


_MAHA = f"""{_AREAS},
s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, covar_samp(x1, x1) AS a, covar_samp(x1, x2) AS b, covar_samp(x2, x2) AS c FROM areas WHERE st < 3),
q AS (SELECT m1, m2, a + r AS a, b, c + r AS c FROM (SELECT *, 1e-8 * (a + c) / 2 AS r FROM s)),
d AS (SELECT id, sqrt(greatest(0, (c * (x1 - m1) * (x1 - m1) - 2 * b * (x1 - m1) * (x2 - m2) + a * (x2 - m2) * (x2 - m2)) / (a * c - b * b))) AS dist
      FROM areas, q)"""


@query("mahalanobis_percentile", f"""
WITH {_MAHA} SELECT id, round(dist, 5) AS mahalanobis,
  round((row_number() OVER (ORDER BY dist, id) - 0.5e0) / count(*) OVER (), 6) AS out_of_distribution FROM d""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = areas(spark, d)
    out = U.mahalanobis_percentile(a.where("st < 3"), a, ["x1", "x2"], "id")
    return out.select("id", F.round("mahalanobis", 5).alias("mahalanobis"),
                      F.round("out_of_distribution", 6).alias("out_of_distribution"))


# --- uncertainty ----------------------------------------------------------------------------

_COMP_SQL = """comp AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'native_tract' WHEN 1 THEN 'county_anchored'
    ELSE 'state_total_only' END AS grain, (c_custkey % 101) / 100.0e0 AS c1, (c_custkey % 89) / 80.0e0 AS c2,
  (c_custkey % 53) / 53.0e0 AS c3, (c_custkey % 17) / 17.0e0 AS c4, (c_custkey % 2) / 4.0e0 AS c5 FROM customer),
sc AS (SELECT *, 0.2e0 * (least(1.0e0, c1) + least(1.0e0, c2) + least(1.0e0, c3) + least(1.0e0, c4) + least(1.0e0, c5)) AS score FROM comp)"""


def components(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    values = [(101, 100.0), (89, 80.0), (53, 53.0), (17, 17.0), (2, 4.0)]
    return read_table(spark, d, "customer", "c_custkey").select(
        k.alias("id"), F.when(k % 3 == 0, "native_tract").when(k % 3 == 1, "county_anchored")
        .otherwise("state_total_only").alias("grain"),
        *[((k % m) / q).alias(n) for (m, q), n in zip(values, U.COMPONENTS, strict=True)])


@query("combine_uncertainty", f"""
WITH {_COMP_SQL} SELECT id, round(score, 6) AS score FROM sc""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).select("id", F.round(U.combine_score(), 6).alias("score"))


@query("weight_sensitivity", f"""
WITH {_COMP_SQL}, m AS (SELECT avg(least(1.0e0, c1)) AS a, avg(least(1.0e0, c2)) AS b, avg(least(1.0e0, c3)) AS c,
  avg(least(1.0e0, c4)) AS d, avg(least(1.0e0, c5)) AS e FROM comp),
u AS (SELECT 'prediction_interval' AS component, a AS v FROM m UNION ALL SELECT 'out_of_distribution', b FROM m
  UNION ALL SELECT 'reconciliation_movement', c FROM m UNION ALL SELECT 'allocation_penalty', d FROM m
  UNION ALL SELECT 'source_degradation', e FROM m)
SELECT component, round((0.2e0 * (SELECT sum(v) FROM u) + 0.1e0 * v) / 1.1e0 - 0.2e0 * (SELECT sum(v) FROM u), 6) AS delta FROM u""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(U.weight_sensitivity(components(spark, d)), {"delta": 6})


@query("tiers", f"""
WITH {_COMP_SQL}, t AS (SELECT quantile_cont(score, 0.75) AS th FROM sc WHERE grain = 'state_total_only')
SELECT id, CASE WHEN grain <> 'state_total_only' THEN 'A' WHEN round(score, 9) >= round(th, 9) THEN 'C' ELSE 'B' END AS tier
FROM sc, t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    scored = components(spark, d).withColumn("score", F.round(U.combine_score(), 9))
    return U.with_tiers(scored, "score", "grain").select("id", "tier")


@query("quantile_threshold", f"""
WITH {_COMP_SQL} SELECT round(quantile_cont(score, 0.75), 6) AS threshold, CAST(count(*) AS BIGINT) AS n
FROM sc WHERE grain = 'state_total_only'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    scored = components(spark, d).withColumn("score", U.combine_score())
    return publish_round(U.quantile_threshold(scored, "score", "grain"), {"threshold": 6})


@query("allocation_penalty", """
SELECT c_custkey AS id, round(CASE c_custkey % 4 WHEN 0 THEN 0.0e0 WHEN 1 THEN least(1.0e0, 0.25e0 * CASE c_custkey % 3 WHEN 0 THEN 1.5e0 ELSE 1.0e0 END)
  WHEN 2 THEN least(1.0e0, 0.75e0 * CASE c_custkey % 3 WHEN 0 THEN 1.5e0 ELSE 1.0e0 END) END, 6) AS allocation_penalty
FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = read_table(spark, d, "customer", "c_custkey").select(
        k.alias("id"), F.concat(F.lit("g"), (k % 4).cast("string")).alias("grain"),
        F.concat(F.lit("b"), (k % 3).cast("string")).alias("band"))
    pen = spark.createDataFrame([("g0", 0.0), ("g1", 0.25), ("g2", 0.75)],
                                "grain string, base double")
    mult = spark.createDataFrame([("b0", 1.5)], "band string, multiplier double")
    return U.allocation_penalty(rows, pen, mult).select(
        "id", F.round("allocation_penalty", 6).alias("allocation_penalty"))


@query("calibration_bins", f"""
WITH {_COMP_SQL}, b AS (SELECT ntile(5) OVER (ORDER BY round(score, 9), id) - 1 AS bin, score, c3 FROM sc)
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(score), 6) AS mean_score,
       round(avg(c3), 6) AS mean_error FROM b GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    scored = components(spark, d).withColumn("score", F.round(U.combine_score(), 9))
    return publish_round(W.equal_count_bins(scored, "score", "reconciliation_movement", "id"),
                         {"mean_score": 6, "mean_error": 6})


@query("weighted_mean", f"""
WITH {_AREAS} SELECT g, round(CASE WHEN sum(hh) > 0 THEN sum(x2 * hh) / sum(hh) ELSE 0 END, 6) AS mean_x2
FROM areas GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return areas(spark, d).groupBy("g").agg(F.round(F.when(
        F.sum("hh") > 0, F.sum(F.col("x2") * F.col("hh")) / F.sum("hh")).otherwise(0.0), 6)
        .alias("mean_x2"))


def surface(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = areas(spark, d)
    rows = a.select(F.col("id").alias("area"), F.col("g").alias("county"),
                    F.col("st").alias("state"), "hh", "x1", "x2", "cnt")
    native = rows.where("state = 0 AND area % 3 = 0").select(
        "area", F.col("cnt").alias("observed"))
    states = read_table(spark, d, "region", "r_regionkey").where("r_regionkey = 0").select(
        F.col("r_regionkey").alias("state"))
    county = rows.where("county % 4 = 0").groupBy("county", "state").agg(
        F.sum("cnt").alias("total"))
    state = rows.groupBy("state").agg((F.sum("cnt") * 1.1).alias("total"))
    pen = spark.createDataFrame(
        [("native_tract", 0.0), ("county_anchored", 0.18), ("state_total_only", 0.26)],
        "grain string, base double")
    # the interval is bootstrapped from the training rows, named by their area
    return SF.build_surface(rows.drop("cnt"), rows, ["x1"], "cnt", "hh",
                            ("area", "county", "state"), D.ridge_log_rate(), native, states,
                            county, state, pen, 0.1)


_SURFACE = f"""{_RIDGE}, {_BOOTSTRAP.removeprefix(_AREAS + ",")},
hw AS (SELECT id, (quantile_cont(p, 0.9) - quantile_cont(p, 0.1)) / 2 AS hw FROM pr GROUP BY 1),
ct AS (SELECT g, st, sum(cnt) AS total FROM areas WHERE g % 4 = 0 GROUP BY 1, 2),
su AS (SELECT st, sum(cnt) * 1.1e0 AS total, coalesce((SELECT sum(total) FROM ct WHERE ct.st = areas.st), 0) AS claimed FROM areas GROUP BY 1),
bo AS (SELECT id, areas.g, areas.st, cnt, x1, {_RIDGE_HAT} AS raw,
  CASE WHEN areas.st = 0 AND id % 3 = 0 THEN 'tract:' || id WHEN areas.st = 0 THEN 'zero:' || areas.st WHEN areas.g % 4 = 0 THEN 'county:' || areas.g
    ELSE 'residual:' || areas.st END AS con,
  CASE WHEN areas.st = 0 THEN 'native_tract' WHEN areas.g % 4 = 0 THEN 'county_anchored' ELSE 'state_total_only' END AS grain,
  CASE WHEN areas.st = 0 AND id % 3 = 0 THEN 'native_registry_observed_count' WHEN areas.st = 0 THEN 'native_registry_zero_by_absence' ELSE 'modeled_reconciled' END AS prov,
  CASE WHEN areas.st = 0 AND id % 3 = 0 THEN cnt WHEN areas.st = 0 THEN 0 WHEN areas.g % 4 = 0 THEN ct.total ELSE su.total - claimed END AS total
  FROM areas JOIN b ON held = -1 LEFT JOIN ct ON ct.g = areas.g LEFT JOIN su ON su.st = areas.st),
re AS (SELECT *, CASE WHEN sum(raw) OVER (PARTITION BY con) > 0 THEN raw * (total / sum(raw) OVER (PARTITION BY con))
    ELSE total / count(*) OVER (PARTITION BY con) END AS rec,
  (row_number() OVER (ORDER BY abs(x1 - (SELECT avg(x1) FROM areas)), id) - 0.5e0) / count(*) OVER () AS ood FROM bo),
scored AS (SELECT re.*, 0.2e0 * (least(1.0e0, greatest(0.0e0, hw / (hw + greatest(raw, 1.0e0)))) + ood
    + least(1.0e0, abs(rec - raw) / (rec + raw + 1)) + CASE grain WHEN 'native_tract' THEN 0.0e0 WHEN 'county_anchored' THEN 0.18e0 ELSE 0.26e0 END + 0.1e0) AS score
  FROM re JOIN hw USING (id)),
surf AS (SELECT *, CASE WHEN grain <> 'state_total_only' THEN 'A' WHEN score >= (SELECT quantile_cont(score, 0.75) FROM scored WHERE grain = 'state_total_only')
    THEN 'C' ELSE 'B' END AS tier FROM scored)"""


@query("build_surface", f"""
WITH {_SURFACE} SELECT id AS area, con AS "constraint", grain, round(rec, 5) AS reconciled, round(score, 6) AS uncertainty_score,
  tier, prov AS provenance FROM surf""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, _totals = surface(spark, d)
    return publish_round(s.select("area", "constraint", "grain", "reconciled", "uncertainty_score",
                                  "tier", "provenance"), {"reconciled": 5, "uncertainty_score": 6})


@query("surface_summary", f"""
WITH {_SURFACE}, l AS (SELECT 'grain' AS dimension, grain AS category, rec, score FROM surf
  UNION ALL SELECT 'tier', tier, rec, score FROM surf UNION ALL SELECT 'provenance', prov, rec, score FROM surf
  UNION ALL SELECT 'all', 'all', rec, score FROM surf)
SELECT dimension, category, CAST(count(*) AS BIGINT) AS rows, round(sum(rec), 4) AS total, round(avg(score), 6) AS mean_uncertainty
FROM l GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, _totals = surface(spark, d)
    return publish_round(SF.surface_summary(s), {"total": 4, "mean_uncertainty": 6})


@query("evidence_summary", f"""
WITH {_AREAS}, t AS (SELECT hh, x1 / 23.0e0 AS anchored, CASE WHEN g % 2 = 0 THEN 'county_anchored' ELSE 'state_total_only' END AS grain,
  CASE WHEN st < 2 THEN 'A' ELSE 'B' END AS tier FROM areas)
SELECT 'grain' AS dimension, grain AS category, sum(hh) AS value FROM t GROUP BY 2
UNION ALL SELECT 'tier', tier, sum(hh) FROM t GROUP BY 2
UNION ALL SELECT 'total', 'all', sum(hh) FROM t
UNION ALL SELECT 'anchored_share', 'all', round(sum(hh * anchored) / sum(hh), 6) FROM t""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = areas(spark, d).select(
        "hh", (F.col("x1") / 23.0).alias("anchored"),
        F.when(F.col("g") % 2 == 0, "county_anchored").otherwise("state_total_only").alias("grain"),
        F.when(F.col("st") < 2, "A").otherwise("B").alias("tier"))
    return publish_round(SF.evidence_summary(t, "hh", "anchored", "grain", "tier"), {"value": 6})


# --- backtest ---------------------------------------------------------------------------------

_BACK = """cells AS (SELECT c_custkey AS cell, CAST(c_custkey * 37 % 101 AS DOUBLE) AS demand, c_custkey % 97 AS population,
    CAST(c_custkey % 6 AS DOUBLE) AS prior FROM customer),
sup AS (SELECT * FROM cells WHERE population >= 1),
dep AS (SELECT o_custkey AS cell, count(*) AS stations, sum(1 + o_orderkey % 4) AS ports FROM orders
  WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1),
rk AS (SELECT 'model' AS ranking, cell, row_number() OVER (ORDER BY demand DESC, cell) AS r FROM sup
  UNION ALL SELECT 'population', cell, row_number() OVER (ORDER BY population DESC, cell) FROM sup
  UNION ALL SELECT 'existing_network', cell, row_number() OVER (ORDER BY prior DESC, cell) FROM sup),
k AS (SELECT i / 10.0e0 AS decile, CAST(round_even(i / 10.0e0 * (SELECT count(*) FROM sup), 0) AS BIGINT) AS cells FROM range(1, 11) t(i)),
cur AS (SELECT ranking, decile, any_value(cells) AS cells,
  sum(CASE WHEN r <= cells THEN coalesce(stations, 0) ELSE 0 END) / CAST((SELECT sum(stations) FROM dep) AS DOUBLE) AS stations_captured,
  sum(CASE WHEN r <= cells THEN coalesce(ports, 0) ELSE 0 END) / CAST((SELECT sum(ports) FROM dep) AS DOUBLE) AS ports_captured
  FROM rk CROSS JOIN k LEFT JOIN dep USING (cell) GROUP BY 1, 2)"""


def backtest_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    cells = read_table(spark, d, "customer", "c_custkey").select(
        k.alias("cell"), (k * 37 % 101).cast("double").alias("demand"),
        (k % 97).alias("population"), (k % 6).cast("double").alias("prior"))
    dep = read_table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate").select(
        F.col("o_custkey").alias("cell"), F.lit(1).alias("stations"),
        (1 + F.col("o_orderkey") % 4).alias("ports"), F.col("o_orderdate").alias("opened"))
    return cells, dep


def backtest(spark: SparkSession, d: str) -> DataFrame:
    cells, dep = backtest_inputs(spark, d)
    return SF.align_origin(cells, dep, "cell", "demand", "population", "prior", "opened",
                           "1998-01-01", ["stations", "ports"])


@query("align_origin", f"""
WITH {_BACK} SELECT ranking, decile, cells, round(stations_captured, 6) AS stations_captured,
  round(ports_captured, 6) AS ports_captured FROM cur""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(backtest(spark, d), {"stations_captured": 6, "ports_captured": 6})


@query("origin_lift", f"""
WITH {_BACK}, t AS (SELECT * FROM cur WHERE decile = 0.1e0)
SELECT b.ranking, round(m.stations_captured / b.stations_captured, 6) AS lift FROM t b, t m
WHERE m.ranking = 'model' AND b.ranking <> 'model'""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return publish_round(SF.lift_table(backtest(spark, d), "stations_captured"), {"lift": 6})


@query("origin_support", f"""
WITH {_BACK} SELECT CAST((SELECT count(*) FROM cells) AS BIGINT) AS cells_with_demand,
  CAST((SELECT count(*) FROM sup) AS BIGINT) AS ranked_cells, CAST(sum(stations) AS BIGINT) AS deployments,
  round(sum(CASE WHEN cell IN (SELECT cell FROM sup) THEN stations ELSE 0 END) / CAST(sum(stations) AS DOUBLE), 6) AS share_inside FROM dep""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells, dep = backtest_inputs(spark, d)
    return publish_round(SF.origin_support(cells, dep, "cell", "population", "opened",
                                           "1998-01-01"), {"share_inside": 6})


@query("random_baseline", f"""
WITH {_BACK}, sd AS (SELECT 1998 AS s UNION ALL SELECT 1998 * 100003 + i FROM range(200) t(i)),
gr AS (SELECT sup.cell, coalesce(stations, 0) AS w, substr(md5(CAST(sup.cell AS VARCHAR)), 1, 3) AS g FROM sup LEFT JOIN dep ON dep.cell = sup.cell),
ra AS (SELECT s, w, row_number() OVER (PARTITION BY s ORDER BY substr(md5(s || ':' || g), 1, 13), g, substr(md5(s || ':' || cell), 1, 13), cell) AS r FROM gr, sd),
cp AS (SELECT s, sum(CASE WHEN r <= (SELECT round_even(count(*) * 0.1e0, 0) FROM sup) THEN w ELSE 0 END) / CAST((SELECT sum(stations) FROM dep) AS DOUBLE) AS c FROM ra GROUP BY 1),
one AS (SELECT c AS v FROM cp WHERE s = 1998)
SELECT CAST(count(*) AS BIGINT) AS draws, round(avg(c), 9) AS mean, round(stddev_pop(c), 9) AS standard_deviation, round(quantile_cont(c, 0.05), 9) AS p5,
  round(quantile_cont(c, 0.95), 9) AS p95, round(max(v), 9) AS single_draw, round(avg(CASE WHEN c < v THEN 1.0e0 ELSE 0.0e0 END), 9) AS single_draw_percentile
FROM cp, one WHERE s <> 1998""")
def _(spark: SparkSession, d: str) -> DataFrame:
    cells, dep = backtest_inputs(spark, d)
    targets = dep.where(W.event_window("opened", "1998-01-01", 24)).groupBy("cell").agg(
        F.sum("stations").cast("double").alias("stations"))
    drawn = W.random_baseline(cells.where("population >= 1"), targets, "cell", "stations", 1998)
    return publish_round(drawn, {c: 9 for c in drawn.columns if c != "draws"})
