"""Queries over quality gates, screens, rankings and published artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.functions.clean import publish_round
from siteplan_spark.operators import quality as Q
from siteplan_spark.operators import ranking as W
from siteplan_spark.plans.registry import query
from siteplan_spark.sources.sinks import build_manifest
from siteplan_spark.sources.tables import population_points, read_table, units

_FP_COLS = {"nation": ["n_name", "n_nationkey", "n_regionkey"],
            "part": ["p_brand", "p_name", "p_partkey", "p_size", "p_type"],
            "customer": ["c_custkey", "c_mktsegment", "c_name", "c_nationkey"]}


def _fp_sql(table: str, vintages: str = "") -> str:
    cols = _FP_COLS[table]
    text = " || chr(1) || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    head = ",".join(cols) + "|" + vintages
    return f"""SELECT '{table}' AS artifact, CAST(count(*) AS BIGINT) AS rows, sha256('{head}' || '|' || count(*) || '|'
  || CAST(sum(CAST(CAST('0x' || substr(h, 1, 15) AS UBIGINT) AS HUGEINT)) AS VARCHAR) || '|'
  || CAST(sum(CAST(CAST('0x' || substr(h, 16, 15) AS UBIGINT) AS HUGEINT)) AS VARCHAR)) AS fingerprint
FROM (SELECT sha256({text}) AS h FROM {table})"""


@query("table_fingerprint", " UNION ALL ".join(_fp_sql(t) for t in _FP_COLS))
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = [Q.table_fingerprint(read_table(spark, d, t, *cols)).select(
        F.lit(t).alias("artifact"), "rows", "fingerprint") for t, cols in _FP_COLS.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("build_manifest", _fp_sql("nation", "orders=2001"))
def _(spark: SparkSession, d: str) -> DataFrame:
    m = build_manifest({"nation": read_table(spark, d, "nation")}, {"orders": "2001"},
                       "2026-01-01T00:00:00Z")
    return m.select("artifact", "rows", "fingerprint")


@query("validate_table", """
SELECT 'null:power' AS rule, CAST(sum(CASE WHEN l_orderkey % 101 <> 0 AND l_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM lineitem
UNION ALL SELECT 'range:power', CAST(sum(CASE WHEN l_orderkey % 101 = 0 THEN 1 WHEN l_orderkey % 5 = 0 THEN 0 WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem
UNION ALL SELECT 'enum:network', CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) FROM lineitem
UNION ALL SELECT 'unique:unit_order+unit_line', CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) FROM lineitem
UNION ALL SELECT 'missing:absent', CAST(1 AS BIGINT)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Q.validate_table(units(spark, d), Q.Constraints(
        columns=["unit_order", "absent"], not_null=["power", "unit_order"],
        ranges={"power": (0.5, 45.0), "ports": (1, 2)}, enums={"network": ["A", "N"]},
        unique=[["unit_order", "unit_line"]]))


@query("lossless_check", """
SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS rows_in, CAST((SELECT count(*) FROM orders) AS BIGINT) AS rows_out,
  true AS lossless""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    staged = o.select(*[F.col(c).cast("string").alias(c) for c in o.columns])
    return Q.lossless_check(staged, o)


@query("column_profile", """
WITH e AS (SELECT 'event_id' AS field, 0 AS m FROM events UNION ALL
  SELECT 'note', CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END FROM events UNION ALL
  SELECT 'event_type', 0 FROM events)
SELECT CAST(count(*) AS BIGINT) AS rows, field, CAST(sum(m) AS BIGINT) AS missing, round(avg(m), 6) AS missing_share,
  sha256('["event_id","event_type","note"]') AS schema_hash FROM e GROUP BY 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events", "event_id", "event_type").withColumn(
        "note", F.when(F.col("event_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, " NULL "))
        .otherwise("x"))
    return publish_round(Q.column_profile(e), {"missing_share": 6})


@query("drift_report", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(900 AS INTEGER) AS low, CAST(22000 AS INTEGER) AS high,
  count(*) BETWEEN 900 AND 22000 AS in_tolerance, true AS schema_changed FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders")
    rows = o.select("o_orderkey").agg(F.count(F.lit(1)).alias("rows"))
    return Q.drift_report(rows, 1000, 20000, 0.1, "0" * 64, Q.schema_hash(o.columns))


@query("registration_checks", """
WITH c AS (SELECT n_name AS k, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey <> 3 GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS areas_present, CAST(1 AS BIGINT) AS stray_total_rows, CAST(0 AS BIGINT) AS negative_areas,
  CAST(sum(n) AS BIGINT) AS sum_of_areas, CAST((SELECT count(*) FROM nation) - count(*) AS BIGINT) AS missing_areas,
  true AS vintage_resolved, false AS coverage_complete, true AS all_non_negative, sum(n) = 1234 AS total_reconciles FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("k"))
    c = read_table(spark, d, "customer", "c_nationkey").where("c_nationkey <> 3").join(
        n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("n")).select(F.lit("Total").alias("k"), "n")
    return Q.registration_checks(c.unionByName(total), "k", "n", n, 1234, "2024")


@query("confidence_needs_defects", """
SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'low_confidence' ELSE 'ok' END AS confidence FROM supplier""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "supplier", "s_suppkey").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0).alias("defects"),
        F.lit(3).alias("flags"))
    return s.select("s_suppkey", Q.assign_confidence("defects", "flags").alias("confidence"))


@query("zscore_screen", """
WITH s AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_extendedprice - m) / sd, 6) AS zscore
FROM lineitem, s WHERE abs((l_extendedprice - m) / sd) > 1.70001e0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey",
                      "l_suppkey", "l_extendedprice")
    return W.zscore_screen(rows, "l_extendedprice", 1.70001).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round("zscore", 6).alias("zscore"))


@query("yoy_screen", """
WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT k, CAST(b.n AS BIGINT) AS n, CAST(a.n AS BIGINT) AS before, round(b.n / CAST(a.n AS DOUBLE), 6) AS growth
FROM b JOIN a USING (k) WHERE b.n / CAST(a.n AS DOUBLE) > 2.51e0 OR b.n / CAST(a.n AS DOUBLE) < 1 / 2.51e0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_custkey", "o_orderdate")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    def count(rows):
        return rows.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return publish_round(W.yoy_screen(count(o.where(F.col("o_orderdate") >= cut)),
                                      count(o.where(F.col("o_orderdate") < cut)),
                                      "k", "n", 2.51), {"growth": 6})


@query("per_capita_screen", """
WITH r AS (SELECT o_custkey AS k, count(*) / CAST(1 + o_custkey % 97 AS DOUBLE) AS rate FROM orders GROUP BY o_custkey),
s AS (SELECT avg(rate) AS m, stddev_pop(rate) AS sd FROM r)
SELECT k, round(rate, 6) AS rate, round((rate - m) / sd, 5) AS zscore FROM r, s WHERE abs((rate - m) / sd) > 3.00001e0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = read_table(spark, d, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n")).select(
        "k", (F.col("n") / (1 + F.col("k") % 97)).alias("rate"))
    return publish_round(W.zscore_screen(r, "rate", 3.00001), {"rate": 6, "zscore": 5})


# --- rankings -------------------------------------------------------------------------------

@query("rank_desc", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rank FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return W.rank_desc(o, "o_orderkey", "o_totalprice").select("o_orderkey", "rank")


@query("rank_within_group", """
SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT)
  AS rank FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return W.group_rank(o, ["o_orderstatus"], [F.desc("o_totalprice"), "o_orderkey"]).select(
        "o_orderkey", "o_orderstatus", "rank")


@query("gain_curve", """
WITH r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part),
t AS (SELECT l_partkey AS id, count(*) AS items, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
k AS (SELECT i / 10.0e0 AS decile, CAST(round_even(i / 10.0e0 * (SELECT count(*) FROM r), 0) AS BIGINT) AS cells FROM range(1, 11) x(i))
SELECT decile, cells, round(sum(CASE WHEN rn <= cells THEN items ELSE 0 END) / CAST((SELECT sum(items) FROM t) AS DOUBLE), 6) AS items_captured,
  round(sum(CASE WHEN rn <= cells THEN qty ELSE 0 END) / CAST((SELECT sum(qty) FROM t) AS DOUBLE), 6) AS qty_captured
FROM k, r LEFT JOIN t USING (id) GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_partkey", "p_retailprice").select(
        F.col("p_partkey").alias("id"), "p_retailprice")
    t = read_table(spark, d, "lineitem", "l_partkey", "l_quantity").groupBy(
        F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("items"),
                                            F.sum("l_quantity").alias("qty"))
    ranked = W.rank_desc(p, "id", "p_retailprice")
    return publish_round(W.gain_curve(ranked, t, "id", "rank", ["items", "qty"]),
                         {"items_captured": 6, "qty_captured": 6})


@query("lift_ratio", """
SELECT n_nationkey, CASE WHEN n_nationkey % 4 > 0 THEN (n_nationkey % 3) / CAST(n_nationkey % 4 AS DOUBLE)
  WHEN n_nationkey % 3 > 0 THEN 'Infinity'::DOUBLE ELSE 1.0e0 END AS lift FROM nation""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read_table(spark, d, "nation", "n_nationkey").select(
        "n_nationkey", W.lift((k % 3).cast("double"), (k % 4).cast("double")).alias("lift"))


@query("percentile_below", """
SELECT o_orderkey, round((rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1)
  / CAST(count(*) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 8) AS percentile FROM orders""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return W.percentile_below(o, ["o_orderstatus"], "o_totalprice").select(
        "o_orderkey", F.round("percentile", 8).alias("percentile"))


@query("midrank_percentile", """
SELECT c_custkey, round((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 0.5e0) / count(*) OVER (), 8) AS percentile FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer", "c_custkey", "c_acctbal")
    return W.midrank_percentile(c, "c_acctbal", "c_custkey").select(
        "c_custkey", F.round("percentile", 8).alias("percentile"))


@query("equal_count_bins", """
WITH b AS (SELECT ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS bin, o_totalprice, o_orderkey FROM orders)
SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 3) AS mean_score,
  round(avg(o_orderkey % 13), 4) AS mean_error FROM b GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderkey", "o_totalprice").withColumn(
        "err", (F.col("o_orderkey") % 13).cast("double"))
    return publish_round(W.equal_count_bins(o, "o_totalprice", "err", "o_orderkey", 7),
                         {"mean_score": 3, "mean_error": 4})


_OBJ = """s AS (SELECT 'p' || n_regionkey AS name, o AS objective, CAST(sum((n_nationkey * (o + 3)) % 17) AS DOUBLE) AS score
  FROM nation, range(0, 4) t(o) GROUP BY 1, 2)"""


def _objective_scores(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "nation", "n_nationkey", "n_regionkey").select(
        F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("name"), "n_nationkey",
        F.explode(F.expr("sequence(0L, 3L)")).alias("objective")).groupBy(
        "name", "objective").agg(F.sum((F.col("n_nationkey") * (F.col("objective") + 3)) % 17)
                                 .cast("double").alias("score"))


@query("relative_to_best", f"""
WITH {_OBJ} SELECT name, objective, round(score / max(score) OVER w, 6) AS relative,
  score / max(score) OVER w < 0.95e0 AS is_tradeoff FROM s WINDOW w AS (PARTITION BY objective)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.relative_to_best(_objective_scores(spark, d), "objective", "score").select(
        "name", "objective", F.round("relative", 6).alias("relative"), "is_tradeoff")


@query("best_on_objective", f"""
WITH {_OBJ} SELECT objective, arg_min(name, (-score, name)) AS winner, max(score) AS best_score FROM s GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.best_on(_objective_scores(spark, d), "objective", "name", "score")


@query("top_category_hit", """
WITH o AS (SELECT c_nationkey AS a, c_mktsegment AS c, count(*) AS w FROM customer GROUP BY 1, 2),
e AS (SELECT c_nationkey AS a, c_mktsegment AS c, sum(c_acctbal) AS w FROM customer GROUP BY 1, 2),
x AS (SELECT a, arg_min(c, (-w, c)) AS observed_top FROM o GROUP BY 1), y AS (SELECT a, arg_min(c, (-w, c)) AS estimated_top FROM e GROUP BY 1)
SELECT a, observed_top, estimated_top, observed_top = estimated_top AS hit FROM x JOIN y USING (a)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "customer", "c_nationkey", "c_mktsegment", "c_acctbal").groupBy(
        F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("c")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    return W.top_category_hit(g.select("a", "c", F.col("n").alias("w")),
                              g.select("a", "c", F.col("s").alias("w")), "a", "c", "w")


@query("complexity_bands", """
WITH g AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)
SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 3 THEN '2-3' WHEN n <= 7 THEN '4-7' ELSE '8+' END AS band,
  CAST(count(*) AS BIGINT) AS orders_n, CAST(sum(n) AS BIGINT) AS touched FROM g GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = read_table(spark, d, "lineitem", "l_orderkey", "l_suppkey").distinct().groupBy(
        "l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(W.complexity_band("n").alias("band")).agg(
        F.count(F.lit(1)).alias("orders_n"), F.sum("n").alias("touched"))


@query("top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return W.top_k(read_table(spark, d, "orders", "o_orderkey", "o_totalprice"), 25,
                   "o_totalprice", "o_orderkey")


@query("top_k_per_group", """
SELECT o_orderpriority, o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER
  (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 10""")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders", "o_orderpriority", "o_orderkey", "o_totalprice")
    return W.top_k_per_group(o, ["o_orderpriority"], 10, "o_totalprice", "o_orderkey").select(
        "o_orderpriority", "o_orderkey", "rank")


@query("deterministic_publish_order", """
SELECT p_brand, p_type, p_partkey, CAST(row_number() OVER (ORDER BY p_brand, p_type, p_partkey) AS BIGINT) AS position FROM part""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part", "p_brand", "p_type", "p_partkey")
    return W.global_rank(p, ["p_brand", "p_type", "p_partkey"], "position")


@query("seeded_random_order", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) * (count(*) + 1) // 2 AS BIGINT) AS rank_sum FROM customer""")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = population_points(spark, d).select("point_id", W.random_order("point_id", 11).alias("h"))
    return W.global_rank(p, ["h", "point_id"]).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rank").alias("rank_sum"))


@query("exact_group_median", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(median(l_extendedprice), 4) AS median
FROM lineitem GROUP BY 1, 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    from siteplan_spark.operators.quantiles import group_median
    rows = read_table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice")
    return publish_round(group_median(rows, ["l_returnflag", "l_linestatus"],
                                      "l_extendedprice"), {"median": 4})


@query("provenance_violations", """
SELECT rule, CAST(sum(v) AS BIGINT) AS violations FROM (
  SELECT 'empty:shares' AS rule, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS v FROM supplier UNION ALL
  SELECT 'sum:shares', CASE WHEN s_suppkey % 7 <> 0 AND s_suppkey % 11 = 0 THEN 1 ELSE 0 END FROM supplier UNION ALL
  SELECT 'missing:score', CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END FROM supplier) GROUP BY 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = read_table(spark, d, "supplier", "s_suppkey").select(
        F.when(k % 7 == 0, F.expr("cast(map() AS map<string, double>)")).otherwise(F.create_map(
            F.lit("a"), F.lit(0.25), F.lit("b"), F.when(k % 11 == 0, 0.5).otherwise(0.75)))
        .alias("shares"), F.when(k % 13 != 0, 0.1).alias("score"))
    return Q.provenance_violations(rows, ["shares"], ["score"])
