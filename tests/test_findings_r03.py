"""Cases of the findings of round 3."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siteplan_spark.llm import filter_audit
from siteplan_spark.operators import access as A
from siteplan_spark.operators import quality as Q
from siteplan_spark.operators import spatial as SP
from tests.test_spatial import crowded, hav, points


def test_focus_summary_without_any_cell_counts_zero(spark):
    none = spark.createDataFrame([], "cell long, population long, points long, km double")
    summary, rolled = A.focus_and_context(none, "population", "cell", 3, F.col("cell") % 2)
    assert [tuple(r) for r in summary.collect()] == [(None, 0, None)]
    assert rolled.count() == 0


def test_conservation_error_is_not_the_rounding_of_many_additions(spark):
    before = spark.createDataFrame([(1, 100000.0), (2, 100000.0), (None, 5.0)], "g long, v double")
    after = spark.range(2_000_000).select((1 + F.col("id") % 2).alias("g"), F.lit(0.1).alias("v"))
    left = spark.createDataFrame([(None, 5.0)], "g long, v double")
    whole = Q.conservation_error(before, after, left, "v").first()
    assert whole["mass_in"] == 200005.0 and whole["mass_unallocated"] == 5.0
    assert whole["mass_out"] == pytest.approx(200000.0, abs=1e-10) and whole["error"] < 1e-10
    by = {r["g"]: r for r in Q.conservation_error(before, after, left, "v", ["g"]).collect()}
    assert set(by) == {1, 2, None} and all(r["error"] < 1e-10 for r in by.values())


def test_conservation_error_of_no_rows_and_of_values_without_a_sum(spark):
    none = spark.createDataFrame([], "v double")
    one = spark.createDataFrame([(3.0,), (None,)], "v double")
    assert tuple(Q.conservation_error(none, none, none, "v").first()) == (0.0, 0.0, 0.0, 0.0)
    assert tuple(Q.conservation_error(one, none, one, "v").first()) == (3.0, 0.0, 3.0, 0.0)
    endless = spark.createDataFrame([(float("inf"),), (1.0,)], "v double")
    assert Q.conservation_error(endless, one, none, "v").first()["mass_in"] == float("inf")


@pytest.mark.parametrize("eps", [0.0, 30.0, 120_500.0, 5e6])
def test_distance_band_join_is_spread_over_tasks_and_exact(spark, tmp_path, eps):
    left, right = crowded(90, 5), crowded(60, 6)
    for name, rows in (("left", left), ("right", right)):
        points(spark, rows).write.parquet(f"{tmp_path}/{name}")
    got = SP.distance_band_join(
        spark.read.parquet(f"{tmp_path}/left"),
        spark.read.parquet(f"{tmp_path}/right").withColumnRenamed("id", "rid"), eps)
    # small files with many pairs must not be one broadcast and one task
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.columns == ["id", "lat", "lon", "rid", "distance_m"]
    found = {(r["id"], r["rid"]): r["distance_m"] for r in got.collect()}
    want = {(i, j): hav(a, o, b, p) for i, a, o in left for j, b, p in right}
    assert set(found) == {k for k, d in want.items() if d <= eps}
    assert all(d == pytest.approx(want[k], abs=1e-3) for k, d in found.items())


def _foot(a, o, s):
    _, a1, o1, a2, o2 = s
    k = math.cos(math.radians(a))
    dx, dy = (o2 - o1) * k, a2 - a1
    n = dx * dx + dy * dy
    t = 0 if n == 0 else max(0, min(1, ((o - o1) * k * dx + (a - a1) * dy) / n))
    return hav(a, o, a1 + t * (a2 - a1), o1 + t * (o2 - o1))


def test_long_segments_are_candidates_near_their_course_only(spark, monkeypatch):
    rnd = random.Random(8)
    segs = [(i, a, o, a + 0.9, o + 0.6) for i, (a, o) in enumerate(
        (rnd.uniform(40, 44), rnd.uniform(-100, -95)) for _ in range(600))]
    rows = [(i, rnd.uniform(40, 44), rnd.uniform(-100, -95)) for i in range(200)]
    rows += [(1000 + i, *rows[0][1:]) for i in range(3000)]  # one crowded place
    offered = []
    candidate_pairs = SP._candidate_pairs

    def counted(*args):
        pairs = candidate_pairs(*args)
        offered.append((args[0].count(), pairs.count()))
        return pairs
    monkeypatch.setattr(SP, "_candidate_pairs", counted)
    got = {r["id"]: r["distance_m"] for r in SP.nearest_segment_join(
        points(spark, rows), spark.createDataFrame(
            segs, "sid long, lat1 double, lon1 double, lat2 double, lon2 double"), "sid").collect()}
    assert len(got) == len(rows)
    for i, a, o in rows[:200]:
        assert got[i] == pytest.approx(min(_foot(a, o, s) for s in segs), abs=1e-3)
    assert all(got[1000 + i] == got[0] for i in range(3000))
    assert offered[0][0] == 200 and offered[0][1] < 200 * len(segs) / 10


def test_segments_of_any_length_anywhere_match_the_formula(spark):
    rnd = random.Random(9)
    segs = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(30)]
    segs = [(i, a, o, max(-90.0, min(90.0, a + rnd.uniform(-40, 40) * (i % 3))),
             max(-180.0, min(180.0, o + rnd.uniform(-60, 60) * (i % 3)))) for i, a, o in segs]
    rows = crowded(90, 10) + [(900 + i, 89.0 - 30 * (i % 6), 179.9 - 0.1 * i) for i in range(30)]
    got = {r["id"]: r["distance_m"] for r in SP.nearest_segment_join(
        points(spark, rows), spark.createDataFrame(
            segs + [(99, None, 0.0, 1.0, 1.0)],
            "sid long, lat1 double, lon1 double, lat2 double, lon2 double"), "sid").collect()}
    for i, a, o in rows:
        assert got[i] == pytest.approx(min(_foot(a, o, s) for s in segs), abs=1e-2)


def test_filter_audit_needs_two_joins_for_each_filter(spark, monkeypatch):
    rows = [(i, "a", 1, 0, 0) for i in range(40)]
    universe = spark.createDataFrame(rows, "k long, part string, n long, good int, toxic int")
    failing = {name: universe.where(F.col("k") % (i + 2) == 0).select("k")
               for i, name in enumerate("ABCDE")}
    plans = []
    cut = filter_audit.cut_lineage

    def counted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join Left"))
        return cut(df)
    monkeypatch.setattr(filter_audit, "cut_lineage", counted)
    found = filter_audit.audit_filters(universe, failing, ["k"])
    # one semi join for the start, one anti and one semi join for each filter, one to a plan
    assert sum(plans) <= 11 and max(plans) == 1
    last = found.where("filter_order = 'EDCBA' AND step = 5").first()
    assert last["kept"] == sum(all(k % d for d in range(2, 7)) for k in range(40))
