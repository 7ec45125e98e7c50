import math
import random

import pytest
from pyspark.sql import functions as F

from siteplan_spark.functions import geo as G
from siteplan_spark.operators import spatial as SP

R = 6_371_008.8


def hav(a, o, b, p):
    a, o, b, p = map(math.radians, (a, o, b, p))
    s = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, s)))


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, lat double, lon double")


def crowded(n, seed):
    """A third in one place, a third in one town, the rest anywhere, poles included."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((i, 40.0, -100.0))
        elif i % 3 == 1:
            rows.append((i, 40.0 + rnd.random() / 50, -100.0 + rnd.random() / 50))
        else:
            rows.append((i, math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)))
    return rows


def test_nearest_join_equals_brute_force_on_crowded_data(spark):
    left, right = crowded(120, 1), crowded(90, 2)
    got = {r["id"]: (r["nearest_id"], r["distance_m"]) for r in SP.nearest_join(
        points(spark, left), points(spark, right).withColumnRenamed("id", "rid"), "rid").collect()}
    for i, a, o in left:
        want = min((hav(a, o, b, p), j) for j, b, p in right)
        assert got[i][1] == pytest.approx(want[0], abs=1e-3)
        assert got[i][0] == want[1] or want[0] > 0


def test_nearest_join_edge_rows(spark):
    left = points(spark, [(1, None, 0.0), (2, float("nan"), 0.0), (3, 95.0, 0.0),
                          (4, 0.0, 179.9), (5, 10.0, 10.0)])
    right = points(spark, [(8, 0.0, -179.9), (9, 0.0, 170.0), (7, 10.0, 10.0),
                           (6, 10.0, 10.0)]).withColumnRenamed("id", "rid")
    got = {r["id"]: r for r in SP.nearest_join(left, right, "rid").collect()}
    assert len(got) == 5
    assert all(got[i]["nearest_id"] is None and got[i]["distance_m"] is None for i in (1, 2, 3))
    assert got[4]["nearest_id"] == 8          # across the antimeridian
    assert got[5]["nearest_id"] == 6          # tie: smallest id
    none = {r["id"]: r for r in SP.nearest_join(left, right.where("rid < 0"), "rid").collect()}
    assert none[5]["distance_m"] == float("inf") and none[5]["nearest_id"] is None


def test_nearest_segment_handles_long_and_zero_length_segments(spark):
    rnd = random.Random(3)
    segs = [(i, rnd.uniform(30, 45), rnd.uniform(-120, -80)) for i in range(40)]
    rows = [(i, a, o, a + rnd.uniform(-3, 3) * (i % 3), o + rnd.uniform(-3, 3) * (i % 3))
            for i, a, o in segs]
    sdf = spark.createDataFrame(rows, "sid long, lat1 double, lon1 double, lat2 double, lon2 double")
    pts = [(i, rnd.uniform(30, 45), rnd.uniform(-120, -80)) for i in range(60)]
    got = {r["id"]: r["distance_m"] for r in SP.nearest_segment_join(
        points(spark, pts), sdf, "sid").collect()}

    def seg(a, o, s):
        _, a1, o1, a2, o2 = s
        k = math.cos(math.radians(a))
        dx, dy = (o2 - o1) * k, a2 - a1
        n = dx * dx + dy * dy
        t = 0 if n == 0 else max(0, min(1, ((o - o1) * k * dx + (a - a1) * dy) / n))
        return hav(a, o, a1 + t * (a2 - a1), o1 + t * (o2 - o1))
    for i, a, o in pts:
        assert got[i] == pytest.approx(min(seg(a, o, s) for s in rows), abs=1e-3)


def brute_components(rows, eps):
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, (i, a, o) in enumerate(rows):
        for j, b, p in rows[n + 1:]:
            if hav(a, o, b, p) <= eps:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


@pytest.mark.parametrize("eps", [50.0, 400.0])
def test_cluster_points_equals_brute_force(spark, eps):
    rows = crowded(150, 4)
    got = {r["id"]: r for r in SP.cluster_points(points(spark, rows + [(999, None, 1.0)]), "id",
                                                 eps_m=eps).collect()}
    want = brute_components(rows, eps)
    assert {i: got[i]["cluster"] for i in want} == want
    assert got[999]["cluster"] == 999 and not got[999]["has_geo"]


def test_chain_is_one_cluster_although_its_ends_are_far_apart(spark):
    step = 40.0 / 111_195.0
    rows = [(i, 10.0 + i * step, 20.0) for i in range(6)] + [(50, 10.5, 20.0)]
    got = {r["id"]: (r["cluster"], r["cluster_size"]) for r in SP.cluster_points(
        points(spark, rows), "id").collect()}
    assert all(got[i] == (0, 6) for i in range(6)) and got[50] == (50, 1)


def test_components_of_a_long_path_and_a_hub(spark):
    n = 200
    edges = [(i, i + 1) for i in range(n)] + [(500, 501 + i) for i in range(n)]
    nodes = sorted({x for e in edges for x in e})
    got = {r["id"]: r["component"] for r in SP.connected_components(
        spark.createDataFrame([(x,) for x in nodes], "id long"),
        spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == (0 if i <= n else 500) for i in nodes)


def test_cluster_diameter_is_exact(spark):
    rnd = random.Random(5)
    rows = [(i, 10 + rnd.random() / 100, 20 + rnd.random() / 100, i % 3, f"n{i % 4}")
            for i in range(90)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, cluster long, network string")
    got = {r["cluster"]: r for r in SP.cluster_diagnostics(df, "cluster", "lat", "lon",
                                                           "network").collect()}
    for c in range(3):
        mine = [r for r in rows if r[3] == c]
        want = max(hav(p[1], p[2], q[1], q[2]) for p in mine for q in mine)
        assert got[c]["diameter_m"] == pytest.approx(want, abs=1e-3)
        assert got[c]["size"] == 30 and got[c]["networks"] == 4


def test_grid_parent_contains_child_and_ring_wraps(spark):
    df = points(spark, [(1, 89.9, 179.99), (2, -45.0, -180.0), (3, 0.0, 0.0), (4, None, 1.0)])
    out = df.select("id", G.cell_of("lat", "lon", 8).alias("c"),
                    G.cell_parent(G.cell_of("lat", "lon", 8), 8, 5).alias("p"),
                    G.cell_of("lat", "lon", 5).alias("q"),
                    F.size(G.k_ring(G.cell_of("lat", "lon", 8), 8, 1)).alias("ring")).collect()
    by = {r["id"]: r for r in out}
    assert all(by[i]["p"] == by[i]["q"] for i in (1, 2, 3)) and by[4]["c"] is None
    assert by[1]["ring"] == 6 and by[2]["ring"] == 9
    assert df.where("id = 4").select(G.haversine_m("lat", "lon", "lat", "lon")).first()[0] is None


@pytest.mark.parametrize("gap_m,linked", [(49.0, True), (51.0, False)])
def test_two_crowded_cells_are_decided_without_comparing_their_places(spark, gap_m, linked):
    # 25,000 places in each of two clumps whose nearest places are gap_m apart
    step = 1.0 / 111_195.0  # a metre of latitude
    clump = spark.range(50_000).select(
        "id", (F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("i"))
    r, t = F.sqrt(F.col("i") / 25_000.0) * 10.0, F.col("i") * 2.399963
    north = F.col("k") * (gap_m + 20.0)
    pts = clump.select("id", (40.0 + (r * F.cos(t) + north) * step).alias("lat"),
                       (10.0 + r * F.sin(t) * step / 0.766).alias("lon"))
    edge = spark.createDataFrame([(50_000, 40.0 + 10.0 * step, 10.0),
                                  (50_001, 40.0 + (10.0 + gap_m) * step, 10.0)],
                                 "id long, lat double, lon double")
    got = SP.cluster_points(pts.unionByName(edge), "id", eps_m=50.0)
    assert got.select("cluster").distinct().count() == (1 if linked else 2)
