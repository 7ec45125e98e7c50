"""Spatial joins and clustering: exact, without cross joins, indifferent to hot spots.

Points are placed on the unit sphere, so every bound is plain three-dimensional box
arithmetic: no poles, no antimeridian, no cosine corrections.

``nearest_join`` works on *cells*, not rows. Both sides are reduced to occupied cells
with tight boxes; starting from one root, pairs of cells are refined level by level and a
pair survives only while its lower bound does not exceed the best upper bound known for
the left cell. What is left is a short candidate list per left cell, and each left row
then meets its own list in one equi-join. A million rows at one place cost one cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteplan_spark.functions.geo import (
    EARTH_RADIUS_M, cell_lat, cell_lon, haversine_m, haversine_sql, is_valid_coordinate,
    segment_distance_sql)
from siteplan_spark.operators.quantiles import group_quantile
from siteplan_spark.session import cut_lineage

BITS = 20          # finest level: 2**20 cells per axis, about 12 m
STEP = 2           # bits per level: four-way split of each axis
LEAF_ROWS = 16     # stop refining once no right cell holds more places than this
PIECES = 8         # pieces of a segment of average length in the index
PIECE_SLACK = 1.05  # how far beyond the best bound pieces are kept before the result is certified
_SLACK = 1.0 + 1e-9

# The published sweep of road distances.
SENSITIVITY_KM = (1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 20.0)


# Expressions below are SQL text: the plans have many columns, and text is parsed on the
# JVM in one call instead of one round trip per operator.

def _unit(lat: str, lon: str) -> dict[str, str]:
    a, o = f"radians({lat})", f"radians({lon})"
    return {"_x": f"cos({a}) * cos({o})", "_y": f"cos({a}) * sin({o})", "_z": f"sin({a})"}


def _valid(lat: str, lon: str) -> str:
    return (f"coalesce({lat} BETWEEN -90 AND 90 AND {lon} BETWEEN -180 AND 180 "
            f"AND NOT isnan({lat}) AND NOT isnan({lon}), false)")


def _with_axes(df: DataFrame, lat: str, lon: str) -> DataFrame:
    n = 1 << BITS
    unit = df.selectExpr("*", *[f"{e} AS {c}" for c, e in _unit(lat, lon).items()])
    return unit.selectExpr("*", *[
        f"CAST(least({n - 1}, floor((_{a} + 1.0D) / 2.0D * {n})) AS BIGINT) AS _i{a}"
        for a in "xyz"])


def _pack(x: str, y: str, z: str) -> str:
    return f"(shiftleft({x}, 40) | shiftleft({y}, 20) | {z})"


def _cell(bits: int) -> str:
    return _pack(*[f"shiftright(_i{a}, {BITS - bits})" for a in "xyz"])


def _up(cell: str, bits: int) -> str:
    """The parent, ``bits`` levels of refinement higher."""
    mask = (1 << 20) - 1
    return _pack(f"shiftright({cell}, {40 + bits})",
                 f"shiftright(shiftright({cell}, 20) & {mask}L, {bits})",
                 f"shiftright({cell} & {mask}L, {bits})")


_BOX = [f"_{side}{axis}" for side in ("lo", "hi") for axis in "xyz"]


def _extent(prefix_lo: str, prefix_hi: str) -> list[Column]:
    return [F.expr(f"min({prefix_lo}{a}) AS _lo{a}") for a in "xyz"] + [
        F.expr(f"max({prefix_hi}{a}) AS _hi{a}") for a in "xyz"]


def _leaf_boxes(df: DataFrame, bits: int, radius: str) -> DataFrame:
    return df.groupBy(F.expr(f"{_cell(bits)} AS cell")).agg(
        *_extent("_", "_"), F.expr(f"max({radius}) AS _r"))


def _coarser(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy(F.expr(f"{_up('cell', STEP)} AS cell")).agg(
        *_extent("_lo", "_hi"), F.expr("max(_r) AS _r"))


def _pyramid(leaf: DataFrame, bits: int) -> dict[int, DataFrame]:
    """Level -> boxes. Each level is aggregated from the finer one, not from the rows."""
    levels = {bits: leaf}
    for b in range(bits - STEP, 0, -STEP):
        levels[b] = _coarser(levels[b + STEP])
    return levels


def _side(boxes: DataFrame, name: str, root: bool) -> DataFrame:
    parent = "0L" if root else _up("cell", STEP)
    return boxes.selectExpr(f"{parent} AS {name}p", f"cell AS {name}",
                            *[f"{c} AS {name}{c}" for c in [*_BOX, "_r"]])


def _bounds() -> tuple[str, str]:
    """Lower and upper bound of the chord between anything in boxes a and b."""
    gaps = [f"greatest(0.0D, b_lo{x} - a_hi{x}, a_lo{x} - b_hi{x})" for x in "xyz"]
    spans = [f"greatest(b_hi{x} - a_lo{x}, a_hi{x} - b_lo{x})" for x in "xyz"]
    near = " + ".join(f"pow({g}, 2)" for g in gaps)
    far = " + ".join(f"pow({s}, 2)" for s in spans)
    return f"sqrt({near}) - b_r", f"sqrt({far}) + b_r"


def _candidate_pairs(left: DataFrame, right: DataFrame, bits: int, radius: str,
                     slack: float = _SLACK) -> DataFrame:
    """(a, b, _limit): for every left leaf cell, the right leaf cells that can hold its nearest.

    All right cells that come as near as the chord ``_limit`` are among them.
    """
    ls = _pyramid(_leaf_boxes(left, bits, "0.0D"), bits)
    rs = _pyramid(_leaf_boxes(right, bits, radius), bits)
    near, far = _bounds()
    pairs: DataFrame | None = None
    for b in range(STEP, bits + 1, STEP):
        l, r = _side(ls[b], "a", pairs is None), _side(rs[b], "b", pairs is None)
        if pairs is None:  # the root has at most 64 occupied children on either side
            grown = l.join(r, F.expr("ap = bp"))
        else:
            grown = pairs.join(l, F.expr("pa = ap")).join(r, F.expr("pb = bp"))
        pairs = (grown.selectExpr("a", "b", f"{near} AS _near", f"{far} AS _far")
                 .selectExpr("a AS pa", "b AS pb", "_near",
                             "min(_far) OVER (PARTITION BY a) AS _best")
                 .selectExpr("pa", "pb", "_near", f"_best * {slack!r}D + 1e-12D AS _limit")
                 .where("_near <= _limit").select("pa", "pb", "_limit"))
        limited = pairs
        pairs = pairs.drop("_limit")
    return limited.selectExpr("pa AS a", "pb AS b", "_limit")


def _leaf_bits(right: DataFrame) -> int:
    """The first level at which no cell holds more than LEAF_ROWS distinct places."""
    levels = ", ".join(f"struct({b} AS bits, {_cell(b)} AS cell)"
                       for b in range(STEP, BITS + 1, STEP))
    worst = (right.selectExpr(f"inline(array({levels}))")
             .groupBy("bits", "cell").count()
             .groupBy("bits").max("count").collect())  # one row per level
    fits = sorted(r["bits"] for r in worst if r["max(count)"] <= LEAF_ROWS)
    return fits[0] if fits else BITS


def _attach(left: DataFrame, right: DataFrame, lat: str, lon: str, payload: Sequence[str],
            distance: str, out: str, id_out: str, radius: str,
            slack: float = _SLACK, limit: Sequence[str] = ()) -> DataFrame:
    bits = _leaf_bits(right)
    placed = _with_axes(left, lat, lon).selectExpr("*", f"{_valid(lat, lon)} AS _ok")
    pairs = _candidate_pairs(placed.where("_ok"), right, bits, radius, slack)
    fields = ", ".join(payload)
    candidates = (pairs.join(right.selectExpr(f"{_cell(bits)} AS b", *payload), "b")
                  .groupBy("a").agg(F.expr(f"collect_set(struct({fields})) AS _c"),
                                    F.max("_limit").alias("_limit")))
    joined = placed.selectExpr("*", f"CASE WHEN _ok THEN {_cell(bits)} END AS a").join(
        candidates, "a", "left")
    best = f"array_min(transform(_c, s -> struct({distance} AS d, s._id AS id))) AS _best"
    return joined.selectExpr(*[f"`{c}`" for c in left.columns], "_ok", "_limit", best).selectExpr(
        *[f"`{c}`" for c in left.columns],
        f"CASE WHEN _best IS NOT NULL THEN _best.d WHEN _ok THEN double('Infinity') END AS {out}",
        f"_best.id AS {id_out}", *limit)


def _of_places(points: DataFrame, lat: str, lon: str) -> DataFrame:
    """(_plat, _plon): the distinct usable places, so rows at one place are searched for once."""
    return cut_lineage(points.where(_valid(lat, lon)).select(
        F.col(lat).alias("_plat"), F.col(lon).alias("_plon")).distinct())


def _to_rows(points: DataFrame, found: DataFrame, lat: str, lon: str, out: str,
             id_out: str) -> DataFrame:
    """What was found for (_plat, _plon), at all rows of those places; nulls elsewhere."""
    met = points.join(found, (points[lat] == found["_plat"]) & (points[lon] == found["_plon"]),
                      "left")
    return met.select(*[points[c] for c in points.columns], found["_d"].alias(out),
                      found["_i"].alias(id_out))


def nearest_join(left: DataFrame, right: DataFrame, right_id: str, lat: str = "lat",
                 lon: str = "lon", out: str = "distance_m",
                 id_out: str = "nearest_id") -> DataFrame:
    """Each left row with the great-circle metres to, and id of, its nearest right row.

    Ties go to the smallest id. With no right row at all the distance is Infinity and the
    id null. A left row without a usable coordinate stays, with null in both.
    """
    places = (right.where(is_valid_coordinate(lat, lon))
              .groupBy(F.col(lat).alias("_lat"), F.col(lon).alias("_lon"))
              .agg(F.min(right_id).alias("_id")))
    indexed = _with_axes(places, "_lat", "_lon")
    found = _attach(_of_places(left, lat, lon), indexed, "_plat", "_plon", ["_id", "_lat", "_lon"],
                    haversine_sql("_plat", "_plon", "s._lat", "s._lon"), "_d", "_i", "0.0D")
    return _to_rows(left, found, lat, lon, out, id_out)


def polyline_segments(df: DataFrame, feature: str, vertices: str) -> DataFrame:
    """array<struct<lat,lon>> per feature to consecutive segments of the same feature.

    Neighbouring vertices are paired inside the array, so no shuffle and no window.
    """
    n = F.size(vertices)
    pairs = F.when(n >= 2, F.transform(
        F.sequence(F.lit(0), n - 2),
        lambda i: F.struct(i.alias("segment"),
                           F.col(vertices)[i]["lat"].alias("lat1"),
                           F.col(vertices)[i]["lon"].alias("lon1"),
                           F.col(vertices)[i + 1]["lat"].alias("lat2"),
                           F.col(vertices)[i + 1]["lon"].alias("lon2"))))
    return df.select(feature, F.inline(pairs)).withColumn(
        "length_m", haversine_m("lat1", "lon1", "lat2", "lon2"))


def nearest_segment_join(points: DataFrame, segments: DataFrame, segment_id: str,
                         lat: str = "lat", lon: str = "lon", out: str = "distance_m",
                         id_out: str = "nearest_segment") -> DataFrame:
    """Distance to the nearest point *on* a segment, exact for segments of any length.

    Segments are indexed in pieces, each by its midpoint and the radius that covers it, so that a
    long segment is a candidate only near its course. A bound from pieces is one on the true
    distance, which the foot in the tangent plane may miss by a little. Pieces a little beyond
    the best bound are kept too, and a result within what was kept is certain. Places whose result
    is not are searched again with whole segments, whose radius widens both bounds: that loses
    nothing at any length. Rows at one place are searched for once.
    """
    ends = ["_id", "lat1", "lon1", "lat2", "lon2"]
    whole = segments.selectExpr(
        f"{segment_id} AS _id", *ends[1:], "radians(lat2 - lat1) AS _dlat",
        "radians(lon2 - lon1) * CASE WHEN lat1 * lat2 <= 0 THEN 1.0D "
        "ELSE greatest(cos(radians(lat1)), cos(radians(lat2))) END AS _dlon").selectExpr(
        *ends, f"sqrt(_dlat * _dlat + _dlon * _dlon) * 0.5D * {_SLACK!r}D AS _rad")
    whole = cut_lineage(whole.where("_rad < double('Infinity')"))
    mean = whole.agg(F.avg("_rad")).first()[0] or 0.0
    n = f"greatest(1, ceil(_rad / {mean / PIECES!r}D))" if mean > 0 else "1L"
    pieces = cut_lineage(whole.selectExpr("*", f"CAST({n} AS INT) AS _n").selectExpr(
        "*", "explode(sequence(0, _n - 1)) AS _k").selectExpr(
        *ends, "_rad / _n AS _rad", "lat1 + (_k + 0.5D) / _n * (lat2 - lat1) AS _mlat",
        "lon1 + (_k + 0.5D) / _n * (lon2 - lon1) AS _mlon").repartition("_mlat", "_mlon"))
    metres = segment_distance_sql("_plat", "_plon", "s")
    places = _of_places(points, lat, lon)
    near = cut_lineage(_attach(
        places, _with_axes(pieces, "_mlat", "_mlon"), "_plat", "_plon", ends, metres, "_d", "_i",
        "_rad", PIECE_SLACK, ["_limit"]))
    sure = F.coalesce(2.0 * F.sin(F.col("_d") / (2.0 * EARTH_RADIUS_M)) * _SLACK
                      <= F.col("_limit"), F.lit(False))
    found, rest = near.where(sure).drop("_limit"), near.where(~sure)
    if not rest.isEmpty():
        middle = whole.selectExpr("*", "(lat1 + lat2) / 2.0D AS _mlat",
                                  "(lon1 + lon2) / 2.0D AS _mlon")
        found = found.unionByName(_attach(
            rest.select("_plat", "_plon"), _with_axes(middle, "_mlat", "_mlon"), "_plat", "_plon",
            ends, metres, "_d", "_i", "_rad"))
    return _to_rows(points, found, lat, lon, out, id_out)


def _chord(metres: float) -> float:
    return 2.0 * math.sin(min(metres / EARTH_RADIUS_M, math.pi) / 2.0)


def _buckets(df: DataFrame, lat: str, lon: str, side: float) -> DataFrame:
    unit = df.where(_valid(lat, lon)).selectExpr(
        "*", *[f"{e} AS {c}" for c, e in _unit(lat, lon).items()])
    return unit.selectExpr("*", *[f"CAST(floor(_{a} / {side!r}D) AS BIGINT) AS _i{a}"
                                  for a in "xyz"])


def _offsets(steps: Sequence[tuple[int, int, int]]) -> str:
    return "array(" + ", ".join(
        f"struct({i} AS dx, {j} AS dy, {k} AS dz)" for i, j, k in steps) + ")"


def _shifted(df: DataFrame, steps: Sequence[tuple[int, int, int]]) -> DataFrame:
    """One copy of each row per bucket offset, under the bucket it is offered to."""
    keep = [c for c in df.columns if c not in ("_ix", "_iy", "_iz")]
    return df.selectExpr("*", f"inline({_offsets(steps)})").selectExpr(
        *[f"`{c}`" for c in keep],
        *[f"_i{a} + d{a} AS _i{a}" for a in "xyz"])


def distance_band_join(left: DataFrame, right: DataFrame, eps_m: float, lat: str = "lat",
                       lon: str = "lon", out: str = "distance_m") -> DataFrame:
    """Rows of two tables within ``eps_m`` of each other (the pairs are the result).

    Buckets are cubes one band wide, so a right row is offered to its 27 neighbours and
    meets left rows by equality. Chords of unit vectors decide all pairs but those at the very
    edge of the band, so a pair that is not in the result costs no trigonometry and one that is
    costs one distance. The two sides must not share column names.
    """
    chord = _chord(eps_m)
    outer, inner = chord * (1.0 + 1e-9) + 1e-14, chord * (1.0 - 1e-9) - 1e-14
    lp = _buckets(left, lat, lon, outer).withColumn("_c", F.cos(F.radians(lat)))
    rp = _buckets(right.withColumnsRenamed({lat: "_rlat", lon: "_rlon"}), "_rlat", "_rlon",
                  outer).withColumn("_c", F.cos(F.radians("_rlat"))).withColumnsRenamed(
        {c: f"_r{c}" for c in ("_x", "_y", "_z", "_c")})
    span = range(-1, 2)
    spread = _shifted(rp, [(i, j, k) for i in span for j in span for k in span])
    keys = ["_ix", "_iy", "_iz"]
    spread = spread.withColumnsRenamed({c: f"_r{c}" for c in keys})
    square = " + ".join(f"(_{a} - _r_{a}) * (_{a} - _r_{a})" for a in "xyz")
    half = " * ".join([f"sin(radians(_rlon - `{lon}`) / 2.0D)"] * 2)
    term = (f"sin(radians(_rlat - `{lat}`) / 2.0D) * sin(radians(_rlat - `{lat}`) / 2.0D) "
            f"+ _c * _r_c * {half}")
    metres = f"{2.0 * EARTH_RADIUS_M!r}D * asin(sqrt(least(1.0D, {term})))"
    met = " AND ".join(f"{c} = _r{c}" for c in keys)
    sure = inner * inner if inner > 0 else -1.0
    # both sides may be small files whose pairs are many: a broadcast would leave them to one task
    pairs = lp.join(spread.hint("merge"), F.expr(
        f"{met} AND {square} <= {outer * outer!r}D "
        f"AND ({square} <= {sure!r}D OR {metres} <= {float(eps_m)!r}D)"))
    names = [*left.columns, *[c for c in right.columns if c not in (lat, lon)]]
    return pairs.selectExpr(*[f"`{c}`" for c in names], f"{metres} AS `{out}`")


_DIAMETER_SPLITS = (8, 64, 512)  # parts per axis of a cluster's frame, per level


# --- clustering ---------------------------------------------------------------------------

#: Parts per axis that a box is split into, and the parts of a cell at which splitting ends.
REFINE, DEEPEST = 4, 4 ** 9

def _fine(side: float, split: int) -> list[str]:
    return [f"CAST(floor(_{a} / {side / split!r}D) AS BIGINT) AS s{a}" for a in "xyz"]


def _sub_boxes(points: DataFrame, side: float, split: int) -> DataFrame:
    """(node, sub-cell) boxes; ``split`` parts per axis inside each cell."""
    return points.selectExpr("node", "_x", "_y", "_z", *_fine(side, split)).groupBy(
        "node", "sx", "sy", "sz").agg(*_extent("_", "_"), F.expr("0.0D AS _r"))


def road_proximity(cells: DataFrame, segments: DataFrame, segment_id: str, level: int,
                   threshold_km: float = 5.0, key: str = "cell") -> DataFrame:
    """(cell, distance_km, within_road): from each cell's centre to the nearest point of a segment.

    Without any segment every distance is infinite and no cell is within: no road anywhere is the
    strongest exclusion, not missing data.
    """
    centres = cells.select(key).distinct().withColumns(
        {"lat": cell_lat(key, level), "lon": cell_lon(key, level)})
    near = nearest_segment_join(centres, segments, segment_id)
    km = F.coalesce(F.col("distance_m") / 1000.0, F.lit(float("inf")))
    return near.select(key, km.alias("distance_km"), (km <= threshold_km).alias("within_road"))


def road_sensitivity(proximity: DataFrame,
                     thresholds_km: Sequence[float] = SENSITIVITY_KM) -> DataFrame:
    """(threshold_km, cells): how many cells each threshold would keep.

    A cell is counted at the first threshold that reaches it, and the counts are added up.
    """
    reach = F.array(*[F.lit(float(t)) for t in sorted(thresholds_km)])
    first = F.get(F.filter(reach, lambda t: t >= F.col("distance_km")), F.lit(0))
    hits = proximity.groupBy(first.alias("threshold_km")).agg(F.count(F.lit(1)).alias("_n"))
    swept = proximity.sparkSession.createDataFrame(
        [(float(t),) for t in thresholds_km], "threshold_km double")
    return swept.join(hits, "threshold_km", "left").select("threshold_km", F.sum(
        F.coalesce("_n", F.lit(0))).over(Window.orderBy("threshold_km")).alias("cells"))


def _renamed(boxes: DataFrame, name: str) -> DataFrame:
    return boxes.selectExpr(f"node AS {name}", *[f"s{a} AS {name}s{a}" for a in "xyz"],
                            *[f"{c} AS {name}{c}" for c in [*_BOX, "_r"]])


def eps_links(df: DataFrame, id_col: str, lat: str, lon: str,
              eps_m: float) -> tuple[DataFrame, DataFrame]:
    """(members, links) with the same connected components as the full eps graph.

    Places closer than the cell diagonal are joined through their cell, so a crowded
    place gives one node instead of all its pairs. Two neighbouring cells are linked when
    some pair across them is within eps. That is decided from boxes: pairs of boxes that may or
    may not hold a link are split again, until one of them surely does or none can.
    members: (id, node). links: (src, dst) between nodes.
    """
    eps = _chord(eps_m)
    side = eps / math.sqrt(3.0)
    placed = _buckets(df.select(F.col(id_col).alias("id"), F.col(lat).alias("_lat"),
                                F.col(lon).alias("_lon")), "_lat", "_lon", side)
    keys = ["_ix", "_iy", "_iz"]
    cells = cut_lineage(placed.groupBy(*keys).agg(
        F.expr("min(id) AS node"), *_extent("_", "_"), F.expr("0.0D AS _r")))
    members = placed.select("id", *keys).join(cells.select(*keys, "node"), keys).select(
        "id", "node")
    # read at every level below
    places = cut_lineage(placed.groupBy("_lat", "_lon", *keys)
                         .agg(*[F.expr(f"min(_{a}) AS _{a}") for a in "xyz"])
                         .join(cells.select(*keys, "node"), keys).drop(*keys))
    span = range(-2, 3)
    ahead = [(i, j, k) for i in span for j in span for k in span if (i, j, k) > (0, 0, 0)]
    a = _shifted(cells.selectExpr(*keys, "node AS a", *[f"{c} AS a{c}" for c in _BOX]), ahead)
    b = cells.selectExpr(*keys, "node AS b", *[f"{c} AS b{c}" for c in [*_BOX, "_r"]])
    near, far = _bounds()
    reach = f"_near <= {eps * _SLACK!r}D"
    pairs = cut_lineage(a.join(b, keys).selectExpr(
        "a", "b", f"{near} AS _near", f"{far} AS _far").where(reach))
    links = [pairs.where(f"_far <= {eps!r}D").select("a", "b")]
    undecided = pairs.where(f"_far > {eps!r}D").select(
        "a", "b", *[F.lit(0).cast("bigint").alias(f"{n}s{x}") for n in "ab" for x in "xyz"])
    split = 1
    while True:
        # the halves of both cells that can still hold a link, four times as fine each time
        deeper = split * REFINE
        ends = undecided.select(F.col("a").alias("node")).union(
            undecided.select("b")).distinct()
        boxes = cut_lineage(_sub_boxes(places.join(ends, "node", "left_semi"), side, deeper))
        up = {n: " AND ".join(f"{n}s{x} DIV {REFINE} = p{n}s{x}" if split > 1 else "true"
                              for x in "xyz") for n in "ab"}
        parents = undecided.selectExpr("a AS pa", "b AS pb", *[
            f"{n}s{x} AS p{n}s{x}" for n in "ab" for x in "xyz"])
        grown = parents.join(_renamed(boxes, "a"), F.expr(f"pa = a AND {up['a']}")).join(
            _renamed(boxes, "b"), F.expr(f"pb = b AND {up['b']}"))
        scored = cut_lineage(grown.selectExpr(
            "a", "b", *[f"{n}s{x}" for n in "ab" for x in "xyz"], f"{near} AS _near",
            f"{far} AS _far").where(reach))
        found = scored.groupBy("a", "b").agg(F.min("_far").alias("_far")).where(
            f"_far <= {eps!r}D").select("a", "b")
        links.append(found)
        undecided = cut_lineage(scored.drop("_near", "_far").join(found, ["a", "b"], "left_anti"))
        split = deeper
        if split >= DEEPEST or undecided.isEmpty():
            break

    # boxes this fine hold places that no distance tells apart
    def side_of(n: str) -> DataFrame:
        return places.selectExpr("node", "_lat", "_lon", *_fine(side, split)).selectExpr(
            f"node AS {n}", f"_lat AS {n}lat", f"_lon AS {n}lon",
            *[f"s{x} AS {n}s{x}" for x in "xyz"])
    links.append(undecided.join(side_of("a"), ["a", "asx", "asy", "asz"])
                 .join(side_of("b"), ["b", "bsx", "bsy", "bsz"])
                 .where(f"{haversine_sql('alat', 'alon', 'blat', 'blon')} <= {eps_m!r}D")
                 .select("a", "b").distinct())
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return members, out.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def connected_components(nodes: DataFrame, edges: DataFrame,
                         rows: int | None = None) -> DataFrame:
    """(id, component) where component is the smallest id reachable from id.

    Each round every node moves to its neighbour with the smallest hashed priority and
    the edges are rewritten and deduplicated, so the graph shrinks geometrically
    whatever order the ids are in. A hub is handled by map-side minima. The edges and
    moves of each round are written to the checkpoint folder. ``rows`` is how many nodes and
    edges there are at most, where that is known.
    """
    live = cut_lineage(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
                       .where("u <> v").distinct(), rows)
    moves: list[DataFrame] = []
    while left := live.count():  # every round merges at least one pair
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest priority among the neighbours and the node itself
        move = (both.groupBy("u").agg(F.expr("min(struct(xxhash64(v) AS h, v AS v)) AS m"))
                .selectExpr("u", "least(m, struct(xxhash64(u) AS h, u AS v)).v AS to"))
        move = cut_lineage(move, 2 * left)
        moves.append(move)
        m1 = move.select(F.col("u"), F.col("to").alias("nu"))
        m2 = move.select(F.col("u").alias("v"), F.col("to").alias("nv"))
        live = cut_lineage(
            live.join(m1, "u").join(m2, "v")
            .select(F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v"))
            .where("u <> v").distinct(), left)
    # each round's moves are fewer than the last, so the labels follow them in one chain
    label = nodes.select("id", F.col("id").alias("component"))
    for move in moves:
        label = label.join(move.withColumnRenamed("u", "component"), "component", "left").select(
            "id", F.coalesce("to", "component").alias("component"))
    label = cut_lineage(label, rows)
    smallest = label.groupBy("component").agg(F.min("id").alias("_min"))
    return label.join(smallest, "component").select("id", F.col("_min").alias("component"))


def cluster_points(df: DataFrame, id_col: str, lat: str = "lat", lon: str = "lon",
                   eps_m: float = 50.0) -> DataFrame:
    """(id, cluster, has_geo, cluster_lat, cluster_lon, cluster_size).

    Chains of points within ``eps_m`` form one cluster, named by its smallest id. A point
    without a usable coordinate is a cluster of its own.
    """
    members, links = eps_links(df, id_col, lat, lon, eps_m)
    comp = connected_components(members.select(F.col("node").alias("id")).distinct(), links)
    comp = comp.select(F.col("id").alias("node"), "component")
    tagged = members.join(comp, "node").select("id", "component")
    full = (df.select(F.col(id_col).alias("id"), F.col(lat).alias("_lat"),
                      F.col(lon).alias("_lon")).join(tagged, "id", "left")
            .withColumn("has_geo", F.col("component").isNotNull())
            .withColumn("cluster", F.coalesce("component", "id")))
    centre = full.groupBy("cluster", "has_geo").agg(
        F.avg(F.when(F.col("has_geo"), F.col("_lat"))).alias("cluster_lat"),
        F.avg(F.when(F.col("has_geo"), F.col("_lon"))).alias("cluster_lon"),
        F.count(F.lit(1)).alias("cluster_size"))
    return full.select("id", "cluster", "has_geo").join(centre, ["cluster", "has_geo"])


def cluster_diagnostics(members: DataFrame, cluster: str, lat: str, lon: str,
                        network: str) -> DataFrame:
    """(cluster, size, networks, diameter_m): the exact largest distance in each cluster.

    Places are reduced to boxes inside their cluster. A pair of boxes survives a level
    only if its far corners reach the best distance already certain, so the places that
    are finally compared are the two opposite ends, not all pairs.
    """
    body = members.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("size"), F.countDistinct(network).alias("networks"))
    places = members.where(_valid(lat, lon)).groupBy(
        F.col(cluster).alias("_k"), F.col(lat).alias("_lat"), F.col(lon).alias("_lon")).agg(
        F.count(F.lit(1)).alias("_n"))
    unit = places.selectExpr("_k", "_lat", "_lon",
                             *[f"{e} AS {c}" for c, e in _unit("_lat", "_lon").items()])
    frame = unit.groupBy("_k").agg(
        *[F.expr(f"min(_{a}) AS _o{a}") for a in "xyz"],
        F.expr("greatest(1e-12D, " + ", ".join(f"max(_{a}) - min(_{a})" for a in "xyz")
               + ") AS _w"))
    finest = _DIAMETER_SPLITS[-1]
    keyed = cut_lineage(unit.join(frame, "_k").selectExpr(
        "_k", "_lat", "_lon", "_x", "_y", "_z",
        *[f"CAST(least({finest - 1}, floor((_{a} - _o{a}) / _w * {finest})) AS INT) AS c{a}"
          for a in "xyz"]))
    near, far = _bounds()
    pairs = None
    for i, split in enumerate(_DIAMETER_SPLITS):
        down = finest // split
        ids = [f"c{a} DIV {down} AS s{a}" for a in "xyz"]
        boxes = keyed.selectExpr("_k AS node", "_x", "_y", "_z", *ids).groupBy(
            "node", "sx", "sy", "sz").agg(*_extent("_", "_"), F.expr("0.0D AS _r"))
        step = split // (_DIAMETER_SPLITS[i - 1] if i else split)
        left, right = _renamed(boxes, "a"), _renamed(boxes, "b")
        if pairs is None:
            grown = left.join(right, F.expr("a = b")).withColumn("_twin", F.lit(True))
        else:
            ups = {n: " AND ".join(f"{n}s{x} DIV {step} = p{n}s{x}" for x in "xyz")
                   for n in "ab"}
            grown = pairs.join(left, F.expr(f"pk = a AND {ups['a']}")).join(
                right, F.expr(f"pk = b AND {ups['b']}")).withColumn("_twin", F.expr(
                    "pasx = pbsx AND pasy = pbsy AND pasz = pbsz"))
        # children of one box meet twice; children of two boxes only once
        scored = grown.where(
            "NOT _twin OR struct(asx, asy, asz) <= struct(bsx, bsy, bsz)").selectExpr(
            "a", *[f"{n}s{x}" for n in "ab" for x in "xyz"],
            f"{near} AS _near", f"{far} AS _far")
        # a cluster holds a bounded number of box pairs, whatever its size
        pairs = (scored.selectExpr("*", "max(_near) OVER (PARTITION BY a) AS _best")
                 .where("_far >= _best * (1.0D - 1e-9)")
                 .selectExpr("a AS pk", *[f"{n}s{x} AS p{n}s{x}" for n in "ab" for x in "xyz"]))

    def ends(n: str) -> DataFrame:
        return keyed.selectExpr("_k AS pk", f"_lat AS {n}lat", f"_lon AS {n}lon",
                                *[f"c{x} AS p{n}s{x}" for x in "xyz"])
    span = (pairs.join(ends("a"), ["pk", "pasx", "pasy", "pasz"])
            .join(ends("b"), ["pk", "pbsx", "pbsy", "pbsz"])
            .groupBy("pk").agg(F.expr(
                f"max({haversine_sql('alat', 'alon', 'blat', 'blon')}) AS diameter_m")))
    return (body.join(span, F.col(cluster) == F.col("pk"), "left").drop("pk")
            .withColumn("diameter_m", F.coalesce("diameter_m", F.lit(0.0))))


def diameter_bands(diagnostics: DataFrame, bands: Sequence[float] = (50.0, 100.0, 200.0, 500.0),
                   suspicious: float = 200.0) -> DataFrame:
    """Counts of clusters, singletons and clusters wider than each band, in one row."""
    multi = F.col("size") > 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return diagnostics.agg(
        F.count(F.lit(1)).alias("clusters"), n(F.col("size") == 1).alias("singletons"),
        F.max("size").alias("max_size"),
        *[n(multi & (F.col("diameter_m") > b)).alias(f"wider_than_{int(b)}") for b in bands],
        n(multi & (F.col("diameter_m") > suspicious)).alias("suspicious"))


def suspicious_clusters(diagnostics: DataFrame, cluster: str, limit: int = 25,
                        wider_than: float = 200.0) -> DataFrame:
    """The report's 25 widest clusters."""
    return (diagnostics.where((F.col("size") > 1) & (F.col("diameter_m") > wider_than))
            .orderBy(F.desc("diameter_m"), cluster).limit(limit))


def compare_distance_methods(df: DataFrame, coarse: str, exact: str,
                             threshold: float) -> DataFrame:
    """Error of one distance against another, and how many rows change sides."""
    # two distances per row are expensive and read several times below
    rows = cut_lineage(df.select((F.col(coarse) - F.col(exact)).alias("_e"),
                                 (F.col(coarse) <= threshold).alias("_a"),
                                 (F.col(exact) <= threshold).alias("_b")))
    body = rows.agg(
        F.avg("_e").alias("mean_error"), F.max("_e").alias("max_error"),
        F.sum(F.when(F.col("_a") != F.col("_b"), 1).otherwise(0)).alias("flips"),
        F.coalesce(F.sum(F.when(F.col("_a") & F.col("_b"), 1).otherwise(0))
                   / F.nullif(F.sum(F.when(F.col("_a") | F.col("_b"), 1).otherwise(0)),
                              F.lit(0)), F.lit(1.0)).alias("selection_jaccard"))
    half = group_quantile(rows, [], "_e", 0.5, "linear", "median_error").drop("n")
    p99 = group_quantile(rows, [], "_e", 0.99, "linear", "p99_error").drop("n")
    return body.join(F.broadcast(half)).join(F.broadcast(p99))
