"""Distances on the sphere and the hierarchical equal-area grid, as column math.

The grid is a square grid on a cylindrical equal-area projection. Level ``n`` has
``2**n`` columns and ``2**n`` rows, so a parent contains exactly four children and
every cell of one level has the same area. Cell ids are longs:
``level * 2**56 + column * 2**28 + row`` (they are not ids of any hexagonal system).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.functions.clean import col

# Fixed value: mean Earth radius in metres.
EARTH_RADIUS_M = 6_371_008.8
EARTH_RADIUS_KM = EARTH_RADIUS_M / 1000.0


def haversine_a(lat1, lon1, lat2, lon2) -> Column:
    """The haversine term, clamped to [0, 1]; monotone in the distance."""
    a1, o1, a2, o2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    s1 = F.sin(F.radians(a2 - a1) / 2.0)
    s2 = F.sin(F.radians(o2 - o1) / 2.0)
    a = s1 * s1 + F.cos(F.radians(a1)) * F.cos(F.radians(a2)) * s2 * s2
    # null coordinates give null, not zero: greatest() and least() skip nulls
    return F.when(a > 1.0, 1.0).when(a < 0.0, 0.0).otherwise(a)


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return 2.0 * EARTH_RADIUS_M * F.asin(F.sqrt(haversine_a(lat1, lon1, lat2, lon2)))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    return 2.0 * EARTH_RADIUS_KM * F.asin(F.sqrt(haversine_a(lat1, lon1, lat2, lon2)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """The same distance in metres as SQL text, for expressions inside lambdas."""
    return (f"{2.0 * EARTH_RADIUS_M!r}D * asin(sqrt(least(1.0D, greatest(0.0D, "
            f"pow(sin(radians(({lat2}) - ({lat1})) / 2.0D), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2.0D), 2)))))")


def segment_distance_sql(lat: str, lon: str, s: str) -> str:
    """``segment_distance_m`` as SQL text; ``s`` names a struct lat1, lon1, lat2, lon2."""
    k = f"cos(radians({lat}))"
    dx, dy = f"(({s}.lon2 - {s}.lon1) * {k})", f"({s}.lat2 - {s}.lat1)"
    norm = f"({dx} * {dx} + {dy} * {dy})"
    along = f"((({lon}) - {s}.lon1) * {k} * {dx} + (({lat}) - {s}.lat1) * {dy})"
    t = (f"(CASE WHEN {norm} > 0 THEN greatest(0.0D, least(1.0D, {along} / {norm})) "
         "ELSE 0.0D END)")
    return haversine_sql(lat, lon, f"{s}.lat1 + {t} * ({s}.lat2 - {s}.lat1)",
                         f"{s}.lon1 + {t} * ({s}.lon2 - {s}.lon1)")


def eps_radians(metres: float) -> float:
    return metres / EARTH_RADIUS_M


def is_valid_coordinate(lat, lon) -> Column:
    """False for null, NaN and out-of-range coordinates."""
    a, o = col(lat), col(lon)
    return F.coalesce(a.between(-90.0, 90.0) & o.between(-180.0, 180.0)
                      & ~F.isnan(a) & ~F.isnan(o), F.lit(False))


def segment_distance_m(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Distance to the nearest point on a segment.

    The foot of the perpendicular is found in a tangent plane at the query point,
    clamped to the segment, and then measured along the great circle.
    """
    a, o, a1, o1, a2, o2 = (col(c) for c in (lat, lon, lat1, lon1, lat2, lon2))
    k = F.cos(F.radians(a))
    dx, dy = (o2 - o1) * k, a2 - a1
    along = ((o - o1) * k * dx + (a - a1) * dy)
    norm = dx * dx + dy * dy
    t = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / norm))) \
        .otherwise(0.0)
    return haversine_m(a, o, a1 + t * (a2 - a1), o1 + t * (o2 - o1))


def unit_vector(lat, lon) -> tuple[Column, Column, Column]:
    a, o = F.radians(col(lat)), F.radians(col(lon))
    return F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)


# --- grid ---------------------------------------------------------------------------------

_SHIFT_LEVEL, _SHIFT_COL, _MASK = 56, 28, (1 << 28) - 1


def _pack(level: int, column: Column, row: Column) -> Column:
    return F.lit(level << _SHIFT_LEVEL).cast("bigint") \
        + F.shiftleft(column.cast("bigint"), _SHIFT_COL) + row.cast("bigint")


def cell_column(cell) -> Column:
    return F.shiftright(col(cell), _SHIFT_COL).bitwiseAND(F.lit(_MASK).cast("bigint"))


def cell_row(cell) -> Column:
    return col(cell).bitwiseAND(F.lit(_MASK).cast("bigint"))


def cell_of(lat, lon, level: int) -> Column:
    """The cell holding a coordinate; null for an invalid one."""
    n = 1 << level
    x = F.floor((col(lon) + 180.0) / 360.0 * n)
    y = F.floor((F.sin(F.radians(col(lat))) + 1.0) / 2.0 * n)
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v))
    return F.when(is_valid_coordinate(lat, lon), _pack(level, clamp(x), clamp(y)))


def cell_parent(cell, level: int, parent_level: int) -> Column:
    d = level - parent_level
    return _pack(parent_level, F.shiftright(cell_column(cell), d),
                 F.shiftright(cell_row(cell), d))


def cell_lat(cell, level: int) -> Column:
    n = 1 << level
    return F.degrees(F.asin((cell_row(cell).cast("double") + 0.5) / n * 2.0 - 1.0))


def cell_lon(cell, level: int) -> Column:
    n = 1 << level
    return (cell_column(cell).cast("double") + 0.5) / n * 360.0 - 180.0


def cell_area_km2(level: int) -> float:
    """Every cell of a level has this area."""
    return 4.0 * math.pi * EARTH_RADIUS_KM ** 2 / (4 ** level)


def k_ring(cell, level: int, k: int) -> Column:
    """The cell and its neighbours up to ``k`` steps, as an array.

    Columns wrap around the antimeridian; rows stop at the poles.
    """
    n = 1 << level
    steps = [(dx, dy) for dx in range(-k, k + 1) for dy in range(-k, k + 1)]
    x, y = cell_column(cell), cell_row(cell)
    ids = F.array(*[
        F.when((y + dy >= 0) & (y + dy < n), _pack(level, F.pmod(x + dx, F.lit(n)), y + dy))
        for dx, dy in steps])
    return F.array_distinct(F.array_compact(ids))


def with_cell(df: DataFrame, lat: str, lon: str, level: int, name: str = "cell") -> DataFrame:
    return df.withColumn(name, cell_of(lat, lon, level))
