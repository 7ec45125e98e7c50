"""Exact medians and quantiles that never gather a whole group in one task.

A bounded sketch brackets the wanted rank; only the distinct values inside the
bracket (a few ten-thousandths of the group) are ordered, on top of an exact count
of what lies below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY


def group_quantile(df: DataFrame, by: Sequence[str], value: str, q: float = 0.5,
                   kind: str = "linear", name: str = "quantile") -> DataFrame:
    """Exact quantile per group: columns ``by``, ``n``, ``name``.

    kind ``linear`` interpolates between the two neighbouring ranks (``q=0.5`` is the
    averaged median); ``upper`` is the element at index ``floor(n * q)``.
    """
    if kind not in ("linear", "upper"):
        raise ValueError(f"unknown quantile kind {kind!r}")
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    low, high = max(0.0, q - MARGIN), min(1.0, q + MARGIN)
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("_v", [low, high], ACCURACY).alias("_b"))
    pos = (F.col("n") - 1) * q
    first = F.floor(pos) if kind == "linear" else F.least(F.floor(F.col("n") * q),
                                                          F.col("n") - 1)
    stats = stats.withColumns({
        # a group this small is ordered whole; in a larger one the margin is several rows
        "_lo": F.when(F.col("n") > ACCURACY, F.col("_b")[0]).otherwise(float("-inf")),
        "_hi": F.when(F.col("n") > ACCURACY, F.col("_b")[1]).otherwise(float("inf")),
        "_k": first.cast("bigint"),
        "_frac": (pos - F.floor(pos)) if kind == "linear" else F.lit(0.0)}).drop("_b")
    distinct = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if by:
        keyed = stats.withColumnsRenamed({c: f"_g_{c}" for c in by})
        joined = distinct.join(keyed, reduce(lambda a, b: a & b, [
            F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])).drop(
            *[f"_g_{c}" for c in by])
    else:
        joined = distinct.join(F.broadcast(stats))  # one row
    # values below the bracket collapse to one row per group before any ordering
    inside = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))
    compact = (joined.where(F.col("_v") <= F.greatest(F.col("_hi"), F.col("_lo")))
               .groupBy(*by, inside.alias("_v"), "n", "_k", "_frac")
               .agg(F.sum("_c").alias("_c")))
    w = Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, 0)
    placed = compact.withColumn("_end", F.sum("_c").over(w)).withColumn(
        "_start", F.col("_end") - F.col("_c"))

    def at(k):
        return F.max(F.when((F.col("_start") <= k) & (k < F.col("_end")), F.col("_v")))

    k1 = F.col("_k")
    k2 = F.when(F.col("_frac") > 0, F.col("_k") + 1).otherwise(F.col("_k"))
    picked = placed.groupBy(*by).agg(F.max("n").alias("n"), F.max("_frac").alias("_frac"),
                                     at(k1).alias("_a"), at(k2).alias("_z"))
    # the sketch errs by n / ACCURACY ranks at most and the margin is five times that; should a
    # rank lie outside the bracket all the same, that is an error and never a null
    missed = F.raise_error(F.lit("the quantile bracket misses its rank")).cast("double")
    quantile = F.col("_a") + F.col("_frac") * (F.col("_z") - F.col("_a"))
    return picked.select(*by, "n", F.when(F.col("n") > 0, F.coalesce(quantile, missed)).alias(name))


def group_median(df: DataFrame, by: Sequence[str], value: str,
                 name: str = "median") -> DataFrame:
    """The averaged median."""
    return group_quantile(df, by, value, 0.5, "linear", name)


def upper_median(df: DataFrame, by: Sequence[str], value: str,
                 name: str = "median") -> DataFrame:
    """The element at index ``n // 2`` of the sorted values."""
    return group_quantile(df, by, value, 0.5, "upper", name)
