"""Distance-based access: gaps, sweeps, gap cells, display roll-ups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.operators.quantiles import upper_median
from siteplan_spark.session import cut_lineage


def access_gap(df: DataFrame, distance: str, population: str, threshold: float,
               by: Sequence[str] = ()) -> DataFrame:
    """Population and points beyond a threshold, their share, and the upper median.

    A distance of Infinity (no site at all) is beyond every threshold and is left out of
    the median.
    """
    # a distance is expensive to compute and is read three times below
    df = cut_lineage(df.select(*by, distance, population))
    beyond = F.col(distance) > threshold
    gap = df.groupBy(*by).agg(
        F.sum(population).alias("population_total"),
        F.sum(F.when(beyond, F.col(population)).otherwise(0)).alias("population_in_gap"),
        F.count(F.lit(1)).alias("points_total"),
        F.sum(F.when(beyond, 1).otherwise(0)).alias("points_in_gap"))
    gap = gap.withColumn("share_in_gap", F.when(
        F.col("population_total") > 0,
        F.col("population_in_gap") / F.col("population_total")).otherwise(0.0))
    finite = df.where(F.col(distance) < float("inf"))
    med = upper_median(finite, by, distance, "median_distance").drop("n")
    if by:
        med = med.withColumnsRenamed({c: f"_g_{c}" for c in by})
        same = reduce(lambda a, b: a & b, [
            F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by])
        out = gap.join(med, same, "left").drop(*[f"_g_{c}" for c in by])
    else:
        out = gap.join(F.broadcast(med), how="left")
    return out.withColumn("median_distance",
                          F.coalesce("median_distance", F.lit(float("inf"))))


def sensitivity_curve(df: DataFrame, distance: str, population: str, start: float,
                      stop: float, step: float, by: Sequence[str] = (),
                      or_equal: bool = False) -> DataFrame:
    """Population beyond (or within, with ``or_equal`` reversed by the caller) each step.

    One pass: a row falls in the highest threshold it exceeds, and thresholds are
    summed from the top over the small histogram. No sweep join.
    """
    n = int(round((stop - start) / step)) + 1
    steps = [start + i * step for i in range(n)]
    lits = F.array(*[F.lit(float(s)) for s in steps])
    d = F.col(distance)
    exceeded = F.size(F.filter(lits, (lambda t: d >= t) if or_equal else (lambda t: d > t)))
    hist = (df.groupBy(*by, exceeded.alias("_slot"))
            .agg(F.sum(population).alias("_pop"), F.count(F.lit(1)).alias("_pts")))
    per = hist.groupBy(*by).agg(F.collect_list(F.struct("_slot", "_pop", "_pts")).alias("_h"))

    # a sum keeps its type: whole weights stay exact, fractional ones stay fractional
    kinds = {"_pop": hist.schema["_pop"].dataType, "_pts": hist.schema["_pts"].dataType}

    def beyond(i: int, field: str) -> Column:
        return F.aggregate(
            F.filter("_h", lambda h: h["_slot"] > i), F.lit(0).cast(kinds[field]),
            lambda acc, h: (acc + F.coalesce(h[field], F.lit(0))).cast(kinds[field]))
    rows = F.array(*[F.struct(F.lit(float(s)).alias("threshold"),
                              beyond(i, "_pop").alias("population_beyond"),
                              beyond(i, "_pts").alias("points_beyond"))
                     for i, s in enumerate(steps)])
    return per.select(*by, F.inline(rows))


def gap_at_threshold(df: DataFrame, distance: str, population: str, low_income: str,
                     threshold: float, scope: Column | None = None) -> DataFrame:
    """Population, share, points and equity population; both halves in one scope."""
    rows = df if scope is None else df.where(scope)
    beyond = F.col(distance) > threshold
    z = F.coalesce(F.col(population), F.lit(0))
    return rows.agg(
        F.coalesce(F.sum(F.when(beyond, z).otherwise(0)), F.lit(0)).alias("population"),
        F.coalesce(F.sum(z), F.lit(0)).alias("_t"),
        F.coalesce(F.sum(F.when(beyond, 1).otherwise(0)), F.lit(0)).alias("points"),
        F.coalesce(F.sum(F.when(beyond, z * F.coalesce(low_income, F.lit(0.0)))), F.lit(0.0))
         .alias("equity_population"),
    ).withColumn("share", F.when(F.col("_t") > 0, F.col("population") / F.col("_t"))
                 .otherwise(0.0)).drop("_t")


def _km(weighted: str, plain: str) -> Column:
    return F.when(F.col("population") > 0, F.col(weighted) / F.col("population")).otherwise(
        F.col(plain) / F.col("points"))


def gap_cells(df: DataFrame, cell: str, distance: str, population: str, low_income: str,
              threshold: float) -> DataFrame:
    """Gap points rolled to cells; the distance is a plain mean where nobody lives."""
    p, d = F.col(population), F.col(distance)
    return (df.where(d > threshold).groupBy(cell).agg(
        F.sum(p).alias("population"), F.sum(d * p).alias("_w"), F.sum(d).alias("_s"),
        F.sum(p * F.coalesce(low_income, F.lit(0.0))).alias("equity"),
        F.count(F.lit(1)).alias("points"))
        .withColumn("km", _km("_w", "_s")).drop("_w", "_s"))


def rollup_gap_cells(cells: DataFrame, parent: Column, name: str = "cell") -> DataFrame:
    """Gap cells to a coarser grid, mass conserved."""
    return (cells.groupBy(parent.alias(name)).agg(
        F.sum("population").alias("population"),
        F.sum(F.col("km") * F.col("population")).alias("_w"),
        F.sum(F.col("km") * F.col("points")).alias("_s"),
        F.sum("equity").alias("equity"), F.sum("points").alias("points"))
        .withColumn("km", _km("_w", "_s")).drop("_w", "_s"))


def rollup_to_parent(df: DataFrame, parent: str, additive: Sequence[str],
                     weighted: dict[str, str], dominant: tuple[str, str],
                     unanimous: str) -> DataFrame:
    """Display roll-up: sums conserved, means weighted, one label, honest categories.

    ``weighted``: value to weight column. ``dominant``: (label, weight); the label with
    the largest weight wins, ties by label. ``unanimous`` survives only if all children
    agree.
    """
    label, lw = dominant
    def mean(v: str, w: str) -> Column:
        ok = (F.abs(F.col(v)) < float("inf")) & ~F.isnan(v)
        return F.when(F.sum(w) > 0, F.sum(F.when(ok, F.col(v) * F.col(w)).otherwise(0.0))
                      / F.sum(w)).otherwise(0.0).alias(v)
    body = df.groupBy(parent).agg(
        *[F.sum(a).alias(a) for a in additive],
        *[mean(v, w) for v, w in weighted.items()],
        F.count(F.lit(1)).alias("children"),
        F.when(F.min(unanimous) == F.max(unanimous), F.min(unanimous)).alias(unanimous))
    labels = (df.where(F.col(label).isNotNull() & (F.col(label) != ""))
              .groupBy(parent, label).agg(F.sum(lw).alias("_w"))
              .groupBy(parent).agg(
                  F.min_by(label, F.struct((-F.col("_w")).alias("w"), F.col(label).alias("l")))
                   .alias(label), F.count(F.lit(1)).alias("labels")))
    return body.join(labels, parent, "left").withColumn("labels",
                                                        F.coalesce("labels", F.lit(0)))


def bbox(df: DataFrame, lat: str, lon: str, pad: float = 0.0,
         by: Sequence[str] = ()) -> DataFrame:
    """Padded extent of the finite points, per group; nulls when there are none at all."""
    ok = ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(F.col(lat)) < float("inf")) \
        & (F.abs(F.col(lon)) < float("inf"))
    return df.where(ok).groupBy(*by).agg(
        (F.min(lat) - pad).alias("south"), (F.max(lat) + pad).alias("north"),
        (F.min(lon) - pad).alias("west"), (F.max(lon) + pad).alias("east"))


def focus_and_context(cells: DataFrame, value: str, id_col: str, k: int,
                      parent: Column) -> tuple[DataFrame, DataFrame]:
    """The top k by a measure within a scope, and focus/context rolled up separately.

    Returns (summary, rolled): the cut-off value and population share, then one row per
    (side, parent). A parent may appear on both sides. Without cells the summary counts zero focus
    cells; cut-off and share are null.
    """
    top = cells.orderBy(F.desc(value), id_col).limit(k).select(id_col)
    tagged = cells.join(F.broadcast(top.withColumn("_f", F.lit(True))), id_col, "left") \
        .withColumn("side", F.when(F.col("_f"), "focus").otherwise("context")).drop("_f")
    focus = F.col("side") == "focus"
    summary = tagged.agg(
        F.min(F.when(focus, F.col(value))).alias("cutoff"),
        F.count(F.when(focus, 1)).alias("focus_cells"),  # none, not null, of no cells
        (F.sum(F.when(focus, F.col("population")).otherwise(0))
         / F.nullif(F.sum("population"), F.lit(0))).alias("population_share"))
    rolled = tagged.groupBy("side", parent.alias("parent")).agg(
        F.sum("population").alias("population"),
        F.sum(F.col("km") * F.col("population")).alias("_w"),
        F.sum(F.col("km") * F.col("points")).alias("_s"), F.sum("points").alias("points"))
    return summary, rolled.withColumn("km", _km("_w", "_s")).drop("_w", "_s")


def top_groups(df: DataFrame, group: str, value: str, k: int) -> DataFrame:
    return df.groupBy(group).agg(F.sum(value).alias(value)).orderBy(
        F.desc(value), group).limit(k)


def label_leaders(df: DataFrame, label: str, value: str, k: int = 3) -> DataFrame:
    """Best value per label, then the k best labels."""
    return df.groupBy(label).agg(F.max(value).alias(value)).orderBy(
        F.desc(value), label).limit(k)


def freshness(df: DataFrame, generated_at: str, now: str, stale_after_days: float = 14.0
              ) -> DataFrame:
    """Age in days of each artifact and whether it is stale."""
    age = (F.unix_timestamp(F.to_timestamp(F.lit(now)))
           - F.unix_timestamp(F.col(generated_at).cast("timestamp"))) / 86400.0
    return df.withColumns({"age_days": age, "is_stale": age > stale_after_days})


def dominant_per_group(df: DataFrame, by: Sequence[str], category: str,
                       weight: str) -> DataFrame:
    """Largest category by weight (ties by name) and its share of the group."""
    per = df.groupBy(*by, category).agg(F.sum(weight).alias("_w"))
    return per.groupBy(*by).agg(
        F.min_by(category, F.struct((-F.col("_w")).alias("w"), F.col(category).alias("c")))
         .alias("dominant"),
        F.when(F.sum("_w") > 0, F.max("_w") / F.sum("_w")).alias("dominant_share"))


