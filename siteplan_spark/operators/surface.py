"""The demand surface and its backtest: the operators chained end to end."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan_spark.functions.clean import movement, relative_interval_width
from siteplan_spark.operators import demand as D
from siteplan_spark.operators import ranking as W
from siteplan_spark.operators import reconcile as RC
from siteplan_spark.operators import uncertainty as U
from siteplan_spark.session import cut_lineage

# How a published number came to hold its value.
OBSERVED_COUNT = "native_registry_observed_count"
ZERO_BY_ABSENCE = "native_registry_zero_by_absence"
MODELLED = "modeled_reconciled"


def build_surface(targets: DataFrame, training: DataFrame, features: Sequence[str],
                  count: str, exposure: str, keys: tuple[str, str, str],
                  estimator: D.Estimator, native: DataFrame, native_states: DataFrame,
                  county_totals: DataFrame, state_totals: DataFrame, penalties: DataFrame,
                  degraded_share: float, half_width: DataFrame | None = None,
                  replicates: int = 40) -> tuple[DataFrame, DataFrame]:
    """(surface, totals): fit, predict, bind, reconcile, score, tier.

    ``keys`` names the (area, county, state) columns. The prediction interval is that of
    ridges refitted to resampled areas, unless ``half_width(area, half_width)`` is supplied.
    """
    area, county, state = keys
    predict = D.fit_counts(estimator, training, features, count, exposure)
    raw = predict(targets).withColumnRenamed("predicted", "raw")
    bound, totals = RC.constraint_plan(raw, area, county, state, native, native_states,
                                       county_totals, state_totals)
    totals = cut_lineage(totals)
    done = RC.proportional_scale(bound, "constraint", "raw", totals.select(
        "constraint", "total"))
    spread = half_width if half_width is not None else D.bootstrap_spread(
        training, targets, features, count, exposure, area, replicates)
    scored = done.join(spread.select(area, "half_width"), area, "left").join(
        penalties.select("grain", "base"), "grain", "left")
    scored = U.mahalanobis_percentile(training, scored, features, area)
    scored = scored.withColumns({
        "prediction_interval": relative_interval_width(
            F.coalesce("half_width", F.lit(0.0)), "raw"),
        "reconciliation_movement": movement("reconciled", "raw"),
        "allocation_penalty": F.col("base"),
        "source_degradation": F.lit(float(degraded_share))}).drop("base", "half_width")
    scored = cut_lineage(scored.withColumn("uncertainty_score", U.combine_score()))
    provenance = (F.when(F.col("constraint").startswith("tract:"), OBSERVED_COUNT)
                  .when(F.col("constraint").startswith("zero:"), ZERO_BY_ABSENCE)
                  .otherwise(MODELLED))
    return (U.with_tiers(scored, "uncertainty_score", "grain")
            .withColumn("provenance", provenance), totals)


def surface_summary(surface: DataFrame, value: str = "reconciled") -> DataFrame:
    """Rows, total and mean uncertainty by grain, by tier, by provenance, and overall."""
    keys = ["grain", "tier", "provenance"]
    cells = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("category"))
                      for k in keys], F.struct(F.lit("all").alias("dimension"),
                                               F.lit("all").alias("category")))
    return surface.select(F.inline(cells), F.col(value).alias("_v"), "uncertainty_score").groupBy(
        "dimension", "category").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("_v").alias("total"),
        F.avg("uncertainty_score").alias("mean_uncertainty"))


def evidence_summary(surface: DataFrame, value: str, anchored: str, grain: str,
                     tier: str) -> DataFrame:
    """Total, anchored share, and value by grain and by tier."""
    cells = F.array(F.struct(F.lit("grain").alias("dimension"), F.col(grain).alias("category")),
                    F.struct(F.lit("tier").alias("dimension"), F.col(tier).alias("category")))
    parts = surface.select(F.inline(cells), F.col(value).alias("_v")).groupBy(
        "dimension", "category").agg(F.sum("_v").alias("value"))
    total = surface.agg(F.sum(value).alias("_t"), (F.sum(F.col(value) * F.col(anchored))
                        / F.nullif(F.sum(value), F.lit(0))).alias("_a"))
    return parts.unionByName(total.select(
        F.inline(F.array(
            F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("category"),
                     F.col("_t").alias("value")),
            F.struct(F.lit("anchored_share").alias("dimension"), F.lit("all").alias("category"),
                     F.coalesce("_a", F.lit(0.0)).alias("value"))))))


def align_origin(cells: DataFrame, deployments: DataFrame, cell: str, demand: str,
                 population: str, prior: str, opened: str, cutoff: str,
                 weights: Sequence[str], months: int = 24, deciles: int = 10) -> DataFrame:
    """Gain curves of the cutoff-valid ranking and two baselines over one support.

    Only inhabited cells are ranked; every later deployment counts in the denominator.
    """
    support = cut_lineage(cells.where(F.col(population) >= 1))
    targets = cut_lineage(deployments.where(W.event_window(opened, cutoff, months))
                          .groupBy(cell).agg(*[F.sum(w).alias(w) for w in weights]))
    parts = []
    for name, value in (("model", demand), ("population", population),
                        ("existing_network", prior)):
        ranked = W.rank_desc(support.select(cell, F.col(value).cast("double").alias("_value")),
                             cell, "_value")
        parts.append(W.gain_curve(ranked, targets, cell, "rank", weights, deciles).select(
            F.lit(name).alias("ranking"), "*"))
    return reduce(DataFrame.unionByName, parts)


def origin_support(cells: DataFrame, deployments: DataFrame, cell: str, population: str,
                   opened: str, cutoff: str, months: int = 24) -> DataFrame:
    """How many cells were ranked, and what share of later events fell inside them."""
    inside = cells.where(F.col(population) >= 1).select(cell).withColumn("_in", F.lit(1))
    later = deployments.where(W.event_window(opened, cutoff, months)).groupBy(cell).agg(
        F.count(F.lit(1)).alias("_n")).join(inside, cell, "left")
    return cells.agg(
        F.count(F.lit(1)).alias("cells_with_demand"),
        F.sum(F.when(F.col(population) >= 1, 1).otherwise(0)).alias("ranked_cells")).join(
        later.agg(F.sum("_n").alias("deployments"), (
            F.sum(F.when(F.col("_in") == 1, F.col("_n")).otherwise(0))
            / F.nullif(F.sum("_n"), F.lit(0))).alias("share_inside")))


def lift_table(curves: DataFrame, metric: str, model: str = "model") -> DataFrame:
    """Top-decile capture of the model over each baseline."""
    top = curves.where(F.abs(F.col("decile") - 0.1) < 1e-9).select(
        "ranking", F.col(metric).alias("_m"))
    mine = top.where(F.col("ranking") == model).select(F.col("_m").alias("_mine"))
    return top.where(F.col("ranking") != model).join(F.broadcast(mine)).select(
        "ranking", W.lift("_mine", "_m").alias("lift"))
