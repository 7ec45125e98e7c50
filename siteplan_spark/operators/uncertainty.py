"""Continuous uncertainty from five named components, and the tiers read off it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.operators.quantiles import group_quantile
from siteplan_spark.operators.ranking import midrank_percentile

# The five components and their declared equal weights.
COMPONENTS = ("prediction_interval", "out_of_distribution", "reconciliation_movement",
              "allocation_penalty", "source_degradation")
DEFAULT_WEIGHTS = {name: 0.2 for name in COMPONENTS}
STATE_ONLY = "state_total_only"


def _clip(c: Column) -> Column:
    """Clipped to [0, 1]; a missing value stays missing (greatest/least skip nulls)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def combine_score(components: Sequence[str] = COMPONENTS,
                  weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the clipped components; all present, weights sum to one."""
    w = dict(weights or {c: 1.0 / len(components) for c in components})
    if set(w) != set(components):
        raise ValueError("every component needs exactly one weight")
    if abs(sum(w.values()) - 1.0) > 1e-8:
        raise ValueError(f"component weights sum to {sum(w.values())}, not 1")
    total = F.lit(0.0)
    for c in components:
        total = total + _clip(F.col(c)) * w[c]
    return total


def weight_sensitivity(df: DataFrame, components: Sequence[str] = COMPONENTS,
                       weights: Mapping[str, float] | None = None,
                       step: float = 0.1) -> DataFrame:
    """Change of the mean score when one weight is raised and all are renormalised."""
    base = dict(weights or {c: 1.0 / len(components) for c in components})
    means = df.agg(*[F.avg(_clip(F.col(c))).alias(c) for c in components])
    rows = []
    for c in components:
        moved = {k: v + (step if k == c else 0.0) for k, v in base.items()}
        scale = sum(moved.values())
        shift = F.lit(0.0)
        for k in components:
            shift = shift + F.col(k) * (moved[k] / scale - base[k])
        rows.append(F.struct(F.lit(c).alias("component"), shift.alias("delta")))
    return means.select(F.inline(F.array(*rows)))


def allocation_penalty(df: DataFrame, penalties: DataFrame, multipliers: DataFrame,
                       grain: str = "grain", band: str = "band") -> DataFrame:
    """Measured error of the evidence grain times the complexity multiplier, clipped.

    ``penalties(grain, base)``, ``multipliers(band, multiplier)``. A grain without a
    measured error keeps a null penalty, to be refused rather than invented.
    """
    return (df.join(penalties.select(grain, "base"), grain, "left")
            .join(multipliers.select(band, "multiplier"), band, "left")
            .withColumn("allocation_penalty",
                        _clip(F.col("base") * F.coalesce("multiplier", F.lit(1.0))))
            .drop("base", "multiplier"))


def complexity_multipliers(strata: DataFrame, overall: float) -> DataFrame:
    """(band, tvd) relative to the overall mean."""
    if overall <= 0:
        raise ValueError("the overall measured error must be positive")
    return strata.select("band", (F.col("tvd") / overall).alias("multiplier"))


def quantile_threshold(df: DataFrame, score: str, grain: str, q: float = 0.75) -> DataFrame:
    """One row: the interpolated quantile over state-total-only rows."""
    subset = df.where(F.col(grain) == STATE_ONLY)
    return group_quantile(subset, [], score, q, "linear", "threshold")


def assign_tier(score: str, grain: str, threshold: str | Column) -> Column:
    t = F.col(threshold) if isinstance(threshold, str) else threshold
    missing = F.raise_error(F.lit("a state-total-only row has no score")).cast("string")
    return (F.when(F.col(grain) != STATE_ONLY, "A").when(F.col(score).isNull(), missing)
            .when(F.col(score) >= t, "C").otherwise("B"))


def with_tiers(df: DataFrame, score: str, grain: str, q: float = 0.75) -> DataFrame:
    """One threshold for the whole table; an error when no row can set it."""
    found = quantile_threshold(df, score, grain, q).select("threshold").first()
    if found is None or found["threshold"] is None:
        raise ValueError("no state-total-only row with a score: there is no threshold")
    return df.withColumn("threshold", F.lit(found["threshold"])).withColumn(
        "tier", assign_tier(score, grain, "threshold"))


def mahalanobis_percentile(training: DataFrame, targets: DataFrame, features: Sequence[str],
                           id_col: str, name: str = "out_of_distribution") -> DataFrame:
    """Distance from the training distribution, as a mid-rank percentile.

    The mean and covariance come from one distributed aggregate; only that k x k matrix
    reaches the driver, and the distance is a column expression.
    """
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = training.agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    cov += 1e-8 * np.trace(cov) / max(k, 1) * np.eye(k)
    inverse = np.linalg.pinv(cov)
    terms = []
    for i in range(k):
        for j in range(k):
            terms.append(f"(`{features[i]}` - {row[f'm{i}']!r}D) * "
                         f"(`{features[j]}` - {row[f'm{j}']!r}D) * {float(inverse[i, j])!r}D")
    scored = targets.withColumn("_q", F.expr(" + ".join(terms))).withColumn(
        "mahalanobis", F.sqrt(F.when(F.col("_q") < 0, 0.0).otherwise(F.col("_q")))).drop("_q")
    return midrank_percentile(scored, "mahalanobis", id_col, name)
