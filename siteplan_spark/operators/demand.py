"""Rates per exposure: fitted on coarse areas, applied to fine ones, scored honestly."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteplan_spark.operators.boosting import fit_boosted_rate
from siteplan_spark.operators.quantiles import upper_median
from siteplan_spark.operators.ranking import global_rank
from siteplan_spark.operators.reconcile import proportional_scale
from siteplan_spark.session import cut_lineage

RAW, RECONCILED = "raw", "reconciled"


def impute_upper_median(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(filled rows with ``imputed_count``, one row of the medians used).

    All columns are melted once, so k medians cost one pass rather than k.
    """
    melted = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"))
        for f in features])))
    med = upper_median(melted, ["feature"], "value")
    wide = med.agg(*[F.coalesce(F.max(F.when(F.col("feature") == f, F.col("median"))),
                                F.lit(0.0)).alias(f"_m_{f}") for f in features])
    missing = reduce(lambda a, b: a + b, [
        F.when(F.col(f).isNull(), 1).otherwise(0) for f in features])
    filled = (df.withColumn("imputed_count", missing).join(F.broadcast(wide))
              .withColumns({f: F.coalesce(F.col(f), F.col(f"_m_{f}")) for f in features})
              .drop(*[f"_m_{f}" for f in features]))
    return filled, wide.toDF(*features)


def constant_rate(training: DataFrame, count: str, exposure: str) -> DataFrame:
    """One row: counts per unit of exposure over areas with at least one unit."""
    return training.where(F.col(exposure) >= 1).agg(
        (F.sum(count) / F.sum(exposure)).alias("rate"))


@dataclass(frozen=True)
class Estimator:
    """A candidate: a fresh fit per call, a name, and a complexity rank for ties.

    ``fit(rows, features, rate, exposure)`` returns a function that adds ``rate_hat``.
    ``held_out(df, group, features, count, exposure)``, where the model has mergeable
    sufficient statistics, predicts every group without itself in one pass.
    """

    name: str
    rank: int
    fit: Callable[[DataFrame, Sequence[str], str, str], Callable[[DataFrame], DataFrame]]
    held_out: Callable[[DataFrame, str, Sequence[str], str, str], DataFrame] | None = None


class _Scaler:
    """Training means and population deviations: 2k scalars on the driver."""

    def __init__(self, rows: DataFrame, features: Sequence[str], *extra) -> None:
        got = rows.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                       *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
                       *extra).first()
        self.extra = got
        self.parts = [(f, got[f"m{i}"] or 0.0, got[f"s{i}"] or 1.0)
                      for i, f in enumerate(features)]
        self.assembler = VectorAssembler(
            inputCols=[f"_z{i}" for i in range(len(features))], outputCol="_x")

    def apply(self, df: DataFrame) -> DataFrame:
        scaled = df.selectExpr("*", *[f"(`{f}` - {float(m)!r}D) / {float(s)!r}D AS _z{i}"
                                      for i, (f, m, s) in enumerate(self.parts)])
        return self.assembler.transform(scaled).drop(*[f"_z{i}" for i in range(len(self.parts))])


def _finish(df: DataFrame, rate) -> DataFrame:
    return df.withColumn("rate_hat", F.greatest(F.lit(0.0), rate)).drop("_x", "_p")


def ridge_log_rate(alpha: float = 1.0) -> Estimator:
    """Weighted ridge on log1p(rate); the normal equations are one pass over the rows."""
    def fit(rows, features, rate, exposure):
        rows = rows.withColumn("_y", F.log1p(rate))
        scaler = _Scaler(rows, features, F.sum(exposure).alias("w"),
                         F.sum(F.col(exposure) * F.col("_y")).alias("wy"),
                         F.sum(F.col(exposure) * F.col("_y") * F.col("_y")).alias("wyy"))
        s = scaler.extra
        # Spark scales the penalty by the weighted label deviation and the weight sum
        sd = max(s["wyy"] / s["w"] - (s["wy"] / s["w"]) ** 2, 0.0) ** 0.5
        model = LinearRegression(featuresCol="_x", labelCol="_y", weightCol=exposure,
                                 predictionCol="_p", solver="normal", elasticNetParam=0.0,
                                 regParam=alpha * sd / s["w"] if sd else 0.0,
                                 standardization=False).fit(scaler.apply(rows))
        return lambda df: _finish(model.transform(scaler.apply(df)), F.expm1("_p"))

    def held_out(df, group, features, count, exposure):
        return _ridge_held_out(df, group, features, count, exposure, alpha)
    return Estimator("ridge_log_rate", 1, fit, held_out)


def _ridge_moments(count: str, exposure: str, features: Sequence[str],
                   times: str = "1.0D") -> list[str]:
    """SQL sums a ridge fit needs; ``times`` is how often a row occurs."""
    k = len(features)
    y, w = f"ln(1.0D + `{count}` / `{exposure}`)", f"{times} * `{exposure}`"
    x = [f"CAST(`{f}` AS DOUBLE)" for f in features]
    sums = [f"sum({times}) AS n", f"sum({w}) AS w", f"sum({w} * {y}) AS wy"]
    for i in range(k):
        sums += [f"sum({times} * {x[i]}) AS s{i}", f"sum({times} * {x[i]} * {x[i]}) AS q{i}",
                 f"sum({w} * {x[i]}) AS wx{i}", f"sum({w} * {x[i]} * {y}) AS wxy{i}"]
        sums += [f"sum({w} * {x[i]} * {x[j]}) AS wxx{i}_{j}" for j in range(i, k)]
    return sums


def _names(sums: Sequence[str]) -> list[str]:
    return [e.rsplit(" AS ", 1)[1] for e in sums]


def _solved_ridges(moments: DataFrame, key: str, k: int, alpha: float) -> DataFrame:
    """(key, _b: intercept and coefficients) from one row of moments for each key.

    The systems are solved where their rows are, so their number has no bound. Moments without
    weight give null.
    """
    names = [c for c in moments.columns if c != key]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            m = {c: frame[c].to_numpy(np.float64) for c in names}
            some = np.where(m["w"] > 0, m["w"], 1.0)
            wx = np.stack([m[f"wx{i}"] for i in range(k)], 1)
            a = np.zeros((len(frame), k, k))
            for i in range(k):
                for j in range(i, k):
                    a[:, i, j] = a[:, j, i] = m[f"wxx{i}_{j}"] - wx[:, i] * wx[:, j] / some
                mean = m[f"s{i}"] / np.where(m["n"] > 0, m["n"], 1.0)
                var = np.maximum(m[f"q{i}"] / np.where(m["n"] > 0, m["n"], 1.0) - mean * mean, 0.0)
                a[:, i, i] += alpha * np.where(var > 0, var, 1.0)
            b = np.stack([m[f"wxy{i}"] for i in range(k)], 1) - wx * (m["wy"] / some)[:, None]
            beta = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            first = (m["wy"] - (beta * wx).sum(1)) / some
            rows = np.column_stack([first, beta])
            yield pd.DataFrame({key: frame[key], "_b": [
                list(r) if w > 0 else None for r, w in zip(rows, m["w"], strict=True)]})

    kind = moments.schema[key].dataType.simpleString()
    return moments.mapInPandas(solve, f"`{key}` {kind}, _b array<double>")


def _ridge_line(features: Sequence[str], b: str = "_b") -> str:
    return " + ".join([f"{b}[0]", *[f"{b}[{i + 1}] * CAST(`{f}` AS DOUBLE)"
                                    for i, f in enumerate(features)]])


def _ridge_held_out(df: DataFrame, group: str, features: Sequence[str], count: str,
                    exposure: str, alpha: float) -> DataFrame:
    """Every group predicted by the ridge fitted without it, from one aggregation.

    The fit needs only sums of products, and the sums without a group are the total minus
    the group's own. A k x k system is solved for each group on the executors.
    """
    sums = _ridge_moments(count, exposure, features)
    train = df.where((F.col(exposure) >= 1) & F.col(count).isNotNull())
    own = cut_lineage(train.groupBy(group).agg(*[F.expr(e) for e in sums]))
    total = own.agg(*[F.sum(c).alias(f"_t_{c}") for c in _names(sums)])  # one row
    groups = df.select(group).distinct()
    rest = groups.join(own, group, "left").join(F.broadcast(total)).select(group, *[
        (F.col(f"_t_{c}") - F.coalesce(c, F.lit(0.0))).alias(c) for c in _names(sums)])
    coef = _solved_ridges(rest, group, len(features), alpha)
    return df.join(coef, group).withColumn("predicted", F.expr(
        f"greatest(0.0D, expm1({_ridge_line(features)})) * `{exposure}`")).drop("_b")


def poisson_rate(alpha: float = 1e-6, max_iter: int = 25) -> Estimator:
    """Log-link Poisson on the rate, weighted by exposure."""
    def fit(rows, features, rate, exposure):
        scaler = _Scaler(rows, features)
        model = GeneralizedLinearRegression(
            family="poisson", link="log", featuresCol="_x", labelCol=rate,
            weightCol=exposure, predictionCol="_p", regParam=alpha, maxIter=max_iter,
            tol=1e-10).fit(scaler.apply(rows))
        return lambda df: _finish(model.transform(scaler.apply(df)), F.col("_p"))

    def held_out(df, group, features, count, exposure):
        return _poisson_held_out(df, group, features, count, exposure, alpha)
    return Estimator("poisson_glm", 2, fit, held_out)


#: Folds fitted side by side: their coefficients travel with each pass.
FOLDS_AT_ONCE = 4096
#: A fit that has not settled after so many passes is an error.
PASSES = 100


def _fold_pass(k: int, beta: np.ndarray, first: int):
    """Moments of one reweighted step of every fold, over the rows that are not its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folds = len(beta)
        a = np.zeros((folds, k + 1, k + 1))
        b = np.zeros((folds, k + 1))
        rows = max(1, 4_000_000 // (folds * (k + 1)))
        for batch in batches:
            own = batch.column(0).to_numpy() - first
            c, e = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            x = np.column_stack([np.ones(len(c)), *[
                batch.column(3 + i).to_numpy() for i in range(k)]])
            for at in range(0, len(c), rows):
                part = slice(at, at + rows)
                xs, line = x[part], x[part] @ beta.T
                w = e[part, None] * np.exp(line)
                mine = (own[part] >= 0) & (own[part] < folds)
                w[np.flatnonzero(mine), own[part][mine]] = 0.0
                # w * (line + (y - mu) / mu), with y * e the count
                z = w * (line - 1.0) + np.where(w > 0, c[part, None], 0.0)
                a += np.einsum("rf,ri,rj->fij", w, xs, xs, optimize=True)
                b += z.T @ xs
        f = np.repeat(np.arange(folds), (k + 1) * (k + 2))
        cell = np.tile(np.arange((k + 1) * (k + 2)), folds)
        yield pa.record_batch([pa.array(f), pa.array(cell), pa.array(np.concatenate(
            [a.reshape(folds, -1), b], axis=1).ravel())], names=["fold", "cell", "v"])
    return run


def _poisson_held_out(df: DataFrame, group: str, features: Sequence[str], count: str,
                      exposure: str, alpha: float) -> DataFrame:
    """Every group predicted by the Poisson model fitted without it, all folds in the same passes.

    Folds have different coefficients, so their weights differ row by row and nothing can be
    subtracted; but one pass computes the moments of a reweighted step for every fold, and each
    task sends one set of sums for each fold. Folds beyond ``FOLDS_AT_ONCE`` take further passes.
    """
    k, x = len(features), [F.col(f).cast("double") for f in features]
    train = df.where((F.col(exposure) >= 1) & F.col(count).isNotNull())
    own = train.groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(exposure).cast("double").alias("e"),
        F.sum(count).cast("double").alias("c"),
        *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum(v * v).alias(f"q{i}") for i, v in enumerate(x)])
    folds = cut_lineage(global_rank(
        df.select(group).distinct().join(own, group, "left").fillna(0.0, ["n", "e", "c"]),
        [group], "_fold").withColumn("_fold", F.col("_fold") - 1))
    sums = ["n", "e", "c", *[f"{a}{i}" for a in "sq" for i in range(k)]]
    total = folds.agg(F.count(F.lit(1)).alias("folds"),
                      *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums]).first()
    rows = cut_lineage(train.join(folds.select(group, "_fold"), group).select(
        "_fold", F.col(count).cast("double").alias("c"), F.col(exposure).cast("double").alias("e"),
        *[v.alias(f"x{i}") for i, v in enumerate(x)]))
    fitted = []
    for first in range(0, total["folds"], FOLDS_AT_ONCE):
        block = folds.where(F.col("_fold").between(first, first + FOLDS_AT_ONCE - 1)).orderBy(
            "_fold").toPandas()  # a block of folds
        rest = {c: total[c] - block[c].fillna(0.0).to_numpy() for c in sums}
        some = np.maximum(rest["n"], 1.0)
        spread = np.stack([np.maximum(rest[f"q{i}"] / some - (rest[f"s{i}"] / some) ** 2, 0.0)
                           for i in range(k)], 1)
        penalty = np.zeros((len(block), k + 1, k + 1))
        for i in range(k):
            penalty[:, i + 1, i + 1] = alpha * rest["e"] * np.where(spread[:, i] > 0,
                                                                    spread[:, i], 1.0)
        able = rest["c"] > 0  # without a count all rates are zero
        beta = np.zeros((len(block), k + 1))
        beta[able, 0] = np.log(rest["c"][able] / rest["e"][able])
        for _ in range(PASSES):
            got = (rows.mapInArrow(_fold_pass(k, beta, first), "fold long, cell long, v double")
                   .groupBy("fold", "cell").agg(F.sum("v").alias("v")).toArrow())
            m = np.zeros((len(block), (k + 1) * (k + 2)))
            m[got["fold"].to_numpy(), got["cell"].to_numpy()] = got["v"].to_numpy()
            a = m[:, :(k + 1) ** 2].reshape(-1, k + 1, k + 1) + penalty
            a[~able] = np.eye(k + 1)
            step = np.linalg.solve(a, m[:, (k + 1) ** 2:, None])[:, :, 0]
            moved = np.abs(step - beta)[able].max(initial=0.0)
            beta[able] = step[able]
            if moved <= 1e-9 * (1.0 + np.abs(beta).max()):
                break
        else:
            raise ValueError(f"the Poisson folds still move by {moved} after {PASSES} passes")
        fitted += [(first + i, [float(v) for v in b] if ok else None)
                   for i, (b, ok) in enumerate(zip(beta, able, strict=True))]
    coef = folds.select(group, "_fold").join(df.sparkSession.createDataFrame(
        fitted, "_fold long, _b array<double>"), "_fold").drop("_fold")
    return df.join(coef, group).withColumn("predicted", F.expr(
        f"coalesce(exp({_ridge_line(features)}), 0.0D) * `{exposure}`")).drop("_b")


def boosted_rate(iterations: int = 200, depth: int = 4, step: float = 0.06) -> Estimator:
    """Boosted trees on Poisson loss."""
    def fit(rows, features, rate, exposure):
        return fit_boosted_rate(rows, features, rate, exposure, iterations, depth, step).predict
    return Estimator("boosted_poisson", 3, fit)


def baseline_rate(name: str = "exposure_share", rank: int = 0) -> Estimator:
    def fit(rows, features, rate, exposure):
        got = rows.agg(F.sum(F.col(rate) * F.col(exposure)).alias("c"),
                       F.sum(exposure).alias("e")).first()
        value = got["c"] / got["e"]
        return lambda df: df.withColumn("rate_hat", F.lit(float(value)))

    def held_out(df, group, features, count, exposure):
        return baseline_held_out(df, group, count, exposure).drop("rate")
    return Estimator(name, rank, fit, held_out)


def fit_counts(estimator: Estimator, training: DataFrame, features: Sequence[str], count: str,
               exposure: str) -> Callable[[DataFrame], DataFrame]:
    """Fit on areas with exposure, predict rate x exposure as ``predicted``."""
    rows = training.where((F.col(exposure) >= 1) & F.col(count).isNotNull()).withColumn(
        "_rate", F.col(count) / F.col(exposure))
    predict = estimator.fit(rows, features, "_rate", exposure)
    return lambda df: predict(df).withColumn(
        "predicted", F.col("rate_hat") * F.col(exposure)).drop("rate_hat")


# --- scoring ------------------------------------------------------------------------------

def error_metrics(df: DataFrame, observed: str, predicted: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """WAPE, MAE and R2 per group; null where the observed total makes them undefined."""
    o, p = F.col(observed).cast("double"), F.col(predicted).cast("double")
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(o).alias("observed_total"),
        F.sum(F.abs(o - p)).alias("_abs"), F.sum((o - p) * (o - p)).alias("_sse"),
        F.var_pop(o).alias("_var"))
    sst = F.col("_var") * F.col("n")
    return agg.select(*by, "n", "observed_total",
                      F.when(F.col("observed_total") > 0,
                             F.col("_abs") / F.col("observed_total")).alias("wape"),
                      (F.col("_abs") / F.col("n")).alias("mae"),
                      F.when(sst > 0, 1.0 - F.col("_sse") / sst).alias("r_squared"))


def weighted_wape(scores: DataFrame, by: Sequence[str] = ("estimator", "mode")) -> DataFrame:
    return scores.groupBy(*by).agg(
        (F.sum(F.col("wape") * F.col("observed_total")) / F.sum("observed_total"))
        .alias("weighted_wape"), F.count(F.lit(1)).alias("groups"))


def leave_one_group_out(df: DataFrame, group: str, features: Sequence[str], count: str,
                        exposure: str, estimators: Sequence[Estimator],
                        totals: DataFrame | None = None) -> DataFrame:
    """Scores per (estimator, held-out group, mode): every group predicted by a fit that
    never saw it, raw and reconciled to its published total.

    The constant rate and the ridge do all groups in one pass, the Poisson model all groups
    in each of its passes. Trees share nothing between folds: for them the driver loops over the
    groups, and every fit and score is distributed. The input is written once because it
    is read several times. Three groups or fewer is refused.
    """
    df = cut_lineage(df)
    named = df.select(group).distinct()
    some = named.limit(4).count()
    if some <= 3:
        raise ValueError(f"only {some} groups: too few to hold one out")
    parts = []
    for estimator in estimators:
        if estimator.held_out is not None:
            predicted = estimator.held_out(df, group, features, count, exposure)
        else:
            held_out = []
            for (g,) in named.orderBy(group).toLocalIterator():
                predict = fit_counts(estimator, df.where(F.col(group) != g), features, count,
                                     exposure)
                held_out.append(predict(df.where(F.col(group) == g)))
            predicted = reduce(DataFrame.unionByName, held_out)
        modes = [predicted.withColumn("mode", F.lit(RAW))]
        if totals is not None:
            modes.append(proportional_scale(predicted, group, "predicted", totals)
                         .where("is_constrained").drop("predicted", "is_constrained")
                         .withColumnRenamed("reconciled", "predicted")
                         .withColumn("mode", F.lit(RECONCILED)))
        scored = error_metrics(reduce(lambda a, b: a.unionByName(b), modes), count,
                               "predicted", [group, "mode"])
        parts.append(scored.withColumn("estimator", F.lit(estimator.name)))
    return reduce(DataFrame.unionByName, parts)


def baseline_held_out(df: DataFrame, group: str, count: str, exposure: str) -> DataFrame:
    """The constant-rate baseline for every held-out group in one aggregate.

    The rate without a group is (total - group) / (total - group), so no loop is needed.
    """
    usable = F.when(F.col(exposure) >= 1, F.col(count)).otherwise(0)
    e = F.when(F.col(exposure) >= 1, F.col(exposure)).otherwise(0)
    per = df.groupBy(group).agg(F.sum(usable).alias("_c"), F.sum(e).alias("_e"))
    all_ = per.agg(F.sum("_c").alias("_tc"), F.sum("_e").alias("_te"))
    rates = per.join(F.broadcast(all_)).select(group, (
        (F.col("_tc") - F.col("_c")) / (F.col("_te") - F.col("_e"))).alias("rate"))
    return df.join(rates, group).withColumn("predicted", F.col("rate") * F.col(exposure))


def select_estimator(aggregates: DataFrame, ranks: DataFrame, tie: float = 0.01,
                     score: str = "weighted_wape") -> DataFrame:
    """Lowest error; within ``tie`` of it the simplest, then the better, then by name."""
    best = aggregates.agg(F.min(score).alias("_b"))
    return (aggregates.join(F.broadcast(best)).where(F.col(score) <= F.col("_b") + tie)
            .join(ranks, "estimator", "left")
            .orderBy(F.coalesce("rank", F.lit(99)), score, "estimator").limit(1)
            .drop("_b"))


def aggregate_excluding(scores: DataFrame, group: str, excluded: Sequence[str]) -> DataFrame:
    """The aggregate recomputed without some groups, and whether the order changes.

    (estimator, mode, wape_all, wape_kept, rank_all, rank_kept, order_changes): ranks are by error
    inside a mode, ties by name, and the order of a mode changes where any of its ranks does.
    Diagnostic: it reads scores that already exist and never refits.
    """
    full = weighted_wape(scores).withColumnRenamed("weighted_wape", "wape_all")
    kept = weighted_wape(scores.where(~F.col(group).isin(*excluded))).withColumnRenamed(
        "weighted_wape", "wape_kept").drop("groups")
    both = full.drop("groups").join(kept, ["estimator", "mode"])
    w = Window.partitionBy("mode")  # as many rows as there are estimators
    ranked = both.withColumns({f"rank_{n}": F.row_number().over(
        w.orderBy(F.col(f"wape_{n}").asc_nulls_last(), "estimator")) for n in ("all", "kept")})
    return ranked.withColumn("order_changes", F.max(
        F.col("rank_all") != F.col("rank_kept")).over(w))


#: Chances that a Poisson(1) draw is at most 0, 1, 2, ...; what is beyond has no float left.
_POISSON_STEPS = tuple(math.fsum(math.exp(-1.0) / math.factorial(j) for j in range(i + 1))
                       for i in range(13))


def resampling_weight(id_col: str, replicate: Column, seed: int) -> Column:
    """How often a row occurs in a replicate: Poisson(1), drawn by md5 of seed, replicate and id.

    Drawing n of n rows with replacement gives each row a Binomial(n, 1/n) count; independent
    Poisson(1) counts are its limit, need no total and depend on nothing but the id.
    """
    digest = F.md5(F.concat_ws(":", F.lit(seed), replicate, F.col(id_col).cast("string")))
    u = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return reduce(lambda a, b: a + b, [F.when(u >= p, 1).otherwise(0) for p in _POISSON_STEPS])


def bootstrap_spread(df: DataFrame, targets: DataFrame, features: Sequence[str], count: str,
                     exposure: str, id_col: str, replicates: int = 40, seed: int = 20260101,
                     alpha: float = 1.0) -> DataFrame:
    """(id, half_width): half of the p10-p90 band of predictions of refitted ridges.

    Training areas are resampled with replacement. One aggregate gives the moments of all
    replicates (a task adds up each replicate before anything is shuffled), the systems are solved
    side by side, and each target evaluates all replicates inside its row.
    """
    if replicates < 2:
        raise ValueError("a bootstrap needs at least two replicates")
    train = df.where((F.col(exposure) >= 1) & F.col(count).isNotNull())
    drawn = train.select(id_col, count, exposure, *features, F.explode(F.sequence(
        F.lit(0), F.lit(replicates - 1))).alias("_r")).withColumn(
        "_times", resampling_weight(id_col, F.col("_r"), seed)).where("_times > 0")
    sums = _ridge_moments(count, exposure, features, "CAST(_times AS DOUBLE)")
    moments = drawn.groupBy("_r").agg(*[F.expr(e) for e in sums])
    fits = cut_lineage(_solved_ridges(moments, "_r", len(features), alpha))
    whole = fits.where("_b IS NOT NULL").agg(F.sort_array(F.collect_list(F.struct("_r", "_b")))
                                             .alias("_fits"))  # one row of ``replicates`` fits
    line = _ridge_line(features, "f._b")
    spread = targets.select(id_col, *features, exposure).join(F.broadcast(whole)).withColumn(
        "_p", F.expr(f"sort_array(transform(_fits, f -> greatest(0.0D, expm1({line})) "
                     f"* `{exposure}`))"))

    def rank(q: float) -> Column:
        at = (F.size("_p") - 1) * q
        low = F.floor(at).cast("int")
        below = F.get("_p", low)
        return below + (at - low) * (F.coalesce(F.get("_p", low + 1), below) - below)
    return spread.select(id_col, ((rank(0.9) - rank(0.1)) / 2.0).alias("half_width"))


def weighted_coarse_features(df: DataFrame, group: str, features: Sequence[str], weight: str,
                             additive: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of each feature at the coarse grain; null where nothing weighs."""
    w = F.col(weight)
    return df.groupBy(group).agg(
        *[(F.sum(F.col(f) * w) / F.nullif(F.sum(F.when(F.col(f).isNotNull(), w)), F.lit(0.0)))
          .alias(f) for f in features],
        F.sum(w).alias(weight), *[F.sum(a).alias(a) for a in additive if a != weight])


def historical_surface(fine: DataFrame, coarse_counts: DataFrame, group: str,
                       features: Sequence[str], exposure: str, count: str,
                       estimator: Estimator) -> DataFrame:
    """Fit at the coarse grain, apply at the fine one, scale to the coarse counts.

    A group whose predictions sum to zero is shared out by exposure.
    """
    coarse = weighted_coarse_features(fine, group, features, exposure).join(
        coarse_counts.select(group, count), group)
    predict = fit_counts(estimator, coarse, features, count, exposure)
    return proportional_scale(predict(fine), group, "predicted",
                              coarse_counts.withColumnRenamed(count, "total"),
                              on_zero="share", share=exposure)


def supply_ablation(df: DataFrame, group: str, features: Sequence[str], extra: Sequence[str],
                    count: str, exposure: str, estimator: Estimator) -> DataFrame:
    """Transfer and in-sample WAPE with and without the extra features."""
    df = cut_lineage(df)
    rows = []
    for label, cols in (("without", list(features)), ("with", [*features, *extra])):
        transfer = weighted_wape(leave_one_group_out(df, group, cols, count, exposure,
                                                     [estimator]), ["estimator"])
        inside = error_metrics(fit_counts(estimator, df, cols, count, exposure)(df), count,
                               "predicted")
        rows.append(transfer.select("weighted_wape").join(F.broadcast(
            inside.select(F.col("wape").alias("in_sample_wape"))))
            .withColumn("features", F.lit(label)))
    return reduce(DataFrame.unionByName, rows)


def estimator_ranks(spark: SparkSession, estimators: Sequence[Estimator]) -> DataFrame:
    return spark.createDataFrame([(e.name, e.rank) for e in estimators],
                                 "estimator string, rank int")
