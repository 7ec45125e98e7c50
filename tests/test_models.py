"""Boosting, folds, resampling, bounds and dated joins against plain computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteplan_spark.operators import boosting as B
from siteplan_spark.operators import demand as D
from siteplan_spark.operators import ranking as W
from siteplan_spark.operators import reconcile as RC
from siteplan_spark.operators import siting as ST


def _areas(spark, n=600, groups=5, seed=4):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.integers(0, 15, n).astype(float), rng.normal(size=n)
    e = rng.integers(1, 60, n).astype(float)
    c = rng.poisson(e * np.exp(0.08 * x1 + 0.4 * (x2 > 0) * (x1 > 7) - 1.0)).astype(float)
    rows = [(i, int(i % groups), *map(float, r)) for i, r in enumerate(zip(x1, x2, e, c))]
    return spark.createDataFrame(rows, "id long, g int, x1 double, x2 double, hh double, cnt double")


def _plain_boost(x, rate, w, iterations, depth, step, bins):
    """The same rule in one process: exhaustive splits over the same bins."""
    edges = []
    for v in x.T:
        s = np.sort(v)
        cut = {s[max(0, math.ceil(len(s) * i / bins) - 1)] for i in range(1, bins)}
        edges.append(np.array(sorted(c for c in cut if c < s[-1])))
    b = np.stack([np.searchsorted(e, v) for v, e in zip(x.T, edges)], 1)
    f = np.full(len(x), np.log((w * rate).sum() / w.sum()))
    for _ in range(iterations):
        g, h = w * np.exp(f) - w * rate, w * np.exp(f)
        nodes = [np.ones(len(x), bool)]
        for _ in range(depth):
            following = []
            for node in nodes:
                best = None
                for j in range(x.shape[1]):
                    for t in range(len(edges[j])):
                        left, right = node & (b[:, j] <= t), node & (b[:, j] > t)
                        if min(left.sum(), right.sum()) < B.MIN_ROWS:
                            continue
                        gain = sum(g[s].sum() ** 2 / h[s].sum() for s in (left, right)) \
                            - g[node].sum() ** 2 / h[node].sum()
                        if best is None or gain > best[0] * (1 + 1e-9):
                            best = gain, left, right
                following += best[1:] if best and best[0] > 1e-9 else [node]
            nodes = following
        for node in nodes:
            f[node] -= step * g[node].sum() / h[node].sum()
    return np.exp(f)


def test_boosting_equals_exhaustive_splits_and_beats_the_constant(spark):
    df = _areas(spark)
    model = B.fit_boosted_rate(df.withColumn("r", F.col("cnt") / F.col("hh")), ["x1", "x2"], "r",
                               "hh", 12, 3, 0.2, bins=16)
    got = model.predict(df).toPandas().sort_values("id")
    rate, w = (got.cnt / got.hh).to_numpy(), got.hh.to_numpy()
    want = _plain_boost(got[["x1", "x2"]].to_numpy(), rate, w, 12, 3, 0.2, 16)
    assert np.allclose(got.rate_hat, want, rtol=1e-8)

    def loss(p):
        return (w * (p - rate * np.log(p))).sum()
    assert loss(got.rate_hat.to_numpy()) < loss(np.full(len(w), (w * rate).sum() / w.sum())) - 10


def test_boosting_with_missing_values_many_passes_and_nothing_to_learn(spark, monkeypatch):
    monkeypatch.setattr(B, "REPLAY", 2)
    monkeypatch.setattr(B, "CELLS", 40)  # several tasks
    df = _areas(spark).withColumn("x1", F.when(F.col("id") % 7 > 0, F.col("x1"))).withColumn(
        "r", F.col("cnt") / F.col("hh"))
    split = B.fit_boosted_rate(df, ["x1", "x2"], "r", "hh", 3, 2, 0.2)
    monkeypatch.setattr(B, "CELLS", 10 ** 6)
    whole = B.fit_boosted_rate(df, ["x1", "x2"], "r", "hh", 3, 2, 0.2)
    a, b = (m.predict(df).select("id", "rate_hat").toPandas().sort_values("id").rate_hat
            for m in (split, whole))
    assert np.allclose(a, b, rtol=1e-9) and a.notna().all()
    none = B.fit_boosted_rate(df.where("false"), ["x1"], "r", "hh", 3)
    assert none.predict(df).agg(F.max("rate_hat")).first()[0] == 0.0
    same = B.fit_boosted_rate(df.withColumn("k", F.lit(1.0)), ["k"], "r", "hh", 3)
    rates = same.predict(df.withColumn("k", F.lit(1.0))).select("rate_hat").distinct().collect()
    assert len(rates) == 1


@pytest.mark.parametrize("estimator", [D.poisson_rate(), D.ridge_log_rate()])
def test_all_folds_at_once_equal_one_fit_for_each(spark, estimator, monkeypatch):
    monkeypatch.setattr(D, "FOLDS_AT_ONCE", 3)
    df = _areas(spark, 200)
    got = estimator.held_out(df, "g", ["x1", "x2"], "cnt", "hh").select("id", "predicted")
    mine = {r.id: r.predicted for r in got.collect()}
    for g in range(5):
        fitted = D.fit_counts(estimator, df.where(F.col("g") != g), ["x1", "x2"], "cnt", "hh")
        for r in fitted(df.where(F.col("g") == g)).collect():
            assert mine[r.id] == pytest.approx(r.predicted, rel=1e-5)


def test_many_folds_have_no_limit(spark):
    df = spark.range(12_000).select(
        "id", F.col("id").alias("g"), (F.col("id") % 17).cast("double").alias("x1"),
        F.lit(2.0).alias("hh"), (F.col("id") % 5).cast("double").alias("cnt"))
    got = D.ridge_log_rate().held_out(df, "g", ["x1"], "cnt", "hh")
    assert got.where("predicted IS NOT NULL").count() == 12_000


def test_resampling_counts_are_poisson(spark):
    w = spark.range(20_000).select(D.resampling_weight("id", F.lit(3), 1).alias("w"))
    share = {r.w: r.n / 20_000 for r in w.groupBy("w").agg(F.count("*").alias("n")).collect()}
    for k in range(5):
        assert share[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)


def test_greedy_takes_far_fewer_rounds_than_picks(spark, monkeypatch):
    rounds = []
    cut = ST.cut_lineage
    monkeypatch.setattr(ST, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    rnd = random.Random(3)
    value = {i: float(rnd.randint(1, 50)) for i in range(400)}
    reach = {i: [j for j in (i - 1, i, i + 1) if j in value] for i in value}
    cost = dict.fromkeys(value, 1.0)
    cand = spark.createDataFrame([(i, v, 1.0) for i, v in value.items()],
                                 "cell long, v double, cost double")
    edges = spark.createDataFrame([(i, x) for i, xs in reach.items() for x in xs],
                                  "candidate long, covered long")
    got = ST.greedy_max_coverage(cand, edges, 61.0, {"v": 1.0}, cost="cost", key="cell").collect()
    covered, spent, want = set(), 0.0, []
    while True:
        gain = {c: sum(value[x] for x in reach[c] if x not in covered) / cost[c]
                for c in value if c not in want and spent + cost[c] <= 61.0}
        best = min(gain, key=lambda c: (-gain[c], c), default=None)
        if best is None or gain[best] <= 0:
            break
        want.append(best)
        covered |= set(reach[best])
        spent += cost[best]
    assert [r.candidate for r in sorted(got, key=lambda r: r.step)] == want
    assert len(rounds) < 40 < len(want)  # three tables a round


def test_bounds_are_never_below_the_best_portfolio(spark):
    rnd = random.Random(6)
    cells, edges, best = [], [], {}
    for g in range(3):
        p = [float(rnd.randint(0, 9)) for _ in range(9)]
        s = [float(rnd.randint(0, 9)) for _ in range(9)]
        reach = [{i, *rnd.sample(range(9), 2)} for i in range(9)]
        cells += [(g, i, 1.0, p[i], s[i]) for i in range(9)]
        edges += [(g, i, x) for i in range(9) for x in reach[i]]
        for floor in (0.0, 12.0, 20.0):
            covers = [set().union(*[reach[j] for j in pick]) for k in range(4)
                      for pick in itertools.combinations(range(9), k)]
            best[g, floor] = max((sum(p[i] for i in c) for c in covers
                                  if sum(s[i] for i in c) >= floor), default=None)
    tags = spark.createDataFrame([(f,) for f in (0.0, 12.0, 20.0)], "floor double")
    c = spark.createDataFrame(cells, "g int, cell long, cost double, main double, other double")
    e = spark.createDataFrame(edges, "g int, candidate long, covered long")
    goals = spark.createDataFrame([(g, f, f, best[g, f] or 0.0) for g, f in best],
                                  "g int, level double, floor double, reached double")
    level = F.broadcast(tags.withColumnRenamed("floor", "level"))
    got = ST.coverage_bound(c.join(level), e.join(level), 3.0, ["g", "level"], goals, 8).collect()
    assert len(got) == 9
    for r in got:
        if best[r.g, r.level] is not None:
            assert best[r.g, r.level] - 1e-9 <= r.bound
    close = [best[r.g, 0.0] / r.bound for r in got if r.level == 0.0]
    assert min(close) > 0.7


def test_nearest_vintage_among_a_million_of_one_key(spark):
    start = F.to_date(F.lit("1900-01-01"))
    v = spark.range(1_000_000).select(
        F.lit("a").alias("k"), F.date_add(start, (F.col("id") % 60_000).cast("int") * 2).alias("day"),
        F.col("id").alias("val"))
    asked = spark.range(50_000).select(
        "id", F.when(F.col("id") % 100 > 0, F.lit("a")).otherwise("b").alias("k"),
        F.when(F.col("id") % 10 > 0, F.date_add(start, (F.col("id") - 10).cast("int"))).alias("at"))
    got = RC.nearest_vintage_join(asked, v, "k", "at", "day", "val").agg(
        F.count("*").alias("n"),
        F.sum(F.when(F.col("k") == "b", F.col("matched_vintage").isNotNull().cast("int"))).alias("b"),
        F.max(F.when(F.col("k") == "a", F.abs(F.datediff("matched_vintage", "at")))).alias("far"),
        F.min(F.when((F.col("k") == "a") & F.col("at").isNull(), F.datediff(
            "matched_vintage", start))).alias("newest"),
        # an odd day lies between two vintages: the newer
        F.min(F.when((F.col("k") == "a") & (F.datediff("at", start) % 2 == 1),
                     F.datediff("matched_vintage", "at"))).alias("odd")).first()
    assert (got.n, got.b, got.far, got.newest, got.odd) == (50_000, 0, 9, 119_998, 1)


def test_ranks_inside_null_and_hot_groups(spark):
    rows = [(None if i % 3 == 0 else "hot" if i % 3 < 2 or i % 5 else "c", (i * 37) % 101, i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(5)
    got = W.group_rank(df, ["g"], ["v", "id"]).collect()
    for g in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.v, r.id))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
