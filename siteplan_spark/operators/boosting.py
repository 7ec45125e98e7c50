"""Boosted trees on Poisson loss, grown from histograms that Spark adds up.

Features are cut into bins once. Rows with the same bins, and so the same prediction for ever,
collapse to one cell with its weights and counts. Each level of a tree is one aggregate: gradient,
hessian and row count for each (node, feature, bin). The driver sees only these sums, whose number
does not depend on the rows, picks the splits and sends the tree with the next pass. Few features
have few cells, however many rows there are; cells that fill less than one task grow their trees
there by the same rule, since there is nothing to add up.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.session import cut_lineage

# trees and passes travel by value, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Most bins of a feature, not counting the one for missing values.
BINS = 64
#: A leaf has at least this many rows and this much hessian.
MIN_ROWS, MIN_HESSIAN = 20, 1e-3
#: Trees that a pass replays before the scores are written again.
REPLAY = 25
#: Cells of a task.
CELLS = 500_000


@dataclass(frozen=True)
class Tree:
    """Nodes in the order of their making. ``feature`` is -1 at a leaf; a row goes to ``left`` when
    its bin is at most ``cut``, else to the node after it."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)


@dataclass(frozen=True)
class BoostedRate:
    """A fitted model: ``edges`` of the bins of each feature, the start and the trees."""

    features: tuple[str, ...]
    edges: tuple[np.ndarray, ...]
    start: float
    trees: tuple[Tree, ...]

    def scores(self, values: np.ndarray) -> np.ndarray:
        """The logarithm of the rate of each row of feature values (NaN: missing)."""
        bins = np.stack([np.where(np.isnan(v), len(e) + 1, np.searchsorted(e, v))
                         for v, e in zip(values.T, self.edges, strict=True)], axis=1)
        return self.start + sum((t.value[t.leaf_of(bins)] for t in self.trees),
                                np.zeros(len(bins)))

    def predict(self, df: DataFrame, name: str = "rate_hat") -> DataFrame:
        """``df`` with the predicted rate."""
        model = self

        @F.arrow_udf("double")
        def rate(*columns: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in columns], 1)
            return pa.array(np.exp(model.scores(x)))
        return df.withColumn(name, rate(*[F.col(f).cast("double") for f in self.features]))


def _bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> tuple[np.ndarray, ...]:
    """Largest value of each bin but the last. A feature of few values has one bin for each."""
    ranks = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), ranks, 100 * bins).alias(str(i))
                     for i, f in enumerate(features)],
                   *[F.max(F.col(f).cast("double")).alias(f"m{i}")
                     for i, f in enumerate(features)]).first()
    return tuple(np.array(sorted({v for v in (got[str(i)] or []) if v < got[f"m{i}"]}), np.float64)
                 for i in range(len(features)))


def _bin_column(feature: str, edges: np.ndarray) -> Column:
    """How many edges are below the value, by bisection in a tree of comparisons."""
    v = F.col(feature).cast("double")

    def descend(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(v <= float(edges[middle]), descend(low, middle)).otherwise(
            descend(middle + 1, high))
    return F.when(v.isNull() | F.isnan(v), F.lit(len(edges) + 1)).otherwise(
        descend(0, len(edges))).cast("smallint")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _score_pass(width: int, start: float, trees: Sequence[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _matrix(b.column(0), width)
            score = b.column(4).to_numpy() + start
            for t in trees:
                score = score + t.value[t.leaf_of(bins)]
            yield pa.record_batch([*b.columns[:4], pa.array(score)], schema=b.schema)
    return run


def _add_histogram(total: np.ndarray, bins: np.ndarray, w: np.ndarray, wy: np.ndarray,
                   n: np.ndarray, score: np.ndarray, growing: Tree, opened: Sequence[int],
                   slots: int) -> None:
    """Add gradient, hessian and rows of each (open node, feature, bin) to ``total``."""
    place = np.full(len(growing.feature), -1)
    place[list(opened)] = np.arange(len(opened))
    at = place[growing.leaf_of(bins)]
    keep = at >= 0
    h = w * np.exp(score)
    width = bins.shape[1]
    for f in range(width):
        cell = ((at * width + f) * slots + bins[:, f])[keep]
        for i, v in enumerate((h - wy, h, n)):
            total[i] += np.bincount(cell, v[keep], total.shape[1])


def _histogram_pass(width: int, slots: int, trees: Sequence[Tree], growing: Tree,
                    opened: Sequence[int]):
    """(cell of node, feature and bin, g, h, n) summed inside each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(opened) * width * slots))
        for b in batches:
            bins = _matrix(b.column(0), width)
            w, wy, n, score = (b.column(i).to_numpy() for i in range(1, 5))
            for t in trees:
                score = score + t.value[t.leaf_of(bins)]
            _add_histogram(total, bins, w, wy, n, score, growing, opened, slots)
        full = np.flatnonzero(total[2])
        yield pa.record_batch([pa.array(full), *[pa.array(t[full]) for t in total]],
                              names=["cell", "g", "h", "n"])
    return run


def _tree_pass(width: int, slots: int, rounds: int, depth: int, step: float):
    """The next trees, grown where all cells are in one task and no sums have to meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        bins = np.concatenate([_matrix(b.column(0), width) for b in got])
        w, wy, n, score = (np.concatenate([b.column(i).to_numpy() for b in got])
                           for i in range(1, 5))

        def histograms(growing: Tree, opened: list[int]) -> np.ndarray:
            total = np.zeros((3, len(opened) * width * slots))
            _add_histogram(total, bins, w, wy, n, score, growing, opened, slots)
            return total.reshape(3, len(opened), width, slots).swapaxes(0, 1)

        for i in range(rounds):
            t = grow_tree(histograms, depth, step)
            score = score + t.value[t.leaf_of(bins)]
            yield pa.record_batch([pa.array([i]), pa.array([pickle.dumps(
                (t.feature, t.cut, t.left, t.value))])], names=["i", "tree"])
    return run


def _best_split(hist: np.ndarray) -> tuple[float, int, int, np.ndarray] | None:
    """(gain, feature, last bin on the left, sums on the left) of one node, from (3, features,
    bins). Gains within a billionth are ties: the first feature and bin win."""
    below = hist.cumsum(axis=2)
    total = below[:, :1, -1:]
    above = total - below
    ok = ((below[2] >= MIN_ROWS) & (above[2] >= MIN_ROWS)
          & (below[1] >= MIN_HESSIAN) & (above[1] >= MIN_HESSIAN))
    if not ok.any():
        return None

    def strength(s: np.ndarray) -> np.ndarray:
        return s[0] ** 2 / np.where(s[1] > 0, s[1], 1.0)

    gain = np.where(ok, strength(below) + strength(above) - strength(total), -np.inf)
    best = gain.max()
    if best <= 1e-20 * max(1.0, float(strength(total)[0, 0])):
        return None
    f, b = divmod(int(np.flatnonzero(gain >= best - 1e-9 * abs(best))[0]), gain.shape[1])
    return float(best), f, b, below[:, f, b]


def grow_tree(histograms: Callable[[Tree, list[int]], np.ndarray], depth: int,
              step: float) -> Tree:
    """A tree grown level by level; ``histograms`` gives (nodes, 3, features, bins) of open nodes."""
    feature, cut, left, value = [-1], [0], [0], [0.0]

    def tree() -> Tree:
        return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))

    opened = [0]
    for _ in range(depth):
        found = histograms(tree(), opened)
        following = []
        for node, hist in zip(opened, found, strict=True):
            split = _best_split(hist)
            if node == 0 and split is None:
                g, h, _n = hist[:, 0].sum(axis=1)
                value[0] = -step * g / h if h > 0 else 0.0
            if split is None:
                continue
            _gain, f, b, sums = split
            feature[node], cut[node], left[node] = f, b, len(feature)
            for g, h, n in (sums, hist[:, 0].sum(axis=1) - sums):
                # a node that cannot hold two leaves is not looked at again
                if n >= 2 * MIN_ROWS:
                    following.append(len(feature))
                feature.append(-1)
                cut.append(0)
                left.append(0)
                value.append(float(-step * g / h))
        opened = following
        if not opened:
            break
    return tree()


def fit_boosted_rate(rows: DataFrame, features: Sequence[str], rate: str, exposure: str,
                     iterations: int = 200, depth: int = 4, step: float = 0.06,
                     bins: int = BINS) -> BoostedRate:
    """Trees fitted to ``rate`` weighted by ``exposure``, on Poisson loss with a log link.

    A missing feature value has a bin above all others. Rows without a rate or a positive exposure
    are left out; without any row, or where all rates are zero, the model is a constant.
    """
    rows = rows.where((F.col(exposure) > 0) & F.col(rate).isNotNull())
    edges = _bin_edges(rows, features, bins)
    width, slots = len(features), max(len(e) for e in edges) + 2
    cells = rows.groupBy(F.array(*[_bin_column(f, e) for f, e in zip(features, edges, strict=True)])
                         .alias("bins")).agg(
        F.sum(F.col(exposure).cast("double")).alias("w"),
        F.sum(F.col(exposure).cast("double") * F.col(rate)).alias("wy"),
        F.count(F.lit(1)).cast("double").alias("n")).withColumn("score", F.lit(0.0))
    state = cut_lineage(cells)
    whole = state.agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"),
                      F.count(F.lit(1)).alias("cells")).first()
    if not whole["w"] or not whole["wy"]:
        return BoostedRate(tuple(features), edges, -np.inf, ())
    start = float(np.log(whole["wy"] / whole["w"]))
    parts = -(-whole["cells"] // CELLS)
    schema = state.schema
    state = cut_lineage(state.coalesce(parts).mapInArrow(_score_pass(width, start, ()), schema))
    trees: list[Tree] = []
    fresh: list[Tree] = []

    def histograms(growing: Tree, opened: list[int]) -> np.ndarray:
        made = state.coalesce(parts).mapInArrow(
            _histogram_pass(width, slots, list(fresh), growing, opened),
            "cell long, g double, h double, n double")
        sums = made.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"),
                                        F.sum("n").alias("n"))
        # nodes x features x bins, whatever the number of rows
        got = sums.toArrow()
        out = np.zeros((3, len(opened) * width * slots))
        for i, name in enumerate("ghn"):
            out[i, got["cell"].to_numpy()] = got[name].to_numpy()
        return out.reshape(3, len(opened), width, slots).swapaxes(0, 1)

    while len(trees) < iterations:
        if parts == 1:
            rounds = min(REPLAY, iterations - len(trees))
            grown = state.coalesce(1).mapInArrow(_tree_pass(width, slots, rounds, depth, step),
                                                 "i long, tree binary").orderBy("i").collect()
            fresh += [Tree(*pickle.loads(r["tree"])) for r in grown]
            trees += fresh
        else:
            trees.append(grow_tree(histograms, depth, step))
            fresh.append(trees[-1])
        if len(fresh) >= REPLAY and len(trees) < iterations:
            state = cut_lineage(state.coalesce(parts).mapInArrow(
                _score_pass(width, 0.0, list(fresh)), schema))
            fresh.clear()
    return BoostedRate(tuple(features), edges, start, tuple(trees))
