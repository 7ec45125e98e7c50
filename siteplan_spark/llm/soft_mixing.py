"""Mixing by soft membership: domain posteriors, then document rates that meet token targets.

A softmax classifier over hashed words is fitted on a bounded sample of labelled documents and
gives every document a posterior over the domains. Document i with t_i tokens and posterior p_i
contributes r_i t_i p_i expected tokens. Nonnegative rates r are fitted by accelerated projected
gradient steps on

    1/2 |sum_i w_i p_i r_i - target|^2 + damping/2 sum_i w_i (r_i - 1)^2,    w_i = t_i / sum t

In the metric of w the gradient of r_i is p_i . residual + damping (r_i - 1), whose Lipschitz
bound is 1 + damping whatever the corpus. A rate is therefore a function of the document's own
posterior and of the residuals of all steps, a few numbers each: a step is one pass over a narrow
table that returns one sum per domain, rates are replayed from the residuals, and neither rates
nor documents are ever shuffled.

A domain with target 0 is banned. No finite damping takes a rare domain to 0, and fitting its
residual would press on clean documents for the little that they have of it. A document that looks
more like the banned domain than like the first one therefore has rate 0, and the others are fitted
to the other targets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from siteplan_spark.llm.common import cut_lineage, text_bytes, where_once

DOMAINS = ("clean", "low", "toxic")
#: Labelled documents for each domain that the classifier is fitted on, at most.
TRAIN_ROWS = 1500
BUCKETS = 1 << 16
SPARSITY, FIT_STEPS = 2e-3, 200
DAMPING, MAX_STEPS, TOLERANCE = 1e-4, 120, 1e-4


# --- the classifier -----------------------------------------------------------------------

def word_buckets(text: bytes) -> np.ndarray:
    """Sorted buckets of the distinct words, and of the distinct endings of words."""
    words = text.lower().split()
    marks = {w.strip(b".,;:") for w in words} | {b" " + w[-2:] for w in words}
    return np.unique(np.fromiter((zlib.crc32(w) % BUCKETS for w in marks), np.int64, len(marks)))


def fit_softmax(rows: list[np.ndarray], label: np.ndarray, n: int) -> np.ndarray:
    """(BUCKETS + 1, n) weights, the last row the bias; proximal gradient with an L1 penalty.

    Classes count alike, whatever their numbers in the sample, and the biases are then moved to
    the sample's shares. Without rows all weights are zero, so posteriors are uniform.
    """
    weights = np.zeros((BUCKETS + 1, n))
    if not rows:
        return weights
    at = np.concatenate(rows)
    sizes = np.array([len(r) for r in rows])
    of = np.repeat(np.arange(len(rows)), sizes)
    goal = np.eye(n)[label]
    share = goal.mean(axis=0)
    each = (goal / np.maximum(share, 1e-12)).sum(axis=1)
    each /= each.sum()
    used, at = np.unique(at, return_inverse=True)
    w, bias, square = np.zeros((len(used), n)), np.zeros(n), np.full((len(used), n), 1e-8)
    for _ in range(FIT_STEPS):
        score = np.stack([np.bincount(of, w[at, c], len(rows)) for c in range(n)], 1) + bias
        p = np.exp(score - score.max(axis=1, keepdims=True))
        miss = (p / p.sum(axis=1, keepdims=True) - goal) * each[:, None]
        slope = np.stack([np.bincount(at, miss[of, c], len(used)) for c in range(n)], 1)
        square += slope ** 2
        step = 0.3 / np.sqrt(square)
        w -= step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * SPARSITY, 0)
        bias -= miss.sum(axis=0)
    weights[used] = w
    weights[-1] = bias + np.log(np.maximum(share, 1e-6))
    return weights


def train(docs: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_id: str,
          quality: str, toxic: str, per_domain: int = TRAIN_ROWS) -> np.ndarray:
    """Weights for DOMAINS from at most ``per_domain`` labelled documents of each.

    A toxic label makes the domain toxic, else quality decides between clean and low. Rows with
    a null id or label are not used. The sample is the labelled ids with the smallest hashes.
    """
    domain = F.when(F.col(toxic) == 1, 2).when(F.col(quality) == 1, 0).when(F.col(quality) == 0, 1)
    known = labels.select(F.col(label_id).alias("id"), domain.alias("domain")).dropna().distinct()
    sample = None
    for d in range(len(DOMAINS)):
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(per_domain)
        sample = part if sample is None else sample.unionAll(part)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({
                "id": batch.column(0).cast(pa.string()), "domain": batch.column(1).cast(pa.int64()),
                "buckets": pa.array([word_buckets(t).astype("<i4").tobytes()
                                     for t in text_bytes(batch.column(2))], pa.binary())})

    # at most per_domain rows of each domain: a proven bound for the broadcast
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(sample), "id").select("id", "domain", "text")
            .mapInArrow(hashed, "id string, domain long, buckets binary").dropDuplicates(["id"])
            .collect())
    rows.sort(key=lambda r: r["id"])
    return fit_softmax([np.frombuffer(r["buckets"], "<i4").astype(np.int64) for r in rows],
                       np.array([r["domain"] for r in rows], np.int64), len(DOMAINS))


_MEMBER = StructType([StructField("tokens", LongType()),
                      StructField("p", ArrayType(DoubleType()))])


def posterior(text: Column, weights: np.ndarray) -> Column:
    """(tokens, p): words and domain posteriors of each whole text; a null is an empty text."""
    used = np.flatnonzero(np.abs(weights[:-1]).sum(axis=1))
    place = np.full(BUCKETS, len(used), np.int32)
    place[used] = np.arange(len(used))
    small = np.vstack([weights[used], np.zeros((1, weights.shape[1]))]).astype(np.float32)
    bias = weights[-1]

    @F.arrow_udf(_MEMBER)
    def member(column: pa.Array) -> pa.Array:
        tokens, p = [], []
        for t in text_bytes(column):
            score = small[place[word_buckets(t)]].sum(axis=0, dtype=np.float64) + bias
            e = np.exp(score - score.max())
            p.append(e / e.sum())
            tokens.append(len(t.split()))
        flat = np.concatenate(p) if p else np.empty(0)
        lists = pa.ListArray.from_arrays(
            np.arange(0, len(flat) + 1, len(bias), dtype=np.int32), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(tokens, pa.int64()), lists],
                                          names=["tokens", "p"])

    return member(text)


# --- rates --------------------------------------------------------------------------------

def replay(p: np.ndarray, residuals: np.ndarray, damping: float = DAMPING) -> tuple:
    """(rates, point at which the next residual is taken) after the given steps from 1."""
    rate = point = np.ones(len(p))
    for k, residual in enumerate(residuals):
        new = np.maximum(0, point - (p @ residual + damping * (point - 1)) / (1 + damping))
        rate, point = new, new + k / (k + 3) * (new - rate)
    return rate, point


def _stack(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def banned(p: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Whether some posterior is over its limit, a multiple of the first domain's."""
    return (p > p[:, :1] * limits).any(axis=1)


def _totals(members: DataFrame, residuals: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Expected tokens by domain at the replayed rates, then at the replayed points."""
    n = len(limits)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * n)
        for batch in batches:
            if batch.num_rows:
                t = batch.column(0).to_numpy().astype(float)
                p = _stack(batch.column(1), n)
                t[banned(p, limits)] = 0
                total += np.concatenate([(r * t) @ p for r in replay(p, residuals)])
        yield pa.record_batch({f"s{i}": pa.array([x]) for i, x in enumerate(total)})

    names = [f"s{i}" for i in range(2 * n)]
    row = (members.select("tokens", "p").mapInArrow(sums, ", ".join(f"{c} double" for c in names))
           .agg(*[F.sum(c).alias(c) for c in names]).first())
    return np.array([x or 0.0 for x in row])


def fit_rates(members: DataFrame, shares: Mapping[str, float], growth: float | None = None,
              damping: float = DAMPING, max_steps: int = MAX_STEPS,
              tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """(residuals of the steps, limits), which give any document its rate by ``replay`` and ``banned``.

    ``shares`` are the wanted shares of the expected tokens by domain. The total is the
    corpus's own, or, with ``growth``, what gives the first domain ``growth`` times its present
    tokens. Stops when all domains are within ``tolerance`` of the total, or after ``max_steps``
    (a target without any mass cannot be met). An empty corpus needs no step.

    A domain with target 0 takes part only by its limit: a document is banned if that domain is
    more likely than the first, or would be if both were equally common in the corpus.
    """
    n = len(DOMAINS)
    want = np.array([shares.get(d, 0.0) for d in DOMAINS])
    residuals, limits, open_ = np.empty((0, n)), np.full(n, np.inf), want > 0
    now = _totals(members, residuals, limits)
    if not open_.all() and open_[0] and now[0] > 0:
        # a margin for posteriors that differ by rounding alone
        limits[~open_] = (1 + 1e-6) * np.minimum(1, now[:n] / now[0])[~open_]
        now = _totals(members, residuals, limits)
    total = now[:n].sum()
    if not total:
        return residuals, limits
    goal = want / want.sum()
    if growth is not None:
        goal = goal * growth * now[0] / total / goal[0]
    while len(residuals) < max_steps:
        if np.abs(now[:n] / total - goal)[open_].max() <= tolerance:
            break
        residuals = np.vstack([residuals, (now[n:] / total - goal) * open_])
        now = _totals(members, residuals, limits)
    return residuals, limits


def rate_of(p: Column, residuals: np.ndarray, limits: np.ndarray,
            damping: float = DAMPING) -> Column:
    """The fitted rate for a column of posteriors."""
    n = len(DOMAINS)

    @F.arrow_udf(DoubleType())
    def rate(column: pa.Array) -> pa.Array:
        stack = _stack(column, n)
        return pa.array(np.where(banned(stack, limits), 0.0, replay(stack, residuals, damping)[0]))

    return rate(p)


def copies_of(rate: Column, *keys: Column) -> Column:
    """How often a row is taken: the whole part of its rate, and the rest by a hash of its keys."""
    draw = F.pmod(F.xxhash64(*keys, F.lit("mixing")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor(rate)
    return (whole + (draw < rate - whole).cast("long")).cast("long")


def soft_mixing(docs: DataFrame, id_col: str, text_col: str, weights: np.ndarray,
                shares: Mapping[str, float], growth: float | None = None) -> DataFrame:
    """(id, tokens, p, rate, copies) for each row.

    Null and empty texts have no tokens and get the rate of their posterior, so do repeated
    rows and rows without an id. Only the two named columns are read. No rows in, none out.
    """
    members = cut_lineage(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("content"),
        posterior(F.col(text_col), weights).alias("m"))
        .select("id", "content", "m.tokens", "m.p"))
    fit = fit_rates(members, shares, growth)
    return members.withColumn("rate", rate_of(F.col("p"), *fit)).select(
        "id", "tokens", "p", "rate",
        copies_of(F.col("rate"), F.col("id"), F.col("content")).alias("copies"))


def take_mixture(docs: DataFrame, id_col: str, text_col: str, weights: np.ndarray,
                 shares: Mapping[str, float], growth: float | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its rate says; a rate below one may drop it.

    Null and empty texts have no tokens and get the rate of their posterior. Rows that repeat an
    id and text are taken equally often. All columns pass through, whatever they are called. No
    rows in, none out.
    """
    member = posterior(F.col(text_col), weights)
    members = cut_lineage(docs.select(member.alias("m")).select("m.tokens", "m.p"))
    fit = fit_rates(members, shares, growth)
    copies = copies_of(rate_of(member["p"], *fit), F.col(id_col), F.xxhash64(F.col(text_col)))
    # the whole row travels as one column, so no name of it can clash
    taken = where_once(docs.select(F.struct("*").alias("row"), copies.alias("copies")),
                       F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))
                        ).select("row.*")
