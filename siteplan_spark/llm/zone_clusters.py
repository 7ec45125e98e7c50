"""Exact k-means over integer vectors with zone maps on a Hilbert curve.

Vectors are ordered along a Hilbert curve through all their dimensions and packed into blocks of
``BLOCK`` neighbours, written once with the smallest and largest value of each dimension. In a
round the distance of a centroid to such a box is bounded from both sides. A centroid whose lower
bound exceeds the smallest upper bound cannot be nearest to any vector of the block; the others
are compared with all its vectors in one exact numpy step.

Rounds read the blocks and give sums of at most one row for each task, centroid and dimension, so
what reaches the driver is k centroids, whatever the number of vectors. Sums come from rows and not
from counters, so a task that runs twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan_spark.llm.common import cut_lineage

BLOCK = 256
#: Bits of a dimension that the curve looks at.
BITS = 4
#: Components up to this size have squared distances that fit 64 bits.
LARGEST = 1 << 21
_EXACT = 1 << 53


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places (rows of bytes, most significant first) of cells of a grid on a Hilbert curve.

    ``cells`` is (n, dimensions), each below ``1 << bits``. The coordinates are turned into the
    transposed index by undoing the rotations of the curve from the coarsest level to the finest.
    """
    x = cells.T.astype(np.uint8 if bits <= 8 else np.uint32)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        lower = x.dtype.type(level - 1)
        for i in range(len(x)):
            high = (x[i] & level) != 0
            swapped = np.where(high, 0, (x[0] ^ x[i]) & lower).astype(x.dtype)
            x[0] ^= np.where(high, lower, swapped)
            x[i] ^= swapped
        level >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = top
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, level - 1, 0).astype(x.dtype)
        level >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _integers(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * values).astype(np.int64).reshape(-1, dims)


def _narrowed(v: np.ndarray) -> np.ndarray:
    """The same values in the smallest type that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        if v.size == 0 or (v.min() >= np.iinfo(kind).min and v.max() <= np.iinfo(kind).max):
            return np.ascontiguousarray(v, kind)
    return v


def _widened(data: bytes, rows: int, dims: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(data) // (rows * dims)]
    return np.frombuffer(data, kind).reshape(rows, dims).astype(np.int64)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]
    ).cast(pa.binary())


def _extent(dims: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                v = _integers(batch.column(0), dims, scale)
                low = v.min(0) if low is None else np.minimum(low, v.min(0))
                high = v.max(0) if high is None else np.maximum(high, v.max(0))
        if low is not None:
            yield pa.record_batch([pa.array(np.arange(dims)), pa.array(low), pa.array(high)],
                                  names=["dim", "low", "high"])
    return run


def _placed(dims: int, scale: float, low: np.ndarray, high: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _integers(batch.column(1), dims, scale)
            cells = ((v - low) << BITS) // (high - low + 1)
            yield pa.record_batch([_binary(hilbert_keys(cells)), batch.column(0),
                                   _binary(_narrowed(v))], names=["place", "id", "vector"])
    return run


def _packed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(1), batch.column(2)
            for at in range(0, batch.num_rows, BLOCK):
                part = vectors[at:at + BLOCK]
                v = np.stack([_widened(x.as_py(), 1, dims)[0] for x in part])
                yield pa.record_batch([
                    pa.array([len(v)], pa.int32()),
                    pa.ListArray.from_arrays([0, len(v)], ids[at:at + BLOCK]),
                    pa.array([_narrowed(v).tobytes()], pa.binary()),
                    pa.array([v.min(0).tolist()], pa.list_(pa.int64())),
                    pa.array([v.max(0).tolist()], pa.list_(pa.int64())),
                ], names=["n", "ids", "vectors", "low", "high"])
    return run


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to a vector of the box, ascending."""
    below, above = low - centroids, centroids - high
    least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(1)
    most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    return np.flatnonzero(least <= most.min())


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row; ties: smaller number.

    Products run in floating point only while every sum is an exact integer there.
    """
    size = max(int(np.abs(v).max()), int(np.abs(centroids).max()))
    kind = np.float64 if 4 * size * size * v.shape[1] < _EXACT else np.int64
    a, c = v.astype(kind), centroids.astype(kind)
    far = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    k = far.argmin(1)
    return k, far[np.arange(len(v)), k].astype(np.int64)


def _assigned(batch: pa.RecordBatch, dims: int,
              centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, cluster, distance) of each block."""
    cols = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        v = _widened(cols["vectors"][i].as_py(), cols["n"][i].as_py(), dims)
        low = cols["low"][i].values.to_numpy(zero_copy_only=False)
        high = cols["high"][i].values.to_numpy(zero_copy_only=False)
        near = candidates(low, high, centroids)
        k, far = nearest(v, centroids[near])
        yield (cols["ids"][i].values if "ids" in cols else None), v, near[k], far


def _sums(dims: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), dims), np.int64)
        count = np.zeros(len(centroids), np.int64)
        for batch in batches:
            for _, v, k, _far in _assigned(batch, dims, centroids):
                np.add.at(total, k, v)
                count += np.bincount(k, minlength=len(centroids))
        k, d = (x.ravel() for x in np.indices(total.shape))
        full = count[k] > 0
        yield pa.record_batch([pa.array(k[full]), pa.array(d[full]), pa.array(total.ravel()[full]),
                               pa.array(count[k[full]])], names=["cluster", "dim", "sum", "n"])
    return run


def _rows(dims: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, k, far in _assigned(batch, dims, centroids):
                yield pa.record_batch([ids, pa.array(k.astype(np.int32)), pa.array(far)],
                                      names=["id", "cluster", "distance"])
    return run


def cluster_vectors(vectors: DataFrame, id_col: str, vector_col: str, k: int = 16, rounds: int = 3,
                    dims: int = 64, scale: float = 64.0, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) of each kept vector.

    Kept are vectors of exactly ``dims`` components, none null or not finite, and none beyond
    ``LARGEST`` in size, whose squared distances would not fit a long. Components become
    ``floor(scale * x)``. The first centroids are the k vectors with the smallest sha256 of
    ``seed:id`` (equal ids: the smaller vector first); with fewer vectors there are fewer. A round
    assigns every vector to the nearest centroid (ties: smaller number) and moves each centroid
    that has vectors to the floor of their mean. ``centroid`` is the final array of integers.
    Repeated rows are vectors of their own, a null id is hashed as an empty one, other columns are
    not read, and a table without a kept vector gives no rows.
    """
    x = F.col(vector_col)
    sound = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(
        F.col(id_col).alias("id"), x.cast("array<double>").alias("x"))
    named = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))),
                   256)
    first = kept.orderBy(named, "x").limit(k).collect()  # k rows
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    if not first:
        return spark.createDataFrame([], f"id {id_type}, cluster int, distance long, "
                                         "cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.floor(scale * np.array([r["x"] for r in first], np.float64)).astype(np.int64)
    extent = (kept.select("x").mapInArrow(_extent(dims, scale), "dim long, low long, high long")
              .groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
              .orderBy("dim").collect())  # one row for each dimension
    low, high = (np.array([r[c] for r in extent], np.int64) for c in ("low", "high"))
    # equal vectors are split by id, so a very frequent one does not fill a task
    placed = kept.mapInArrow(_placed(dims, scale, low, high),
                             f"place binary, id {id_type}, vector binary")
    blocks = cut_lineage(
        placed.repartitionByRange("place", "id").sortWithinPartitions("place", "id").mapInArrow(
            _packed(dims), f"n int, ids array<{id_type}>, vectors binary, low array<long>, "
                           "high array<long>"))
    bare = blocks.drop("ids")
    for _ in range(rounds):
        sums = bare.mapInArrow(_sums(dims, centroids), "cluster long, dim long, sum long, n long")
        centroids = centroids.copy()
        for r in sums.groupBy("cluster", "dim").agg(
                F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum"),
                F.sum("n").alias("n")).collect():  # k rows for each dimension
            centroids[r["cluster"], r["dim"]] = int(r["sum"]) // r["n"]
    rows = cut_lineage(blocks.mapInArrow(_rows(dims, centroids),
                                         f"id {id_type}, cluster int, distance long"))
    inertia = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = rows.agg(F.sum("distance").alias("inertia"))
    final = spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())],
                                  "cluster int, centroid array<long>")
    # at most k rows each
    return (rows.join(F.broadcast(inertia.join(F.broadcast(final), "cluster")), "cluster")
            .join(F.broadcast(whole)).select("id", "cluster", "distance", "cluster_inertia",
                                             "inertia", "centroid"))
