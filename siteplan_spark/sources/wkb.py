"""Lines in well-known binary, decoded and encoded a batch at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# these functions travel by value, so executors need no copy of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LINE, _LINES = 2, 5  # geometry types of WKB


def _gather(data: np.ndarray, at: np.ndarray, kind: str, big: np.ndarray) -> np.ndarray:
    """Numbers of ``kind`` at byte positions, each in its own byte order."""
    width = np.dtype(kind).itemsize
    raw = data[at[:, None] + np.arange(width)]
    raw[big] = raw[big, ::-1]
    return np.ascontiguousarray(raw).view(f"<{kind}")[:, 0]


def _line_headers(data: np.ndarray, at: np.ndarray,
                  end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(big-endian, type, count) of the geometries that start at ``at``."""
    if (at + 9 > end).any():
        raise ValueError("a WKB geometry ends within its header")
    order = data[at]
    if (order > 1).any():
        raise ValueError(f"unknown WKB byte order {int(order.max())}")
    big = order == 0
    return big, _gather(data, at + 1, "u4", big), _gather(data, at + 5, "u4", big).astype(np.int64)


def decode_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray,
                                                                 np.ndarray, np.ndarray]:
    """(row, part, first vertex, vertices) of all lines of a batch of WKB geometries.

    ``data`` holds the geometries back to back, geometry i from ``offsets[i]`` to
    ``offsets[i + 1]``. All headers of a step are read together; the parts of multi-lines are
    walked in step, so the steps are as many as the most parts of a row. ``first vertex`` has one
    entry more than there are lines; vertices are (x, y). Anything but a whole LineString or
    MultiLineString of two dimensions is an error, since a guess would put roads elsewhere.
    """
    at, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    big, kind, count = _line_headers(data, at, end)
    if not np.isin(kind, (_LINE, _LINES)).all():
        raise ValueError(f"geometry type {int(kind[~np.isin(kind, (_LINE, _LINES))][0])} "
                         "is not a line")
    rows = np.flatnonzero(kind == _LINE)
    found = [(rows, np.zeros(len(rows), np.int64), at[rows] + 9, count[rows], big[rows])]
    cursor = np.where(kind == _LINE, at + 9 + 16 * count, at + 9)
    part, live = 0, np.flatnonzero((kind == _LINES) & (count > 0))
    while len(live):
        own_big, own_kind, own_count = _line_headers(data, cursor[live], end[live])
        if (own_kind != _LINE).any():
            raise ValueError("a part of a multi-line is not a line")
        found.append((live, np.full(len(live), part), cursor[live] + 9, own_count, own_big))
        cursor[live] += 9 + 16 * own_count
        if (cursor[live] > end[live]).any():
            raise ValueError("a WKB geometry is shorter than its count of points")
        part += 1
        live = live[count[live] > part]
    if (cursor != end).any():
        raise ValueError("a WKB geometry is not as long as its count of points")
    row, part_of, start, n, order = (np.concatenate(x) for x in zip(*found, strict=True))
    sort = np.lexsort((part_of, row))
    row, part_of, start, n, order = (x[sort] for x in (row, part_of, start, n, order))
    first = np.concatenate([[0], np.cumsum(n)])
    points = np.repeat(start - 16 * first[:-1], n) + 16 * np.arange(first[-1])
    flip = np.repeat(order, n)
    xy = np.stack([_gather(data, points + d, "f8", flip) for d in (0, 8)], 1)
    return row, part_of, first, xy


def decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, vertices) of each line from (feature, geometry) batches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column(1).cast(pa.large_binary())
        _, offsets, data = packed.buffers()
        ends = np.frombuffer(offsets, np.int64)[packed.offset:packed.offset + len(packed) + 1]
        row, part, first, xy = decode_lines(np.frombuffer(data, np.uint8), ends)
        names = pc.binary_join_element_wise(
            batch.column(0).take(pa.array(row)).cast(pa.string()),
            pa.array(part).cast(pa.string()), "#")
        vertices = pa.ListArray.from_arrays(
            pa.array(first, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(np.ascontiguousarray(xy[:, d])) for d in (1, 0)], names=["lat", "lon"]))
        yield pa.record_batch([names, vertices], names=["feature", "vertices"])


def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, geometry) with a little-endian LineString for each (feature, vertices)."""
    for batch in batches:
        lines = batch.column(1)
        n = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lines.flatten()
        xy = np.stack([pc.struct_field(flat, [name]).to_numpy(zero_copy_only=False)
                       for name in ("lon", "lat")], 1).astype("<f8")
        ends = np.concatenate([[0], np.cumsum(9 + 16 * n)])
        data = np.zeros(ends[-1], np.uint8)
        head = np.zeros((len(n), 9), np.uint8)
        head[:, 0], head[:, 1] = 1, _LINE
        head[:, 5:] = n.astype("<u4").view(np.uint8).reshape(-1, 4)
        data[ends[:-1, None] + np.arange(9)] = head
        at = np.repeat(ends[:-1] + 9 - 16 * (np.cumsum(n) - n), n) + 16 * np.arange(len(xy))
        data[at[:, None] + np.arange(16)] = xy.view(np.uint8).reshape(-1, 16)
        geometry = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(n), [None, pa.py_buffer(ends.tobytes()),
                                        pa.py_buffer(data.tobytes())]).cast(pa.binary())
        yield pa.record_batch([batch.column(0), geometry], names=["feature", "geometry"])
