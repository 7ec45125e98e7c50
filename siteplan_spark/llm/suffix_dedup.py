"""Exact removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``LENGTH`` bytes (a window) that also starts earlier: in a
document with a smaller key, or earlier in the same document. Suffix-sorting a whole corpus
against itself would compare every shard with every other, so shards are formed by content:

1. Each window has an anchor: the leftmost of its ``GRAM``-byte strings with the smallest hash.
   Equal windows have equal anchors, so a window whose anchor occurs once cannot repeat. Tasks
   report each distinct anchor once, and anchors seen twice anywhere are kept. Nothing is lost.
2. Runs of windows around one anchor occurrence are cut out and dealt to shards by anchor, so
   equal windows meet in one shard. Each shard is suffix-sorted by prefix doubling that only
   refines unsorted groups (Larsson and Sadakane); common prefixes with the preceding suffix
   follow by Kasai's rule, taken through all runs in step; neighbours that share ``LENGTH``
   bytes are one class, of which the earliest window stays.
3. An anchor with more than ``HOT`` occurrences is split over several shards. Their surviving
   windows are sorted lists, merged in pairs by binary search.

Copies are collapsed inside each task before anything is sent, so a group of copies reaches a
shard at most once per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from siteplan_spark.llm.common import cut_lineage, text_bytes

LENGTH, GRAM = 100, 24
#: Occurrences of an anchor beyond which it is split, and the size of a part.
HOT = 20_000
#: Bytes that are suffix-sorted together, at least; anchors are not divided between shards.
SHARD_BYTES = 4_000_000
#: Anchors, or runs, that a task holds back to collapse copies among them.
HELD = 1_500_000
_PLACE = (1 << 30) - 1
_LINK, _COPY, _HOT, _BLOB = 1, 2, 3, 0


@F.arrow_udf(BinaryType())
def _packed(text: pa.Array) -> pa.Array:
    """Texts travel to their places and spans compressed."""
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(t) for t in text_bytes(text)], pa.binary())


def _unpacked(column: pa.Array) -> list[bytes]:
    open_ = zstandard.ZstdDecompressor()
    return [open_.decompress(t.as_py()) for t in column]


# --- anchors ------------------------------------------------------------------------------

def _rolling(buf: np.ndarray, length: int, factor: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``length`` bytes, by joining powers of two."""
    part, size, done, at, scale = buf.astype(np.uint64) + np.uint64(1), 1, None, 0, factor
    while True:
        if length & size:
            if done is None:
                done = part
            else:  # strings joined so far, then this part
                m = len(buf) - (at + size) + 1
                done = done[:m] * np.uint64(scale) + part[at:at + m]
            at += size
        if size * 2 > length:
            return done
        part = part[:-size] * np.uint64(scale) + part[size:] if len(part) > size else part[:0]
        size, scale = size * 2, scale * scale % (1 << 64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _runs(buf: np.ndarray, doc: np.ndarray) -> tuple:
    """(first window, last window, anchor place, anchor hash) of each run inside one document."""
    n = len(buf) - LENGTH + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = _mixed(_rolling(buf, GRAM, 0xD1342543DE82EF95))
    low = (h >> np.uint64(30) << np.uint64(30)) | np.arange(len(h), dtype=np.uint64)
    span, size = LENGTH - GRAM + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[span - size:span - size + n])
    anchor = (low & np.uint64(_PLACE)).astype(np.int64)
    whole = doc[:n] == doc[LENGTH - 1:]
    cut = np.ones(n, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:n] != doc[:n - 1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    return first, last, anchor[first], h[anchor[first]]


def _chunks(texts: list[bytes], size: int = 1 << 22) -> Iterator[tuple]:
    """(bytes, document number of each byte, place of each byte's chunk start in its document).

    Short documents are joined; a long one is taken in overlapping parts.
    """
    held, total = [], 0

    def joined(parts):
        buf = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = [len(p) for _, _, p in parts]
        shift = np.array([s for _, s, _ in parts]) - np.cumsum([0, *sizes[:-1]])
        return buf, np.repeat([i for i, _, _ in parts], sizes), np.repeat(shift, sizes)

    for i, text in enumerate(texts):
        for start in range(0, max(1, len(text) - LENGTH + 1), size):
            part = text[start:start + size + LENGTH - 1]
            held.append((i, start, part))
            total += len(part)
            if total >= size or len(text) > size:
                yield joined(held)
                held, total = [], 0
    if held:
        yield joined(held)


def _rows(kind, key, a, b, data) -> pa.RecordBatch:
    return pa.record_batch({
        "kind": pa.array(np.broadcast_to(kind, len(key)), pa.int32()),
        "key": pa.array(key, pa.int64()), "a": pa.array(a, pa.int64()),
        "b": pa.array(b, pa.int64()), "data": pa.array(data, pa.binary())})


_SCHEMA = "kind int, key long, a long, b long, data binary"


def _by_document(keys: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order].astype("<u4")
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        data = [places[i:j].tobytes() for i, j in zip(starts, np.append(starts[1:], len(keys)))]
        none = np.zeros(len(starts), np.int64)
        yield _rows(_LINK, keys[starts], none, none, data)


_ENTRY = [("h", "<u4"), ("n", "<u4"), ("place", "<u4"), ("key", "<i8")]


def _report(parts: int):
    """Pass over the texts: distinct anchors for the parts, anchors known to repeat, copies."""
    def flush(held):
        h, key, place = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        h, key, place = h[order], key[order], place[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        count = np.diff(np.append(starts, len(h)))
        again = np.repeat(count > 1, count)
        yield from _by_document(key[again], place[again])
        entry = np.empty(len(starts), _ENTRY)
        entry["h"], entry["n"] = (h[starts] & np.uint64(0xFFFFFFFF)), count
        entry["place"], entry["key"] = place[starts], key[starts]
        part = ((h[starts] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        entry, part = entry[order], part[order]
        at = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        none = np.zeros(len(at), np.int64)
        yield _rows(_BLOB, part[at], none, none,
                    [entry[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(part)))])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        held, total, seen = [], 0, {}
        for batch in batches:
            keys, texts, copies = [], [], []
            for key, text in zip(batch.column(0).to_numpy(zero_copy_only=False).tolist(),
                                 text_bytes(batch.column(1))):
                if len(text) < LENGTH:
                    continue
                mark = hashlib.blake2b(text, digest_size=16).digest()
                before = seen.setdefault(mark, key)
                if before < key:
                    copies.append((key, len(text)))
                    continue
                if key < before:  # the later copy has been read already
                    seen[mark] = key
                    copies.append((before, len(text)))
                keys.append(key)
                texts.append(text)
            if copies:
                yield _rows(_COPY, *zip(*[(k, 0, n, b"") for k, n in copies]))
            keys = np.array(keys, np.int64)
            for buf, doc, shift in _chunks(texts):
                _, _, anchor, h = _runs(buf, doc)
                if len(h):
                    held.append((h, keys[doc[anchor]], anchor + shift[anchor]))
                    total += len(h)
                if total >= HELD:
                    yield from flush(held)
                    held, total = [], 0
            if len(seen) > HELD:
                seen.clear()
        if held:
            yield from flush(held)

    return report


def _repeated(hot: int):
    """Of each part: places whose anchor was reported twice or more, and anchors to be split."""
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            blob = pa.compute.equal(batch.column(0), _BLOB)
            yield batch.filter(pa.compute.invert(blob))
            part = batch.filter(blob)
            held += [(k, np.frombuffer(d.as_py(), _ENTRY)) for k, d in zip(
                part.column(1).to_pylist(), part.column(4))]
        if not held:
            return
        entry = np.concatenate([e for _, e in held])
        h = entry["h"].astype(np.int64) | np.repeat(
            [k << 32 for k, _ in held], [len(e) for _, e in held])
        order = np.argsort(h, kind="stable")
        h, entry = h[order], entry[order]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        sizes = np.diff(np.append(starts, len(h)))
        total = np.add.reduceat(entry["n"].astype(np.int64), starts)
        found = np.repeat(total > 1, sizes) & (entry["n"] == 1)
        yield from _by_document(entry["key"][found], entry["place"][found])
        many = total > hot
        if many.any():
            yield _rows(_HOT, h[starts][many], -(-total[many] // hot), total[many],
                        [b""] * int(many.sum()))

    return repeated


# --- runs ---------------------------------------------------------------------------------

def _joined(gone: list[tuple]) -> pa.RecordBatch:
    """Spans (key, start, end), joined where they overlap or touch."""
    key, a, b = (np.array(x, np.int64) for x in zip(*sorted(gone)))
    head = np.r_[True, (key[1:] != key[:-1]) | (a[1:] > b[:-1])]  # runs: ends rise with starts
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(key)) - 1
    return _rows(_COPY, key[first], a[first], b[last], [b""] * len(first))


def _cut(parts: int):
    """Rows (key, text, places): the runs whose anchors repeat, each distinct one once a task."""
    def flush(seen):
        rows = [(key, start, data, h) for (h, data), (key, start) in seen.items()]
        if rows:
            key, start, data, h = zip(*rows)
            yield _rows(_LINK, key, start, h, data)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = _unpacked(batch.column(1))
            wanted = [np.frombuffer(b"".join(p), "<u4").astype(np.int64)
                      for p in batch.column(2).to_pylist()]
            sought = np.unique(np.concatenate(
                [np.int64(i) << 32 | w for i, w in enumerate(wanted)] or [np.empty(0, np.int64)]))
            gone = []
            for buf, doc, shift in _chunks(texts):
                first, last, anchor, h = _runs(buf, doc)
                if not len(h):
                    continue
                name = doc[anchor].astype(np.int64) << 32 | (anchor + shift[anchor])
                take = np.isin(name, sought)
                label = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64) << 32 | (
                    h & np.uint64(0xFFFFFFFF)).astype(np.int64)
                raw = buf.tobytes()
                for f, e, d, s, g in zip(first[take].tolist(), (last[take] + LENGTH).tolist(),
                                         doc[first[take]].tolist(), shift[first[take]].tolist(),
                                         label[take].tolist()):
                    run, mine = (g, raw[f:e]), (keys[d], f + s)
                    before = seen.setdefault(run, mine)
                    if before is not mine:
                        later = max(before, mine)
                        gone.append((later[0], later[1], later[1] + e - f))
                        if mine < before:
                            seen[run] = mine
            if gone:
                yield _joined(gone)
            if len(seen) > HELD // 8:
                yield from flush(seen)
                seen = {}
        yield from flush(seen)

    return cut


# --- suffix arrays ------------------------------------------------------------------------

def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by prefix doubling from seven bytes, refining only open groups.

    A byte takes nine bits, so that the end of the text is smaller than any byte.
    """
    n = len(text)
    padded = np.concatenate([text.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    word = np.zeros(n, np.uint64)
    for i in range(7):
        word = (word << np.uint64(9)) | padded[i:i + n]
    sa = np.argsort(word, kind="stable")
    head = np.ones(n, bool)
    head[1:] = word[sa[1:]] != word[sa[:-1]]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, slot, 0))
    single = head & np.append(head[1:], True)
    slot, depth = slot[~single], 7
    while len(slot):
        suffix = sa[slot]
        after = suffix + depth
        beyond = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[suffix] * (n + 1) + beyond
        order = np.argsort(pair, kind="stable")
        pair, suffix = pair[order], suffix[order]
        sa[slot] = suffix
        head = np.ones(len(slot), bool)
        head[1:] = pair[1:] != pair[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(head, slot, 0))
        slot = slot[~(head & np.append(head[1:], True))]
        depth *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, before: np.ndarray, starts: np.ndarray,
                    counts: np.ndarray) -> np.ndarray:
    """Common prefix, up to LENGTH, of each window with the suffix before it in order.

    ``before[i]`` is that suffix for place i (-1: none). Kasai's rule, that the prefix of the
    next place is at most one shorter, is followed through all runs at the same time.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(LENGTH + 1, np.uint8)])
    shared = np.zeros(n, np.int16)
    length = np.zeros(len(starts), np.int64)
    for step in range(int(counts.max()) if len(counts) else 0):
        live = np.flatnonzero(counts > step)
        place = starts[live] + step
        other = before[place]
        have = np.maximum(length[live] - 1, 0)
        have[other < 0] = 0
        open_ = np.flatnonzero(other >= 0)
        while len(open_):
            a, b = place[open_] + have[open_], other[open_] + have[open_]
            more = (have[open_] < LENGTH) & (b < n) & (padded[a] == padded[np.minimum(b, n)])
            open_ = open_[more]
            have[open_] += 1
        length[live] = have
        shared[place] = have
    return shared


def _classes(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, offset, class) of every window of the runs; equal windows share a class."""
    size = np.array([len(r) for r in runs])
    starts = np.cumsum(np.append(0, size[:-1] + 1))
    text = np.frombuffer(b"\xff".join(runs) + b"\xff", np.uint8)  # no UTF-8 text has this byte
    sa, rank = suffix_array(text)
    before = np.full(len(text), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    counts = size - LENGTH + 1
    shared = common_prefixes(text, before, starts, counts)
    run = np.repeat(np.arange(len(runs)), counts)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = starts[run] + offset
    order = np.argsort(rank[place])
    label = np.empty(len(run), np.int64)
    label[order] = np.cumsum(shared[place[order]] < LENGTH)
    return run, offset, label


def _spans(key: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows at these places of these documents, joined where they follow each other."""
    if len(key):
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        head = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1)])
        last = np.append(head[1:], len(key)) - 1
        yield _rows(_COPY, key[head], place[head], place[last] + LENGTH, [b""] * len(head))


_WINDOW = [("x", "<u8"), ("y", "<u8"), ("key", "<i8"), ("place", "<i8")]


def _sorted_shard(rows: list[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    """One shard of (key, start, run, split): later windows of each class, and split survivors."""
    first: dict[bytes, int] = {}
    key, start = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    size = np.array([len(r[2]) for r in rows])
    split = np.array([r[3] for r in rows])
    order = np.lexsort((start, key))
    for i in order.tolist():
        first.setdefault(rows[i][2], i)
    own = np.fromiter(first.values(), np.int64, len(first))
    copies = np.setdiff1d(np.arange(len(rows)), own)
    if len(copies):
        yield _rows(_COPY, key[copies], start[copies], start[copies] + size[copies],
                    [b""] * len(copies))
    run, offset, label = _classes([rows[i][2] for i in own])
    at, place = key[own][run], start[own][run] + offset
    order = np.lexsort((place, at, label))
    head = np.r_[True, label[order][1:] != label[order][:-1]]
    yield from _spans(at[order][~head], place[order][~head])
    kept = order[head]
    kept = kept[split[own][run[kept]]]
    if len(kept):
        text = np.frombuffer(b"".join(rows[i][2] for i in own), np.uint8)
        base = np.cumsum(np.append(0, size[own][:-1]))
        spot = base[run[kept]] + offset[kept]
        window = np.empty(len(kept), _WINDOW)
        window["x"] = _mixed(_rolling(text, LENGTH, 0xD1342543DE82EF95)[spot])
        window["y"] = _mixed(_rolling(text, LENGTH, 0xAF251AF3B0F025B5)[spot])
        window["key"], window["place"] = at[kept], place[kept]
        window = window[np.lexsort((window["y"], window["x"]))]
        part = (window["x"] % np.uint64(parts)).astype(np.int64)
        for p in np.unique(part):
            yield _rows(_BLOB, [int(p)], [0], [0], [window[part == p].tobytes()])


def _shards(parts: int):
    """Rows (kind, key, a, b, data, salts) in order of anchor: sort shard after shard."""
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, last = [], 0, None
        for batch in batches:
            run = pa.compute.equal(batch.column(0), _LINK)
            yield batch.select(range(5)).filter(pa.compute.invert(run))
            part = batch.filter(run)
            for key, start, h, data, salts, salt in zip(*(part.column(i).to_pylist()
                                                          for i in range(1, 7))):
                if total >= SHARD_BYTES and (h, salt) != last:
                    yield from _sorted_shard(rows, parts)
                    rows, total = [], 0
                rows.append((key, start, data, salts > 1))
                total += len(data)
                last = (h, salt)
        if rows:
            yield from _sorted_shard(rows, parts)

    return shards


def merge_sorted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(merged, later): two sorted lists of windows by binary search; of equals the earlier stays."""
    lo, hi = np.searchsorted(a["x"], b["x"], "left"), np.searchsorted(a["x"], b["x"], "right")
    match = np.full(len(b), -1)
    for shift in range(int((hi - lo).max()) if len(b) else 0):
        at = np.minimum(lo + shift, len(a) - 1)
        match[(lo + shift < hi) & (a["y"][at] == b["y"])] = at[
            (lo + shift < hi) & (a["y"][at] == b["y"])]
    both = np.flatnonzero(match >= 0)
    old, new = a[match[both]], b[both]
    earlier = (new["key"] < old["key"]) | (
        (new["key"] == old["key"]) & (new["place"] < old["place"]))
    later = np.where(earlier, old, new)
    a = a.copy()
    a[match[both[earlier]]] = new[earlier]
    rest = b[match < 0]
    return np.insert(a, np.searchsorted(a["x"], rest["x"]), rest), later


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survivors of split anchors: the lists of each part, merged in pairs."""
    lists = [np.frombuffer(d.as_py(), _WINDOW) for batch in batches for d in batch.column(4)]
    while len(lists) > 1:
        merged = []
        for i in range(0, len(lists) - 1, 2):
            one, later = merge_sorted(lists[i], lists[i + 1])
            yield from _spans(later["key"], later["place"])
            merged.append(one)
        lists = merged + lists[len(lists) - len(lists) % 2:]


# --- the operator -------------------------------------------------------------------------

def repeated_spans(texts: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, spans): unmerged spans [a, b) to be removed, for rows (key long, text) with unique keys."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spots = cut_lineage(texts.mapInArrow(_report(parts), _SCHEMA)
                        .repartition(parts, "kind", "key").mapInArrow(_repeated(hot), _SCHEMA))
    places = spots.where(F.col("kind") == _LINK).groupBy("key").agg(
        F.collect_list("data").alias("places"))  # the places of one document
    runs = (texts.select("key", _packed("text").alias("text")).join(places, "key")
            .mapInArrow(_cut(parts), _SCHEMA))
    split = spots.where(F.col("kind") == _HOT).select(F.col("key").alias("b"),
                                                      F.col("a").alias("salts"))
    # at most one row for each ``hot`` places; a join that is planned by keys would write all runs
    # twice, once for the join and once for the shards
    dealt = runs.join(F.broadcast(split), "b", "left").withColumn(
        "salts", F.coalesce("salts", F.lit(1).cast("long")))
    salt = F.pmod(F.xxhash64("data"), F.col("salts"))
    shards = (dealt.select("kind", "key", "a", "b", "data", "salts", salt.alias("salt"))
              .repartition(parts, "b", "salt").sortWithinPartitions("b", "salt")
              .mapInArrow(_shards(parts), _SCHEMA))
    marks = cut_lineage(shards)
    across = (marks.where(F.col("kind") == _BLOB).repartition(parts, "key")
              .mapInArrow(_merge, _SCHEMA))
    gone = (spots.where(F.col("kind") == _COPY).unionByName(marks.where(F.col("kind") == _COPY))
            .unionByName(across))
    return gone.groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text) with unique keys in the order of documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    odd = rows.groupBy("id").count().where("count > 1 OR id IS NULL")
    if odd.isEmpty():
        return rows.select(F.col("id").alias("key"), "id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("id").asc_nulls_last(), F.col("text")]
    ranked = rows.distinct().repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut_lineage(ranked.withColumn("key", F.monotonically_increasing_id())
                       .select("key", "id", "text"))


def merged_spans(spans: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in spans[np.argsort(spans[:, 0])].tolist() if len(spans) else []:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, spans, kept = [], [], []
        for text, found in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
            gone = merged_spans(np.array([(s["a"], s["b"]) for s in found or []],
                                         np.int64).reshape(-1, 2))
            edges = [0, *[x for s in gone for x in s], len(text)]
            n.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in gone])
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.record_batch({
            "id": batch.column(0), "n_bytes": pa.array(n, pa.int64()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()),
                                                         ("end", pa.int64())]))),
            "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, spans, kept): the removed byte runs and the remaining bytes of each document.

    A null text is an empty one; texts under LENGTH bytes lose nothing. Ids order documents. Rows
    that repeat id and text are one document and give one row; texts that share an id are
    ordered by text, and rows without an id come last. Only the two named columns are read.
    """
    texts = _keyed(docs, id_col, text_col)
    spans = repeated_spans(texts.select("key", "text"), hot)
    packed = texts.select("key", "id", _packed("text").alias("text"))
    return (packed.join(spans, "key", "left").select("id", "text", "spans")
            .mapInArrow(_finish, "id long, n_bytes long, "
                        "spans array<struct<start: long, end: long>>, kept binary"))
