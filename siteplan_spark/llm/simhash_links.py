"""Near-duplicates by SimHash, found through an inverted index over byte positions.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most three bits
differ in at most three bytes, so they share at least five: that is the guaranteed minimum of
matches. A posting list of one positional byte holds a 256th of all fingerprints, and tallying
its pairs would be quadratic. The lists are therefore intersected five positions at a time
before any pair is formed: a pair's tally reaches five exactly if some five positions agree.
Inside an intersected list only three bytes are free, so a list never holds more than 2^24
fingerprints, however large the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from siteplan_spark.llm.common import cut_lineage, text_bytes
from siteplan_spark.operators.spatial import connected_components

#: At most this many bits may differ, and so at least this many bytes agree.
MAX_BITS = 3
MIN_BYTES = 8 - MAX_BITS
SLOTS = list(combinations(range(8), MIN_BYTES))
_MASKS = [sum(0xFF << (8 * p) for p in slot) for slot in SLOTS]
_ONES = np.uint64(0x0101010101010101)
#: Lists up to the first size are compared as stacked matrices, up to the second as one
#: matrix in blocks, beyond it by looking up every mask of up to three bits. All are exact.
_STACKED, _BLOCKED = 64, 4096


# --- fingerprints -------------------------------------------------------------------------

def simhash64(text: bytes) -> int:
    """The unsigned fingerprint of one text: a bit is 1 if set in over half the hashes."""
    words = text.lower().split()
    if not words:
        return 0
    shingles = (map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= 3
                else [b" ".join(words)])
    n = max(1, len(words) - 2)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n).tobytes(), "big")


@F.arrow_udf(LongType())
def _simhash_column(text: pa.Array) -> pa.Array:
    prints = np.fromiter((simhash64(b) for b in text_bytes(text)), np.uint64, len(text))
    return pa.array(prints.view(np.int64))


def fingerprint(text: Column) -> Column:
    """The fingerprint as a signed long. A null or empty text has fingerprint zero."""
    return _simhash_column(text)


# --- links --------------------------------------------------------------------------------

def _linked(x: np.ndarray) -> np.ndarray:
    """Whether pairs with this XOR pass the byte tally and then the bit distance."""
    y = x | (x >> np.uint64(4))
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    tally = 8 - np.bitwise_count(y & _ONES)
    return (tally >= MIN_BYTES) & (np.bitwise_count(x) <= MAX_BITS)


def _stacked(prints: np.ndarray, linked: Callable = _linked) -> np.ndarray:
    """Smallest linked place in each row of an (m, g) stack of lists."""
    m, g = prints.shape
    link = linked(prints[:, :, None] ^ prints[:, None, :])
    label = np.broadcast_to(np.arange(g, dtype=np.int32), (m, g))
    while True:
        new = np.where(link, label[:, None, :], g).min(axis=2).astype(np.int32)
        if np.array_equal(new, label):
            return label
        label = new


def _blocked(prints: np.ndarray, linked: Callable = _linked) -> np.ndarray:
    label = np.arange(len(prints))
    while True:
        new = label.copy()
        for i in range(0, len(prints), 512):
            link = linked(prints[i:i + 512, None] ^ prints[None, :])
            new[i:i + 512] = np.where(link, new[None, :], len(prints)).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _looked_up(prints: np.ndarray, slot: int) -> np.ndarray:
    """The same for a long list: its three free bytes index a table of all 2^24 values."""
    free = [p for p in range(8) if p not in SLOTS[slot]]
    rest = np.zeros(len(prints), np.int64)
    for k, p in enumerate(free):
        rest |= ((prints >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << (8 * k)
    place = np.full(1 << (8 * len(free)), -1, np.int32)
    place[rest] = np.arange(len(rest), dtype=np.int32)
    flips = [sum(1 << b for b in c) for r in range(1, MAX_BITS + 1)
             for c in combinations(range(8 * len(free)), r)]
    label = np.arange(len(rest))
    while True:
        before = label.copy()
        for flip in flips:
            other = place[rest ^ flip]
            have = other >= 0
            label[have] = np.minimum(label[have], label[other[have]])
        label = label[label]
        if np.array_equal(before, label):
            return label


def _forest(slot: np.ndarray, prints: np.ndarray, starts: np.ndarray) -> tuple:
    """Edges that connect what is linked inside each list: at most one for each member."""
    sizes = np.diff(np.append(starts, len(prints)))
    left, right = [], []

    def add(members: np.ndarray, label: np.ndarray) -> None:
        moved = label != np.arange(members.shape[-1])
        root = np.take_along_axis(members, label, axis=-1)
        left.append(root[moved])
        right.append(members[moved])

    for g in np.unique(sizes[sizes > 1]):
        at = starts[sizes == g]
        if g <= _STACKED:
            step = max(1, 2_000_000 // int(g * g))
            for i in range(0, len(at), step):
                members = prints[at[i:i + step, None] + np.arange(g)]
                add(members, _stacked(members))
        else:
            for s in at:
                members = prints[s:s + g]
                add(members, _blocked(members) if g <= _BLOCKED
                    else _looked_up(members, int(slot[s])))
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return join(left), join(right)


def _link_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (slot, key, print) in order: link inside each list, carrying the open one over."""
    held: list[tuple] = []

    def out(slot, key, prints, starts):
        a, b = _forest(slot, prints, starts)
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), "u8")
        return pa.record_batch({"src": pa.array(pairs[:, 0].astype(np.uint64).view(np.int64)),
                                "dst": pa.array(pairs[:, 1].astype(np.uint64).view(np.int64))})

    def merged():
        return tuple(np.concatenate(parts) for parts in zip(*held))

    for batch in batches:
        slot, key, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(slot):
            continue
        prints = prints.view(np.uint64)
        same = held and held[0][0][0] == slot[0] and held[0][1][0] == key[0]
        cuts = np.flatnonzero((slot[1:] != slot[:-1]) | (key[1:] != key[:-1])) + 1
        if held and not len(cuts) and same:
            held.append((slot, key, prints))
            continue
        held.append((slot, key, prints))
        slot, key, prints = merged()
        starts = np.flatnonzero(np.r_[True, (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])])
        last = starts[-1]
        yield out(slot[:last], key[:last], prints[:last], starts[:-1])
        held = [(slot[last:], key[last:], prints[last:])]
    if held:
        slot, key, prints = merged()
        yield out(slot, key, prints, np.zeros(1, np.int64))


def fingerprint_links(prints: DataFrame, column: str) -> DataFrame:
    """(src, dst): edges between distinct fingerprints that connect all pairs within three bits.

    The edges are a spanning forest of each posting list, so their number is linear in the
    number of list entries, whatever the sizes of the groups.
    """
    distinct = prints.select(F.col(column).alias("_p")).distinct()
    entry = F.explode(F.array(*[
        F.struct(F.lit(i).alias("slot"), F.col("_p").bitwiseAND(
            F.lit(m - (1 << 64) if m >= 1 << 63 else m)).alias("key"))
        for i, m in enumerate(_MASKS)]))
    lists = (distinct.select(entry.alias("e"), "_p").select("e.slot", "e.key", "_p")
             .repartition("slot", "key").sortWithinPartitions("slot", "key"))
    return lists.mapInArrow(_link_lists, "src long, dst long").distinct()


# --- components ---------------------------------------------------------------------------

def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, content, fingerprint, root, component) for each row."""
    text = F.col(text_col)
    hashed = cut_lineage(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("content"),
                                     fingerprint(text).alias("fingerprint")))
    first = cut_lineage(hashed.groupBy("fingerprint").agg(F.min("id").alias("first")))
    links = cut_lineage(fingerprint_links(first, "fingerprint"))
    ends = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    groups = connected_components(ends, links).withColumnsRenamed(
        {"id": "fingerprint", "component": "root"})
    rooted = first.join(groups, "fingerprint", "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component"))
    labels = cut_lineage(rooted.join(named, "root").select("fingerprint", "root", "component"))
    return hashed.join(labels, "fingerprint")


def simhash_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, fingerprint long, component): component is the smallest id reachable over links.

    One row for each input row, repeated rows included; other columns are not touched, so
    their names cannot clash. Null and empty texts have fingerprint zero and are linked like
    any other. A row without an id takes part and gets its component; a component in which
    no row has an id is null. No rows in, no rows out. Copies meet as one fingerprint before
    anything is paired, so a group of copies costs one entry.
    """
    return _labelled(docs, id_col, text_col).select("id", "fingerprint", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component, with the columns of ``docs``.

    The row with the smallest id stays; among rows that share it, the text with the smallest
    hash, once. A component in which no row has an id keeps one row the same way.
    """
    kept = (_labelled(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component")))
            .groupBy("root").agg(F.min(F.struct("id", "content")).alias("k"))
            .select(F.col("k.id").alias("_kept_id"), F.col("k.content").alias("_kept_content")))
    keyed = docs.withColumn("_content", F.xxhash64(F.col(text_col)))
    met = keyed.join(kept, keyed[id_col].eqNullSafe(kept["_kept_id"])
                     & (keyed["_content"] == kept["_kept_content"]), "left_semi")
    return met.dropDuplicates([id_col, "_content"]).drop("_content")
