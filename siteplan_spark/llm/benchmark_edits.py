"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may occur with up to k = floor(rate * m) edits. Cut into
k + 1 pieces, at least one piece must occur unchanged. An automaton finds every piece in every
whole text in one pass; around each hit the item is verified with Myers' bit-parallel distance.
The benchmark is the stated query set: it is taken in blocks of bounded size, each searched
through all documents. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Edits allowed per normalised character of an item.
ERROR_RATE = 0.07
#: Items with fewer normalised characters say too little to be searched for.
MIN_CHARS = 40
#: Characters of benchmark text that are broadcast at a time.
BLOCK_CHARS = 1_000_000


class _Fold(dict):
    """For str.translate: letters and digits stay, all else becomes a space."""

    def __missing__(self, code: int) -> int:
        self[code] = kept = code if chr(code).isalnum() else 32
        return kept


def normalise(text: str | None, fold: _Fold) -> str:
    """Lower case, words of letters and digits, single spaces."""
    return " ".join((text or "").lower().translate(fold).split())


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 consecutive (start, end) that cover m characters as evenly as possible."""
    return [(i * m // (k + 1), (i + 1) * m // (k + 1)) for i in range(k + 1)]


def myers(masks: dict[str, int], m: int, text: str) -> int:
    """Fewest edits between a pattern of m characters and any substring of ``text``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        equal = masks.get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best = score
        up, down = (up << 1) & full, (down << 1) & full
        vertical = equal | minus
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return best


class _Searcher:
    """One block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float, least: int):
        self.fold, self.items = _Fold(), []
        found: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            s = normalise(text, self.fold)
            if len(s) < least:
                continue
            k, masks = int(rate * len(s)), {}
            for i, c in enumerate(s):
                masks[c] = masks.get(c, 0) | 1 << i
            for a, b in pieces(len(s), k):
                found.setdefault(s[a:b], []).append((len(self.items), b))
            self.items.append((key, len(s), k, masks))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str | None) -> Iterator[tuple[int | None, int, int]]:
        """(item, edits, allowed) for each item of the block that the text contains."""
        if self.empty or not text:
            return
        s, windows = normalise(text, self.fold), {}
        for end, places in self.automaton.iter(s):
            for n, b in places:
                _, m, k, _ = self.items[n]
                start = end + 1 - b - k
                spans = windows.setdefault(n, [])
                if spans and spans[-1][0] <= start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + m + 2 * k)
                else:
                    spans.append([start, start + m + 2 * k])
        for n, spans in windows.items():
            key, m, k, masks = self.items[n]
            best = min(myers(masks, m, s[max(0, a):b]) for a, b in spans)
            if best <= k:
                yield key, best, k


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about BLOCK_CHARS characters."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    for i in range(n):
        yield [(r["id"], r["text"]) for r in rows.where(block == i).collect()]


def find_leaks(docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_col: str,
               item_text: str, rate: float = ERROR_RATE, least: int = MIN_CHARS) -> DataFrame:
    """(id, item_id, n_edits, allowed): each document with each item found in it.

    One row for each row of ``docs`` and item, also for repeated rows, null ids and equal
    items. Null and empty texts contain nothing. Items with fewer than ``least`` normalised
    characters are not searched for. No items or no documents give no rows. Only the named
    columns are read, so others may have any name.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([StructField("id", rows.schema["id"].dataType)] + [
        StructField(n, LongType()) for n in ("item_id", "n_edits", "allowed")])
    context, out = docs.sparkSession.sparkContext, None
    for block in _blocks(items, item_col, item_text):
        sent = context.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = _Searcher(sent.value, rate, least)
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column(1)):
                    for hit in searcher.matches(text.as_py()):
                        at.append(i)
                        hits.append(hit)
                item, edits, allowed = zip(*hits) if hits else ((), (), ())
                yield pa.record_batch({
                    "id": batch.column(0).take(pa.array(at, pa.int64())),
                    "item_id": pa.array(item, pa.int64()), "n_edits": pa.array(edits, pa.int64()),
                    "allowed": pa.array(allowed, pa.int64())})

        found = rows.mapInArrow(search, schema)
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _free_of(sent, rate: float, least: int):
    @F.arrow_udf(BooleanType())
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searcher = _Searcher(sent.value, rate, least)
        for texts in batches:
            yield pa.array([next(searcher.matches(t.as_py()), None) is None for t in texts],
                           pa.bool_())

    return clean


def drop_leaks(docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text: str,
               rate: float = ERROR_RATE, least: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item."""
    context = docs.sparkSession.sparkContext
    for block in _blocks(items, item_col, item_text):
        sent = context.broadcast(block)
        docs = docs.where(_free_of(sent, rate, least)(F.col(text_col)))
    return docs
