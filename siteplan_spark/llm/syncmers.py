"""Fingerprints of documents from closed syncmers, with DataFrame functions only.

A k-mer is ``K`` consecutive tokens. It is chosen when the smallest hash of its inner ``S``-mers
lies at an edge (the first or the last of them). The choice depends on the k-mer alone and never
on its neighbours, so a passage gives the same anchors wherever it stands, and of ``K - S + 1``
k-mers in a row at least one is chosen. The fingerprint of a text is the sequence of the hashes of
its anchors in text order, so the place of an anchor is its index.

Two fingerprints are compared by position: anchors that both hold are paired, each pair has a
displacement, and a pair counts when its displacement is near the median of all. The likeness is
twice the number of such pairs over the number of anchors (Dice).

Tokens are runs of characters other than ASCII white space, except that a character of a script
written without spaces is a token by itself and a run is cut after ``PIECE`` characters. All work
on a text happens inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.llm.common import cut_lineage
from siteplan_spark.operators.ranking import global_rank

K, S = 8, 2
#: Longest token in characters; a longer unbroken run is several tokens.
PIECE = 32
#: Blocks of scripts written without spaces: Thai and Lao, Myanmar, Khmer, Kana, Han.
UNSPACED = (r"\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}"
            r"\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}")
SPACE = r"[\x20\x09-\x0D]+"
TOKEN = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]{{1,{PIECE}}}"
#: Pairs may be displaced from the median by this many anchors, and by this share of the shorter.
SLACK, SLACK_SHARE = 4, 0.25


def _with_tokens(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with the tokens of ``text``. Splitting at white space is ten times as fast as the
    pattern of a token and gives the same unless a word is long or written without spaces."""
    raw, words = f"{name}_r", F.col(f"{name}_w")
    out = df.withColumn(raw, F.coalesce(text, F.lit("")))
    out = out.withColumn(f"{name}_w", F.filter(F.split(raw, SPACE), lambda w: w != ""))
    plain = ~F.exists(words, lambda w: F.octet_length(w) > PIECE) & (
        (F.octet_length(raw) == F.length(raw)) | ~F.col(raw).rlike(f"[{UNSPACED}]"))
    return out.withColumn(name, F.when(plain, words).otherwise(F.regexp_extract_all(
        F.col(raw), F.lit(TOKEN), F.lit(0)))).drop(raw, f"{name}_w")


def with_anchors(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` with one more column ``name``: array<int>, the anchors of ``text`` in text order.

    A text of fewer than ``K`` tokens has one anchor, the hash of all its tokens; one without
    tokens (null, empty, white space) has none.
    """
    w, t, m, c = (f"{name}_{p}" for p in ("tokens", "t", "m", "c"))
    hashes, inner = F.col(t), F.col(m)
    width = K - S + 1

    def chosen(i: Column) -> Column:
        edges = F.least(F.get(inner, i), F.get(inner, i + (width - 1)))
        return edges <= F.array_min(F.slice(inner, i + 2, width - 2))

    def anchor(i: Column) -> Column:
        return F.shiftright(F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]), 32).cast("int")

    # each column is named by the next more than once, so the optimizer keeps them apart
    out = _with_tokens(df, text, w).withColumn(t, F.transform(w, lambda x: F.xxhash64(x)))
    out = out.withColumn(m, F.when(F.size(hashes) >= K, F.transform(
        hashes, lambda h, i: F.xxhash64(*[F.get(hashes, i + j) for j in range(S)]))))
    out = out.withColumn(c, F.filter(F.when(F.size(hashes) >= K, F.sequence(
        F.lit(0), F.size(hashes) - K)), chosen))
    whole = F.when(F.size(hashes) > 0, F.array(F.shiftright(F.xxhash64(hashes), 32).cast("int")))
    return out.withColumn(name, F.coalesce(
        F.when(F.size(hashes) >= K, F.transform(F.col(c), anchor)), whole,
        F.array().cast("array<int>"))).drop(w, t, m, c)


def as_text(anchors: Column) -> Column:
    """Eight lowercase hex digits for each anchor, in text order."""
    return F.lower(F.array_join(F.transform(anchors, lambda h: F.substring(
        F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF) + (1 << 32)), 2, 8)), ""))


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``df`` with one more column ``name``: the likeness (0 to 1) of two columns of anchors.

    An anchor that a fingerprint holds more than once counts where it comes first. Two empty
    fingerprints have likeness 1, an empty one and another 0.
    """
    x, y, s, d = (f"{name}_{p}" for p in "xysd")
    rows = df.withColumns({x: F.array_distinct(a), y: F.array_distinct(b)})

    def coded(column: str, side: int) -> Column:
        return F.transform(column, lambda h, i: F.shiftleft(h.cast("long"), 31) + i * 2 + side)

    # sorted by anchor, then place; equal anchors of the two sides are neighbours
    rows = rows.withColumn(s, F.when(F.arrays_overlap(x, y), F.sort_array(
        F.concat(coded(x, 0), coded(y, 1)))))
    low = (1 << 31) - 1

    def displaced(v: Column, j: Column) -> Column:
        w = F.get(s, j + 1)
        moved = F.shiftright(w.bitwiseAND(low), 1) - F.shiftright(v.bitwiseAND(low), 1)
        return F.when(F.shiftright(v, 31) == F.shiftright(w, 31),
                      F.when(v.bitwiseAND(1) == 0, moved).otherwise(-moved))

    rows = rows.withColumn(d, F.sort_array(F.array_compact(F.transform(s, displaced))))
    middle = F.get(d, F.floor(F.size(d) / 2).cast("int"))
    slack = SLACK + F.least(F.size(x), F.size(y)) * SLACK_SHARE
    near = F.coalesce(F.size(F.filter(d, lambda v: F.abs(v - middle) <= slack)), F.lit(0))
    total = F.size(x) + F.size(y)
    return rows.withColumn(name, F.when(total > 0, 2.0 * near / total).otherwise(F.lit(1.0))).drop(
        x, y, s, d)


def edited_by_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_chars, text, anchors, edited, next_anchors) of each document.

    Documents are ordered by descending id, and the first follows the last. ``edited`` is the text
    with its last third (rounded down, in code points) replaced by the start of the next document.

    Only ids, hashes and lengths are ordered. Whole texts are shuffled once, by id and text hash;
    what a document needs of the next one (the start of its text and its anchors) is cut there and
    shuffled to it, and the whole texts are met where they already are.

    A null text is empty. Null ids come last. Documents that share an id follow each other by the
    hash of their text; rows equal in both are one document. A single document follows itself.
    Other columns are not read. No rows in, no rows out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", "text", F.xxhash64("id", F.col("id").isNull()).alias("a"),
        F.xxhash64("text").alias("b"))
    ids = keyed.select("id", "a", "b", F.length("text").alias("n")).distinct()
    ranked = cut_lineage(global_rank(ids, [F.desc_nulls_last("id"), F.desc("b")]))
    count = ranked.agg(F.count(F.lit(1)).alias("_count"))
    follower = ranked.join(F.broadcast(count)).select(
        F.col("a").alias("a"), F.col("b").alias("b"),
        F.when(F.col("rank") > 1, F.col("rank") - 1).otherwise(F.col("_count")).alias("rank"))
    needs = follower.join(ranked.select(
        "rank", F.col("a").alias("for_a"), F.col("b").alias("for_b"),
        F.floor(F.col("n") / 3).cast("int").alias("take")), "rank").drop("rank")
    # one struct, so that both uses below ask for the same columns and share one shuffle
    whole = with_anchors(keyed, F.col("text"), "anchors").groupBy("a", "b").agg(
        F.first(F.struct("id", "text", "anchors")).alias("doc"))
    starts = whole.join(needs, ["a", "b"]).select(
        F.col("for_a").alias("a"), F.col("for_b").alias("b"),
        F.substring(F.col("doc.text"), F.lit(1), F.col("take")).alias("start"),
        F.col("doc.anchors").alias("next_anchors"))
    text, n = F.col("doc.text"), F.length("doc.text")
    cut = F.substring(text, F.lit(1), n - F.floor(n / 3).cast("int"))
    return whole.join(starts, ["a", "b"]).select(
        "doc.id", n.cast("long").alias("n_chars"), text, "doc.anchors",
        F.concat(cut, F.col("start")).alias("edited"), "next_anchors")


def fingerprint_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_chars, fingerprint, edited, edited_fingerprint, near_edited, near_next).

    The rows of ``edited_by_next`` with fingerprints as text and likenesses.
    """
    rows = with_anchors(edited_by_next(docs, id_col, text_col), F.col("edited"), "edited_anchors")
    rows = with_likeness(rows, "anchors", "edited_anchors", "near_edited")
    rows = with_likeness(rows, "anchors", "next_anchors", "near_next")
    return rows.select("id", "n_chars", as_text(F.col("anchors")).alias("fingerprint"), "edited",
                       as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
                       "near_edited", "near_next")
