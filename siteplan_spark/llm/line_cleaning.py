"""Line-first cleaning with DataFrame functions only.

Each line is judged by itself: is it noise (symbols or capitals in every other word), navigation
(separators), boilerplate (a short line with a stock phrase), or a fragment without closing
punctuation. Lines that fail are removed, and a document that loses too much of its text, or
fails the word rules of the whole text, is rejected. Everything happens inside one row, so
there is no shuffle and no document is larger than itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.llm.common import where_once

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document is rejected when lines with more than this share of its words were removed.
MAX_LOST_PERCENT = 60

SYMBOLS = r"[#*$%&|<>{}~^]"
CAPITALS = r"[A-ZÀ-ÖØ-Þ]{2,}"
SEPARATORS = r"[|•·»]"
CLOSING = r"[.!?:;…\"”’»)\]][\x20\x09-\x0D]*\z"
STOCK = ("all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|"
         "click here|subscribe|log ?in|sign ?(in|up)|lorem ipsum")
STOCK_WORDS = 20


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _judge(line: Column) -> Column:
    """(line, n words, bad)."""
    n = _count(line, WORD)
    bad = ((2 * _count(line, SYMBOLS) >= n)
           | ((n >= 3) & (2 * _count(line, CAPITALS) >= n))
           | (_count(line, SEPARATORS) >= 3)
           | ((n <= STOCK_WORDS) & F.lower(line).rlike(STOCK))
           | ~line.rlike(CLOSING))
    return F.struct(line.alias("line"), n.cast("long").alias("n"), bad.alias("bad"))


def measure_lines(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with one more column ``line_cleaning``: the counts, the verdict, the cleaned text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost (words in removed
    lines), base_failed, kept, cleaned (the surviving lines, joined by line feeds). Rows stay
    as they are, repeated ones too. A null text counts as empty: no words, not kept. Working
    columns start with ``_lc_``; other columns pass through whatever they are called.
    """
    w, t = F.col("_lc_words"), F.col("_lc_text")
    hashes, pairs = F.col("_lc_hashes"), F.col("_lc_pairs")
    cut = (docs.withColumn("_lc_text", F.coalesce(F.col(text_col), F.lit("")))
           .withColumn("_lc_words", F.filter(F.split(t, SPACE), lambda x: x != "")))
    # windows are compared by hash; only a text in which some window repeats is sorted
    cut = cut.withColumn("_lc_hashes", F.when(F.size(w) > WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(w, i, WINDOW)))))
    cut = cut.withColumn("_lc_pairs", F.when(
        F.size(F.array_distinct(hashes)) < F.size(hashes),
        F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    starts = F.sort_array(F.transform(
        F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"] == p["h"])
                 .eqNullSafe(True) | (F.get(pairs, k + 1)["h"] == p["h"]).eqNullSafe(True)),
        lambda p: p["i"]))
    repeats = F.coalesce(F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct(i.alias("last"),
                              (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"]), F.lit(0).cast("long"))
    cut = cut.withColumn("_lc_repeats", repeats).withColumn("_lc_lines", F.transform(
        F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)), _judge))
    lines, n = F.col("_lc_lines"), F.size(w).cast("long")
    lost = F.aggregate(lines, F.lit(0).cast("long"),
                       lambda a, x: a + F.when(x["bad"], x["n"]).otherwise(F.lit(0)))
    texts = F.transform(lines, lambda x: x["line"])
    cut = cut.withColumn("_lc_lost", lost)
    failed = (n < MIN_WORDS) | (100 * F.col("_lc_repeats") > MAX_REPEAT_PERCENT * n)
    return cut.withColumn("line_cleaning", F.struct(
        n.alias("n_words"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        _count(t, r"[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size(texts) - F.size(F.array_distinct(texts))).cast("long").alias("n_dup_lines"),
        F.col("_lc_repeats").alias("n_repeat_words"),
        F.col("_lc_lost").alias("n_lost"),
        failed.alias("base_failed"),
        (~failed & (100 * F.col("_lc_lost") <= MAX_LOST_PERCENT * n)).alias("kept"),
        F.array_join(F.transform(F.filter(lines, lambda x: ~x["bad"]), lambda x: x["line"]),
                     "\n").alias("cleaned"),
    )).select(*[F.col(f"`{c}`") for c in docs.columns if c != "line_cleaning"], "line_cleaning")


def keep_clean_lines(docs: DataFrame, text_col: str, length_col: str) -> DataFrame:
    """The documents that are kept, with failed lines gone and their length counted anew."""
    found = where_once(measure_lines(docs, text_col), F.col("line_cleaning.kept"))
    text = F.col("line_cleaning.cleaned")
    return found.withColumns({
        text_col: text, length_col: F.length(text).cast(docs.schema[length_col].dataType),
    }).select(*docs.columns)
