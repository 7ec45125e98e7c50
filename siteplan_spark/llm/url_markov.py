"""URL filters by the likelihood ratio of two character models, in DataFrame functions only.

Smoothed variable-order Markov models of accepted and of rejected URLs give every character the
logarithm of the ratio of its two probabilities. Their sum over a URL, divided by its length, is
compared with a threshold calibrated on labelled URLs which the models have not seen.

Characters are folded to an alphabet of ``SYMBOLS`` symbols and contexts have three at most, so
there are never more than ``SYMBOLS`` ** 4 (about three million) different entries to score,
whatever the number of URLs: that is the proven bound of the table that is broadcast. URLs are
scored once for each distinct folded form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.llm.common import cut_lineage

ORDER = 3
#: a-z, one digit, ten marks, one symbol for everything else, start and end.
SYMBOLS = 40
#: Log ratios are kept in millionths and scores in hundredths, as whole numbers, so that
#: sums do not depend on the order of rows.
UNIT, STEP = 1_000_000, 10_000
#: Folded hosts whose MD5 starts with one of these digits are held out to place the threshold.
HELD_OUT = ("0", "1", "2")

#: Words in a host name that mark a URL as rejected for training.
REJECTED_HOSTS = "spam|pills|casino|viagra|porn|warez|adult|betting"

Rule = tuple[str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    def chosen(value: int) -> Column:
        ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
        return F.coalesce(*[F.when(fits(r[1]), F.lit(r[value])) for r in ordered],
                          F.lit(None).cast("string"))

    return chosen(1), chosen(0)


def folded(host: Column, path: Column) -> Column:
    """Start marks, the host and path in the small alphabet, end mark.

    The last label of the host is left out: rules name it, and models that learned from their
    verdicts would only repeat them.
    """
    named = F.concat(F.regexp_replace(host, r"[^.]*\z", ""), path)
    small = F.regexp_replace(F.lower(named), "[0-9]+", "0")
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(small, r"[^a-z0./_%=+:,;-]", "~"),
                    F.lit("$"))


def _grams(texts: DataFrame) -> DataFrame:
    """``texts`` with one row for each character after the start marks: gram of four."""
    return texts.select("*", F.explode(F.sequence(F.lit(1), F.length("folded") - ORDER))
                        .alias("_i")).withColumn(
        "gram", F.substring(F.col("folded"), F.col("_i"), F.lit(ORDER + 1))).drop("_i")


def log_ratios(grams: DataFrame, training: DataFrame) -> DataFrame:
    """(gram, units): log(P accepted / P rejected) of the last character after the others.

    Witten-Bell smoothing: a context with n characters of t kinds gives its own counts the
    weight n / (n + t) and the next shorter context the rest; an unseen context gives it all.
    ``training``: (folded, label, n) with label ``allow`` or ``block``.
    """
    counted = _grams(training).groupBy("label", "gram").agg(F.sum("n").alias("n"))
    orders = F.explode(F.sequence(F.lit(0), F.lit(ORDER)))
    gram = F.substring(F.col("gram"), ORDER + 1 - F.col("k"), F.col("k") + 1)
    # the tables of one corpus are bounded like its entries, so they are written and joined once
    seen = cut_lineage(counted.withColumn("k", orders).groupBy("label", "k", gram.alias("g")).agg(
        F.sum("n").cast("double").alias("n")))
    contexts = seen.groupBy("label", "k", F.substring(F.col("g"), F.lit(1), F.col("k")).alias("c")
                            ).agg(F.sum("n").alias("all"),
                                  F.count(F.lit(1)).cast("double").alias("kinds"))
    wanted = (grams.select("gram").distinct().withColumn("k", orders)
              .withColumn("label", F.explode(F.array(F.lit("allow"), F.lit("block"))))
              .withColumns({"g": gram, "c": F.substring(
                  F.col("gram"), ORDER + 1 - F.col("k"), F.col("k"))}))
    steps = (wanted.join(seen, ["label", "k", "g"], "left")
             .join(contexts, ["label", "k", "c"], "left").groupBy("gram", "label")
             .agg(F.sort_array(F.collect_list(F.struct("k", "n", "all", "kinds"))).alias("s")))
    p = F.aggregate("s", F.lit(1.0 / SYMBOLS), lambda p, x: F.when(x["all"].isNull(), p).otherwise(
        (F.coalesce(x["n"], F.lit(0.0)) + x["kinds"] * p) / (x["all"] + x["kinds"])))
    pairs = steps.select("gram", "label", F.ln(p).alias("log")).groupBy("gram").agg(
        (F.max(F.when(F.col("label") == "allow", F.col("log")))
         - F.max(F.when(F.col("label") == "block", F.col("log")))).alias("ratio"))
    return pairs.select("gram", F.round(F.col("ratio") * UNIT).cast("long").alias("units"))


def score_urls(forms: DataFrame, training: DataFrame) -> DataFrame:
    """(folded, score): mean log ratio of each form in hundredths, rounded down."""
    grams = _grams(forms.select("folded"))
    ratios = cut_lineage(log_ratios(grams, training))
    # at most SYMBOLS ** 4 rows, see the module's text
    return (grams.join(F.broadcast(ratios), "gram").groupBy("folded")
            .agg(F.floor(F.sum("units") / (F.count(F.lit(1)) * STEP)).alias("score")))


def threshold(scored: DataFrame) -> int | None:
    """The lowest score that is allowed, from rows (score, label, n).

    Of all scores up to zero, so that nothing is rejected that the accepted model finds
    likelier, it is the one with the highest sum of the shares of accepted at or above it and
    of rejected below it; the lower among equals. Null if a label is missing.
    """
    per = scored.groupBy(F.least("score", F.lit(0)).alias("score")).agg(
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("bad"))
    # scores are whole hundredths of a bounded logarithm: a few thousand rows at most
    rows = sorted((r["score"], r["good"], r["bad"]) for r in per.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return None
    best, below_good, below_bad = None, 0, 0
    for score, g, b in rows:
        value = (good - below_good) * bad + below_bad * good
        if best is None or value > best[0]:
            best = value, score
        below_good, below_bad = below_good + g, below_bad + b
    return best[1]


def filter_urls(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule],
                rejected_hosts: str = REJECTED_HOSTS) -> DataFrame:
    """(id, host, path, rule, verdict, score) of each page.

    Rules decide first. Labels for training are the rules' verdicts, and ``block`` for hosts
    with a rejected word that no rule decides. A URL without a rule is allowed if its score
    reaches the threshold; without held-out URLs of both kinds all such are allowed. Null and
    malformed URLs have an empty host and path and are scored like others. Repeated rows and
    null ids give a row each. Only the two named columns are read.
    """
    host, path = url_parts(F.col("url"))
    rows = (pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
            .withColumns({"host": host, "path": path}))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    label = F.coalesce("ruled", F.when(F.col("host").rlike(rejected_hosts), "block"))
    rows = (rows.withColumns({"rule": rule, "ruled": verdict,
                              "folded": folded(F.col("host"), F.col("path"))})
            .withColumn("label", label).drop("url"))
    forms = cut_lineage(rows.groupBy("folded", "label").agg(F.count(F.lit(1)).alias("n")))
    site = F.regexp_extract("folded", r"^[^/]*", 0)
    held = F.md5(site.cast("binary")).substr(1, 1).isin(*HELD_OUT)
    known = forms.where(F.col("label").isNotNull())
    scores = cut_lineage(score_urls(forms.select("folded").distinct(), known.where(~held)))
    limit = threshold(known.where(held).join(scores, "folded"))
    allowed = F.lit(True) if limit is None else F.col("score") >= limit
    return rows.join(scores, "folded").select(
        "id", "host", "path", "rule",
        F.coalesce("ruled", F.when(allowed, "allow").otherwise("block")).alias("verdict"),
        F.col("score").cast("long").alias("score"))
