"""What each filter of a chain removes, in every order, from relations of failing ids.

One table of failing keys is stored for each filter. What is left after some filters does not
depend on their order, so there are 2^n sets of filters instead of n! orders of n steps. The
documents left by a set are those left by the set without its last filter, minus (left anti join)
the keys that this filter fails; a filter removes the documents left before it that (left semi
join) are among its failing keys. Counts of a set and a filter then serve all orders in which the
filter comes right after that set.

Joins run on the key of a document, so no group is hot. Only documents that some filter fails
take part; the others survive everything and are counted once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.llm.common import cut_lineage

SPACE = r"[\x20\x09-\x0D]+"
KEY = ("_id", "_text")
COUNTS = ("removed", "good_lost", "toxic_lost")


def text_conditions(text: Column) -> dict[str, Column]:
    """The filters of a single text, by name: true where the text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n = F.size(words)
    return {"A": n < 200,
            "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
            "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
            "D": text.rlike("[#$%&*|]")}


def document_relations(docs: DataFrame, id_col: str, text_col: str, part_col: str,
                       labels: DataFrame, label_id: str, quality: str,
                       toxic: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(universe, failing keys of the filters A to E) of a table of documents.

    The universe has the key of each document (hashes of its id and its text), ``part``, ``n`` (how
    often the row occurs), ``good`` and ``toxic`` (0 or 1). A null text is empty, a null part the
    empty string. Rows equal in id, text and part are one document that counts ``n`` times. Filter
    E fails a text that a smaller id has too; null ids are larger than all others and fail only
    where some id has their text. A label holds where any label row of the id says so.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), text.alias("t"),
                       F.coalesce(F.col(part_col), F.lit("")).alias("part"))
    # two hashes with different seeds: 128 bits tell texts apart
    facts = cut_lineage(read.select(
        "id", "part", F.xxhash64("id", F.col("id").isNull()).alias("_id"),
        F.xxhash64("t").alias("_text"), F.xxhash64(F.lit(1), "t").alias("_more"),
        *[c.alias(name) for name, c in text_conditions(F.col("t")).items()]))
    marks = labels.groupBy(F.col(label_id).alias("id")).agg(
        F.max((F.col(quality) == 1).cast("long")).alias("good"),
        F.max((F.col(toxic) == 1).cast("long")).alias("toxic"))
    universe = (facts.groupBy("id", *KEY, "part").agg(F.count(F.lit(1)).alias("n"))
                .join(marks, "id", "left")
                .select(*KEY, "part", "n", F.coalesce("good", F.lit(0)).alias("good"),
                        F.coalesce("toxic", F.lit(0)).alias("toxic")))
    failing = {name: facts.where(name).select(*KEY) for name in "ABCD"}
    # copies collapse where they are read, so a text with many of them is one row a task
    first = facts.groupBy("_text", "_more").agg(F.min("id").alias("id")).select(
        F.xxhash64("id", F.col("id").isNull()).alias("_id"), "_text", "_more")
    failing["E"] = facts.select(*KEY, "_more").join(
        first, [*KEY, "_more"], "left_anti").select(*KEY)
    return universe, failing


def audit_filters(universe: DataFrame, failing: Mapping[str, DataFrame],
                  key: Sequence[str] = KEY) -> DataFrame:
    """One row for each part, order of the filters and step.

    Columns: part, filter_order (names joined), step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removals summed over all orders). ``universe`` has
    ``key``, part, n, good and toxic; a failing key that is not in it is ignored. Zeros are
    included; an empty universe gives no rows. Sets and orders grow fast: meant for few filters.
    """
    names, keys = list(failing), list(key)
    every = (1 << len(names)) - 1
    stored = [cut_lineage(failing[n].select(*keys).distinct()) for n in names]
    universe = cut_lineage(universe.select(*keys, "part", "n", "good", "toxic"))
    some = reduce(DataFrame.unionByName, stored).distinct()
    # each set follows from the one without its last filter, so one anti join serves all sets that
    # end in a filter; a stored union keeps the optimizer from joining its parts one by one
    left = cut_lineage(universe.join(some, keys, "left_semi").withColumn("left_by", F.lit(0)))
    for f in range(len(names)):
        left = cut_lineage(left.unionByName(
            left.join(stored[f], keys, "left_anti")
            .withColumn("left_by", F.col("left_by").bitwiseOR(1 << f))))
    kept = cut_lineage(left.groupBy("part", "left_by").agg(F.sum("n").alias("left")))
    taken = reduce(DataFrame.unionByName, [cut_lineage(
        left.where(F.col("left_by").bitwiseAND(1 << f) == 0).join(stored[f], keys, "left_semi")
        .groupBy("part", "left_by", F.lit(1 << f).alias("filter"))
        .agg(F.sum("n").alias("removed"), F.sum(F.col("n") * F.col("good")).alias("good_lost"),
             F.sum(F.col("n") * F.col("toxic")).alias("toxic_lost")))
        for f in range(len(names))])
    # the orders in which a filter follows exactly this set
    before = F.bit_count("left_by")
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(len(names) - 1 - k))
                                    for k in range(len(names))]), before + 1)
    others = F.lit(every).bitwiseXOR(F.col("filter"))
    by_filter = taken.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("left_by") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("left_by") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * orders.cast("long")).alias("shapley"))
    parts = universe.groupBy("part").agg(F.sum("n").alias("total"))
    # documents that fail nothing are left by every set
    sound = parts.join(kept.where("left_by = 0").select("part", F.col("left").alias("some")),
                       "part", "left").select(
        "part", (F.col("total") - F.coalesce("some", F.lit(0))).alias("sound"))
    # one text, since thousands of Column calls would take the driver longer than the joins
    steps = ", ".join(
        f"struct('{''.join(names[f] for f in order)}', {i + 1}, {1 << f}, "
        f"{sum(1 << x for x in order[:i])})"
        for order in permutations(range(len(names))) for i, f in enumerate(order))
    grid = sound.selectExpr("part", "sound", f"inline(array({steps})) AS (filter_order, step, "
                            "filter, left_by)")
    after = F.col("left_by").bitwiseOR(F.col("filter"))
    found = (grid.join(taken, ["part", "left_by", "filter"], "left")
             .join(by_filter, ["part", "filter"], "left").withColumn("after", after)
             .join(kept.select("part", F.col("left_by").alias("after"), "left"),
                   ["part", "after"], "left"))

    def whole(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long")

    return found.select(
        "part", "filter_order", "step", (F.col("sound") + whole("left")).alias("kept"),
        whole("removed").alias("removed"), (whole("fails") - whole("removed")).alias("redundant"),
        *[whole(c).alias(c) for c in ("unique_fails", "good_lost", "toxic_lost", "shapley")])
