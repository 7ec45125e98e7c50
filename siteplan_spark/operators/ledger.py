"""Dispositions: every row is either kept or excluded for one named reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.session import cut_lineage

INCLUDED = "included"


@dataclass(frozen=True)
class Rule:
    """An exclusion: rows for which ``predicate`` is true leave under ``reason``."""

    reason: str
    description: str
    predicate: Column


def _check_names(rules: Sequence[Rule]) -> None:
    names = [r.reason for r in rules]
    if len(set(names)) != len(names) or INCLUDED in names:
        raise ValueError(f"exclusion reasons must be distinct and not 'included': {names}")


def disposition(rules: Sequence[Rule]) -> Column:
    """First matching reason in declared order, else ``included``."""
    _check_names(rules)
    pick = reduce(
        lambda acc, r: acc.when(F.coalesce(r.predicate, F.lit(False)), F.lit(r.reason)),
        rules[1:],
        F.when(F.coalesce(rules[0].predicate, F.lit(False)), F.lit(rules[0].reason)))
    return pick.otherwise(INCLUDED)


def classify_first_match(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded); the excluded rows carry their ``reason``."""
    tagged = df.withColumn("reason", disposition(rules))
    return (tagged.where(F.col("reason") == INCLUDED).drop("reason"),
            tagged.where(F.col("reason") != INCLUDED))


def exclusion_ledger(df: DataFrame, rules: Sequence[Rule],
                     weight: str | Column | None = None,
                     by: Sequence[str] = ()) -> DataFrame:
    """Count (and weight) per disposition. Balanced by construction: one row, one reason."""
    w = F.lit(None).cast("double") if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight)
    aggs = [F.count(F.lit(1)).alias("n")]
    if weight is not None:
        aggs.append(F.sum("_w").alias("weight"))
    described = F.create_map(*[F.lit(x) for r in rules for x in (r.reason, r.description)])
    return (df.select(*by, disposition(rules).alias("reason"), w.alias("_w"))
            .groupBy(*by, "reason").agg(*aggs)
            .withColumn("description",
                        F.coalesce(F.try_element_at(described, F.col("reason")),
                                   F.lit("kept"))))


def is_balanced(ledger: DataFrame, retrieved: DataFrame) -> DataFrame:
    """One row: retrieved, included, excluded, balanced."""
    total = retrieved.agg(F.count(F.lit(1)).alias("retrieved"))
    parts = ledger.agg(
        F.coalesce(F.sum(F.when(F.col("reason") == INCLUDED, F.col("n"))), F.lit(0))
         .alias("included"),
        F.coalesce(F.sum(F.when(F.col("reason") != INCLUDED, F.col("n"))), F.lit(0))
         .alias("excluded"))
    return (total.join(parts)
            .withColumn("balanced",
                        F.col("retrieved") == F.col("included") + F.col("excluded")))


def merge_ledgers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Chain a second stage onto the survivors of the first.

    The second ledger must describe exactly the rows the first kept, and the stages may
    not share a reason; both are checked on the two small ledgers.
    """
    kept = first.where(F.col("reason") == INCLUDED).agg(F.sum("n")).first()[0] or 0
    seen = second.agg(F.sum("n")).first()[0] or 0
    if kept != seen:
        raise ValueError(f"second stage describes {seen} rows, the first kept {kept}")
    shared = (first.select("reason").intersect(second.select("reason"))
              .where(F.col("reason") != INCLUDED).count())
    if shared:
        raise ValueError("the two stages share an exclusion reason")
    return first.where(F.col("reason") != INCLUDED).unionByName(
        second, allowMissingColumns=True)


def latest_snapshot(df: DataFrame, flag: str, label: str) -> DataFrame:
    """Rows flagged latest; an error when the flag names no snapshot or several."""
    rows = df.where(F.lower(F.col(flag)) == "true")
    labels = rows.select(label).distinct().limit(2).collect()
    if len(labels) != 1:
        raise ValueError(f"{'no' if not labels else 'more than one'} snapshot flagged latest")
    return rows


def geography_resolution(df: DataFrame, area: str, jurisdiction: str, home: str,
                         valid_areas: DataFrame, weight: str | None = None) -> DataFrame:
    """Placed / unresolved / out-of-jurisdiction / unknown totals.

    An unknown jurisdiction is never assumed to be elsewhere: the accounting fails
    closed (``licenses_zero`` is false) while any such or unresolved record exists.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    valid = valid_areas.select(F.col(area)).distinct().withColumn("_valid", F.lit(True))
    place = F.trim(F.coalesce(F.col(jurisdiction).cast("string"), F.lit("")))
    kind = (F.when(place == "", "unknown_jurisdiction")
            .when(place != home, "out_of_jurisdiction")
            .when(F.coalesce("_valid", F.lit(False)), "placed")
            .otherwise("unresolved"))
    tagged = df.join(valid, area, "left").select(kind.alias("kind"), w.alias("_w"))
    parts = {k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("_w"))), F.lit(0)).alias(k)
             for k in ("placed", "unresolved", "out_of_jurisdiction", "unknown_jurisdiction")}
    return tagged.agg(F.sum("_w").alias("retrieved"), *parts.values()).withColumn(
        "licenses_zero",
        (F.col("unresolved") == 0) & (F.col("unknown_jurisdiction") == 0))


def flag_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep every row and say which ones repeat an earlier row.

    The first row of each key is found by a partial aggregate and joined back, so a
    key that holds a large part of the table is never sorted in one task. Identical rows
    are told apart by their place in a table that is written first, so exactly one row of
    a key is not a repeat.
    """
    rows = cut_lineage(df.withColumn("_place", F.monotonically_increasing_id()))
    mark = F.struct(*order, "_place")
    first = rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(
        F.min(mark).alias("_first"), F.count(F.lit(1)).alias("copies"))
    cond = reduce(lambda a, b: a & b,
                  [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(first, cond).select(
        *df.columns, "copies", (~mark.eqNullSafe(F.col("_first"))).alias("is_repeat"))
