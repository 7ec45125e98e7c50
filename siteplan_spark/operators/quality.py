"""Data-quality gates as aggregates over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteplan_spark.functions.clean import is_missing
from siteplan_spark.session import cut_lineage


def table_fingerprint(df: DataFrame, volatile: Sequence[str] = (),
                      vintages: Mapping[str, str] | None = None) -> DataFrame:
    """Order-independent content hash: (rows, fingerprint).

    Each row is hashed on the executors; the hashes are summed as decimals, so repeated
    rows count, and the sum is combined with the sorted column names and the vintages.
    """
    names = sorted(c for c in df.columns if c not in set(volatile))
    text = F.concat_ws("\u0001", *[
        F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in names])
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    part2 = F.conv(F.substring(F.sha2(text, 256), 16, 15), 16, 10).cast("decimal(38,0)")
    header = ",".join(names) + "|" + ",".join(
        f"{k}={v}" for k, v in sorted((vintages or {}).items()))
    return (df.agg(F.count(F.lit(1)).alias("rows"), F.sum(part).alias("a"),
                   F.sum(part2).alias("b"))
            .select("rows", F.sha2(F.concat_ws(
                "|", F.lit(header), F.col("rows"), F.coalesce(F.col("a").cast("string"), F.lit("")),
                F.coalesce(F.col("b").cast("string"), F.lit(""))), 256).alias("fingerprint")))


@dataclass(frozen=True)
class Constraints:
    """What a published table promises."""

    columns: Sequence[str] = ()
    not_null: Sequence[str] = ()
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None
    enums: Mapping[str, Sequence[str]] | None = None
    unique: Sequence[Sequence[str]] = ()
    strict: bool = False


def validate_table(df: DataFrame, rules: Constraints) -> DataFrame:
    """Every violated rule with its row count; all failures are reported, not the first.

    Row rules are one aggregate over one scan. Each uniqueness rule adds one grouping.
    """
    found = set(df.columns)
    checks: list[tuple[str, Column]] = []
    schema_faults = [f"missing:{c}" for c in rules.columns if c not in found]
    if rules.strict:
        schema_faults += [f"unexpected:{c}" for c in sorted(found - set(rules.columns))]
    for c in rules.not_null:
        if c in found:
            checks.append((f"null:{c}", F.col(c).isNull()))
    for c, (low, high) in (rules.ranges or {}).items():
        if c in found:
            bad = F.lit(False)
            if low is not None:
                bad = bad | (F.col(c) < low)
            if high is not None:
                bad = bad | (F.col(c) > high)
            checks.append((f"range:{c}", bad))
    for c, allowed in (rules.enums or {}).items():
        if c in found:
            checks.append((f"enum:{c}", ~F.col(c).isin(*allowed)))
    parts: list[DataFrame] = []
    if checks:
        counted = df.agg(*[F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(f"_{i}")
                           for i, (_, cond) in enumerate(checks)])
        parts.append(counted.select(F.inline(F.array(*[
            F.struct(F.lit(name).alias("rule"),
                     F.coalesce(F.col(f"_{i}"), F.lit(0).cast("bigint")).alias("violations"))
            for i, (name, _) in enumerate(checks)]))))
    for keys in rules.unique:
        # counted as keys seen more than once, after a map-side partial count
        parts.append(
            df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("violations"))
            .select(F.lit("unique:" + "+".join(keys)).alias("rule"), "violations"))
    if schema_faults:
        parts.append(df.sparkSession.createDataFrame(
            [(f, 1) for f in schema_faults], "rule string, violations bigint"))
    return reduce(DataFrame.unionByName, parts).where(F.col("violations") > 0)


def assert_valid(df: DataFrame, rules: Constraints) -> None:
    faults = validate_table(df, rules).orderBy("rule").collect()
    if faults:
        raise ValueError("; ".join(f"{r['rule']} ({r['violations']})" for r in faults))


def lossless_check(staged: DataFrame, source_rows: int | DataFrame) -> DataFrame:
    """rows in, rows out, lossless; and the staged column names must not repeat."""
    if len(set(staged.columns)) != len(staged.columns):
        raise ValueError("duplicate column names in a staged table")
    out = staged.agg(F.count(F.lit(1)).alias("rows_out"))
    rows_in = (F.lit(source_rows).alias("rows_in") if isinstance(source_rows, int) else None)
    if rows_in is not None:
        both = out.select(rows_in, "rows_out")
    else:
        both = source_rows.agg(F.count(F.lit(1)).alias("rows_in")).join(out)
    return both.withColumn("lossless", F.col("rows_in") == F.col("rows_out"))


def schema_hash(columns: Sequence[str]) -> Column:
    """Order-sensitive hash of the field names."""
    return F.sha2(F.to_json(F.array(*[F.lit(c) for c in columns])), 256)


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per field: rows, missing, missing share, distinct-name hash. One scan."""
    names = list(columns or df.columns)
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.sum(F.when(is_missing(c), 1).otherwise(0)).alias(f"_{i}")
        for i, c in enumerate(names)])
    return counted.select(F.col("_rows").alias("rows"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"),
                 F.coalesce(F.col(f"_{i}"), F.lit(0)).cast("bigint").alias("missing"))
        for i, c in enumerate(names)]))) \
        .withColumn("missing_share", F.when(F.col("rows") > 0, F.col("missing") / F.col("rows"))
                    .otherwise(0.0)) \
        .withColumn("schema_hash", schema_hash(names))


def drift_report(profile_rows: DataFrame, expected_low: int, expected_high: int,
                 tolerance: float, expected_hash: str, observed_hash: Column) -> DataFrame:
    """``profile_rows(rows)`` against the tolerance band, plus a schema-changed flag."""
    low, high = int(expected_low * (1 - tolerance)), int(expected_high * (1 + tolerance))
    return profile_rows.select(
        "rows", F.lit(low).alias("low"), F.lit(high).alias("high"),
        F.col("rows").between(low, high).alias("in_tolerance"),
        (observed_hash != expected_hash).alias("schema_changed"))


def conditional_coverage(df: DataFrame, measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Share of a measure reported *given the thing exists*, by rows and by weight.

    ``measures``: name to (count column, value column). One scan; no reshaping shuffle.
    """
    aggs = []
    for i, (n, v) in enumerate(measures.values()):
        present = F.coalesce(F.col(n), F.lit(0)) > 0
        reported = present & (F.coalesce(F.col(v).try_cast("double"), F.lit(0.0)) > 0)
        aggs += [F.sum(F.when(present, 1).otherwise(0)).cast("bigint").alias(f"p{i}"),
                 F.sum(F.when(reported, 1).otherwise(0)).cast("bigint").alias(f"r{i}"),
                 F.sum(F.when(present, F.col(n)).otherwise(0)).cast("bigint").alias(f"wp{i}"),
                 F.sum(F.when(reported, F.col(n)).otherwise(0)).cast("bigint").alias(f"wr{i}")]
    rows = F.array(*[F.struct(
        F.lit(name).alias("measure"), F.col(f"p{i}").alias("present"),
        F.col(f"r{i}").alias("reported"), F.col(f"wp{i}").alias("weight_present"),
        F.col(f"wr{i}").alias("weight_reported")) for i, name in enumerate(measures)])
    return df.agg(*aggs).select(F.inline(rows)).withColumns({
        "row_coverage": F.when(F.col("present") > 0, F.col("reported") / F.col("present")),
        "weight_coverage": F.when(F.col("weight_present") > 0,
                                  F.col("weight_reported") / F.col("weight_present"))})


def duplicate_profile(df: DataFrame, columns: Sequence[str],
                      by: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct rows, rows in duplicate groups, redundant rows, largest group."""
    keys = [*by, *[c for c in columns if c not in by]]
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return groups.groupBy(*by).agg(
        F.sum("_n").cast("bigint").alias("rows"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).cast("bigint")
         .alias("rows_in_duplicate_groups"),
        F.sum(F.col("_n") - 1).cast("bigint").alias("redundant_rows"),
        F.max("_n").alias("largest_group"))


# Header fragments that would indicate a per-unit identifier, and the
# columns whose names look like one but are known not to be.
IDENTIFIER_HINTS = ("unit_id", "unitid", "evse_id", "evseid", "port_id", "portid",
                    "serial", "uuid", "guid", "connector_id", "connectorid")
KNOWN_NON_UNIT_IDS = ("ID", "Federal Agency ID", "NPS Unit Name")


def identifiability_report(df: DataFrame, columns: Sequence[str],
                           by: Sequence[str] = ()) -> DataFrame:
    """Can rows be told apart? Header hints plus the duplicate profile, as decisions."""
    hints = [c for c in df.columns if c not in KNOWN_NON_UNIT_IDS
             and any(h in c.lower() for h in IDENTIFIER_HINTS)]
    return duplicate_profile(df, columns, by).withColumns({
        "identifier_columns": F.lit(",".join(sorted(hints))),
        "has_identifier": F.lit(bool(hints)),
        "rows_are_distinct": F.col("redundant_rows") == 0,
        "dedup_is_safe": F.lit(bool(hints)) | (F.col("redundant_rows") == 0)})


def count_drift(df: DataFrame, count: str, expected: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Monitor (not enforce) that a count column equals its usual value."""
    c = F.col(count)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(c == expected, 1).otherwise(0)).cast("bigint").alias("as_expected"),
        F.sum(F.when(c > expected, 1).otherwise(0)).cast("bigint").alias("above"),
        F.sum(F.when((c < expected) | c.isNull(), 1).otherwise(0)).cast("bigint").alias("below"))


def conservation_error(before: DataFrame, after: DataFrame, unallocated: DataFrame,
                       value: str, by: Sequence[str] = ()) -> DataFrame:
    """|in - out - unallocated|, overall or per group.

    Rounding errors of a plain sum grow with the rows and look like lost mass. Each value is therefore
    split at one power of two for all tables: sums of the multiples of it are exact, and what is below
    is too small for the order of its additions to matter.
    """
    names = ("mass_in", "mass_out", "mass_unallocated")
    rows = cut_lineage(reduce(DataFrame.unionByName, [
        df.select(*by, F.col(value).cast("double").alias("_v"), F.lit(name).alias("_part"))
        for df, name in zip((before, after, unallocated), names)]))
    # all values together are below 2^51 units
    scale = rows.agg(F.sum(F.abs("_v")).alias("_all")).select(
        F.when((F.col("_all") > 1e-280) & (F.col("_all") < float("inf")), F.pow(
            F.lit(2.0), F.ceil(F.log2("_all")) - 50)).alias("_unit"))
    split = rows.join(F.broadcast(scale)).withColumn(
        "_high", F.coalesce(F.rint(F.col("_v") / F.col("_unit")) * F.col("_unit"), "_v"))
    z = lambda name, v: F.coalesce(
        F.sum(F.when(F.col("_part") == name, v)), F.lit(0.0))
    sums = split.groupBy(*by).agg(
        *[z(n, F.col("_high")).alias(f"_h_{n}") for n in names],
        *[z(n, F.when(F.col("_unit").isNotNull(), F.col("_v") - F.col("_high"))).alias(f"_l_{n}")
          for n in names])
    left = [F.col(f"_{k}_mass_in") - F.col(f"_{k}_mass_out") - F.col(f"_{k}_mass_unallocated")
            for k in "hl"]
    return sums.select(*by, *[(F.col(f"_h_{n}") + F.col(f"_l_{n}")).alias(n) for n in names],
                       F.abs(left[0] + left[1]).alias("error"))


def registration_checks(counts: DataFrame, key: str, count: str, expected: DataFrame,
                        published_total: int | None, vintage: str | None,
                        total_labels: Sequence[str] = ("United States", "Total")) -> DataFrame:
    """The release properties of a count table, as one row of named outcomes."""
    stray = F.col(key).isin(*total_labels)
    body = counts.where(~stray)
    summary = counts.agg(
        F.sum(F.when(~stray, 1).otherwise(0)).cast("bigint").alias("areas_present"),
        F.sum(F.when(stray, 1).otherwise(0)).cast("bigint").alias("stray_total_rows"),
        F.sum(F.when(~stray & (F.col(count) < 0), 1).otherwise(0)).cast("bigint")
         .alias("negative_areas"),
        F.sum(F.when(~stray, F.col(count))).cast("bigint").alias("sum_of_areas"))
    missing = (expected.select(key).distinct().join(body.select(key), key, "left_anti")
               .agg(F.count(F.lit(1)).alias("missing_areas")))
    return summary.join(missing).withColumns({
        "vintage_resolved": F.lit(bool(vintage)),
        "coverage_complete": (F.col("missing_areas") == 0) & (F.col("stray_total_rows") == 0),
        "all_non_negative": F.col("negative_areas") == 0,
        "total_reconciles": F.lit(None).cast("boolean") if published_total is None
        else F.col("sum_of_areas") == published_total})


def assign_confidence(defects: str, flags: str) -> Column:
    """Low only on corroborated defects; review flags alone never lower it."""
    del flags  # carried for a reviewer, never a reason on its own
    return F.when(F.col(defects) > 0, "low_confidence").otherwise("ok")


def assert_no_leakage(vintages: DataFrame, cutoff: str, feature: str = "feature",
                      released: str = "released", period_end: str = "period_end") -> None:
    """Every feature must have been released by the cutoff; names all offenders."""
    late = leakage(vintages, cutoff, released, period_end).orderBy(feature).collect()
    if late:
        raise ValueError("not available at the cutoff: " + ", ".join(r[feature] for r in late))


def leakage(vintages: DataFrame, cutoff: str, released: str = "released",
            period_end: str = "period_end") -> DataFrame:
    day = F.to_date(F.lit(cutoff))
    return vintages.where(F.col(released).isNull() | (F.col(released) > day)
                          | (F.col(period_end) > day))


def assert_inputs_allowed(spark: SparkSession, expressions: Mapping[str, Column],
                          allowed: Sequence[str]) -> None:
    """Analyse each expression against a frame that has only the allowed columns."""
    empty = spark.createDataFrame([], ", ".join(f"`{c}` double" for c in allowed))
    refused = []
    for name, expression in expressions.items():
        try:
            empty.select(expression).schema  # noqa: B018 - analysis is the check
        except Exception:  # noqa: BLE001 - any analysis failure is a refusal
            refused.append(name)
    if refused:
        raise ValueError(f"expressions read columns outside the allow-list: {refused}")


# Categorical columns a published table may not carry.
BANNED_COLUMNS = ("urban", "rural", "urbanicity", "urban_rural", "is_urban", "is_rural",
                  "urban_class", "rural_class")


def assert_no_banned_columns(df: DataFrame, banned: Sequence[str] = BANNED_COLUMNS) -> None:
    found = sorted(c for c in df.columns if c.lower() in set(banned))
    if found:
        raise ValueError(f"banned columns present: {found}")


def provenance_violations(df: DataFrame, share_maps: Sequence[str],
                          components: Sequence[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows whose share maps are empty or do not sum to one, or lack a component."""
    checks = []
    for m in share_maps:
        total = F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x)
        checks += [(f"empty:{m}", F.coalesce(F.size(m), F.lit(0)) <= 0),
                   (f"sum:{m}", (F.size(m) > 0) & (F.abs(total - 1.0) > tolerance))]
    checks += [(f"missing:{c}", F.col(c).isNull()) for c in components]
    counted = df.agg(*[F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(f"_{i}")
                       for i, (_, cond) in enumerate(checks)])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations"))
        for i, (n, _) in enumerate(checks)])))


def ladder_order_check(df: DataFrame, position: str, value: str) -> DataFrame:
    """Is a measured value monotone in the declared order? For a handful of rungs."""
    from pyspark.sql import Window as W
    # the ladder has one row per declared rung, so one ordered task is enough
    w = W.orderBy(position)
    return df.withColumns({"previous": F.lag(value).over(w)}).withColumn(
        "in_order", F.col("previous").isNull() | (F.col(value) >= F.col("previous")))
