"""From messy capacity observations to unit, site and area supply."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteplan_spark.functions.clean import is_zero_anomaly, valid_positive
from siteplan_spark.operators.quantiles import group_median
from siteplan_spark.session import cut_lineage

REPORTED, EMPIRICAL, DEFAULT, UNRESOLVED = (
    "reported", "empirical_fallback", "type_default", "unresolved")
# Weakest source wins (by rank), and what each source is worth.
SOURCE_RANK = {REPORTED: 0, EMPIRICAL: 1, DEFAULT: 2, UNRESOLVED: 3}
SOURCE_CONFIDENCE = {REPORTED: "high", EMPIRICAL: "medium", DEFAULT: "low",
                     UNRESOLVED: "none"}


def _lookup(mapping: dict, c: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[c]


def _label(keys: Sequence[str]) -> Column:
    return F.concat_ws("+", *[
        F.concat(F.lit(f"{k}="), F.coalesce(F.col(k).cast("string"), F.lit("")))
        for k in keys])


def empirical_medians(df: DataFrame, hierarchy: Sequence[Sequence[str]], value: str,
                      min_n: int = 30) -> DataFrame:
    """Median and sample size of the valid values, at every grouping of a hierarchy.

    One row per peer group: ``grouping``, ``peer_group``, the key columns (null where a
    key is not part of the grouping), ``sample_size``, ``median``, ``usable``.
    """
    keys = list(dict.fromkeys(k for level in hierarchy for k in level))
    valid = df.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys],
                      valid_positive(value).alias("_value")).where(F.col("_value").isNotNull())
    levels = F.array(*[
        F.struct(F.lit("|".join(level)).alias("grouping"),
                 *[(F.col(k) if k in level else F.lit(None).cast("string")).alias(f"_k_{k}")
                   for k in keys])
        for level in hierarchy])
    expanded = valid.select(F.inline(levels), "_value")
    medians = group_median(expanded, ["grouping", *[f"_k_{k}" for k in keys]], "_value")
    named = medians.select("grouping", *[F.col(f"_k_{k}").alias(k) for k in keys],
                           F.col("n").alias("sample_size"), "median")
    label = reduce(lambda acc, level: acc.when(
        F.col("grouping") == "|".join(level), _label(level)),
        hierarchy[1:], F.when(F.col("grouping") == "|".join(hierarchy[0]), _label(hierarchy[0])))
    return named.withColumns({"peer_group": label, "usable": F.col("sample_size") >= min_n})


def median_table(medians: DataFrame) -> DataFrame:
    """The report: largest sample first, then by label."""
    return medians.select("grouping", "peer_group", "sample_size",
                          F.round("median", 3).alias("median"), "usable") \
        .orderBy(F.desc("sample_size"), "peer_group")


def fallback_lookup(df: DataFrame, medians: DataFrame,
                    hierarchy: Sequence[Sequence[str]]) -> DataFrame:
    """Attach the most specific usable group: ``fallback_value``, ``fallback_group``.

    One left join per level; each right side has one row per peer group, so a hot
    peer group only ever repeats on the left.
    """
    out = df
    usable = medians.where("usable")
    for i, level in enumerate(hierarchy):
        side = usable.where(F.col("grouping") == "|".join(level)).select(
            *[F.col(k).alias(f"_j{i}_{k}") for k in level],
            F.col("median").alias(f"_m{i}"), F.col("peer_group").alias(f"_g{i}"))
        cond = reduce(lambda a, b: a & b, [
            F.coalesce(out[k].cast("string"), F.lit("")) == side[f"_j{i}_{k}"] for k in level])
        out = out.join(side, cond, "left").drop(*[f"_j{i}_{k}" for k in level])
    n = range(len(hierarchy))
    return out.withColumns({
        "fallback_value": F.coalesce(*[F.col(f"_m{i}") for i in n]),
        "fallback_group": F.coalesce(*[F.col(f"_g{i}") for i in n])}).drop(
            *[f"_m{i}" for i in n], *[f"_g{i}" for i in n])


def resolve_ladder(df: DataFrame, value: str, hierarchy: Sequence[Sequence[str]],
                   defaults: DataFrame, default_keys: Sequence[str], min_n: int = 30,
                   default_value: str = "default_value") -> DataFrame:
    """Reported, else empirical median, else documented default, else unresolved.

    Every row keeps how it was resolved and how far to trust it.
    """
    # one row per peer group, joined once per level: computed once
    medians = cut_lineage(empirical_medians(df, hierarchy, value, min_n))
    looked = fallback_lookup(df, medians, hierarchy)
    ref = defaults.select(*[F.col(k).alias(f"_d_{k}") for k in default_keys],
                          F.col(default_value).alias("_default"))
    cond = reduce(lambda a, b: a & b,
                  [looked[k] == ref[f"_d_{k}"] for k in default_keys])
    joined = looked.join(ref, cond, "left").drop(*[f"_d_{k}" for k in default_keys])
    reported = valid_positive(value)
    source = (F.when(reported.isNotNull(), REPORTED)
              .when(F.col("fallback_value").isNotNull(), EMPIRICAL)
              .when(F.col("_default").isNotNull(), DEFAULT).otherwise(UNRESOLVED))
    return joined.withColumns({
        "resolved": F.coalesce(reported, "fallback_value", "_default"),
        "source": source,
        "is_zero_anomaly": is_zero_anomaly(value)}).withColumns({
            "confidence": _lookup(SOURCE_CONFIDENCE, F.col("source")),
            "fallback_group": F.when(F.col("source") == EMPIRICAL, F.col("fallback_group"))}
        ).drop("fallback_value", "_default")


def ladder_tally(df: DataFrame, source: str = "source") -> DataFrame:
    """Rows and share per rung."""
    tally = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return tally.join(F.broadcast(total)).withColumn(
        "share", F.when(F.col("_total") > 0, F.col("n") / F.col("_total")).otherwise(0.0)
    ).drop("_total")


def unit_capacity(df: DataFrame, unit: Sequence[str], value: str, count: str, ports: str,
                  source: str, level: str, connector: str, keep: Sequence[str] = (),
                  unit_max: str | None = None) -> DataFrame:
    """Capacity per unit: the maximum over alternatives, never their sum.

    A unit-level reported maximum goes first; a unit with several ports stays
    unresolved because nothing says which connector serves which port.
    """
    present = F.coalesce(F.col(count), F.lit(0)) > 0
    rank = _lookup(SOURCE_RANK, F.col(source))
    # (unit, connector) first: both the standards and the per-standard maximum come
    # out of a map-side combine
    per = (df.groupBy(*unit, connector)
           .agg(F.max(F.when(present, F.col(value))).alias("_v"),
                F.max(F.when(present, rank)).alias("_rank"),
                F.max(F.when(present, 1).otherwise(0)).alias("_present"),
                F.max(ports).alias("_ports"), F.min(level).alias("_level"),
                F.max(unit_max if unit_max else F.lit(None).cast("double")).alias("_um"),
                *[F.min(k).alias(k) for k in keep]))
    agg = per.groupBy(*unit).agg(
        F.max("_v").alias("_max"), F.max("_rank").alias("_worst"),
        F.sum("_present").alias("_standards"), F.max("_ports").alias("ports"),
        F.min("_level").alias("level"), F.max("_um").alias("_um"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("_v").isNotNull(), F.struct(connector, "_v"))))).alias("compatible"),
        *[F.min(k).alias(k) for k in keep])
    has_max = F.coalesce(F.col("_um") > 0, F.lit(False))
    by_rank = {v: k for k, v in SOURCE_RANK.items()}
    worst = _lookup(by_rank, F.coalesce(F.col("_worst"), F.lit(SOURCE_RANK[UNRESOLVED])))
    return agg.select(
        *unit, *keep, "level", "ports",
        F.when(has_max, F.col("_um")).when(F.col("ports") > 1, F.lit(None))
         .otherwise(F.col("_max")).alias("capacity"),
        F.when(has_max, "unit_reported_maximum")
         .when(F.col("ports") > 1, "multi_port_unresolved")
         .when(F.col("_max").isNotNull(), "single_port_connector_maximum")
         .otherwise("unresolved").alias("basis"),
        F.when(has_max, REPORTED).otherwise(worst).alias("source"),
        F.col("_standards").cast("int").alias("standards"),
        ((F.col("_standards") > 1) & (F.col("ports") == 1)).alias("is_multi_connector"),
        "compatible").withColumn("confidence", _lookup(SOURCE_CONFIDENCE, F.col("source")))


def site_capacity(df: DataFrame, site: str, public: str) -> DataFrame:
    """Sum over a site's units, with the public operational subset kept apart."""
    cap = F.coalesce(F.col("capacity"), F.lit(0.0))
    pub = F.col(public)
    z = lambda cond, x: F.sum(F.when(cond, x).otherwise(0))
    return df.groupBy(site).agg(
        F.count(F.lit(1)).alias("unit_count"), F.sum("ports").alias("ports"),
        F.sum(cap).alias("capacity"),
        z(F.col("capacity").isNull(), F.lit(1)).alias("units_unresolved"),
        F.sum(F.when(F.col("source") == REPORTED, cap).otherwise(0.0)).alias("_reported"),
        z(pub, F.lit(1)).alias("public_units"), z(pub, F.col("ports")).alias("public_ports"),
        F.sum(F.when(pub, cap).otherwise(0.0)).alias("public_capacity"),
    ).withColumn("reported_capacity_share",
                 F.when(F.col("capacity") > 0, F.col("_reported") / F.col("capacity"))
                 .otherwise(0.0)).drop("_reported")


def ports_by_level(df: DataFrame, site: str, public: str) -> DataFrame:
    """site -> map(level -> ports), all units and the public subset."""
    per = df.groupBy(site, "level").agg(
        F.sum("ports").alias("_p"),
        F.sum(F.when(F.col(public), F.col("ports")).otherwise(0)).alias("_pp"),
        F.max(F.col(public).cast("int")).alias("_any"))
    return per.groupBy(site).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "_p"))))
         .alias("ports_by_level"),
        F.map_from_entries(F.array_sort(F.collect_list(
            F.when(F.col("_any") == 1, F.struct("level", "_pp"))))).alias("public_ports_by_level"))


def compatible_by_standard(df: DataFrame, site: str, public: str) -> DataFrame:
    """Capacity a vehicle of each standard could use; overlapping, so never summed up."""
    flat = df.select(site, public, F.explode("compatible").alias("standard", "_v"))
    return flat.groupBy(site, "standard").agg(
        F.sum("_v").alias("compatible_capacity"),
        F.sum(F.when(F.col(public), F.col("_v")).otherwise(0.0)).alias("public_compatible_capacity"))


def qualifying_sites(df: DataFrame, ports_map: str, levels: Sequence[str]) -> DataFrame:
    """Sites with at least one public port at one of the levels."""
    has = reduce(lambda a, b: a | b, [
        F.coalesce(F.try_element_at(F.col(ports_map), F.lit(x)), F.lit(0)) > 0 for x in levels])
    return df.where(has)


def site_rollup(sites: DataFrame, stations: DataFrame, unit_counts: DataFrame, site: str,
                station: str, network: str, public: str) -> DataFrame:
    """Stations and networks per site, joined to units counted per station beforehand.

    ``unit_counts(station, unit_count, public_unit_count)`` is already one row per
    station, so joining it cannot multiply station rows.
    """
    joined = stations.join(sites, station).join(unit_counts, station, "left")
    return joined.groupBy(site).agg(
        F.countDistinct(station).alias("station_count"),
        F.countDistinct(network).alias("network_count"),
        F.sum(F.when(F.col(public), 1).otherwise(0)).alias("public_stations"),
        F.coalesce(F.sum("unit_count"), F.lit(0)).alias("unit_count"),
        F.coalesce(F.sum("public_unit_count"), F.lit(0)).alias("public_unit_count"))


def supply_by_area(df: DataFrame, area: str, station: str, level: str, ports: str,
                   households: DataFrame | None = None) -> DataFrame:
    """Ports by level and distinct stations per area; rates per 1,000 households."""
    # one row per (area, level, station) first, so the distinct count is a plain sum
    per = df.groupBy(area, level, station).agg(F.sum(ports).alias("_p"))
    ported = per.groupBy(area, level).agg(F.sum("_p").alias("ports"),
                                          F.count(F.lit(1)).alias("stations_at_level"))
    if households is None:
        return ported
    return ported.join(households.select(area, "households"), area).withColumn(
        "ports_per_1k", F.when(F.col("households") > 0,
                               F.col("ports") * 1000.0 / F.col("households")).otherwise(0.0))


def station_capacity(units: DataFrame, station: str) -> DataFrame:
    """Capacity per station; an unresolved unit adds nothing."""
    return units.groupBy(station).agg(
        F.sum(F.coalesce("capacity", F.lit(0.0))).alias("capacity"),
        F.count(F.lit(1)).alias("units"))


def reconcile_counts(parents: DataFrame, children: DataFrame, key: str,
                     reported: Sequence[str], legacy: Column) -> DataFrame:
    """Child row count against the reported total, as a named class per parent."""
    counts = children.groupBy(key).agg(
        F.count(F.lit(1)).alias("child_rows"),
        F.max(F.when(legacy, 1).otherwise(0)).alias("_legacy"))
    joined = parents.join(counts, key, "left").withColumns({
        "child_rows": F.coalesce("child_rows", F.lit(0)),
        "_legacy": F.coalesce("_legacy", F.lit(0))})
    all_null = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in reported])
    total = F.when(~all_null, reduce(lambda a, b: a + b, [
        F.coalesce(F.col(c), F.lit(0)) for c in reported]))
    return joined.withColumn("reported_total", total).withColumn(
        "class",
        F.when(F.col("reported_total") == F.col("child_rows"), "reconciles")
        .when(F.col("child_rows") == 0, "no_unit_records")
        .when(F.col("reported_total").isNull(), "missing_station_aggregate")
        .when(F.col("_legacy") == 1, "legacy_charging_level")
        .otherwise("upstream_count_mismatch")).drop("_legacy")


def reconciliation_tally(df: DataFrame) -> DataFrame:
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return df.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(
        F.broadcast(total)).withColumn("rate", F.round(F.col("n") / F.col("_t"), 6)).drop("_t")
