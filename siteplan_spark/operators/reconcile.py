"""Making estimates agree exactly with the totals they claim to sum to."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteplan_spark.operators.ledger import Rule, disposition
from siteplan_spark.operators.ranking import carry_known
from siteplan_spark.session import cut_lineage

TOLERANCE = 1e-6


def proportional_scale(df: DataFrame, group: str, value: str, totals: DataFrame,
                       total: str = "total", on_zero: str = "equal",
                       share: str | None = None, out: str = "reconciled") -> DataFrame:
    """value x total / group sum.

    A zero-sum group is spread evenly, or by ``share`` (the exposure fallback). A group
    without a known total keeps its raw values and ``is_constrained`` false.
    """
    if on_zero == "share" and not share:
        raise ValueError("the share policy needs a share column")
    sums = df.groupBy(group).agg(
        F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"),
        *([F.sum(share).alias("_x")] if share else []))
    known = sums.join(totals.select(group, F.col(total).cast("double").alias("_t")), group,
                      "left")
    spread = F.col("_t") / F.col("_n")
    if on_zero == "share":
        spread = F.when(F.col("_x") > 0, F.col("_t") * F.col(share) / F.col("_x")).otherwise(
            spread)
    joined = df.join(known, group, "left")
    scaled = (F.when(F.col("_t").isNull(), F.col(value))
              .when(F.col("_s") > 0, F.col(value) * (F.col("_t") / F.col("_s")))
              .otherwise(spread))
    return joined.withColumns({out: scaled, "is_constrained": F.col("_t").isNotNull()}).drop(
        "_s", "_n", "_t", "_x")


def constraint_residuals(df: DataFrame, group: str, value: str, totals: DataFrame,
                         total: str = "total") -> DataFrame:
    """|achieved - total| for every constraint, including one that binds no row."""
    got = df.groupBy(group).agg(F.sum(value).alias("achieved"))
    return totals.select(group, F.col(total).cast("double").alias("total")).join(
        got, group, "left").withColumn(
        "residual", F.abs(F.coalesce("achieved", F.lit(0.0)) - F.col("total")))


def assert_constraints(df: DataFrame, group: str, value: str, totals: DataFrame,
                       total: str = "total", tolerance: float = TOLERANCE) -> None:
    """Raise with the worst offender unless every constraint holds."""
    worst = constraint_residuals(df, group, value, totals, total).orderBy(
        F.desc("residual"), group).first()
    if worst is not None and worst["residual"] > tolerance:
        raise ValueError(f"constraint {worst[group]!r} is off by {worst['residual']:.6g}")


def validate_constraints(totals: DataFrame, members: DataFrame, group: str,
                         total: str = "total") -> DataFrame:
    """Constraints that can never hold: a negative total, or one that binds no rows."""
    bound = members.select(group).distinct().withColumn("_m", F.lit(True))
    return totals.join(bound, group, "left").select(
        group, F.when(F.col(total) < 0, "negative_total")
        .when(F.col("_m").isNull(), "binds_no_rows").alias("fault")).where(
        F.col("fault").isNotNull())


def ipf(df: DataFrame, value: str, constraints: Sequence[tuple[str, DataFrame]],
        total: str = "total", max_iter: int = 200, tol: float = TOLERANCE,
        out: str = "reconciled") -> tuple[DataFrame, int, float]:
    """Raking over overlapping constraints: (rows, rounds, worst residual).

    Raking only ever multiplies whole groups, so the rows stay untouched: the rounds run
    on the cross-classified sums and update one small multiplier table per dimension,
    checkpointed each time. Only the worst residual reaches the driver.
    """
    dims = [g for g, _ in constraints]
    totals = {g: cut_lineage(t.select(g, F.col(total).cast("double").alias("_t")))
              for g, t in constraints}
    rows = df.withColumn("_v", F.col(value).cast("double"))
    for g in dims:  # a group that starts at zero is seeded flat
        seed = rows.groupBy(g).agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_n")).join(
            totals[g], g).where("_s <= 0 AND _t > 0").select(
            g, (F.col("_t") / F.col("_n")).alias("_seed"))
        rows = rows.join(seed, g, "left").withColumn("_v", F.coalesce("_seed", "_v")).drop(
            "_seed")
    rows = cut_lineage(rows)
    cells = cut_lineage(rows.groupBy(*dims).agg(F.sum("_v").alias("_v")))
    factor = {g: totals[g].select(g, F.lit(1.0).alias(f"_k_{g}")) for g in dims}

    def scaled(base: DataFrame) -> DataFrame:
        for g in dims:
            base = base.join(factor[g], g, "left").withColumn(
                "_v", F.col("_v") * F.coalesce(f"_k_{g}", F.lit(1.0))).drop(f"_k_{g}")
        return base

    def worst() -> float:
        now = scaled(cells)
        parts = [now.groupBy(g).agg(F.sum("_v").alias("_s")).join(totals[g], g).agg(
            F.max(F.abs(F.col("_s") - F.col("_t"))).alias("r")) for g in dims]
        return float(reduce(DataFrame.unionByName, parts).agg(F.max("r")).first()[0] or 0.0)

    rounds, residual = 0, worst()
    while rounds < max_iter and residual > tol:
        for g in dims:
            got = scaled(cells).groupBy(g).agg(F.sum("_v").alias("_s"))
            factor[g] = cut_lineage(
                totals[g].join(got, g).join(factor[g], g).select(g, (
                    F.col(f"_k_{g}") * F.when(F.col("_s") > 0, F.col("_t") / F.col("_s"))
                    .otherwise(1.0)).alias(f"_k_{g}")))
        rounds += 1
        residual = worst()
    return scaled(rows).withColumnRenamed("_v", out), rounds, residual


# --- which total is authoritative -------------------------------------------------------

# Constraint sources in precedence order.
NATIVE, COUNTY, STATE = ("native_tract_registry", "county_observation",
                         "state_registration_total")


def resolve_precedence(candidates: DataFrame, jurisdiction: str,
                       source: str = "source") -> DataFrame:
    """One authority per jurisdiction; every displaced candidate is kept as superseded.

    ``candidates(jurisdiction, source, total, is_complete, licenses_zero,
    coverage_complete)``. A native source wins only if it is complete and licensed to
    read absence as zero; counties only if they cover the jurisdiction; else the external
    total.
    """
    s = F.col(source)
    qualifies = (F.when(s == NATIVE, F.col("is_complete") & F.col("licenses_zero"))
                 .when(s == COUNTY, F.col("coverage_complete"))
                 .otherwise(F.lit(True)))
    rank = F.when(s == NATIVE, 0).when(s == COUNTY, 1).otherwise(2)
    tagged = candidates.withColumns({
        "_q": F.coalesce(qualifies, F.lit(False)), "_r": rank})
    # at most three candidates per jurisdiction
    best = tagged.where("_q").groupBy(jurisdiction).agg(F.min("_r").alias("_best"))
    out = tagged.join(best, jurisdiction, "left")
    status = (F.when(F.col("_r") == F.col("_best"), "operative")
              .when(F.col("_q"), "superseded")
              .when(F.col("_best").isNull(), "unconstrained").otherwise("not_qualified"))
    return out.withColumn("status", status).drop("_q", "_r", "_best")


def coverage_complete(observed: DataFrame, reference: DataFrame, group: str,
                      member: str) -> DataFrame:
    """Per group: does the observed set hold every reference member?"""
    seen = observed.select(group, member).distinct().withColumn("_o", F.lit(1))
    return (reference.select(group, member).distinct().join(seen, [group, member], "left")
            .groupBy(group).agg(F.count(F.lit(1)).alias("expected"),
                                F.sum(F.coalesce("_o", F.lit(0))).alias("seen"))
            .withColumn("is_complete", F.col("expected") == F.col("seen")))


def constraint_plan(rows: DataFrame, area: str, county: str, state: str, native: DataFrame,
                    native_states: DataFrame, county_totals: DataFrame,
                    state_totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bind each area to exactly one constraint: (rows with ``constraint``, totals).

    ``native(area, observed)`` binds its own areas in the states whose operative source is
    native (``native_states``); areas there that the registry does not name are completed
    zeros. Elsewhere ``county_totals(county, state, total)`` bind the observed counties,
    and the rest takes ``state_totals(state, total)`` less what the counties claimed. A
    negative residual is kept as such and reported by ``negative_residuals``.
    """
    nat = native.select(area, F.col("observed").alias("_native"))
    nat_states = native_states.select(state).distinct().withColumn("_ns", F.lit(True))
    cty = county_totals.select(county, F.col("total").alias("_ct"))
    claimed = county_totals.groupBy(state).agg(F.sum("total").alias("_claimed"))
    st = state_totals.select(state, F.col("total").alias("_st")).join(
        claimed, state, "left")
    bound = (rows.join(nat, area, "left").join(nat_states, state, "left")
             .join(cty, county, "left").join(st, state, "left"))
    is_native = F.coalesce("_ns", F.lit(False))
    text = lambda c: F.col(c).cast("string")
    named = bound.withColumns({
        "constraint": F.when(is_native & F.col("_native").isNotNull(),
                             F.concat(F.lit("tract:"), text(area)))
        .when(is_native, F.concat(F.lit("zero:"), text(state)))
        .when(F.col("_ct").isNotNull(), F.concat(F.lit("county:"), text(county)))
        .when(F.col("_st").isNotNull(), F.concat(F.lit("residual:"), text(state))),
        "grain": F.when(is_native, "native_tract")
        .when(F.col("_ct").isNotNull(), "county_anchored").otherwise("state_total_only")})
    kind = F.split("constraint", ":")[0]
    totals = (named.where(F.col("constraint").isNotNull()).groupBy("constraint", state)
              .agg(*[F.max(c).alias(c) for c in ("_native", "_ct", "_st", "_claimed")])
              .select("constraint", state, F.when(kind == "tract", F.col("_native"))
                      .when(kind == "zero", F.lit(0.0)).when(kind == "county", F.col("_ct"))
                      .otherwise(F.col("_st") - F.coalesce("_claimed", F.lit(0.0)))
                      .cast("double").alias("total")))
    return named.drop("_native", "_ns", "_ct", "_st", "_claimed"), totals


def negative_residuals(totals: DataFrame) -> DataFrame:
    """States whose observed counties exceed the published total: a conflict, not a clamp."""
    return totals.where(F.col("total") < 0)


def accounting_identity(published: DataFrame, value: str, constraint: str, state: str,
                        totals: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """published = constraints + unconstrained, per jurisdiction and overall (null key)."""
    per = published.groupBy(state).agg(
        F.sum(value).alias("published"),
        F.sum(F.when(F.col(constraint).isNull(), F.col(value)).otherwise(0.0))
         .alias("unconstrained"))
    con = totals.groupBy(state).agg(F.sum("total").alias("constrained"))
    rows = per.join(con, state, "left").withColumn(
        "constrained", F.coalesce("constrained", F.lit(0.0)))
    overall = rows.agg(*[F.sum(c).alias(c) for c in
                         ("published", "unconstrained", "constrained")])
    both = rows.unionByName(overall, allowMissingColumns=True)
    gap = F.abs(F.col("published") - F.col("constrained") - F.col("unconstrained"))
    return both.withColumn("gap", gap).withColumn("holds", F.col("gap") <= tolerance)


# --- dated sources ------------------------------------------------------------------------

def nearest_vintage_join(df: DataFrame, vintages: DataFrame, key: str, observed_at: str,
                         vintage_date: str, value: str) -> DataFrame:
    """The vintage nearest in time to each observation; the newest when it has no date.

    An equally near pair gives the newer, vintages of one day the smaller value. Only the distinct
    (key, day) of the observations meet the vintages: both are put in order together and the
    vintage before and after is carried to each day, so neither a key with very many vintages nor
    one with very many observations is gathered. A key without a vintage gets nulls.
    """
    days = vintages.where(F.col(vintage_date).isNotNull()).groupBy(
        key, F.col(vintage_date).alias("_day")).agg(F.min(value).alias("_value"))
    found = F.struct("_day", "_value")
    asked = df.where(F.col(observed_at).isNotNull()).select(
        key, F.col(observed_at).cast("date").alias("_day")).distinct()
    line = days.select(key, "_day", found.alias("_v")).unionByName(
        asked.withColumn("_asked", F.lit(1)), allowMissingColumns=True)
    # a vintage of the same day comes first, and so is carried to the question
    placed = carry_known(line, [key], ["_day", F.col("_asked").asc_nulls_first()], "_v",
                         "_last", "_next").where("_asked = 1")
    before = F.abs(F.datediff(F.col("_last._day"), F.col("_day")))
    after = F.abs(F.datediff(F.col("_next._day"), F.col("_day")))
    pick = F.when(F.col("_next").isNull() | (before < after), F.col("_last")).otherwise(
        F.coalesce("_next", "_last"))
    dated = placed.select(F.col(key).alias("_key"), F.col("_day").alias("_at"),
                          pick.alias("_dated"))
    newest = days.groupBy(F.col(key).alias("_newest_key")).agg(F.max_by(found, "_day").alias("_new"))
    matched = F.when(F.col(observed_at).isNull(), F.col("_new")).otherwise(F.col("_dated"))
    return (df.join(dated, (F.col(key) == F.col("_key"))
                    & (F.col(observed_at).cast("date") == F.col("_at")), "left")
            .join(newest, F.col(key) == F.col("_newest_key"), "left")
            .withColumns({"matched_vintage": matched["_day"], "matched_value": matched["_value"]})
            .drop("_key", "_at", "_dated", "_newest_key", "_new"))


def as_of_release(cutoffs: DataFrame, vintages: DataFrame, source: str = "source",
                  cutoff: str = "cutoff") -> tuple[DataFrame, DataFrame]:
    """(chosen, excluded) editions per source and cutoff.

    An edition is usable when its release and its period end are both known for certain
    and not after the cutoff; the newest usable one is chosen. The cutoffs, a declared list, stand
    in one row. An edition is counted where it first becomes usable, so a source of many editions
    is reduced to one row for each cutoff before anything is repeated.
    """
    dates = cutoffs.select(cutoff).where(F.col(cutoff).isNotNull()).distinct()
    listed = vintages.join(F.broadcast(dates.agg(F.sort_array(F.collect_list(cutoff))
                                                 .alias("_cuts"))))
    since = F.when(F.col("certain"), F.when(
        F.col("released").isNotNull() & F.col("period_end").isNotNull(),
        F.greatest("released", "period_end")))
    listed = listed.withColumn("_since", since)
    later = F.filter("_cuts", lambda c: c >= F.col("_since"))
    # running maxima: the best edition of a cutoff is that of all slots up to it
    slots = listed.withColumn("_open", later).where(F.size("_open") > 0).groupBy(
        source, F.get("_open", F.lit(0)).alias("_from")).agg(
        F.max(F.struct("released", "period_end", "edition")).alias("_c"),
        F.max("_open").alias("_open"))
    chosen = (slots.select(source, F.explode("_open").alias(cutoff), "_c")
              .groupBy(source, cutoff).agg(F.max("_c").alias("_c")).select(source, cutoff, "_c.*"))
    shut = F.filter("_cuts", lambda c: F.col("_since").isNull() | (c < F.col("_since")))
    excluded = listed.select(source, F.explode(shut).alias(cutoff), "edition", "certain",
                             "released").select(
        source, cutoff, "edition",
        F.when(~F.coalesce("certain", F.lit(False)), "release_uncertain")
        .when(F.col("released") > F.col(cutoff), "released_after_cutoff")
        .otherwise("period_after_cutoff").alias("reason"))
    return chosen, excluded


def upsert_by_key(full: DataFrame, fresh: DataFrame, key: Sequence[str]) -> DataFrame:
    """Overlay a partial refresh by key; rows it does not mention stay as they are."""
    rest = [c for c in full.columns if c not in key]
    f = fresh.select(*key, *[F.col(c).alias(f"_f_{c}") for c in rest],
                     F.lit(True).alias("_fresh"))
    return full.join(f, list(key), "full").select(
        *key, *[F.when(F.col("_fresh"), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c)
                for c in rest])


def latest_per_key(df: DataFrame, key: str, vintage: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(F.max(vintage).alias(vintage), *[
        F.max_by(v, vintage).alias(v) for v in values])


def panel_join(observed: DataFrame, features: DataFrame, states: DataFrame, area: str,
               exposure: str) -> tuple[DataFrame, DataFrame]:
    """Observed counts to features at their own grain: (panel, dispositions).

    ``states(area)`` lists the areas inside the jurisdiction. Reasons are checked in
    order: no area, outside the state, no features, no exposure.
    """
    inside = states.select(area).distinct().withColumn("_in", F.lit(True))
    feats = features.withColumn("_has", F.lit(True))
    joined = observed.join(inside, area, "left").join(feats, area, "left")
    rules = [
        Rule("no_area", "the record names no area", F.col(area).isNull()),
        Rule("outside_state", "the area is not in the jurisdiction", F.col("_in").isNull()),
        Rule("no_features", "no features at this grain", F.col("_has").isNull()),
        Rule("no_exposure", "the area has no exposure",
             F.coalesce(F.col(exposure), F.lit(0.0)) <= 0)]
    tagged = joined.withColumn("disposition", disposition(rules)).drop("_in", "_has")
    kept = tagged.where(F.col("disposition") == "included").drop("disposition")
    return kept, tagged.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def lookup_with_suffix(df: DataFrame, table: DataFrame, state: str, name: str, code: str,
                       suffix: str = " County") -> DataFrame:
    """(state, name) to code, retried with a suffix; unresolved rows stay, with a reason."""
    s, n = F.upper(F.trim(F.col(state))), F.trim(F.col(name))
    t1 = table.select(F.col(state).alias("_s1"), F.col(name).alias("_n1"),
                      F.col(code).alias("_c1"))
    t2 = table.select(F.col(state).alias("_s2"), F.col(name).alias("_n2"),
                      F.col(code).alias("_c2"))
    out = (df.join(t1, (s == F.col("_s1")) & (n == F.col("_n1")), "left")
           .join(t2, (s == F.col("_s2")) & (F.concat(n, F.lit(suffix)) == F.col("_n2")),
                 "left"))
    return out.withColumns({
        code: F.coalesce("_c1", "_c2"),
        "lookup": F.when(F.col("_c1").isNotNull(), "exact")
        .when(F.col("_c2").isNotNull(), "suffixed").otherwise("unresolved")}).drop(
        "_s1", "_n1", "_c1", "_s2", "_n2", "_c2")


