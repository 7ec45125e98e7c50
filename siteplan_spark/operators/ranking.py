"""Rankings, gain curves, percentiles and baselines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteplan_spark.session import cut_lineage


#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
_ROW_BITS = 33


def _sorted_places(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The rows range-partitioned, ordered and written once, with ``_p`` (the place of their
    partition) and ``_w`` (their 0-based place inside it), both read off one row id."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = cut_lineage(df.sort(*cols).withColumn("_m", F.monotonically_increasing_id()))
    return placed.withColumns({"_p": F.shiftright("_m", _ROW_BITS),
                               "_w": F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("_m")


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """1-based position in a total order, without sending the table to one task.

    Rows are range-partitioned on the whole sort key, so equal leading values are split
    by the later keys; the ordered partitions are written once, and each row gets
    its place in its partition plus the sizes of the partitions before it. The full rows
    are shuffled once. ``order`` must end in a unique column.
    """
    parts = _sorted_places(df, order)
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition, so an unpartitioned window is bounded
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    return (parts.join(F.broadcast(before.drop("_n")), "_p")
            .withColumn(name, (F.col("_w") + F.col("_before") + 1).cast("bigint"))
            .drop("_p", "_w", "_before"))


def group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
               name: str = "rank") -> DataFrame:
    """Position inside each group, also when one group holds most of the rows.

    The same sorted partitions serve every group: a partition holds one run of each
    group, and a row's position is its place minus the start of the run plus the sizes
    of the group's earlier runs. The full rows are shuffled once; the runs, one for each
    group and partition, are joined without moving the rows where they are few.
    """
    parts = _sorted_places(df, [*by, *order])
    keys = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    runs = parts.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_w").alias("_start"))
    before = runs.withColumn("_before", F.sum("_n").over(
        Window.partitionBy(*by).orderBy("_p")) - F.col("_n") - F.col("_start")).select(
        *[F.col(c).alias(f"_g_{c}") for c in by], F.col("_p").alias("_q"), "_before")
    return (parts.join(before, reduce(lambda a, b: a & b, keys, F.col("_p") == F.col("_q")))
            .withColumn(name, (F.col("_w") + F.col("_before") + 1).cast("bigint"))
            .drop("_p", "_w", "_before", "_q", *[f"_g_{c}" for c in by]))


def carry_known(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str,
                last: str, following: str) -> DataFrame:
    """``last`` and ``following``: the nearest non-null ``value`` of the group at or before each
    row, and at or after it, in ``order``.

    The rows are range-partitioned once, so a group of any size is spread. Inside a partition the
    values are carried along; what crosses its edges comes from one row for each group and
    partition.
    """
    parts = _sorted_places(df, [*by, *order])
    here = Window.partitionBy("_p", *by).orderBy("_w")
    known = F.when(F.col(value).isNotNull(), F.col("_w"))
    runs = parts.groupBy(*by, "_p").agg(F.min_by(value, known).alias("_f"),
                                        F.max_by(value, known).alias("_l"))
    across = Window.partitionBy(*by).orderBy("_p")
    edges = runs.select(
        *[F.col(c).alias(f"_g_{c}") for c in by], F.col("_p").alias("_q"),
        F.last("_l", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_f", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"))
    keys = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    carried = parts.withColumns({
        last: F.last(value, True).over(here.rowsBetween(Window.unboundedPreceding, 0)),
        following: F.first(value, True).over(here.rowsBetween(0, Window.unboundedFollowing))})
    return (carried.join(edges, reduce(lambda a, b: a & b, keys, F.col("_p") == F.col("_q")))
            .withColumns({last: F.coalesce(last, "_before"),
                          following: F.coalesce(following, "_after")})
            .drop("_p", "_w", "_q", "_before", "_after", *[f"_g_{c}" for c in by]))


def rank_desc(df: DataFrame, id_col: str, value: str, name: str = "rank") -> DataFrame:
    """Descending by value, ties by id, a missing value counting as zero."""
    return (df.withColumn("_v", F.coalesce(F.col(value), F.lit(0.0)))
            .transform(lambda d: global_rank(d, [F.desc("_v"), id_col], name)).drop("_v"))


def gain_curve(ranked: DataFrame, targets: DataFrame, id_col: str, rank: str,
               weights: Sequence[str], deciles: int = 10) -> DataFrame:
    """Share of each target weight captured by the top 1/deciles, 2/deciles, ... rows.

    The denominator is every target, including those the ranking never listed. Cut-offs
    use half-even rounding.
    """
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    totals = targets.agg(*[F.sum(w).alias(f"_t_{w}") for w in weights])
    placed = ranked.select(id_col, rank).join(targets.select(id_col, *weights), id_col)
    # each captured target goes to the first decile that reaches it, then one running sum
    cuts = F.array(*[F.struct(F.lit(i / deciles).alias("decile"),
                              F.bround(F.lit(i / deciles) * F.col("_n")).cast("bigint")
                              .alias("cells")) for i in range(1, deciles + 1)])
    marks = n.select(F.inline(cuts))
    cut_list = n.select(F.transform(cuts, lambda c: c["cells"]).alias("_cuts"))
    hit = (placed.join(F.broadcast(cut_list))
           .withColumn("_slot", F.size(F.filter("_cuts", lambda c: c < F.col(rank))))
           .groupBy("_slot").agg(*[F.sum(w).alias(f"_c_{w}") for w in weights]))
    marks = marks.withColumn("_slot", F.bround(F.col("decile") * deciles).cast("int") - 1)
    w = Window.orderBy("decile")  # ``deciles`` rows
    joined = marks.join(hit, "_slot", "left").join(F.broadcast(totals))
    return joined.select("decile", "cells", *[
        F.when(F.col(f"_t_{x}") > 0,
               F.coalesce(F.sum(f"_c_{x}").over(w), F.lit(0.0)) / F.col(f"_t_{x}"))
         .otherwise(0.0).alias(f"{x}_captured") for x in weights])


def lift(mine: Column | str, theirs: Column | str) -> Column:
    """Capture ratio; Infinity over a zero baseline, 1 when both are zero."""
    m = F.col(mine) if isinstance(mine, str) else mine
    t = F.col(theirs) if isinstance(theirs, str) else theirs
    return (F.when(t > 0, m / t).when(m > 0, F.lit(float("inf"))).otherwise(F.lit(1.0)))


def percentile_below(df: DataFrame, by: Sequence[str], value: str,
                     name: str = "percentile") -> DataFrame:
    """Share of the cohort strictly below each value.

    Counted over distinct values: equal values collapse first, so a cohort that repeats
    one value a billion times still orders one row for it.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ordered = group_running(counts, by, value, "_n")
    keys = [*by, value]
    return (df.join(ordered.select(*keys, (F.col("_before") / F.col("_total")).alias(name)),
                    keys))


def group_running(counts: DataFrame, by: Sequence[str], value: str, n: str) -> DataFrame:
    """``_before`` (sum of n over smaller values) and ``_total`` per group."""
    parts = cut_lineage(counts.sort(*by, value).withColumn("_p", F.spark_partition_id()))
    runs = parts.groupBy(*by, "_p").agg(F.sum(n).alias("_s"))
    w = Window.partitionBy(*by)
    offsets = runs.withColumns({
        "_off": F.sum("_s").over(w.orderBy("_p")) - F.col("_s"),
        "_total": F.sum("_s").over(w)}).drop("_s")
    inner = F.sum(n).over(Window.partitionBy("_p", *by).orderBy(value)) - F.col(n)
    placed = parts.withColumn("_in", inner)
    return (placed.join(offsets, [*by, "_p"])
            .withColumn("_before", F.col("_in") + F.col("_off")).drop("_in", "_off", "_p"))


def midrank_percentile(df: DataFrame, value: str, id_col: str,
                       name: str = "percentile") -> DataFrame:
    """(stable position + 0.5) / n."""
    ranked = global_rank(df, [value, id_col], "_rank")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(F.broadcast(n)).withColumn(
        name, (F.col("_rank") - 0.5) / F.col("_n")).drop("_rank", "_n")


def equal_count_bins(df: DataFrame, score: str, error: str, id_col: str,
                     bins: int = 5) -> DataFrame:
    """n bins by score, larger bins first, with mean score and mean error."""
    ranked = global_rank(df.select(id_col, score, error), [score, id_col], "_rank")
    n = ranked.agg(F.count(F.lit(1)).alias("_n"))
    i, k = F.col("_rank") - 1, F.least(F.lit(bins), F.col("_n"))
    size, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    big = extra * (size + 1)
    slot = F.when(i < big, F.floor(i / (size + 1))).otherwise(
        extra + F.floor((i - big) / F.greatest(size, F.lit(1))))
    return (ranked.join(F.broadcast(n)).withColumn("bin", slot.cast("bigint"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                                F.avg(score).alias("mean_score"),
                                F.avg(error).alias("mean_error")))


def zscore_screen(df: DataFrame, value: str, threshold: float = 3.0) -> DataFrame:
    """Rows further than ``threshold`` population deviations from the mean.

    Nothing is flagged below three rows or at zero spread. Two mergeable aggregates and
    a one-row join; no global window.
    """
    stats = df.agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"),
                   F.stddev_pop(value).alias("_sd"))
    return (df.join(F.broadcast(stats))
            .where((F.col("_n") >= 3) & (F.col("_sd") >= 1e-12))
            .withColumn("zscore", (F.col(value) - F.col("_mean")) / F.col("_sd"))
            .where(F.abs("zscore") > threshold).drop("_n", "_mean", "_sd"))


def yoy_screen(current: DataFrame, previous: DataFrame, key: str, count: str,
               threshold: float) -> DataFrame:
    """Counts that moved by more than ``threshold`` times, in either direction."""
    before = previous.select(key, F.col(count).alias("before"))
    growth = F.col(count) / F.col("before")
    return (current.join(before, key).where(F.col("before") != 0)
            .withColumn("growth", growth)
            .where((F.col("growth") > threshold) | (F.col("growth") < 1.0 / threshold)))


def relative_to_best(scores: DataFrame, objective: str, score: str,
                     threshold: float = 0.95) -> DataFrame:
    """Score as a share of the objective's best, and whether it falls short."""
    best = scores.groupBy(objective).agg(F.max(score).alias("_best"))
    return (scores.join(best, objective)
            .withColumn("relative", F.when(F.col("_best") > 0, F.col(score) / F.col("_best"))
                        .otherwise(1.0))
            .withColumn("is_tradeoff", F.col("relative") < threshold).drop("_best"))


def best_on(scores: DataFrame, objective: str, name: str, score: str) -> DataFrame:
    """Winner per objective, ties by name."""
    return scores.groupBy(objective).agg(
        F.min_by(name, F.struct((-F.col(score)).alias("s"), F.col(name).alias("n")))
         .alias("winner"), F.max(score).alias("best_score"))


def top_category_hit(observed: DataFrame, estimated: DataFrame, area: str, category: str,
                     weight: str) -> DataFrame:
    """Does the plurality category agree? Ties go to the smallest category."""
    def top(df: DataFrame, out: str) -> DataFrame:
        return df.groupBy(area).agg(F.min_by(category, F.struct(
            (-F.col(weight)).alias("w"), F.col(category).alias("c"))).alias(out))
    return (top(observed, "observed_top").join(top(estimated, "estimated_top"), area)
            .withColumn("hit", F.col("observed_top") == F.col("estimated_top")))


# How many targets an area touches, as reporting bands.
COMPLEXITY_BANDS = (("1", 1, 1), ("2-3", 2, 3), ("4-7", 4, 7), ("8+", 8, None))


def complexity_band(n: Column | str) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return (F.when(c <= 1, "1").when(c <= 3, "2-3").when(c <= 7, "4-7").otherwise("8+"))


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str],
                  values: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[
        F.min_by(v, F.struct(*order)).alias(v) for v in values])


def last_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str],
                 values: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[
        F.max_by(v, F.struct(*order)).alias(v) for v in values])


def top_k(df: DataFrame, k: int, value: str, id_col: str) -> DataFrame:
    """The k best rows; Spark keeps k per task and merges."""
    return df.orderBy(F.desc(value), id_col).limit(k)


def top_k_per_group(df: DataFrame, by: Sequence[str], k: int, value: str,
                    id_col: str) -> DataFrame:
    """The k best rows of each group.

    Spark's window group limit drops rows past k before the shuffle, so a hot group
    sends at most k rows per task.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(value), id_col)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked_reasons(df: DataFrame, demand: str, ports: str, distance: str, equity: str,
                   tier: str, pct: tuple[str, str, str]) -> DataFrame:
    """Threshold rules as sentences, the most distinctive first; ``headline`` leads.

    ``pct`` names the demand, distance and equity percentile columns.
    """
    # Thresholds, weights and wording of the published reasons.
    d, k, e = (F.col(c) for c in pct)
    km = F.format_string("%.0f", F.col(distance))
    rules = [
        (d >= 0.6, d, F.when(d >= 0.9, "Among the highest estimated EV demand in the state")
         .otherwise("Above-average estimated EV demand")),
        (F.col(ports) == 0, F.lit(0.55), F.lit("No public fast charging here today")),
        ((F.col(ports) != 0) & (F.col(demand) / F.nullif(F.col(ports), F.lit(0)) > 500),
         F.lit(0.72), F.lit("Existing fast charging is thin for the demand")),
        ((k >= 0.7) & (F.col(distance) < float("inf")), k,
         F.concat(F.lit("Nearest fast charging is "), km, F.lit(" km away"))),
        (e >= 0.6, e, F.when(e >= 0.9, "Reaches one of the largest underserved populations here")
         .otherwise("Reaches an above-average underserved population")),
        (F.col(tier) == "A", F.lit(0.4),
         F.lit("Local registration data supports the estimate")),
    ]
    found = F.array_compact(F.array(*[
        F.when(cond, F.struct((-weight.cast("double")).alias("w"), F.lit(i).alias("i"),
                              text.alias("text")))
        for i, (cond, weight, text) in enumerate(rules)]))
    return df.withColumn("_r", F.array_sort(found)).withColumns({
        "reasons": F.transform("_r", lambda r: r["text"]),
        "headline": F.coalesce(F.try_element_at("_r", F.lit(1))["text"],
                               F.lit("Meets the screening criteria"))}).drop("_r")


def random_order(id_col: str | Column, seed: int | Column) -> Column:
    """A reproducible shuffle key of 52 bits: md5 of seed and id, whatever the order of rows."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = F.lit(seed) if isinstance(seed, int) else seed
    digest = F.md5(F.concat_ws(":", s.cast("string"), c.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


#: Groups of cells that a draw orders as wholes: 16 to this power.
_GROUP_DIGITS = 3


def random_baseline(cells: DataFrame, targets: DataFrame, id_col: str, weight: str,
                    seed: int, draws: int = 200, fraction: float = 0.1) -> DataFrame:
    """Capture by the top fraction of seeded random rankings of the cells.

    One row: draws, mean, standard_deviation, p5, p95, ``single_draw`` (the ranking of ``seed``
    itself) and ``single_draw_percentile`` (share of draws below it). Cells fall into 4,096 groups
    by md5 of their id. A draw orders the groups, and the cells of a group, by md5 of the draw and
    the group or cell. So the sizes and target weights of the groups, counted once, serve all
    draws; only the cells of the one group that a draw cuts through are ordered, on average one in
    4,096. The denominator is every target, also one that is not among the cells.
    """
    total = targets.agg(F.sum(weight).alias("_total"))
    own = targets.groupBy(id_col).agg(F.sum(weight).cast("double").alias("_w"))
    grouped = cut_lineage(cells.select(id_col).join(own, id_col, "left").select(
        id_col, F.coalesce("_w", F.lit(0.0)).alias("_w"),
        F.substring(F.md5(F.col(id_col).cast("string")), 1, _GROUP_DIGITS).alias("_g")))
    sizes = grouped.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"), F.sum("_w").alias("_sw"))
    n = sizes.agg(F.sum("_c").alias("_n"))
    # the ranking of the seed itself is one more draw
    seeds = F.array(F.lit(seed), *[F.lit(seed * 100003 + i) for i in range(draws)])
    slots = sizes.select("_g", "_c", "_sw", F.explode(seeds).alias("_seed"))
    w = Window.partitionBy("_seed").orderBy(random_order("_g", F.col("_seed")), "_g")
    run = slots.join(F.broadcast(n)).withColumns({
        "_end": F.sum("_c").over(w),
        "_take": F.bround(F.lit(fraction) * F.col("_n")).cast("bigint")})
    run = cut_lineage(run)
    full = run.groupBy("_seed").agg(F.sum(F.when(F.col("_end") <= F.col("_take"), F.col("_sw")))
                                    .alias("_full"))
    edge = run.where((F.col("_end") > F.col("_take"))
                     & (F.col("_end") - F.col("_c") < F.col("_take"))).select(
        "_seed", "_g", (F.col("_take") - F.col("_end") + F.col("_c")).alias("_room"))
    inside = grouped.join(edge, "_g").withColumn("_k", F.row_number().over(
        Window.partitionBy("_seed").orderBy(random_order(id_col, F.col("_seed")), id_col)))
    part = inside.where(F.col("_k") <= F.col("_room")).groupBy("_seed").agg(
        F.sum("_w").alias("_part"))
    captured = full.join(part, "_seed", "left").join(F.broadcast(total)).select(
        "_seed", ((F.coalesce("_full", F.lit(0.0)) + F.coalesce("_part", F.lit(0.0)))
                  / F.col("_total")).alias("captured"))
    single = captured.where(F.col("_seed") == seed).select(F.col("captured").alias("single_draw"))
    rest = captured.where(F.col("_seed") != seed).join(F.broadcast(single))
    return rest.agg(F.count(F.lit(1)).alias("draws"), F.avg("captured").alias("mean"),
                    F.stddev_pop("captured").alias("standard_deviation"),
                    F.percentile("captured", 0.05).alias("p5"),
                    F.percentile("captured", 0.95).alias("p95"),
                    F.max("single_draw").alias("single_draw"),
                    F.avg((F.col("captured") < F.col("single_draw")).cast("double"))
                    .alias("single_draw_percentile"))


def event_window(ts: Column | str, cutoff: str, months: int = 24) -> Column:
    """Half-open membership [cutoff, cutoff + months)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    start = F.to_date(F.lit(cutoff))
    return (c >= start) & (c < F.add_months(start, months))


def jaccard(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Overlap of two selections; 1 when both are empty."""
    both = (left.select(key).distinct().withColumn("_l", F.lit(1))
            .join(right.select(key).distinct().withColumn("_r", F.lit(1)), key, "full"))
    return both.agg(F.coalesce(
        F.sum(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1).otherwise(0))
        / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(1.0)).alias("jaccard"))


def set_reconciliation(before: DataFrame, after: DataFrame, key: str,
                       measure: str | None = None) -> DataFrame:
    """entered / left / intersection with counts (and a summed measure)."""
    m = F.lit(0.0) if measure is None else F.col(measure).cast("double")
    l = before.select(key, m.alias("_lm"), F.lit(1).alias("_l"))
    r = after.select(key, m.alias("_rm"), F.lit(1).alias("_r"))
    side = (F.when(F.col("_l").isNull(), "entered").when(F.col("_r").isNull(), "left")
            .otherwise("intersection"))
    return (l.join(r, key, "full").groupBy(side.alias("side"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.coalesce("_rm", "_lm")).alias("measure")))


def key_parity(batches: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Keys not present in every batch, with how many batches hold them."""
    tagged = None
    for b in batches:
        one = b.select(*key).distinct()
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy(*key).agg(F.count(F.lit(1)).alias("batches")).where(
        F.col("batches") < len(batches))


def overlapping_members(links: DataFrame, member: str, group: str) -> DataFrame:
    """Members claimed by more than one group: empty for a valid partition."""
    return links.select(member, group).distinct().groupBy(member).agg(
        F.count(F.lit(1)).alias("groups")).where(F.col("groups") > 1)


def parameter_grid(spark: SparkSession, start: float, stop: float, step: float,
                   name: str = "threshold") -> DataFrame:
    n = int(round((stop - start) / step))
    return spark.range(n + 1).select((F.lit(float(start)) + F.col("id") * step).alias(name))
