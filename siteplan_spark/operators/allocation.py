"""Moving quantities between geographies without losing mass or provenance."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteplan_spark.functions.geo import cell_of, is_valid_coordinate
from siteplan_spark.operators.ledger import Rule, classify_first_match
from siteplan_spark.operators.ranking import complexity_band
from siteplan_spark.session import cut_lineage


def _group_totals(df: DataFrame, group: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach group totals by aggregate-and-join.

    Unlike a window this combines on the map side and never puts a hot group in one
    task; the totals side has one row per group, so AQE may split the large side.
    """
    totals = df.groupBy(*group).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(totals, list(group))


def normalise_weights(df: DataFrame, group: str, weight: str, on_zero: str = "equal",
                      name: str = "weight_share") -> DataFrame:
    """weight / group total. A zero-sum group is split evenly or rejected (null share)."""
    if on_zero not in ("equal", "reject"):
        raise ValueError(f"unknown zero-sum policy {on_zero!r}")
    tot = _group_totals(df, [group], _t=F.sum(weight), _n=F.count(F.lit(1)))
    fallback = F.lit(1.0) / F.col("_n") if on_zero == "equal" else F.lit(None).cast("double")
    return tot.withColumns({
        name: F.when(F.col("_t") > 0, F.col(weight) / F.col("_t")).otherwise(fallback),
        "basis": F.when(F.col("_t") > 0, "weighted").otherwise(
            "equal_split" if on_zero == "equal" else "unallocatable")}).drop("_t", "_n")


def area_weights(parts: DataFrame, source: str, target: str, area: str) -> DataFrame:
    """(source, target, weight, basis) from part areas; a zero-area source splits evenly."""
    edges = parts.groupBy(source, target).agg(F.sum(area).alias("_area"))
    return normalise_weights(edges, source, "_area", "equal", "weight").select(
        source, target, "weight",
        F.when(F.col("basis") == "weighted", "area").otherwise("equal_split").alias("basis"))


def allocate(values: DataFrame, links: DataFrame, key: str, target: str, value: str,
             weight: str = "weight") -> tuple[DataFrame, DataFrame]:
    """(allocated, unallocatable): value x link weight, and every row no link could take."""
    edges = links.where(F.col(weight).isNotNull()).select(key, target, weight)
    out = values.join(edges, key).withColumn("allocated", F.col(value) * F.col(weight))
    left = values.join(edges.select(key).distinct(), key, "left_anti").withColumn(
        "reason", F.lit("no_link"))
    return out, left


def population_cell_weights(points: DataFrame, area: str, lat: str, lon: str,
                            population: str, level: int) -> DataFrame:
    """(area, cell, weight): each area's population share per cell.

    An area nobody lives in is split evenly over the distinct cells of its points.
    """
    cells = (points.where(is_valid_coordinate(lat, lon))
             .groupBy(area, cell_of(lat, lon, level).alias("cell"))
             .agg(F.sum(population).alias("_pop")))
    return normalise_weights(cells, area, "_pop", "equal", "weight").select(
        area, "cell", "weight", "basis")


def weights_sum_to_one(weights: DataFrame, group: str, weight: str = "weight",
                       tolerance: float = 1e-9) -> DataFrame:
    """Groups whose weights do not sum to one: empty when the weights are sound."""
    return weights.groupBy(group).agg(F.sum(weight).alias("total")).where(
        F.abs(F.col("total") - 1.0) > tolerance)


def weighted_shares(df: DataFrame, by: Sequence[str], category: str, weight: str,
                    name: str = "shares") -> DataFrame:
    """by -> map(category -> share of weight); an empty map when nothing weighs."""
    per = df.groupBy(*by, category).agg(F.sum(weight).alias("_w"))
    grouped = per.groupBy(*by).agg(
        F.sum("_w").alias("_t"),
        F.array_sort(F.collect_list(F.struct(F.col(category).alias("k"),
                                             F.col("_w").alias("v")))).alias("_e"))
    shares = F.map_from_entries(F.transform(
        "_e", lambda e: F.struct(e["k"], e["v"] / F.col("_t"))))
    return grouped.select(*by, F.when(F.col("_t") > 0, shares).otherwise(
        F.map_from_entries(F.filter(F.transform("_e", lambda e: F.struct(
            e["k"], e["v"].cast("double"))), lambda e: F.lit(False)))).alias(name))


def aggregate_with_provenance(df: DataFrame, weights: DataFrame, key: str, value: str,
                              population: str, additive: Sequence[str],
                              means: Sequence[str], categories: Sequence[str]
                              ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Source rows x weights onto cells: (cells, category shares, unallocated).

    Sums are additive. Means and shares weigh each contribution by its value; where a
    cell has no value by its population; where it has neither by its link weight.
    """
    edges = weights.where(F.col("weight") > 0).select(key, "cell", "weight")
    contrib = df.join(edges, key)
    v = F.col(value) * F.col("weight")
    p = F.col(population) * F.col("weight")
    totals = contrib.groupBy("cell").agg(F.sum(v).alias("_tv"), F.sum(p).alias("_tp"))
    based = contrib.join(totals, "cell").withColumn(
        "_b", F.when(F.col("_tv") > 0, v).when(F.col("_tp") > 0, p)
        .otherwise(F.col("weight")))
    cells = based.groupBy("cell").agg(
        *[F.sum(F.col(a) * F.col("weight")).alias(a) for a in
          dict.fromkeys([value, population, *additive])],
        F.count(F.lit(1)).alias("contributors"),
        (F.max("_b") / F.sum("_b")).alias("largest_contributor_share"),
        *[(F.sum(F.col(m) * F.col("_b")) / F.sum("_b")).alias(m) for m in means])
    rows = F.array(*[F.struct(F.lit(c).alias("dimension"),
                              F.col(c).cast("string").alias("category")) for c in categories])
    flat = based.select("cell", "_b", F.inline(rows))
    per = flat.groupBy("cell", "dimension", "category").agg(F.sum("_b").alias("_w"))
    # a dimension has a handful of categories per cell
    whole = F.sum("_w").over(Window.partitionBy("cell", "dimension"))
    shares = per.select("cell", "dimension", "category", (F.col("_w") / whole).alias("share"))
    lost = df.join(edges.select(key).distinct(), key, "left_anti")
    return cells, shares, lost


# --- comparing allocation methods -------------------------------------------------------

def align_shares(observed: DataFrame, estimated: DataFrame, by: Sequence[str], category: str,
                 share: str) -> DataFrame:
    """Full outer alignment of two share vectors, missing read as zero."""
    o = observed.select(*by, category, F.col(share).alias("observed"))
    e = estimated.select(*by, category, F.col(share).alias("estimated"))
    return o.join(e, [*by, category], "full").withColumns({
        "observed": F.coalesce("observed", F.lit(0.0)),
        "estimated": F.coalesce("estimated", F.lit(0.0))})


def share_errors(aligned: DataFrame, by: Sequence[str], category: str) -> DataFrame:
    """Per group: total variation distance, mean absolute share error, top category hit."""
    gap = F.abs(F.col("observed") - F.col("estimated"))

    def best(c: str) -> Column:
        return F.min_by(category, F.struct((-F.col(c)).alias("w"), F.col(category).alias("k")))
    return aligned.groupBy(*by).agg(
        (F.sum(gap) / 2.0).alias("tvd"), F.avg(gap).alias("mae"),
        (best("observed") == best("estimated")).alias("hit"))


def compare_allocation_methods(pairs: DataFrame, methods: DataFrame, source: str, target: str,
                               min_n: int = 10) -> dict[str, DataFrame]:
    """Score each method's source -> target weights against the observed pairs.

    ``pairs(source, target)`` is one row per record; ``methods(method, source, target,
    weight)``. Weights are used exactly as supplied. Returns scores per (method, source),
    weighted summaries, win shares, strata by complexity and the area-level ledger.
    """
    # read by the ledger, the observed shares and the scores
    counts = cut_lineage(pairs.groupBy(source, target).agg(F.count(F.lit(1)).alias("_n")))
    areas = counts.groupBy(source).agg(F.sum("_n").alias("records"),
                                       F.count(F.lit(1)).alias("targets"))
    names = methods.select("method").distinct()
    n_methods = names.agg(F.count(F.lit(1)).alias("_m"))
    covered = (methods.groupBy(source, "method").agg(F.sum("weight").alias("_w"))
               .where(F.col("_w") > 0).groupBy(source).agg(F.count(F.lit(1)).alias("_c")))
    ready = areas.join(covered, source, "left").join(F.broadcast(n_methods))
    rules = [Rule("below_minimum", "fewer records than the minimum",
                  F.col("records") < min_n),
             Rule("no_method_weights", "some method has no weights here",
                  F.coalesce(F.col("_c"), F.lit(0)) < F.col("_m"))]
    kept, excluded = classify_first_match(ready, rules)
    ledger = (excluded.select("reason", "records")
              .unionByName(kept.select(F.lit("included").alias("reason"), "records"))
              .groupBy("reason").agg(F.count(F.lit(1)).alias("areas"),
                                     F.sum("records").alias("records")))
    kept = kept.select(source, "records", "targets")
    observed = counts.join(kept, source).select(
        source, target, (F.col("_n") / F.col("records")).alias("share"))
    # repeat the observed vector once per method: methods are a declared handful
    observed_m = observed.join(F.broadcast(names))
    estimated = methods.join(kept.select(source), source, "left_semi").select(
        "method", source, target, F.col("weight").alias("share"))
    aligned = align_shares(observed_m, estimated, ["method", source], target, "share")
    by = ["method", source]
    scores = cut_lineage(share_errors(aligned, by, target).join(kept, source).withColumn(
        "band", complexity_band("targets")))
    w = F.col("records")
    summary = scores.groupBy("method").agg(
        (F.sum(F.col("tvd") * w) / F.sum(w)).alias("weighted_mean_tvd"),
        F.avg("tvd").alias("unweighted_mean_tvd"),
        (F.sum(F.col("mae") * w) / F.sum(w)).alias("weighted_mean_mae"),
        F.avg(F.col("hit").cast("double")).alias("top_target_accuracy"))
    # strictly best only: the two lowest of a handful of methods per area
    ranked = scores.groupBy(source).agg(
        F.array_sort(F.collect_list(F.struct("tvd", "method"))).alias("_r"))
    clear = ranked.where((F.size("_r") < 2) | (F.col("_r")[0]["tvd"] < F.try_element_at(
        "_r", F.lit(2))["tvd"])).select(F.col("_r")[0]["method"].alias("method"))
    total = kept.agg(F.count(F.lit(1)).alias("_areas"))
    wins = clear.groupBy("method").agg(F.count(F.lit(1)).alias("_wins"))
    win_share = (names.join(wins, "method", "left").join(F.broadcast(total))
                 .select("method", F.when(F.col("_areas") > 0, F.coalesce(
                     "_wins", F.lit(0)) / F.col("_areas")).otherwise(0.0).alias("win_share")))
    strata = scores.groupBy("band", "method").agg(
        F.count(F.lit(1)).alias("areas"), F.sum("records").alias("records"),
        (F.sum(F.col("tvd") * w) / F.sum(w)).alias("weighted_tvd"))
    return {"scores": scores, "summary": summary, "win_share": win_share,
            "strata": strata, "ledger": ledger}


def rebuild_from_grain(fine: DataFrame, grain: Sequence[str], fine_key: str, value: str,
                       basis: str) -> DataFrame:
    """Known grain totals spread over fine areas by ``basis``: (fine_key, estimated).

    A grain with a zero basis cannot place its total; its rows stay with a null estimate.
    """
    if not grain:
        total = fine.agg(F.sum(value).alias("_t"), F.sum(basis).alias("_b"))
        joined = fine.join(F.broadcast(total))
    else:
        joined = _group_totals(fine, grain, _t=F.sum(value), _b=F.sum(basis))
    return joined.select(*grain, fine_key, value, F.when(
        F.col("_b") > 0, F.col("_t") * F.col(basis) / F.col("_b")).alias("estimated"))


def transformation_ladder(fine: DataFrame, grains: Mapping[str, Sequence[str]], fine_key: str,
                          value: str, basis: str) -> DataFrame:
    """How much of the fine distribution survives each evidence grain.

    One row per grain: fine-level TVD between the observed and the rebuilt distribution,
    and how much of the value could be placed. Finer grains come first.
    """
    rows = []
    for position, (name, keys) in enumerate(grains.items()):
        rebuilt = rebuild_from_grain(fine, keys, fine_key, value, basis)
        total = fine.agg(F.sum(value).alias("_total"))
        placed = F.coalesce("estimated", F.lit(0.0))
        rows.append(rebuilt.join(F.broadcast(total)).agg(
            (F.sum(F.abs(F.col(value) / F.col("_total") - placed / F.col("_total"))) / 2.0)
            .alias("tvd"),
            F.sum(F.when(F.col("estimated").isNotNull(), F.col(value)).otherwise(0))
             .alias("placed"),
            F.sum(F.when(F.col("estimated").isNull(), F.col(value)).otherwise(0))
             .alias("unplaced"))
            .select(F.lit(position).alias("position"), F.lit(name).alias("grain"), "tvd",
                    "placed", "unplaced"))
    return reduce(DataFrame.unionByName, rows)


def centroid_resolution_benchmark(points: DataFrame, area: str, lat: str, lon: str,
                                  population: str, level: int) -> DataFrame:
    """Share of population that moves cell if each area sat at its weighted centroid."""
    w = F.col(population)
    centre = points.groupBy(area).agg(
        (F.sum(F.col(lat) * w) / F.sum(w)).alias("_clat"),
        (F.sum(F.col(lon) * w) / F.sum(w)).alias("_clon")).select(
        area, cell_of("_clat", "_clon", level).alias("_ccell"))
    cells = points.groupBy(area, cell_of(lat, lon, level).alias("cell")).agg(
        F.sum(population).alias("_p"))
    return cells.join(centre, area).agg(
        F.sum("_p").alias("population"),
        F.sum(F.when(F.col("cell") != F.col("_ccell"), F.col("_p")).otherwise(0))
         .alias("moved")).withColumn("moved_share", F.when(
             F.col("population") > 0, F.col("moved") / F.col("population")).otherwise(0.0))
