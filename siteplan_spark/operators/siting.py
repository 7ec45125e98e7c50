"""Choosing a portfolio of sites under a budget, and scoring what was chosen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteplan_spark.functions.clean import is_saturated
from siteplan_spark.functions.geo import k_ring
from siteplan_spark.operators.ledger import Rule, classify_first_match, exclusion_ledger
from siteplan_spark.operators.ranking import random_order, relative_to_best, top_k_per_group
from siteplan_spark.session import cut_lineage

# The objectives every portfolio is scored on.
OBJECTIVES = ("population_served", "demand_covered", "equity_coverage",
              "accessibility_improvement", "estimated_utilisation", "cost_efficiency")


def candidate_rules(saturation: float, min_population: float, has_roads: bool) -> list[Rule]:
    rules = [Rule("uninhabited", "nobody lives in the cell",
                  F.coalesce(F.col("population"), F.lit(0.0)) < min_population)]
    if has_roads:
        rules.append(Rule("beyond_primary_secondary_roads",
                          "no primary or secondary road within the configured distance",
                          ~F.coalesce(F.col("within_road"), F.lit(False))))
    rules.append(Rule("already_saturated", "existing ports per 1,000 demand reach the limit",
                      is_saturated("existing_ports", "demand", saturation)))
    return rules


def build_candidates(cells: DataFrame, saturation: float, road: DataFrame | None = None,
                     min_population: float = 1.0, key: Sequence[str] = ("cell",),
                     allow_missing_roads: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates, ledger): uninhabited, then beyond road, then saturated, in that order.

    Without road distances this refuses unless the degraded mode is asked for; then every
    candidate is marked ``road_data_unavailable``.
    """
    if road is None and not allow_missing_roads:
        raise ValueError("candidates need road distances; pass allow_missing_roads=True to "
                         "record the missing filter instead")
    rows = cells if road is None else cells.join(road.select(*key, "within_road"), list(key),
                                                 "left")
    rules = candidate_rules(saturation, min_population, road is not None)
    kept, _ = classify_first_match(rows, rules)
    return (kept.withColumn("road_data_unavailable", F.lit(road is None)),
            exclusion_ledger(rows, rules))


def coverage_edges(candidates: DataFrame, level: int, k: int = 1, cell: str = "cell",
                   by: Sequence[str] = ()) -> DataFrame:
    """(by, candidate, covered): the candidate's k-ring that is itself in the set."""
    reach = candidates.select(*by, F.col(cell).alias("candidate"),
                              F.explode(k_ring(cell, level, k)).alias("covered"))
    have = candidates.select(*by, F.col(cell).alias("covered")).distinct()
    return reach.join(have, [*by, "covered"], "left_semi")


#: Values are exact decimals with this many digits after the point: neither the order of a sum nor
#: a last bit decides a tie.
VALUE_DIGITS = 12


def _rounds(links: DataFrame, keys: list[str], spent: DataFrame | None, budget: float,
            most: int | None) -> DataFrame:
    """(keys, candidate, score, cost, total): what greedy picks before its first pick over budget.

    A candidate whose score beats all candidates it shares a cell with is picked before any of
    them, with the gain it has now, since gains only fall when a neighbour is picked. So each
    round takes all such local maxima at once; sorted by score they are the picks in their order.
    Once the picks of a group exceed the budget, candidates that come later are left alone.
    ``total`` is the money spent up to the pick.
    """
    picks = cuts = None
    while True:
        score = F.col("_g").cast("double")
        live = links.groupBy(*keys, "candidate").agg(
            F.sum("value").alias("_g"), F.max("cost").alias("cost")).where("_g > 0").withColumn(
            "score", F.when(F.col("cost") > 0, score / F.col("cost")).otherwise(score)).drop("_g")
        if cuts is not None:
            live = live.join(cuts, keys, "left").where(
                F.col("_cut").isNull() | (F.col("score") > F.col("_cut"))
                | ((F.col("score") == F.col("_cut")) & (F.col("candidate") < F.col("_last")))
            ).drop("_cut", "_last")
        ranked = links.join(live, [*keys, "candidate"]).select(
            *keys, "candidate", "covered", (-F.col("score")).alias("_s"))
        best = ranked.groupBy(*keys, "covered").agg(
            F.min(F.struct("_s", "candidate")).alias("_b"))
        beaten = ranked.join(best, [*keys, "covered"]).where(
            F.col("_b.candidate") != F.col("candidate")).select(*keys, "candidate").distinct()
        won = cut_lineage(live.join(beaten, [*keys, "candidate"], "left_anti")
                          .select(*keys, "candidate", "score", "cost"))
        if won.isEmpty():
            return picks if picks is not None else won.withColumn("total", F.lit(0.0))
        order = [F.desc("score"), F.col("candidate")]
        w = Window.partitionBy(*keys).orderBy(*order)
        all_picks = won if picks is None else picks.select(won.columns).unionByName(won)
        if most is not None:  # more picks than this cost more than the budget
            all_picks = all_picks.withColumn("_k", F.row_number().over(w)).where(
                F.col("_k") <= most + 1).drop("_k")
        so_far = (all_picks.withColumn("_spent", F.lit(0.0)) if spent is None
                  else all_picks.join(spent, keys, "left"))
        placed = so_far.withColumn(
            "total", F.coalesce("_spent", F.lit(0.0)) + F.sum("cost").over(w)).drop("_spent")
        over = F.min(F.when(F.col("total") > budget, F.struct(
            (-F.col("score")).alias("s"), "candidate")))
        picks = cut_lineage(placed)
        cuts = picks.groupBy(*keys).agg(over.alias("_o")).where("_o IS NOT NULL").select(
            *keys, (-F.col("_o.s")).alias("_cut"), F.col("_o.candidate").alias("_last"))
        gone = links.join(won.select(*keys, "candidate"), [*keys, "candidate"], "left_semi")
        links = cut_lineage(links.join(gone.select(*keys, "covered").distinct(),
                                       [*keys, "covered"], "left_anti"))


def greedy_max_coverage(candidates: DataFrame, coverage: DataFrame, budget: float,
                        weights: Mapping[str, float], by: Sequence[str] = (),
                        cost: str | None = None, key: str = "candidate") -> DataFrame:
    """(by, step, candidate, gain): repeatedly the best marginal weighted gain per cost.

    Ties go to the smallest id; a candidate that no longer fits the budget is skipped;
    the run ends when nothing affordable adds value. All groups, of any size, are solved in the
    same rounds (see ``_rounds``), far fewer than there are picks. When a pick does not fit, what
    was picked before it stands, all that no longer fits is left out, and the rounds go on from
    there. The number of picks of a group is bounded by its budget; its candidates are not.
    """
    keys = list(by) or ["_all"]
    whole = [] if by else [F.lit(1).alias("_all")]
    score = reduce(lambda a, b: a + b, [
        F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * float(w) for c, w in weights.items()])
    cand = candidates.select(
        *by, *whole, F.col(key).alias("candidate"),
        score.cast(f"decimal(38,{VALUE_DIGITS})").alias("value"),
        (F.col(cost).cast("double") if cost else F.lit(1.0)).alias("cost"))
    edges = coverage.select(*by, *whole, "candidate", "covered").distinct()
    value = cand.select(*keys, F.col("candidate").alias("covered"), "value")
    links = cut_lineage(edges.join(cand.select(*keys, "candidate", "cost").where(
        F.col("cost") <= budget), [*keys, "candidate"]).join(value, [*keys, "covered"]).where(
        "value <> 0"))
    least, largest = links.agg(F.min("cost"), F.max("cost")).first()
    most = int(budget // least) if least and least > 0 else None
    spent, chosen = None, []
    for phase in count():
        picks = _rounds(links, keys, spent, budget, most)
        over = Window.partitionBy(*keys)  # no more picks than the budget holds, and one
        kept = picks.withColumn("_over", F.min(F.when(F.col("total") > budget, F.col("total")))
                                .over(over)).where(
            F.col("_over").isNull() | (F.col("total") < F.col("_over"))).drop("_over").withColumn(
            "phase", F.lit(phase))
        chosen.append(kept)
        # where all cost the same, a pick that does not fit leaves none that does
        if least == largest:
            break
        kept = chosen[-1] = cut_lineage(kept)
        cut = picks.where(F.col("total") > budget).select(*keys).distinct()
        paid = kept.groupBy(*keys).agg(F.max("total").alias("_paid"))
        if spent is not None:
            paid = spent.join(paid, keys, "full").select(
                *keys, F.coalesce("_paid", "_spent").alias("_paid"))
        spent = cut_lineage(paid.withColumnRenamed("_paid", "_spent"))
        # only groups that met a pick over budget have anything left to do
        mine = links.join(kept.select(*keys, "candidate"), [*keys, "candidate"], "left_semi")
        links = cut_lineage(
            links.join(cut, keys, "left_semi").join(spent, keys, "left")
            .where(F.coalesce("_spent", F.lit(0.0)) + F.col("cost") <= budget).drop("_spent")
            .join(mine.select(*keys, "covered").distinct(), [*keys, "covered"], "left_anti"))
        if links.isEmpty():
            break
    w = Window.partitionBy(*keys).orderBy("phase", F.desc("score"), "candidate")
    return reduce(DataFrame.unionByName, chosen).select(
        *by, F.row_number().over(w).alias("step"), "candidate", F.col("score").alias("gain"))


def score_selection(selection: DataFrame, candidates: DataFrame, coverage: DataFrame,
                    by: Sequence[str] = (), key: str = "cell",
                    of: Sequence[str] = ()) -> DataFrame:
    """The six objectives of each selection; a cell covered twice counts once.

    ``of`` names columns that tell several selections over the same candidates apart.
    """
    picked = selection.select(*of, *by, "candidate")
    attrs = candidates.select(*by, F.col(key).alias("covered"), "population", "demand",
                              "equity_population", "existing_ports")
    covered = (coverage.join(picked, [*by, "candidate"]).select(*of, *by, "covered").distinct()
               .join(attrs, [*by, "covered"]))
    got = covered.groupBy(*of, *by).agg(
        F.sum("population").alias("population_served"), F.sum("demand").alias("demand_covered"),
        F.sum("equity_population").alias("equity_coverage"),
        F.sum(F.when(F.col("existing_ports") <= 0, F.col("demand")).otherwise(0.0))
         .alias("accessibility_improvement"))
    cost = F.col("cost") if "cost" in candidates.columns else F.lit(1.0)
    spend = candidates.select(*by, F.col(key).alias("candidate"), cost.alias("_c")).join(
        picked, [*by, "candidate"]).groupBy(*of, *by).agg(
        F.sum("_c").alias("_cost"), F.count(F.lit(1)).alias("sites"))
    joined = got.join(spend, [*of, *by]) if of or by else got.join(F.broadcast(spend))
    return joined.withColumns({
        "estimated_utilisation": F.when(F.col("sites") > 0,
                                        F.col("demand_covered") / F.col("sites")).otherwise(0.0),
        "cost_efficiency": F.when(F.col("_cost") > 0,
                                  F.col("demand_covered") / F.col("_cost")).otherwise(0.0)
    }).drop("_cost")


def baseline_portfolios(candidates: DataFrame, budget: int, by: Sequence[str],
                        seed: int, key: str = "cell") -> DataFrame:
    """(portfolio, by, candidate): the four simple rules, top ``budget`` per group."""
    rules = {"baseline_population_weighted": F.col("population").cast("double"),
             "baseline_demand_only": F.col("demand").cast("double"),
             "baseline_existing_network_proximity": F.col("existing_ports").cast("double"),
             "baseline_random": random_order(key, seed)}
    rows = candidates.select(*by, F.col(key).alias("candidate"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("portfolio"), c.alias("_v")) for n, c in rules.items()])))
    top = top_k_per_group(rows, ["portfolio", *by], budget, "_v", "candidate")
    return top.select("portfolio", *by, "candidate")


def cross_objective_table(portfolios: DataFrame, candidates: DataFrame, coverage: DataFrame,
                          by: Sequence[str] = (), key: str = "cell",
                          threshold: float = 0.95) -> DataFrame:
    """(portfolio, by, objective, score, relative, is_tradeoff) for every portfolio."""
    scores = score_selection(portfolios, candidates, coverage, by, key, ["portfolio"])
    long = scores.select("portfolio", *by, F.inline(F.array(*[
        F.struct(F.lit(o).alias("objective"), F.col(o).cast("double").alias("score"))
        for o in OBJECTIVES])))
    if not by:
        return relative_to_best(long, "objective", "score", threshold)
    tag = F.concat_ws("|", *by, "objective")
    return relative_to_best(long.withColumn("_o", tag), "_o", "score", threshold).drop("_o")


def coverage_bound(cells: DataFrame, edges: DataFrame, budget: float, keys: Sequence[str],
                   goals: DataFrame, steps: int = 20) -> DataFrame:
    """(keys, bound): no portfolio of the budget that meets the floor covers more than ``bound``.

    ``cells(keys, cell, cost, main, other)`` holds what covering a cell is worth, ``edges(keys,
    candidate, covered)`` which cells a candidate covers, ``goals(keys, floor, reached)`` the least
    ``other`` to be covered and what some portfolio reaches of ``main``.

    "A covered cell has a chosen candidate" and the floor are priced instead of demanded. With any
    prices the best choice is separate for each cell and, for the candidates, a knapsack; its value
    (with the knapsack's last piece cut) bounds the true optimum from above. Prices follow the
    subgradient, with steps from the distance between the bound and ``reached``, and the smallest
    bound seen is kept. A step is two aggregates over the edges; the knapsack orders no more
    candidates of a group than its budget can hold. A floor that no portfolio can meet may give a
    bound below what ``reached`` says.
    """
    keys = list(keys)
    sums = cells.groupBy(*keys).agg(F.sum("main").alias("_m"), F.sum("other").alias("_o"))
    unit = lambda c, t: F.when(F.col(t) > 0, F.col(c) / F.col(t)).otherwise(0.0)
    # both objectives as shares of their totals, so that one step length serves both prices
    scaled = cells.join(sums, keys)
    cost = cells.select(*keys, F.col("cell").alias("candidate"), F.col("cost"))
    links = cut_lineage(edges.join(cost, [*keys, "candidate"]).select(
        *keys, "candidate", "covered", "cost"))
    state = cut_lineage(scaled.select(
        *keys, F.col("cell").alias("covered"), unit("main", "_m").alias("p"),
        unit("other", "_o").alias("s")).withColumn("price", F.col("p")))
    heads = cut_lineage(goals.join(sums, keys).select(
        *keys, F.col("_m").alias("scale"), unit("floor", "_o").alias("floor"),
        unit("reached", "_m").alias("reached"), F.lit(0.0).alias("mu"),
        F.lit(1.0).alias("best")))
    least = cells.agg(F.min("cost")).first()[0]
    most = int(budget // least) + 1 if least and least > 0 else None
    for step in range(steps):
        worth = links.join(state.select(*keys, "covered", "price"), [*keys, "covered"]).groupBy(
            *keys, "candidate").agg(F.sum("price").alias("r"), F.max("cost").alias("cost"))
        w = Window.partitionBy(*keys).orderBy(
            F.desc(F.col("r") / F.greatest("cost", F.lit(1e-300))), "candidate")
        if most is not None:
            worth = worth.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most)
        before = F.sum("cost").over(w) - F.col("cost")
        part = F.when(F.col("cost") > 0, (F.lit(float(budget)) - before) / F.col("cost")).otherwise(1.0)
        taken = cut_lineage(worth.withColumn("x", F.greatest(F.lit(0.0), F.least(
            F.lit(1.0), part))).where("x > 0").select(*keys, "candidate", "x", "r"))
        knapsack = taken.groupBy(*keys).agg(F.sum(F.col("x") * F.col("r")).alias("_x"))
        cover = links.join(taken.select(*keys, "candidate", "x"), [*keys, "candidate"]).groupBy(
            *keys, "covered").agg(F.sum("x").alias("_c"))
        gap = F.col("p") + F.col("mu") * F.col("s") - F.col("price")
        covered = F.coalesce("_c", F.lit(0.0))
        # at a price equal to the worth any share may be taken: the covered one is best
        y = F.when(gap > 1e-15, 1.0).when(gap < -1e-15, 0.0).otherwise(F.least(covered, F.lit(1.0)))
        moved = cut_lineage(state.join(heads.select(*keys, "mu"), keys)
                            .join(cover, [*keys, "covered"], "left")
                            .withColumn("_y", y).withColumn("_g", covered - F.col("_y"))
                            .withColumn("_v", F.greatest(gap, F.lit(0.0)))
                            .select(*keys, "covered", "p", "s", "price", "_y", "_g", "_v"))
        tally = moved.groupBy(*keys).agg(
            F.sum("_v").alias("_v"), F.sum(F.col("_g") * F.col("_g")).alias("_gg"),
            F.sum(F.col("_y") * F.col("s")).alias("_s"))
        bound = F.col("_v") + F.coalesce("_x", F.lit(0.0)) - F.col("mu") * F.col("floor")
        slack = F.col("_s") - F.col("floor")
        length = F.when(F.col("_gg") + slack * slack > 0, 0.95 ** step * F.greatest(
            F.col("_u") - F.col("reached"), F.lit(0.0)) / (F.col("_gg") + slack * slack)).otherwise(0.0)
        heads = cut_lineage(heads.join(tally, keys).join(knapsack, keys, "left")
                            .withColumn("_u", bound).withColumn("_t", length)
                            .select(*keys, "scale", "floor", "reached",
                                    F.greatest(F.lit(0.0), F.col("mu") - F.col("_t") * slack)
                                    .alias("mu"), F.least("best", "_u").alias("best"), "_t"))
        state = moved.join(heads.select(*keys, "_t"), keys).select(
            *keys, "covered", "p", "s", F.greatest(
                F.lit(0.0), F.col("price") - F.col("_t") * F.col("_g")).alias("price"))
        state = cut_lineage(state)
        heads = heads.drop("_t")
    return heads.select(*keys, (F.col("best") * F.col("scale")).alias("bound"))


def epsilon_sweep(candidates: DataFrame, coverage: DataFrame, budget: float, primary: str,
                  secondary: str, levels: int = 5, by: Sequence[str] = (),
                  key: str = "cell") -> DataFrame:
    """Floors on the secondary objective from 0 to its achievable ceiling, both ways.

    Each (group, sense, level) is one weighted greedy run: the weight moves from the
    primary to the secondary objective with the floor, and ``feasible`` says whether the
    floor was met. ``with_gaps`` adds how far from the best it can be at most.
    """
    grid = [(s, i, i / (levels - 1)) for s in ("primary", "secondary") for i in range(levels)]
    cells = F.array(*[F.struct(F.lit(s).alias("sense"), F.lit(i).alias("level"),
                               F.lit(e).alias("epsilon")) for s, i, e in grid])
    spread = candidates.select("*", F.inline(cells))
    forward = F.col("sense") == "primary"
    main = F.when(forward, F.col(primary)).otherwise(F.col(secondary))
    other = F.when(forward, F.col(secondary)).otherwise(F.col(primary))
    sums = candidates.groupBy(*by).agg(F.sum(primary).alias("_ps"), F.sum(secondary).alias("_ss"))
    spread = spread.join(sums, list(by)) if by else spread.join(F.broadcast(sums))
    main_t = F.when(forward, F.col("_ps")).otherwise(F.col("_ss"))
    other_t = F.when(forward, F.col("_ss")).otherwise(F.col("_ps"))
    norm = lambda v, t: F.when(t > 0, v / t).otherwise(0.0)
    spread = spread.withColumn("_score", norm(main, main_t) * (1.0 - F.col("epsilon"))
                               + norm(other, other_t) * F.col("epsilon"))
    keys = [*by, "sense", "level"]
    edges = coverage.select("*", F.inline(cells)).drop("epsilon")
    picks = greedy_max_coverage(spread, edges, budget, {"_score": 1.0}, keys, key=key)
    covered = (edges.join(picks.select(*keys, "candidate"), [*keys, "candidate"], "left_semi")
               .select(*keys, "covered").distinct()
               .join(candidates.select(*by, F.col(key).alias("covered"),
                                       F.col(primary).alias("_p"), F.col(secondary).alias("_s")),
                     [*by, "covered"]))
    got = covered.groupBy(*keys).agg(F.sum("_p").alias("primary_covered"),
                                     F.sum("_s").alias("secondary_covered"))
    floor_on = F.when(forward, F.col("secondary_covered")).otherwise(F.col("primary_covered"))
    top = got.withColumn("_f", floor_on).where(F.col("level") == levels - 1).select(
        *by, "sense", F.col("_f").alias("ceiling"))
    out = got.withColumn("_f", floor_on).join(top, [*by, "sense"])
    eps = F.col("level") / F.lit(float(levels - 1))
    return out.withColumns({"epsilon": eps, "floor": eps * F.col("ceiling"),
                            "feasible": F.col("_f") >= eps * F.col("ceiling") - 1e-9}).drop("_f")


def with_gaps(sweep: DataFrame, candidates: DataFrame, coverage: DataFrame, budget: float,
              primary: str, secondary: str, by: Sequence[str] = (), key: str = "cell",
              steps: int = 20) -> DataFrame:
    """The rows of ``epsilon_sweep`` with ``bound`` (see ``coverage_bound``) and ``gap``, the share
    of it that the selection misses; null where the selection does not meet the floor."""
    keys = [*by, "sense", "level"]
    sweep = cut_lineage(sweep)
    forward = F.col("sense") == "primary"
    reached = F.when(forward, F.col("primary_covered")).otherwise(F.col("secondary_covered"))
    goals = sweep.select(*keys, "floor", F.when(F.col("feasible"), reached).otherwise(0.0)
                         .cast("double").alias("reached"))
    tags = goals.select(*keys)
    cost = F.col("cost").cast("double") if "cost" in candidates.columns else F.lit(1.0)
    plain = candidates.select(*by, F.col(key).alias("cell"), cost.alias("cost"),
                              F.col(primary).cast("double").alias("_p"),
                              F.col(secondary).cast("double").alias("_s"))
    join = (lambda df: df.join(tags, list(by))) if by else (lambda df: df.join(F.broadcast(tags)))
    cells = join(plain).select(*keys, "cell", "cost",
                               F.when(forward, F.col("_p")).otherwise(F.col("_s")).alias("main"),
                               F.when(forward, F.col("_s")).otherwise(F.col("_p")).alias("other"))
    bound = coverage_bound(cells, join(coverage.select(*by, "candidate", "covered")), budget, keys,
                           goals, steps)
    return sweep.join(bound, keys).withColumn("gap", F.when(F.col("feasible"), F.when(
        F.col("bound") > 0, 1.0 - reached / F.col("bound")).otherwise(0.0)))


def selection_shortfall(heuristic: DataFrame, reference: DataFrame, by: Sequence[str],
                        objective: str) -> DataFrame:
    """(reference - heuristic) / reference per group, zero for an empty reference."""
    h = heuristic.select(*by, F.col(objective).alias("heuristic"))
    r = reference.select(*by, F.col(objective).alias("reference"))
    return r.join(h, list(by), "left").withColumn("shortfall", F.when(
        F.col("reference") > 0, (F.col("reference") - F.coalesce("heuristic", F.lit(0.0)))
        / F.col("reference")).otherwise(0.0))


def perturbation_overlap(cells: DataFrame, scales: Mapping[str, float], budget: float,
                         saturation: float, level: int, road: DataFrame | None = None,
                         by: Sequence[str] = (), k: int = 1, key: str = "cell") -> DataFrame:
    """(by, scenario, jaccard): how much of the base selection survives a scaled demand.

    Each scenario rebuilds its candidates from the cells, because the saturation limit depends on
    demand, and is solved as a group of one greedy run. Two empty selections are alike.
    """
    names = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(v)).alias("_scale"))
                      for n, v in {"base": 1.0, **scales}.items()])
    scaled = cells.select("*", F.inline(names)).withColumn(
        "demand", F.col("demand") * F.col("_scale")).drop("_scale")
    keys = [*by, "scenario"]
    kept = cut_lineage(build_candidates(scaled, saturation, road, key=[*by, key])[0])
    picks = greedy_max_coverage(kept, coverage_edges(kept, level, k, key, keys), budget,
                                {"demand": 1.0}, keys, key=key)
    has = {n: F.max(F.when(F.col("scenario") == n, 1).otherwise(0)) for n in ["base", *scales]}
    sets = picks.groupBy(*by, "candidate").agg(*[c.alias(f"_in_{n}") for n, c in has.items()])
    overlap = [F.struct(
        F.lit(n).alias("scenario"),
        F.sum(F.col("_in_base") * F.col(f"_in_{n}")).alias("both"),
        F.sum(F.greatest("_in_base", f"_in_{n}")).alias("either")) for n in scales]
    groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    found = sets.groupBy(*by).agg(F.array(*overlap).alias("_o"))
    joined = groups.join(found, list(by), "left") if by else groups.join(F.broadcast(found),
                                                                         how="left")
    none = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(0).cast("long").alias("both"),
                              F.lit(0).cast("long").alias("either")) for n in scales])
    return joined.select(*by, F.inline(F.coalesce("_o", none))).select(
        *by, "scenario", F.when(F.col("either") > 0, F.col("both") / F.col("either"))
        .otherwise(1.0).alias("jaccard"))


def selection_table(selection: DataFrame, cells: DataFrame, key: str = "cell") -> DataFrame:
    """Ranked selection with the attributes of each chosen cell."""
    return selection.join(cells, selection["candidate"] == cells[key]).select(
        "step", *[cells[c] for c in cells.columns], "gain")


def selection_counts(table: DataFrame) -> DataFrame:
    return table.agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum(F.when(F.col("existing_ports") <= 0, 1).otherwise(0)).alias("unserved"),
        F.sum(F.when(F.col("tier") == "A", 1).otherwise(0)).alias("tier_a"))


def clustering_sensitivity(base: DataFrame, moved: DataFrame, cells: DataFrame,
                           saturation: float, key: str = "cell") -> DataFrame:
    """Does moving each site to its cluster centroid change the candidate set?

    ``base`` and ``moved`` hold (cell, existing_ports) under the two placements. One row:
    candidate Jaccard and how many cells flip their saturation status.
    """
    def saturated(supply: DataFrame, name: str) -> DataFrame:
        return cells.join(supply.select(key, "existing_ports"), key, "left").select(
            key, is_saturated(F.coalesce("existing_ports", F.lit(0)), "demand", saturation)
            .alias(name))
    both = saturated(base, "_a").join(saturated(moved, "_b"), key)
    return both.agg(
        F.sum(F.when(F.col("_a") != F.col("_b"), 1).otherwise(0)).alias("saturation_flips"),
        F.coalesce(F.sum(F.when(~F.col("_a") & ~F.col("_b"), 1).otherwise(0))
                   / F.nullif(F.sum(F.when(~F.col("_a") | ~F.col("_b"), 1).otherwise(0)),
                              F.lit(0)), F.lit(1.0)).alias("candidate_jaccard"))


def compare_supply_conditions(cells: DataFrame, supply: DataFrame, conditions: Sequence[str],
                              saturation: float, level: int, budgets: Sequence[int],
                              road: DataFrame | None = None, k: int = 1,
                              key: str = "cell") -> DataFrame:
    """What placing the existing sites differently changes downstream, against the first condition.

    ``supply(condition, cell, existing_ports)``; a cell without a row has no ports. One row for each
    condition: candidates, candidate_jaccard, saturation_changes (cells), demand_delta and
    equity_delta (covered at the middle budget) and, for each budget, ``overlap_<budget>``, the
    Jaccard index of the portfolios. Conditions are groups of one greedy run at the largest budget,
    of which the smaller portfolios are the first steps.
    """
    if not budgets:
        raise ValueError("at least one budget is needed to compare portfolios")
    base, middle = conditions[0], sorted(budgets)[len(budgets) // 2]
    tagged = cells.drop("existing_ports").select("*", F.explode(F.array(*[
        F.lit(c) for c in conditions])).alias("condition"))
    applied = cut_lineage(tagged.join(
        supply.select("condition", key, "existing_ports"), ["condition", key], "left")
        .withColumn("existing_ports", F.coalesce("existing_ports", F.lit(0)))
        .withColumn("_full", is_saturated("existing_ports", "demand", saturation)))
    kept = cut_lineage(build_candidates(applied, saturation, road, key=[key])[0])
    edges = cut_lineage(coverage_edges(kept, level, k, key, ["condition"]))
    picks = cut_lineage(greedy_max_coverage(kept, edges, max(budgets), {"demand": 1.0},
                                            ["condition"], key=key))

    def jaccard_with_base(sets: DataFrame, tags: list[str], member: str) -> DataFrame:
        """(condition, tags, jaccard, n) of (condition, tags, member)."""
        own = sets.groupBy("condition", *tags).agg(F.count(F.lit(1)).alias("n"))
        first = sets.where(F.col("condition") == base).drop("condition")
        both = sets.join(first, [*tags, member]).groupBy("condition", *tags).agg(
            F.count(F.lit(1)).alias("_both"))
        total = first.groupBy(*tags).agg(F.count(F.lit(1)).alias("_first"))
        met = own.join(both, ["condition", *tags], "left")
        met = met.join(total, tags, "left") if tags else met.join(F.broadcast(total))
        return met.select(
            "condition", *tags, "n", (F.coalesce("_both", F.lit(0)) / (
                F.col("n") + F.coalesce("_first", F.lit(0)) - F.coalesce("_both", F.lit(0))))
            .alias("jaccard"))

    sets = kept.select("condition", F.col(key).alias("member"))
    candidates = jaccard_with_base(sets, [], "member").withColumnsRenamed(
        {"n": "candidates", "jaccard": "candidate_jaccard"})
    first = applied.where(F.col("condition") == base).select(key, F.col("_full").alias("_base"))
    flips = applied.join(first, key).groupBy("condition").agg(
        F.sum((F.col("_full") != F.col("_base")).cast("long")).alias("saturation_changes"))
    steps = picks.select("condition", F.col("candidate").alias("member"), F.explode(F.filter(
        F.array(*[F.lit(b) for b in budgets]), lambda b: b >= F.col("step"))).alias("budget"))
    overlap = jaccard_with_base(steps, ["budget"], "member").groupBy("condition").agg(*[
        F.max(F.when(F.col("budget") == b, F.col("jaccard"))).alias(f"overlap_{b}")
        for b in budgets])
    covered = edges.join(picks.where(F.col("step") <= middle).select("condition", "candidate"),
                         ["condition", "candidate"], "left_semi").select(
        "condition", F.col("covered").alias(key)).distinct()
    reached = covered.join(kept.select("condition", key, "demand", "equity_population"),
                           ["condition", key]).groupBy("condition").agg(
        F.sum("demand").alias("_d"), F.sum("equity_population").alias("_e"))
    shipped = reached.where(F.col("condition") == base).select(
        F.col("_d").alias("_bd"), F.col("_e").alias("_be"))
    return (flips.join(candidates, "condition", "left").join(overlap, "condition", "left")
            .join(reached, "condition", "left").join(F.broadcast(shipped), how="left")
            .select("condition", "candidates", "candidate_jaccard", "saturation_changes",
                    *[f"overlap_{b}" for b in budgets], (F.col("_d") - F.col("_bd"))
                    .alias("demand_delta"), (F.col("_e") - F.col("_be")).alias("equity_delta")))
