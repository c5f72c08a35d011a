"""Forecasts without a model for every fold at once: means and medians of the seasons before, and a player's own past.

A fold is a group and an outcome season; what it may learn from are the rows of its group with earlier ones.
Sums by season are added up over the seasons before; medians come from quantile sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import age_band, weighted_present
from . import sketches
from .lineage import written
from .projection import previous_rate, previous_total
from .ranks import matched, quantiles

#: Names of the forecasts, in the order in which ties are settled.
NAMES = (
    "previous_season_total", "previous_season_per_game", "two_year_weighted_average", "three_year_weighted_average", "position_age_group_average",
    "historical_median_comparable_opportunity",
)


def _number(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def fold_sizes(rows: DataFrame, by: list[str], season: str, least: int = 1) -> DataFrame:
    """``by, fold, rows``: the seasons of each group that have ``least`` rows before them."""
    n = rows.groupBy(*by, season).agg(F.count("*").alias("n"))  # a row for each group and season
    before = n.select(*by, F.col(season).alias("_s"), "n")
    d = matched(n.select(*by, F.col(season).alias("fold")), before, by, "inner").where("_s < fold").groupBy(*by, "fold").agg(F.sum("n").alias("rows"))
    return d.where(F.col("rows") >= least)


def past_means(rows: DataFrame, by: list[str], keys: list[str], season: str, targets: list[str], folds: DataFrame) -> DataFrame:
    """``by, keys, fold, n`` and the means of the targets over the seasons before the fold; missing outcomes count 0."""
    sums = rows.groupBy(*by, *keys, F.col(season).alias("_s")).agg(F.count("*").alias("n"), *[F.sum(_number(t)).alias(t) for t in targets])
    d = matched(sums, folds.select(*by, "fold"), by, "inner").where("_s < fold")
    return d.groupBy(*by, *keys, "fold").agg(F.sum("n").alias("n"), *[(F.sum(t) / F.sum("n")).alias(t) for t in targets])


def past_edges(rows: DataFrame, by: list[str], season: str, opportunity: str, folds: DataFrame, tiers: int = 4, k: int = sketches.K, exact: bool = False) -> DataFrame:
    """``by, fold, edges``: distinct quantiles of opportunity before the fold, merged from a sketch, or from exact counts, for each season; none under two rows a tier."""
    if exact:
        counts = rows.groupBy(*by, F.col(season).alias("_s"), _number(opportunity).alias("_o")).agg(F.count("*").alias("_rows"))
        before = matched(counts, folds.select(*by, "fold"), by, "inner").where("_s < fold")
        whole = quantiles(before, [*by, "fold"], F.col("_o"), {f"_q{i}": i / tiers for i in range(1, tiers)}, linear=False, weight=F.col("_rows"))
        at = F.array_sort(F.array_distinct(F.array(*[f"_q{i}" for i in range(1, tiers)])))
        return whole.select(*by, "fold", F.when(F.col("n") >= 2 * tiers, at).otherwise(F.array().cast("array<double>")).alias("edges"))
    parts = sketches.states(rows.withColumn("_s", F.col(season)), [*by, "_s"], _number(opportunity), k)
    whole = sketches.merged(matched(parts, folds.select(*by, "fold"), by, "inner").where("_s < fold"), [*by, "fold"])
    at = F.array_sort(F.array_distinct(F.array(*[sketches.quantile("state", i / tiers) for i in range(1, tiers)])))
    return whole.select(*by, "fold", F.when(F.col("n") >= 2 * tiers, at).otherwise(F.array().cast("array<double>")).alias("edges"))


def past_medians(rows: DataFrame, by: list[str], season: str, opportunity: str, targets: list[str], edges: DataFrame, k: int = sketches.K, exact: bool = False) -> DataFrame:
    """``by, fold, tier, target, median``: medians of each tier of opportunity before the fold; tier -1 is all tiers.

    Tiers differ by fold, so a row counts once for each later fold; only sketches, or exact counts of values, of
    (fold, tier) are shuffled.
    """
    each = F.array(*[F.struct(F.lit(t).alias("target"), _number(t).alias("y")) for t in targets])
    d = matched(rows.select(*by, F.col(season).alias("_s"), _number(opportunity).alias("_o"), F.explode(each).alias("_t")), F.broadcast(edges), by, "inner").where("_s < fold")
    d = d.select(*by, "fold", "_t.target", "_t.y", sketches.tier(F.col("_o"), F.col("edges")).alias("tier"))
    if exact:
        keys = [*by, "fold", "target", "tier"]
        counts = written(d.groupBy(*keys, "y").agg(F.count("*").alias("_rows")))
        both = counts.unionByName(counts.withColumn("tier", F.lit(-1)))
        return quantiles(both, keys, F.col("y"), {"median": 0.5}, linear=False, weight=F.col("_rows")).select(*by, "fold", "tier", "target", "median")
    parts = sketches.states(d, [*by, "fold", "target", "tier"], F.col("y"), k)
    whole = sketches.merged(parts, [*by, "fold", "target"]).withColumn("tier", F.lit(-1))
    return parts.unionByName(whole).select(*by, "fold", "tier", "target", sketches.quantile("state", 0.5).alias("median"))


def fold_baselines(
    pairs: DataFrame, stats: list[str], by: list[str] | None = None, season: str = "target_season", age: str = "age", opportunity: str = "fantasy_points_ppr", least: int = 150, k: int = sketches.K, exact: bool = False
) -> DataFrame:
    """``by, season, target, player_id, model, predicted, actual`` of all forecasts and folds, one plan.

    ``pairs`` have each statistic, ``prev_*`` and ``prev2_*`` of it, its ``outcome_*``, ``games``, an age and an
    opportunity.  The age forecast is the mean of the group and age band, else of the group; the opportunity
    forecast the median of the tier, else of the group; from sketches of size ``k``, or exactly.
    """
    by = by or ["position"]
    targets = [f"outcome_{s}" for s in stats]
    past = [c for s in stats for c in (s, f"prev_{s}", f"prev2_{s}")]
    rows = written(pairs.select(*by, season, "player_id", *dict.fromkeys([*past, "games", age, opportunity, *targets])).withColumn("_band", age_band(age)))  # it is read for sums, sketches and forecasts
    folds = written(fold_sizes(rows, by, season, least))
    edges = written(past_edges(rows, by, season, opportunity, folds, k=k, exact=exact))
    medians = written(past_medians(rows, by, season, opportunity, targets, edges, k, exact))
    bands, groups = (past_means(rows, by, keys, season, targets, folds) for keys in (["_band"], []))

    test = rows.withColumn("fold", F.col(season)).join(F.broadcast(folds.select(*by, "fold")), [*by, "fold"])  # a row for each group and season
    d = matched(test, F.broadcast(edges), [*by, "fold"], "inner").withColumn("tier", sketches.tier(_number(opportunity), F.col("edges")))
    d = matched(matched(d, bands.drop("n").withColumnsRenamed({t: f"_b_{t}" for t in targets}), [*by, "fold", "_band"]), groups.drop("n").withColumnsRenamed({t: f"_g_{t}" for t in targets}), [*by, "fold"])
    own = {
        s: {
            NAMES[0]: previous_total(s), NAMES[1]: previous_rate(s), NAMES[2]: F.coalesce(weighted_present([(s, 0.65), (f"prev_{s}", 0.35)]), F.lit(0.0)),
            NAMES[3]: F.coalesce(weighted_present([(s, 0.5), (f"prev_{s}", 0.3), (f"prev2_{s}", 0.2)]), F.lit(0.0)), NAMES[4]: F.coalesce(f"_b_outcome_{s}", f"_g_outcome_{s}"),
        }
        for s in stats
    }
    each = [F.struct(F.lit(f"outcome_{s}").alias("target"), _number(f"outcome_{s}").alias("actual"), F.array(*[F.struct(F.lit(n).alias("model"), c.alias("predicted")) for n, c in own[s].items()]).alias("m")) for s in stats]
    long = d.select(*by, season, "player_id", "fold", "tier", F.explode(F.array(*each)).alias("_t")).select(*by, season, "player_id", "fold", "tier", "_t.*")
    keys = [*by, "fold", "target"]
    own_tier = matched(long, medians.where("tier >= 0"), [*keys, "tier"])
    both = matched(own_tier, medians.where("tier < 0").select(*keys, F.col("median").alias("_whole")), keys)
    last = F.struct(F.lit(NAMES[5]).alias("model"), F.coalesce("median", "_whole").alias("predicted"))
    out = both.select(*by, season, "target", "player_id", "actual", F.explode(F.concat("m", F.array(last))).alias("_m"))
    return out.select(*by, season, "target", "player_id", "_m.model", "_m.predicted", "actual")
