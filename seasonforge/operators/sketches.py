"""Quantiles from mergeable sketches: states by group, merged upwards, no sort of a whole table.

A state holds some ``3 * k`` values whatever the number of rows.  The rank of an estimate is off by 1.3 % at
k = 200, by 0.08 % at k = 4,096 (in 99 of 100 cases); with fewer rows than k it is exact: the smallest value
that so many of the rows do not exceed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size parameter of a sketch.
K = 4096


def states(rows: DataFrame, by: list[str], value: Column, k: int = K) -> DataFrame:
    """``by, n, state``: a sketch of the present values of each group."""
    v = value.cast("double")
    d = rows.select(*by, F.when(~F.isnan(v), v).alias("_v")).where("_v is not null")
    return d.groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", F.lit(k)).alias("state"))


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """``by, n, state`` of coarser groups, from the states of finer ones: the rows are not read again."""
    return parts.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("state").alias("state"))


def quantile(state: str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(state, F.lit(float(p)))


def tier(opportunity: Column, edges: Column) -> Column:
    """How many edges are under the value; the first tier without edges or value."""
    return F.coalesce(F.size(F.filter(edges, lambda e: e < opportunity)), F.lit(0))


def tier_edges(rows: DataFrame, opportunity: str, tiers: int = 4, k: int = K) -> DataFrame:
    """``edges``: one row with the distinct quantiles that part the rows into tiers; none under two rows a tier."""
    whole = states(rows, [], F.col(opportunity), k)
    at = F.array_sort(F.array_distinct(F.array(*[quantile("state", i / tiers) for i in range(1, tiers)])))
    return whole.select(F.when(F.col("n") >= 2 * tiers, at).otherwise(F.array().cast("array<double>")).alias("edges"))


def fit_intervals(train: DataFrame, opportunity: str, low: float = 0.2, high: float = 0.8, tiers: int = 4, least: int = 40, k: int = K) -> DataFrame:
    """``tier, n, low, high, edges``: residual quantiles (``actual - predicted``) of each tier of opportunity.

    A tier of fewer than ``least`` rows, or none, has those of all rows, merged from the tiers' states.
    """
    ok = train.where("actual is not null and predicted is not null").where(F.col(opportunity).isNotNull())
    edges = F.broadcast(tier_edges(ok, opportunity, tiers, k))  # a single row
    marked = ok.join(edges).select(tier(F.col(opportunity), F.col("edges")).alias("tier"), (F.col("actual") - F.col("predicted")).alias("_r"))
    parts = states(marked, ["tier"], F.col("_r"), k)
    whole = merged(parts, []).select(quantile("state", low).alias("_low"), quantile("state", high).alias("_high"))
    all_tiers = train.sparkSession.range(tiers).select(F.col("id").cast("int").alias("tier"))
    d = all_tiers.join(parts, "tier", "left").join(F.broadcast(whole)).join(edges)  # single rows
    own = F.coalesce(F.col("n"), F.lit(0)) >= least
    return d.select("tier", F.coalesce("n", F.lit(0)).alias("n"), F.when(own, quantile("state", low)).otherwise(F.col("_low")).alias("low"), F.when(own, quantile("state", high)).otherwise(F.col("_high")).alias("high"), "edges")


def intervals(rows: DataFrame, fitted: DataFrame | None, opportunity: str, point: str = "predicted") -> DataFrame:
    """``low, mid, high`` around a prediction; without a fit, a quarter of it and 5 at least to either side."""
    x = F.col(point).cast("double")
    if fitted is None:
        wide = F.greatest(F.abs(x) * 0.25, F.lit(5.0))
        return rows.withColumns({"low": x - wide, "mid": x, "high": x + wide})
    one = F.broadcast(fitted.agg(F.first("edges").alias("_edges"), F.map_from_entries(F.collect_list(F.struct("tier", F.struct("low", "high")))).alias("_q")))  # one row, a few tiers
    d = rows.join(one).withColumn("_b", F.try_element_at("_q", tier(F.col(opportunity), F.col("_edges"))))
    return d.withColumns({"low": F.least(x, x + F.col("_b.low")), "mid": x, "high": F.greatest(x, x + F.col("_b.high"))}).drop("_edges", "_q", "_b")
