"""Operators over a player's seasons in order, and ranks."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import clip, mean_of_present, weighted_present
from .ranks import mean_ranks


def by_season() -> WindowSpec:
    """Seasons of a player, in order."""
    return Window.partitionBy("player_id").orderBy("season")


def so_far() -> WindowSpec:
    """All seasons of a player up to this one."""
    return by_season().rowsBetween(Window.unboundedPreceding, 0)


def lag_features(seasons: DataFrame, stats: list[str]) -> DataFrame:
    """Lags, trends, weighted lags, running sums, bests and counts of a player's seasons.

    Lags are by row, so missing seasons are skipped.  Running values are null where the value is.
    """
    out = {}
    for c in stats:
        x = F.col(c)
        one, two = F.lag(c, 1).over(by_season()), F.lag(c, 2).over(by_season())
        out |= {
            f"prev_{c}": one, f"{c}_trend": x - one,
            f"{c}_w2": weighted_present([(x, 0.65), (one, 0.35)]), f"{c}_w3": weighted_present([(x, 0.55), (one, 0.30), (two, 0.15)]),
            f"career_{c}": F.when(x.isNotNull(), F.sum(c).over(so_far())), f"best_{c}": F.when(x.isNotNull(), F.max(c).over(so_far())),
            f"{c}_seasons": F.count(c).over(so_far()),
        }
    return seasons.withColumns(out)


def mean_trend(rows: DataFrame, stats: list[str], name: str = "opportunity_trend") -> DataFrame:
    return rows.withColumn(name, mean_of_present(*[f"{c}_trend" for c in stats]))


def availability(seasons: DataFrame, scheduled: Column) -> DataFrame:
    """Share of games played, games missed now and before, three-season sums, durability, seasons with the team."""
    share = clip(F.col("games") / scheduled.cast("double"), 0.0, 1.0)
    d = seasons.withColumn("scheduled", scheduled).withColumns({"played_share": share, "missed": clip(F.col("scheduled") - F.col("games"), 0, None)})
    three = by_season().rowsBetween(-2, 0)
    lagged = [F.col("played_share"), F.lag("played_share", 1).over(by_season()), F.lag("played_share", 2).over(by_season())]
    d = d.withColumns({
        "prev1_missed": F.lag("missed", 1).over(by_season()), "prev2_missed": F.lag("missed", 2).over(by_season()), "missed_3yr": F.sum("missed").over(three),
        "durability": weighted_present(list(zip(lagged, (0.5, 0.3, 0.2), strict=True))),
        "_change": F.when(F.lag("team").over(by_season()).eqNullSafe(F.col("team")), 0).otherwise(1),
    })
    d = d.withColumn("_spell", F.sum("_change").over(so_far()))
    spell = Window.partitionBy("player_id", "_spell").orderBy("season").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("seasons_with_team", F.count("*").over(spell)).drop("_change", "_spell")


def latest_before(rows: DataFrame, outcomes: DataFrame, lookback: int = 3) -> DataFrame:
    """For each player and outcome season the latest row in the ``lookback`` seasons before it.

    A row of season t is a candidate for the outcome seasons t + 1 to t + lookback only, so rows are
    expanded to those instead of being joined with all seasons.
    """
    each = rows.withColumn("target_season", F.explode(F.sequence(F.col("season") + 1, F.col("season") + lookback)))
    each = each.join(outcomes.select(F.col("season").alias("target_season")).distinct(), "target_season", "left_semi")
    return latest(each, ["player_id", "target_season"], "season").withColumn("seasons_since", F.col("target_season") - F.col("season") - 1)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The whole last row of each key, by ``order``, then by all columns: an aggregate, not a sort of the group."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    best = F.max(F.struct(order, *rest)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, f"r.{order}", *[f"r.{c}" for c in rest])


def earliest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, order)]
    best = F.min(F.struct(order, *rest)).alias("r")
    return rows.groupBy(*keys).agg(best).select(*keys, f"r.{order}", *[f"r.{c}" for c in rest])


def most_complete(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the most values present; ties to the smallest ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    full = sum((F.col(c).isNotNull().cast("int") for c in rest[1:]), F.col(rest[0]).isNotNull().cast("int"))
    w = Window.partitionBy(*keys).orderBy(full.desc(), order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def average_rank(rows: DataFrame, by: Column, name: str, partition: list[str]) -> DataFrame:
    """Ranks by a number, the least first, with ties at their mean; none for null.  No task holds a whole group."""
    return mean_ranks(rows, partition, {name: -by})


def top_per_group(rows: DataFrame, partition: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def seasons_with_team(seasons: DataFrame) -> DataFrame:
    """How many seasons the player has had with the team, this one included."""
    return seasons.withColumn("seasons_with_team", F.dense_rank().over(Window.partitionBy("player_id", "team").orderBy("season")))


def numbered(rows: DataFrame, orders: dict[str, list[Column]], buckets: int = 256, within: tuple[str, ...] = (), inside: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Row numbers of the whole table by several orders, without a task that holds the whole table.

    ``orders``: name of the number -> columns, of which the first is a number, highest first.  Rows are dealt
    to ``buckets`` by quantiles of that number, numbered in their bucket, and moved by the rows of the
    buckets before: a table of ``buckets`` rows for each group of ``within``, or of what ``inside`` has for
    the number.
    """
    keys = {n: f"_k_{n}" for n in orders}
    d = rows.withColumns({keys[n]: F.coalesce(cols[0].cast("double"), F.lit(float("-inf"))) for n, cols in orders.items()})
    d = d.persist(StorageLevel.MEMORY_AND_DISK)  # read once for the edges and once for each order; lost blocks are computed again
    probabilities = [i / buckets for i in range(1, buckets)]
    edges = d.approxQuantile(list(keys.values()), probabilities, 0.25 / buckets)  # buckets numbers for each order
    for name, at in zip(orders, edges, strict=True):
        step, key = F.array(*[F.lit(float(x)) for x in sorted(set(at), reverse=True)]), F.col(keys[name])
        d = d.withColumn(f"_b_{name}", F.size(F.filter(step, lambda e: e > key)) if at else F.lit(0))  # noqa: B023
    out = d
    groups = {name: (inside or {}).get(name, within) for name in orders}
    for name, cols in orders.items():
        within = groups[name]
        before = d.groupBy(*within, f"_b_{name}").agg(F.count("*").alias("_n"))  # from the rows as given, so plans don't nest
        w = Window.partitionBy(*within).orderBy(f"_b_{name}").rowsBetween(Window.unboundedPreceding, -1)
        before = before.select(*within, f"_b_{name}", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy(*within, f"_b_{name}").orderBy(F.col(keys[name]).desc(), *cols[1:]))
        out = out.withColumn("_own", own).join(before, [*within, f"_b_{name}"]).withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).drop("_own", "_before")
    return out.drop(*keys.values(), *[f"_b_{n}" for n in orders])
