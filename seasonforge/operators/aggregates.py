"""Season tables from weekly and play-level facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio


def weighted_rate(rate: str, weight: str) -> Column:
    """Mean of a rate by volume: rows without a rate don't count; null without volume."""
    w = F.sum(F.when(F.col(rate).isNotNull(), F.col(weight)))
    return F.when(w > 0, F.sum(F.col(rate) * F.col(weight)).cast("double") / w)


def player_seasons(weekly: DataFrame, sums: list[str], regular: str = "REG") -> DataFrame:
    """One row per player and season: games (distinct weeks), last team and position, number of teams, sums.

    ``weekly`` has player_id, season, week, team, position, season_type.  The last team is that of the
    latest week, by name on ties; the last position is the latest that is not null.
    """
    if not weekly.columns:
        raise ValueError("no weekly facts")
    latest = F.struct("week", "team")
    return weekly.where(F.col("season_type") == regular).groupBy("player_id", "season").agg(
        F.countDistinct("week").alias("games"),
        F.max(latest)["team"].alias("team"),
        F.countDistinct("team").alias("teams"),
        F.max(F.when(F.col("position").isNotNull(), F.struct("week", "position")))["position"].alias("position"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )


def team_seasons(weekly: DataFrame, sums: list[str]) -> DataFrame:
    """One row per team and season with ``team_`` sums, games and sums per game."""
    d = weekly.groupBy("team", "season").agg(F.countDistinct("week").alias("team_games"), *[F.sum(c).alias(f"team_{c}") for c in sums])
    return d.select("*", *[safe_ratio(f"team_{c}", "team_games").alias(f"team_{c}_per_game") for c in sums])


def games_per_season(schedule: DataFrame) -> DataFrame:
    """Most games of any team in each season; ``schedule`` has season, home_team, away_team."""
    both = schedule.select("season", F.explode(F.array("home_team", "away_team")).alias("team"))
    return both.groupBy("season", "team").agg(F.count("*").alias("n")).groupBy("season").agg(F.max("n").alias("games"))


def points_per_game(schedule: DataFrame) -> DataFrame:
    """Mean score of each team and season over home and away games."""
    sides = F.array(F.struct(F.col("home_team").alias("team"), F.col("home_score").alias("score")), F.struct(F.col("away_team").alias("team"), F.col("away_score").alias("score")))
    d = schedule.select("season", F.inline(sides))
    return d.groupBy("team", "season").agg(F.avg("score").alias("points_per_game"))


def depth_summary(depth: DataFrame) -> DataFrame:
    """Median and last rank of a player's depth entries, last team, and whether they started (median of 1)."""
    last = F.max(F.struct("at", "rank", "team"))
    d = depth.groupBy("player_id", "season").agg(F.median("rank").alias("median_rank"), last["rank"].alias("final_rank"), last["team"].alias("final_team"))
    return d.withColumn("starter", F.col("median_rank") <= 1)


def prefer_totals(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of metrics: of the week-0 totals of a player and season if there are any, else of all weeks."""
    has = F.max((F.col("week") == 0).cast("int"))
    chosen = lambda c: F.when(has == 1, F.avg(F.when(F.col("week") == 0, F.col(c)))).otherwise(F.avg(c))
    return rows.groupBy("player_id", "season").agg(*[chosen(c).alias(c) for c in metrics])


def situational(plays: DataFrame) -> DataFrame:
    """Counts and shares of kinds of plays, by player and season.

    ``plays`` has player_id, season, yardline, down, gained.  Red zone: 20 yards or less; inside five;
    explosive: a gain of 10 or more; stuffed: none; success: a positive gain.
    """
    share = lambda c: F.avg(c.cast("double"))
    return plays.groupBy("player_id", "season").agg(
        F.count_if(F.col("yardline") <= 20).alias("red_zone"), F.count_if(F.col("yardline") <= 5).alias("inside_five"),
        share(F.col("gained") >= 10).alias("explosive_rate"), share(F.col("gained") <= 0).alias("stuffed_rate"), share(F.col("gained") > 0).alias("success_rate"),
        F.avg(F.when(F.col("down") == 3, (F.col("gained") > 0).cast("double"))).alias("third_down_rate"),
    )


def pace(plays: DataFrame, about: int | None = None, most: int = 500_000) -> DataFrame:
    """Seconds per play of a team and season: spans of games, over their plays.

    ``about``: how many plays there are, if known.  They are then dealt by game to tasks of some ``most`` plays, so
    that the table of games of a task does not grow with the input.
    """
    if about is not None:
        plays = plays.select("team", "season", "game_id", "clock").repartition(max(1, -(-about // most)), "game_id")
    game = plays.groupBy("team", "season", "game_id").agg((F.max("clock") - F.min("clock")).alias("span"), F.count("*").alias("plays"))
    return game.groupBy("team", "season").agg((F.sum("span").cast("double") / F.sum("plays")).alias("pace"))


def vacated(rows: DataFrame, amount: str) -> DataFrame:
    """Share of a team's amount that belongs to players whose next team is another one; unknown next teams don't count."""
    known = F.col("next_team").isNotNull()
    gone = F.sum(F.when(known & (F.col("next_team") != F.col("team")), F.col(amount)).otherwise(0))
    d = rows.groupBy("team", "season").agg(safe_ratio(gone, F.sum(F.when(known, F.col(amount)))).alias("vacated_share"))
    return d.withColumn("returning_share", F.lit(1.0) - F.col("vacated_share"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values that are not null: one pass, one row per column."""
    one = rows.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "coverage")


def pearson(x: str, y: str) -> Column:
    """Correlation of the rows where both are present; null without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def long_to_wide(rows: DataFrame, ids: list[str], category: str, kind: str, value: str, names: list[str]) -> DataFrame:
    """One column for each ``category_kind``: sums of values, null where there are none.  Names are given, so one pass does."""
    key = F.lower(F.concat_ws("_", category, kind))
    return rows.withColumn("_k", key).groupBy(*ids).pivot("_k", names).agg(F.sum(value))
