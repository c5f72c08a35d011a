"""Features of a season, and pairs of a season's features with a later outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import age_at, bmi, clip, safe_ratio
from .windows import latest_before


def rates(rows: DataFrame, spec: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Ratios with a least denominator: name -> (numerator, denominator, least); null where a column is not there."""
    have = set(rows.columns)
    return rows.withColumns({n: safe_ratio(a, b, m) if {a, b} <= have else F.lit(None).cast("double") for n, (a, b, m) in spec.items()})


# Ratios by position, as numerator, denominator and least volume.
PASSING = {
    "completion_pct": ("completions", "attempts", 50), "yards_per_attempt": ("passing_yards", "attempts", 50), "td_rate": ("passing_tds", "attempts", 50),
    "interception_rate": ("interceptions", "attempts", 50), "sack_rate": ("sacks", "dropbacks", 50), "air_conversion": ("passing_yards", "passing_air_yards", 100),
    "passing_yards_per_game": ("passing_yards", "games", 0), "carries_per_game": ("carries", "games", 0), "yards_per_carry": ("rushing_yards", "carries", 20),
}
RUSHING = {
    "carries_per_game": ("carries", "games", 0), "yards_per_carry": ("rushing_yards", "carries", 20), "rush_td_rate": ("rushing_tds", "carries", 20),
    "catch_rate": ("receptions", "targets", 15), "yards_per_reception": ("receiving_yards", "receptions", 10), "rush_share": ("carries", "team_carries", 0),
}
RECEIVING = {
    "targets_per_game": ("targets", "games", 0), "catch_rate": ("receptions", "targets", 15), "yards_per_target": ("receiving_yards", "targets", 15),
    "yards_per_reception": ("receiving_yards", "receptions", 10), "depth_of_target": ("receiving_air_yards", "targets", 15), "air_conversion": ("receiving_yards", "receiving_air_yards", 100),
    "target_share": ("targets", "team_targets", 0),
}


def adjusted_yards(rows: DataFrame) -> DataFrame:
    """Yards per attempt with 20 for a touchdown and -45 for an interception; missing counts of either are none."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.withColumn("adjusted_yards", safe_ratio(F.col("passing_yards") + 20 * n("passing_tds") - 45 * n("interceptions"), "attempts", 50))


def routes(rows: DataFrame) -> DataFrame:
    """Routes from snaps and the team's share of passes, and rates per route."""
    d = rows.withColumn("routes", F.col("snaps") * F.col("team_pass_rate"))
    return d.withColumns({"targets_per_route": safe_ratio("targets", "routes", 50), "yards_per_route": safe_ratio("receiving_yards", "routes", 50)})


def body_and_capital(rows: DataFrame) -> DataFrame:
    """Entry season, experience, body mass, whether undrafted, log of draft capital (0 without a pick from 1 on, down to minus infinity at 264)."""
    entry = F.coalesce("rookie_year", "entry_year", "draft_year")
    left = F.lit(263.0) - F.col("draft_pick")
    capital = F.when(left > -1, F.log1p(left)).when(left == -1, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return rows.withColumns({
        "entry_season": entry, "experience": clip(F.col("season") - entry, 0), "bmi": bmi("weight", "height"),
        "is_undrafted": F.col("draft_pick").isNull().cast("int"), "draft_capital_log": F.when(F.col("draft_pick") > 0, capital).otherwise(0.0),
    })


def age_features(rows: DataFrame) -> DataFrame:
    d = rows.withColumn("age", age_at("birth_date", "target_season"))
    return d.withColumns({"age_squared": F.col("age") * F.col("age"), "experience_at_target": clip(F.col("target_season") - F.col("entry_season"), 0), "is_rookie": (F.col("entry_season") == F.col("target_season")).cast("int")})


def era_flags(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"anomalous_season": F.col("season").isin(2020, 2021).cast("int"), "seventeen_games": (F.col("season") >= 2021).cast("int")})


def own_share(rows: DataFrame, amount: str, group: list[str], name: str) -> DataFrame:
    """A row's share of its group's amount."""
    return rows.withColumn(name, safe_ratio(amount, F.sum(amount).over(Window.partitionBy(*group))))


def competition(rows: DataFrame, room: DataFrame, amount: str) -> DataFrame:
    """Share of the amount at the projected team that belongs to others; the room is grouped by next team."""
    total = room.groupBy(F.col("next_team").alias("projected_team")).agg(F.sum(amount).alias("_room"))
    d = rows.join(total, "projected_team", "left")
    return d.withColumn("competition", safe_ratio(F.col("_room") - F.coalesce(amount, F.lit(0)), "_room")).drop("_room")


def leader_context(rows: DataFrame, amount: str, value: str) -> DataFrame:
    """Value of the player with the largest amount in each team and season (smallest id on ties), and whether the player changed."""
    best = rows.groupBy("team", "season").agg(F.max(F.struct(amount, (-F.col("player_id")).alias("neg"), value)).alias("b"))
    d = best.select("team", "season", (-F.col("b.neg")).alias("leader"), F.col(f"b.{value}").alias(f"leader_{value}"))
    return d.withColumn("leader_changed", (F.lag("leader").over(Window.partitionBy("team").orderBy("season")) != F.col("leader")).cast("int"))


def modelling_pairs(features: DataFrame, outcomes: DataFrame, targets: list[str], lookback: int = 3) -> DataFrame:
    """Features of the latest season within ``lookback`` before each outcome season, with what happened then.

    A player without a row in the outcome season did not play: outcomes 0, ``target_played`` 0.
    """
    d = latest_before(features, outcomes, lookback)
    o = outcomes.select("player_id", F.col("season").alias("target_season"), *[F.col(c).alias(f"outcome_{c}") for c in targets], F.lit(1).alias("target_played"))
    d = d.join(o, ["player_id", "target_season"], "left")
    return d.withColumns({c: F.coalesce(c, F.lit(0)) for c in [*[f"outcome_{t}" for t in targets], "target_played"]})


def usable_columns(rows: DataFrame, wanted: list[str]) -> list[str]:
    """Wanted columns that are there and numeric."""
    kinds = {f.name: f.dataType for f in rows.schema}
    return [c for c in wanted if isinstance(kinds.get(c), T.NumericType)]
