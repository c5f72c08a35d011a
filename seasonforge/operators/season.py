"""The season feature table: dimension, optional sources, team context, statuses and features by position, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import mean_of_present, safe_ratio, weighted_present
from . import nearest
from .features import adjusted_yards, body_and_capital, era_flags, rates, routes
from .ranks import correlations, paired_correlations
from .windows import availability, by_season, so_far

KEYS = ["player_id", "season"]
# Statuses of the active roster, and the columns of a team's own context.
ACTIVE = ("ACT", "A01")
OWN = ("team_pass_attempts", "team_rush_attempts", "team_targets", "team_plays", "team_dropbacks")
PLAIN = ("team_pass_rate", "team_rz_rush_plays", "team_rz_pass_plays")
POSITIONS = ("QB", "RB", "WR", "TE")
RED_ZONE = 20


def attach(rows: DataFrame, *sources: DataFrame | None) -> DataFrame:
    """Sources of a row for a player and season, joined in order; what is absent is skipped, columns that are there already are dropped."""
    for s in sources:
        if s is not None:
            rows = rows.join(s.drop(*[c for c in s.columns if c in rows.columns and c not in KEYS]), KEYS, "left")
    return rows


def attach_suffixed(rows: DataFrame, other: DataFrame, on: list[str], suffix: str, how: str = "left") -> DataFrame:
    """A join in which colliding columns of the other side get a suffix."""
    return rows.join(other.withColumnsRenamed({c: f"{c}{suffix}" for c in other.columns if c in rows.columns and c not in on}), on, how)


def attach_dimension(rows: DataFrame, players: DataFrame, rosters: DataFrame) -> DataFrame:
    """Biography of the player, completed from the season's roster; entry season, experience, body and draft capital."""
    bio = ("birth_date", "height", "weight")
    d = rows.join(players, "player_id", "left").join(rosters.select(*KEYS, "entry_year", *[F.col(c).alias(f"_{c}") for c in bio]), KEYS, "left")
    return body_and_capital(d.withColumns({c: F.coalesce(c, f"_{c}") for c in bio}).drop(*[f"_{c}" for c in bio]))


def own_team(rows: DataFrame, context: DataFrame) -> DataFrame:
    """Volume of the team that the player was at, as ``own_*``; its rate of passes and red-zone plays under their names."""
    own = [F.col(c).alias(f"own_{c}") for c in OWN if c in context.columns]
    return rows.join(context.select("team", "season", *own, *[c for c in PLAIN if c in context.columns]), ["team", "season"], "left")


def team_context(seasons: DataFrame, plays: DataFrame | None, names: list[str]) -> DataFrame:
    """Team seasons with play aggregates; of the named columns the missing ones are null, all are doubles."""
    d = seasons if plays is None else seasons.join(plays, ["team", "season"], "left")
    return d.select("team", "season", *[(F.col(n) if n in d.columns else F.lit(None)).cast("double").alias(n) for n in names])


def regular(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of the regular season, where there is a column that tells."""
    return rows.where(F.col(kind) == "REG") if kind in rows.columns else rows


def team_plays(plays: DataFrame) -> DataFrame:
    """Red-zone volume, neutral pass rate and mean value of a team's regular plays.

    Neutral: a win probability from 0.2 to 0.8 and over 120 seconds left in the half.
    """
    d = regular(plays, "season_type").where(F.col("team").isNotNull() & F.col("play_type").isin("pass", "run"))
    near, passed = F.col("yardline") <= RED_ZONE, F.col("play_type") == "pass"
    neutral = F.col("wp").between(0.2, 0.8) & (F.col("half_seconds") > 120)
    return d.groupBy("team", "season").agg(
        F.count("*").alias("team_plays"), F.count_if(near).alias("team_rz_plays"), F.count_if(near & passed).alias("team_rz_pass_plays"),
        F.count_if(near & ~passed).alias("team_rz_rush_plays"), F.avg(F.when(neutral, passed.cast("double"))).alias("team_neutral_pass_rate"), F.avg("epa").alias("team_epa"),
    )


def snap_totals(snaps: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Snaps, mean share and games by regular season of the players that the crosswalk knows under the foreign id.

    Aggregated before the join, so only a row for a player and season meets the crosswalk.
    """
    d = regular(snaps, "game_type").groupBy("foreign_id", "season").agg(F.sum("snaps").cast("double").alias("snaps"), F.avg("share").alias("snap_share"), F.count_distinct("week").alias("snap_games"))
    known = crosswalk.where("foreign_id is not null").groupBy("foreign_id").agg(F.min("player_id").alias("player_id"))
    return d.join(known, "foreign_id").drop("foreign_id")


def roster_status(rows: DataFrame, rosters: DataFrame) -> DataFrame:
    """Whether the player was on the active roster of the season; null if unknown."""
    d = attach(rows, rosters.select(*KEYS, "status"))
    return d.withColumn("roster_active", F.col("status").isin(*ACTIVE).cast("int"))


def depth_chart(rows: DataFrame, depth: DataFrame | None) -> DataFrame:
    """Published depth rank and whether a starter; null without a depth chart."""
    if depth is None:
        return rows.withColumns({"depth_rank": F.lit(None).cast("double"), "starter": F.lit(None).cast("int")})
    return attach(rows, depth.select(*KEYS, "depth_rank", "starter"))


# Ratios by position, as numerator, denominator and least volume.
PASSER = {
    "dropbacks_per_game": ("dropbacks", "games", 0), "attempts_per_game": ("pass_attempts", "games", 0), "completion_pct": ("completions", "pass_attempts", 50),
    "yards_per_attempt": ("passing_yards", "pass_attempts", 50), "passing_td_rate": ("passing_tds", "pass_attempts", 50), "interception_rate": ("interceptions", "pass_attempts", 50),
    "air_yards_per_attempt": ("passing_air_yards", "pass_attempts", 50), "first_down_rate": ("passing_first_downs", "pass_attempts", 50), "sack_rate": ("sacks", "dropbacks", 50),
    "qb_carries_per_game": ("carries", "games", 0), "qb_yards_per_carry": ("rushing_yards", "carries", 20), "qb_rushing_td_rate": ("rushing_tds", "carries", 20),
    "air_conversion": ("passing_yards", "passing_air_yards", 100), "dropback_share": ("dropbacks", "own_team_dropbacks", 0),
}
RUNNER = {
    "carries_per_game": ("carries", "games", 0), "opportunity_per_game": ("weighted_opportunity", "games", 0), "yards_per_carry": ("rushing_yards", "carries", 20),
    "rushing_td_rate": ("rushing_tds", "carries", 20), "catch_rate": ("receptions", "targets", 15), "yards_per_target": ("receiving_yards", "targets", 15),
    "yards_per_reception": ("receiving_yards", "receptions", 10), "rush_share": ("carries", "own_team_rush_attempts", 0), "rz_carry_share": ("rz_carries", "team_rz_rush_plays", 0),
    "goal_line_share": ("inside_five_carries", "rz_carries", 0),
}
CATCHER = {
    "targets_per_game": ("targets", "games", 0), "catch_rate": ("receptions", "targets", 15), "yards_per_target": ("receiving_yards", "targets", 15),
    "yards_per_reception": ("receiving_yards", "receptions", 10), "after_catch": ("yards_after_catch", "receptions", 10), "receiving_td_rate": ("receiving_tds", "targets", 15),
    "depth_of_target": ("receiving_air_yards", "targets", 15), "target_share": ("targets", "own_team_targets", 0),
}


def passers(rows: DataFrame) -> DataFrame:
    """Passing features; dropbacks are attempts and sacks where they are not given."""
    made = F.coalesce(F.col("pass_attempts"), F.lit(0)) + (F.coalesce(F.col("sacks"), F.lit(0)) if "sacks" in rows.columns else F.lit(0))
    d = rows if "dropbacks" in rows.columns else rows.withColumn("dropbacks", made)
    return adjusted_yards(rates(d, PASSER).withColumn("attempts", F.col("pass_attempts"))).drop("attempts")


def runners(rows: DataFrame) -> DataFrame:
    """Rushing features; a target weighs as two carries."""
    d = rows.withColumn("weighted_opportunity", F.coalesce(F.col("carries"), F.lit(0)) + 2 * F.coalesce(F.col("targets"), F.lit(0)))
    return rates(d, RUNNER)


def catchers(rows: DataFrame) -> DataFrame:
    """Receiving features; yards per air yard from 100 air yards on, the published value first."""
    d = rates(rows, CATCHER)
    if not {"receiving_yards", "receiving_air_yards"} <= set(rows.columns):
        return d
    derived = safe_ratio("receiving_yards", "receiving_air_yards", 100)
    return d.withColumn("racr", F.coalesce("racr", derived) if "racr" in rows.columns else derived)


def tight_ends(rows: DataFrame) -> DataFrame:
    """Receiving features, the share of the targets of the team's tight ends, routes per dropback, and blocking snaps."""
    d = catchers(rows)
    room = F.sum(F.when(F.col("position") == "TE", F.coalesce(F.col("targets"), F.lit(0)))).over(Window.partitionBy("team", "season"))
    d = d.withColumn("te_target_share", safe_ratio(F.col("targets"), room))
    if "routes" in d.columns:
        d = d.withColumns({"routes_per_dropback": safe_ratio("routes", "own_team_dropbacks"), "inline_gap": F.col("snap_share") - F.col("route_participation")})
    return d


def season_table(seasons: DataFrame, players: DataFrame, rosters: DataFrame, context: DataFrame, depth: DataFrame | None = None, sources: tuple[DataFrame | None, ...] = ()) -> DataFrame:
    """Features of every player and season: each step adds columns to the ones before, later ones win."""
    d = attach(attach_dimension(seasons, players, rosters), *sources)
    d = depth_chart(roster_status(own_team(d, context), rosters), depth)
    d = passers(d) if "pass_attempts" in d.columns else d
    return era_flags(tight_ends(runners(d)))


def shared_rates(rows: DataFrame) -> DataFrame:
    """Points, lost fumbles and rushing yards per game."""
    return rates(rows, {f"{c}_per_game": (c, "games", 0) for c in ("fantasy_points_ppr", "fumbles_lost", "rushing_yards")})


# Usage whose change is a trend, columns summed up over a career, and those kept from the season before.
TRENDS = {"fantasy_points_ppr_per_game": "fantasy_points_ppr_trend", "targets_per_game": "target_trend", "carries_per_game": "carry_trend", "snap_share": "snap_share_trend"}
CAREER = {"fantasy_points_ppr": "career_fantasy_points", "games": "career_games", **{c: f"career_{c}" for c in ("targets", "carries", "pass_attempts", "receptions")}}
BEFORE = ("fantasy_points_ppr", "targets", "carries", "receptions", "games")


def history(rows: DataFrame) -> DataFrame:
    """Weighted seasons, trends, career sums and bests, and values of the season before: all from a player's own past.

    Seasons are taken by row, so one that is missing is skipped; weights of missing values go to the rest.
    Columns that the rows have not are skipped, except for the points.
    """
    have = set(rows.columns)
    lag = lambda c, k: F.lag(c, k).over(by_season())
    new = {}
    for c in ("fantasy_points_ppr", "fantasy_points_ppr_per_game"):
        new[f"{c}_w2"] = weighted_present([(F.col(c), 0.65), (lag(c, 1), 0.35)])
        new[f"{c}_w3"] = weighted_present([(F.col(c), 0.55), (lag(c, 1), 0.30), (lag(c, 2), 0.15)])
    new |= {n: F.when(F.col(c).isNotNull(), F.sum(c).over(so_far())) for c, n in CAREER.items() if c in have}
    new["best_season_fantasy_points"] = F.when(F.col("fantasy_points_ppr").isNotNull(), F.max("fantasy_points_ppr").over(so_far()))
    new["seasons_observed"] = F.count("season").over(so_far())
    new |= {n: F.col(c) - lag(c, 1) for c, n in TRENDS.items() if c in have}
    new |= {f"prev_{c}": lag(c, 1) for c in BEFORE if c in have}
    d = rows.withColumns(new)
    trends = [c for c in ("target_trend", "carry_trend", "snap_share_trend") if c in new]
    return d.withColumns({
        "career_fantasy_points_per_game": safe_ratio("career_fantasy_points", "career_games"),
        "opportunity_trend": mean_of_present(*trends) if trends else F.lit(None).cast("double"),
    })


def full_season_table(
    seasons: DataFrame, players: DataFrame, rosters: DataFrame, context: DataFrame, schedule: DataFrame, depth: DataFrame | None = None, sources: tuple[DataFrame | None, ...] = ()
) -> DataFrame:
    """The whole season table of the modelled positions, one row for each player and season, known by its end.

    Biography and draft capital; optional sources (snaps, situations, advanced statistics); the team's
    volume; games played and missed, by ``schedule(season, scheduled_games)``; roster status and depth chart;
    rates all positions share; features by position, routes among them where there are snaps; lags, trends
    and careers; flags of odd seasons.  What has no source is null.
    """
    d = attach(attach_dimension(seasons.where(F.col("position").isin(*POSITIONS)), players, rosters), *sources)
    d = own_team(d, context).join(schedule.select("season", F.col("scheduled_games").alias("_scheduled")), "season", "left")
    d = availability(d, F.col("_scheduled")).drop("_scheduled")
    d = shared_rates(depth_chart(roster_status(d, rosters), depth))
    if {"snaps", "team_pass_rate"} <= set(d.columns):
        d = routes(d).withColumn("route_participation", safe_ratio("routes", "own_team_dropbacks") if "own_team_dropbacks" in d.columns else F.lit(None).cast("double"))
    return era_flags(history(tight_ends(runners(passers(d) if "pass_attempts" in d.columns else d))))



# ---- entrants


def year_one_curves(pairs: DataFrame, outcomes: list[str]) -> DataFrame:
    """Mean outcomes of first seasons by position and group of picks: 1 to 4 up to picks 10, 32, 64 and 100, else 5."""
    pick = F.col("draft_pick")
    group = F.when(pick <= 10, 1).when(pick <= 32, 2).when(pick <= 64, 3).when(pick <= 100, 4).otherwise(5)
    d = pairs.where(F.col("experience") == 1).groupBy("position", group.alias("bucket"))
    return d.agg(F.count("*").alias("n"), *[F.avg(o).alias(o) for o in outcomes])


def team_priors(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy("team").agg(*[F.avg(n).alias(n) for n in names])


def final_college(college: DataFrame) -> DataFrame:
    """The last season of each college player."""
    return college.groupBy("college_id").agg(F.max_by(F.struct(*[c for c in college.columns if c != "college_id"]), "college_season").alias("x")).select("college_id", "x.*")


def enrich_entrants(entrants: DataFrame, college: DataFrame, yards: str = "yards") -> DataFrame:
    """Entrants with their college season: by id if any id matches, else by name; and worth of the pick.

    Whether any matches is a window over matches counted in the same plan, not an action of its own.
    """
    by_id = college.select("college_id", F.struct(yards, "college_season").alias("_by_id"))
    by_name = college.groupBy("name_key").agg(F.max(F.struct("college_season", yards)).alias("x")).select("name_key", F.struct(F.col(f"x.{yards}"), F.col("x.college_season")).alias("_by_name"))
    d = entrants.join(by_id, "college_id", "left").join(by_name, "name_key", "left")
    any_ = d.agg(F.coalesce(F.max(F.col(f"_by_id.{yards}").isNotNull()), F.lit(False)).alias("_any"))  # one row
    found = F.when(F.col("_any"), F.col("_by_id")).otherwise(F.col("_by_name"))
    d = d.crossJoin(F.broadcast(any_)).withColumns({yards: found[yards], "college_season": found["college_season"]}).drop("_by_id", "_by_name", "_any")
    pick = F.col("draft_pick").cast("double")
    return d.withColumns({"capital_inverse": 1 / F.greatest(pick, F.lit(1.0)), "capital_log": F.log1p(pick)})


def feature_research(pairs: DataFrame, names: list[str], outcome: str, least: int = 30, min_coverage: float = 0.35) -> DataFrame:
    """What is known of each feature, a row each, the most important first by ``rank``.

    ``feature, coverage, missing_rate, mean, std, decision, pearson, spearman, r2, stability, rank_stability,
    importance, rank``.  Deviations are of the population.  Correlations are with the outcome, a missing one
    counting 0, and (stability) with the feature's ``_lag1`` column where there is one; each needs ``least``
    rows and some spread.  Features are included from ``min_coverage`` on.  All features are ranked at once.
    """
    one = pairs.agg(F.array(*[F.struct(F.lit(n).alias("feature"), F.avg(F.col(n).isNotNull().cast("double")).alias("coverage"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")) for n in names]).alias("a"))
    d = one.select(F.inline("a"))
    found = correlations(pairs.withColumn("_y", F.coalesce(F.col(outcome).cast("double"), F.lit(0.0))), names, "_y", least)
    d = d.join(found.select("feature", "pearson", "spearman"), "feature", "left")
    lagged = [n for n in names if f"{n}_lag1" in pairs.columns]
    none = F.lit(None).cast("double")
    if lagged:
        each = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x"), F.col(f"{n}_lag1").cast("double").alias("y")) for n in lagged])
        same = paired_correlations(pairs.select(F.explode(each).alias("_f")).select("_f.*"), ["feature"], least)
        d = d.join(same.select("feature", F.col("pearson").alias("stability"), F.col("spearman").alias("rank_stability")), "feature", "left")
    else:
        d = d.withColumns({"stability": none, "rank_stability": none})
    d = d.withColumns({
        "missing_rate": 1 - F.col("coverage"), "decision": F.when(F.col("coverage") >= min_coverage, "included").otherwise("excluded"),
        "r2": F.col("pearson") * F.col("pearson"), "importance": F.coalesce(F.abs("pearson"), F.lit(0.0)),
    })
    return d.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))  # a row for each feature


def neighbours(rows: DataFrame, queries: DataFrame, names: list[str], k: int = 3, rounded: bool = True) -> DataFrame:
    """The k seasons of other players nearest to each query, in standardised features, among those of its position.

    ``player_id, season, other_id, other_season, distance, rank``, by the index of ``nearest``.
    """
    return nearest.nearest(rows, queries, names, k, rounded=rounded)
