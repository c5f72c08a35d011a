"""Moves between seasons: loading them, patching rosters and projections, and auditing the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import alnum_key, truth

# Moves that keep a player at the team, codes of players without a team, and statuses off the roster.
SAME_TEAM = ("re_signed", "extended", "revised_contract", "franchise_tagged", "new_contract")
RETIRED = ("RET", "RETIRED")
NO_ROSTER = ("FA", "UNKNOWN", "RET", "RETIRED")
OFF_ROSTER = ("unsigned", "retired")


def destination(team: str = "new_team") -> Column:
    """Team after a move; retired players are free agents."""
    return F.when(F.col(team).isin(*RETIRED), F.lit("FA")).otherwise(F.col(team))


def clean_moves(raw: DataFrame) -> DataFrame:
    """Moves with trimmed ids, upper-case teams and flags; flags that are no columns hold for all rows."""
    up = {c: F.upper(F.trim(F.col(c).cast("string"))) for c in ("new_team", "old_team") if c in raw.columns}
    flag = lambda c: F.coalesce(truth(F.col(c).cast("string"), False), F.lit(False)) if c in raw.columns else F.lit(True)
    flags = {"on_roster": flag("active_roster"), "eligible": flag("projection_eligible")}
    return raw.withColumns({"player_id": F.trim(F.col("player_id").cast("string")), "effective_season": F.col("effective_season").cast("int"), **up, **flags})


def moves_of(moves: DataFrame, season: int) -> DataFrame:
    """Moves of a season whose player is known."""
    return moves.where((F.col("effective_season") == season) & (F.col("player_id") != ""))


def unresolved_moves(moves: DataFrame, season: int) -> DataFrame:
    return moves.where((F.col("effective_season") == season) & (F.coalesce(F.col("player_id"), F.lit("")) == ""))


def as_of(moves: DataFrame) -> DataFrame:
    """The latest date of the moves, as text: one row."""
    return moves.agg(F.max(F.when(F.col("as_of_date") != "", F.col("as_of_date"))).alias("as_of_date"))


def week_one_teams(history: DataFrame, roster: DataFrame, season: int) -> DataFrame:
    """First-week teams of earlier seasons together with the roster of the target season, one row for a player and season."""
    first = history.where((F.col("week") == 1) & (F.col("season") != season)).select("player_id", "season", F.col("team").alias("week1_team"))
    both = first.unionByName(roster.where(F.col("season") == season).select("player_id", "season", F.col("team").alias("week1_team")))
    return both.groupBy("player_id", "season").agg(F.max("week1_team").alias("week1_team"))


def patch_week_one(teams: DataFrame, moves: DataFrame, season: int) -> DataFrame:
    """First-week teams with the moves of ``season``; a season without rows starts from the one before.

    Other seasons stay.  Whether the season has rows is found in the same pass: rows of the season before
    are candidates that any row of the season itself rules out.
    """
    own = F.max(F.when(F.col("season") == season, 1).otherwise(0))
    found = teams.agg(own.alias("found"))  # one row
    seed = teams.where(F.col("season") == season - 1).crossJoin(F.broadcast(found)).where("found = 0")
    target = teams.where(F.col("season") == season).unionByName(seed.select("player_id", F.lit(season).cast("int").alias("season"), "week1_team"))
    patch = moves_of(moves, season).groupBy("player_id").agg(F.max(destination()).alias("new"))
    patched = target.join(patch, "player_id", "full").select("player_id", F.lit(season).cast("int").alias("season"), F.coalesce("new", "week1_team").alias("week1_team"))
    return teams.where(F.col("season") != season).select("player_id", "season", "week1_team").unionByName(patched)


def patch_projection(rows: DataFrame, moves: DataFrame, season: int) -> DataFrame:
    """Projection rows with next and projected team, team change and depth rank taken from the moves, which win,
    and what they say of the player's role: status, confidence, uncertainty, roster, eligibility, priority.

    The team of the feature season stays.  A player with several moves has the last by date.  What the moves
    have no column of is null.
    """
    m = moves_of(moves, season)
    said = [F.col(c) if c in moves.columns else F.lit(None).cast("string").alias(c) for c in ("starter_confidence", "role_uncertainty")]
    last = F.struct("as_of_date", destination().alias("team"), F.expr("try_cast(expected_rank AS double)").alias("rank"), "roster_status", "eligible", "priority", "on_roster", *said)
    m = m.groupBy("player_id").agg(F.max(last).alias("m"))
    d = rows.join(m, "player_id", "left")
    moved = F.col("m.team")
    return d.select(
        *[c for c in rows.columns if c not in ("next_team", "projected_team", "depth_rank")],
        F.coalesce(moved, "next_team").alias("next_team"),
        F.coalesce(moved, "projected_team", "next_team").alias("projected_team"),
        F.coalesce(F.col("m.rank"), "depth_rank").alias("depth_rank"),
        F.coalesce(moved != F.col("team"), F.lit(False)).cast("int").alias("team_changed"),
        F.col("m.roster_status").alias("offseason_status"), F.col("m.eligible").alias("projection_eligible"), F.col("m.priority").alias("offseason_priority"),
        F.col("m.starter_confidence").alias("starter_confidence"), F.col("m.role_uncertainty").alias("role_uncertainty"), F.col("m.on_roster").alias("offseason_active_roster"),
    )


def conflicts(rows: DataFrame, moves: DataFrame, season: int, priority: str = "P1") -> DataFrame:
    """Players of a priority whose projected team is not the one they moved to."""
    m = moves_of(moves, season).where(F.col("priority") == priority).select("player_id", "roster_status", destination().alias("expected_team"))
    return rows.select("player_id", "projected_team").join(m, "player_id").where(F.col("projected_team") != F.col("expected_team"))


def off_roster_on_team(rows: DataFrame, moves: DataFrame, season: int) -> DataFrame:
    """Players off all rosters who are still projected at a team."""
    m = moves_of(moves, season).where(F.col("roster_status").isin(*OFF_ROSTER) | ~F.col("on_roster")).select("player_id", "roster_status").distinct()
    return rows.select("player_id", "projected_team").join(m, "player_id").where(F.col("projected_team").isNotNull() & ~F.col("projected_team").isin(*NO_ROSTER))


def leavers(moves: DataFrame, season: int) -> DataFrame:
    """Moves to another team."""
    return moves_of(moves, season).where(~F.col("transaction_type").isin(*SAME_TEAM) | (F.col("new_team") != F.col("old_team")))


def vacated_by_team(features: DataFrame, moves: DataFrame, season: int, amounts: list[str]) -> DataFrame:
    """What the players who left their team after ``season`` did there: ``team, leavers, vacated_*``."""
    m = leavers(moves, season + 1).where(F.col("new_team") != F.col("old_team")).select("player_id", F.col("old_team").alias("team"))
    d = features.where(F.col("season") == season).join(m, ["player_id", "team"])
    return d.groupBy("team").agg(F.count("*").alias("leavers"), *[F.sum(a).alias(f"vacated_{a}") for a in amounts])


def audit(rows: DataFrame, moves: DataFrame, season: int) -> DataFrame:
    """The findings of a season by kind: ``kind, n, ok``; conflicts and players off all rosters must be none once patched.

    Stuck before the patch are the conflicts of the unpatched rows, and players still projected at the team
    that a move took them from; moves that keep a player at a team take nobody.
    """
    gone = moves_of(moves, season).where(~F.col("transaction_type").isin(*SAME_TEAM) & (F.col("new_team") != F.col("old_team"))).select("player_id", "old_team")
    left = rows.select("player_id", "projected_team").join(gone, "player_id").where("projected_team = old_team")
    stuck = conflicts(rows, moves, season).select("player_id").unionByName(left.select("player_id"))
    patched = patch_projection(rows, moves, season)
    kinds = {
        "stuck_before": stuck, "conflicts": conflicts(patched, moves, season), "off_roster_on_team": off_roster_on_team(patched, moves, season),
        "unresolved": unresolved_moves(moves, season),
    }
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, d in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", (F.col("n") == 0) | F.col("kind").isin("stuck_before", "unresolved"))


def listed_present(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """A list of names with a flag for those that are among the present ones, whatever their case and signs."""
    keys = present.select(alnum_key("name").alias("_key")).where("_key is not null").distinct().withColumn("present", F.lit(True))
    return wanted.withColumn("_key", alnum_key("name")).join(keys, "_key", "left").drop("_key").withColumn("present", F.coalesce("present", F.lit(False)))


def resolve_moves(moves: DataFrame, players: DataFrame) -> DataFrame:
    """Moves by name with the id of the player of that name: of several, one of the same position, then an active one, then the smallest id."""
    p = players.select(alnum_key("name").alias("_key"), F.col("player_id").alias("_id"), F.col("position").alias("_position"), F.col("status").alias("_status"))
    best = F.min(F.struct((F.col("_position") != F.col("position")).alias("a"), (F.col("_status") != "ACT").alias("b"), "_id"))
    d = moves.withColumn("_key", alnum_key("name")).join(p, "_key", "left")
    return d.groupBy("name", "position").agg(best.alias("_b")).select("name", "position", F.col("_b._id").alias("player_id"))
