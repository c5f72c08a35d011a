"""The draft pool and what its readers ask: filters, sort keys, comparison, actions of a room."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import age_by_year, stable_unit
from .windows import numbered

# Points of a kicker's and a defender's statistics, a defender's points without any, and how
# many players of a position the pool takes from the rosters.
KICKING = {"fg_made": 3.0, "fg_made_50_59": 1.0, "fg_made_60_": 2.0, "pat_made": 1.0}
DEFENDING = {
    "def_tackles_solo": 1.5, "def_tackle_assists": 0.75, "def_sacks": 4.0, "def_interceptions": 5.0, "def_fumbles_forced": 3.0, "def_fumbles": 3.0, "def_pass_defended": 1.0,
    "def_tds": 6.0, "def_safeties": 2.0,
}
WITHOUT, OTHERWISE, SPREAD = {"LB": 82.0, "DL": 72.0, "DB": 68.0}, 60.0, 18.0
LIMITS = {"K": 40, "DL": 60, "LB": 60, "DB": 60}
TEAM_FIRST, TEAM_STEP, TEAM_SPREAD, SEASON_GAMES, LATE = 112.0, 0.7, 8.0, 17, 999.0


def contains(name: str, text: str | None) -> Column:
    """Whether a column holds a text in any case; no text holds always."""
    return F.lit(True) if not text else F.contains(F.lower(F.col(name)), F.lit(text.lower()))


def optional(name: str, value) -> Column:
    """Equality that an absent value switches off."""
    return F.lit(True) if value is None else F.col(name) == value


def browse(rows: DataFrame, position: str | None = None, rookie: bool | None = None, text: str | None = None, by: str = "overall_rank", descending: bool = False) -> DataFrame:
    """Rows of a position, of rookies or not, with a text in name or team, ordered by a chosen key, then by id; numbered anew."""
    d = rows.where(optional("position", position) & optional("rookie", rookie) & (contains("name", text) | contains("team", text)))
    key = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return d.withColumn("row", F.row_number().over(Window.orderBy(key, "player_id")))


def available(pool: DataFrame, picks: DataFrame, **options) -> DataFrame:
    """Pool players that are not picked yet, filtered."""
    return browse(pool.join(picks.select("player_id"), "player_id", "left_anti"), **options)


def or_all(rows: DataFrame, wanted: Column) -> DataFrame:
    """Rows that are wanted; all rows if none is.  One pass: the flag is broadcast as a single row."""
    some = rows.agg(F.coalesce(F.max(wanted), F.lit(False)).alias("_some"))
    return rows.crossJoin(F.broadcast(some)).where(wanted | ~F.col("_some")).drop("_some")


def baseline_points(players: DataFrame, stats: DataFrame) -> DataFrame:
    """``player_id, position, points`` of kickers and defenders, by what they did in a season.

    ``players(player_id, position)``; ``stats``: rows of a player's statistics, summed up; those that are
    missing count 0.  A defender without points has some by position, and a share of 18 by a hash of the id.
    """
    total = lambda worth: sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * k for c, k in worth.items() if c in stats.columns), F.lit(0.0))
    sums = stats.groupBy("player_id").agg(F.sum(total(KICKING)).alias("_k"), F.sum(total(DEFENDING)).alias("_d"))
    d = players.select("player_id", "position").join(sums, "player_id", "left")
    start = F.coalesce(F.create_map(*[F.lit(x) for kv in WITHOUT.items() for x in kv])[F.col("position")], F.lit(OTHERWISE))
    defence = F.when(F.col("_d") > 0, F.col("_d")).otherwise(start + stable_unit(F.col("player_id").cast("string")) * SPREAD)
    return d.select("player_id", "position", F.round(F.when(F.col("position") == "K", F.coalesce("_k", F.lit(0.0))).otherwise(defence), 2).alias("points"))


def build_pool(*sources: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Players of all sources, the first source of an id wins; a limited position keeps its best; ranked by source, then points.

    Sources have ``player_id, name, team, position, points``.  Ranks are over the whole pool and a position.
    """
    d = None
    for i, s in enumerate(sources):
        s = s.select("player_id", "name", F.coalesce("team", F.lit("FA")).alias("team"), "position", "points", F.lit(i).alias("source"))
        d = s if d is None else d.unionByName(s)
    first = d.groupBy("player_id").agg(F.min(F.struct("source", (-F.col("points")).alias("neg"), "name", "team", "position", "points")).alias("x")).select("player_id", "x.*").drop("neg")
    if limits:  # every task passes on as many rows of a limited position as the largest limit
        place = Window.partitionBy("position").orderBy("source", F.col("points").desc(), "player_id")
        most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("position")]
        few = F.col("position").isin(*limits)
        best = first.where(few).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= max(limits.values())).where(F.col("_place") <= most).drop("_place")
        first = best.unionByName(first.where(~few | F.col("position").isNull()))
    order = [F.coalesce("points", F.lit(-1e11)) - F.col("source") * 1e12, F.col("points").desc(), F.col("player_id")]
    return numbered(first, {"overall_rank": order, "position_rank": order}, inside={"position_rank": ("position",)})


def team_defenses(teams: DataFrame) -> DataFrame:
    """An entry for each team's defence: ``teams(team, place)``, places from 0."""
    points = F.round(TEAM_FIRST - F.col("place") * TEAM_STEP + stable_unit("team") * TEAM_SPREAD, 2)
    return teams.select(
        F.concat(F.lit("DEF-"), "team").alias("player_id"), F.concat("team", F.lit(" Defense")).alias("name"), "team", F.lit("DEF").alias("position"), F.lit(False).alias("rookie"),
        F.lit(None).cast("int").alias("age"), (1 + F.floor(F.col("place") / 8)).cast("int").alias("tier"), points.alias("points"), "place",
    )


def published_pool(projected: DataFrame, rosters: DataFrame, stats: DataFrame, teams: DataFrame, season: int) -> DataFrame:
    """The pool of a draft: projected players, the best kickers and defenders of the rosters, a defence of each team.

    ``projected``: ``player_id, name, team, position, rookie, age, tier, points, points_per_game, overall_rank``;
    ``rosters``: ``player_id, name, team, position, years_exp, birth_date`` of the season; ``stats``: see
    ``baseline_points``; ``teams``: ``team, place``.  The result has the columns of ``projected``,
    ``position_rank, adp`` and ``source``.  An id that came before is left out, though it counts for its
    position's limit.  Ranks go on from one source to the next; a tier of the rosters holds twelve.
    """
    kept = rosters.where(F.col("position").isin(*LIMITS) & F.col("player_id").isNotNull()).groupBy("player_id").agg(F.max(F.struct("name", "team", "position", "years_exp", "birth_date")).alias("r")).select("player_id", "r.*")
    worth = baseline_points(kept, stats).select("player_id", "points")
    most = F.create_map(*[F.lit(x) for kv in LIMITS.items() for x in kv])[F.col("position")]
    best = kept.join(worth, "player_id").withColumn("place", F.row_number().over(Window.partitionBy("position").orderBy(F.col("points").desc(), "name", "player_id"))).where(F.col("place") <= most)
    base = best.select(
        "player_id", F.coalesce("name", "player_id").alias("name"), F.coalesce("team", F.lit("FA")).alias("team"), "position", (F.coalesce("years_exp", F.lit(0)) == 0).alias("rookie"), age_by_year("birth_date", F.lit(season)).alias("age"),
        F.lit(None).cast("int").alias("tier"), "points", F.round(F.col("points") / SEASON_GAMES, 2).alias("points_per_game"), F.lit(LATE).alias("adp"), F.lit("roster-baseline").alias("source"), F.lit(1).alias("_s"), F.lit(0.0).alias("_o"),
    )
    first = projected.select(
        "player_id", "name", F.coalesce("team", F.lit("FA")).alias("team"), "position", "rookie", "age", "tier", F.round("points", 2).alias("points"), F.round("points_per_game", 2).alias("points_per_game"),
        F.round(F.col("overall_rank").cast("double"), 2).alias("adp"), F.lit("projection").alias("source"), F.lit(0).alias("_s"), F.col("overall_rank").cast("double").alias("_o"),
    )
    last = team_defenses(teams).select("*", F.round(F.col("points") / SEASON_GAMES, 2).alias("points_per_game"), F.lit(LATE).alias("adp"), F.lit("team-defense").alias("source"), F.lit(2).alias("_s"), F.col("place").cast("double").alias("_o")).drop("place")
    d = first.unionByName(base).unionByName(last)
    rest = [c for c in d.columns if c not in ("player_id", "_s", "_o")]
    one = d.groupBy("player_id").agg(F.min(F.struct("_s", "_o", *rest)).alias("x")).select("player_id", "x.*")
    order = [-(F.col("_s") * 1e12 + F.col("_o")), F.col("points").desc(), F.col("name"), F.col("player_id")]
    ranked = numbered(one, {"overall_rank": order, "position_rank": order}, inside={"position_rank": ("position",)})
    # twelve to a tier, after what projected players of the position took
    taken = F.coalesce(F.col("tier"), (1 + F.floor((F.col("position_rank") - 1) / 12)).cast("int"))
    return ranked.withColumn("tier", taken).drop("_s", "_o")


def compare(rows: DataFrame, ids: list, measures: list[str], most: int = 4) -> DataFrame:
    """Up to ``most`` players side by side: ``measure`` and a column for each id."""
    ids = ids[:most]
    d = rows.where(F.col("player_id").isin(*ids)).select("player_id", *[F.col(m).cast("double").alias(m) for m in measures]).unpivot("player_id", measures, "measure", "value")
    return d.groupBy("measure").pivot("player_id", ids).agg(F.first("value"))


def visible(rows: DataFrame, members: DataFrame, user, public: str = "is_public") -> DataFrame:
    """Rows of rooms that a user takes part in, and of public ones."""
    own = members.where(F.col("user_id") == user).select("room").distinct().withColumn("_own", F.lit(True))
    return rows.join(own, "room", "left").where(F.col(public) | F.coalesce(F.col("_own"), F.lit(False))).drop("_own")


def counter_bid(points: Column, current: Column, remaining: Column, picks: Column, rounds: Column, budget: Column, least: Column) -> Column:
    """An automatic bid, null if there is none: the least raise over the current one, if it leaves the least bid for each open slot
    but this, and is no more than a share of the budget that grows with the player's points (or the least bid)."""
    bid = current + least
    reserve = F.greatest(F.lit(0), rounds - picks - 1) * least
    most = F.greatest(least.cast("double"), F.round(budget * F.least(F.lit(0.42), F.greatest(F.lit(0.015), points / 900.0))))
    return F.when((bid <= remaining - reserve) & (bid <= most), bid)


def counter_bids(auctions: DataFrame, slots: DataFrame, fits: DataFrame, pause: float = 1.0) -> DataFrame:
    """``draft, player_id, slot, bid``: at most one automatic bid for each open auction.

    ``auctions(draft, player_id, points, current_bid, highest_slot, seconds, seed, pick_number, rounds, budget,
    minimum)``, ``seconds`` since the last bid; ``slots(draft, slot, is_cpu, remaining, picks)``;
    ``fits(draft, slot, player_id)``.  Bids come ``pause`` seconds after the last one, not from the slot that
    leads, and only for players that fit; of several slots the first by a seeded hash.
    """
    d = auctions.where(F.col("seconds").isNull() | (F.col("seconds") >= pause)).join(slots.where("is_cpu"), "draft").where("slot <> highest_slot")
    d = d.join(fits, ["draft", "slot", "player_id"], "left_semi")
    d = d.withColumn("bid", counter_bid(F.col("points"), F.col("current_bid"), F.col("remaining"), F.col("picks"), F.col("rounds"), F.col("budget"), F.col("minimum"))).where("bid is not null")
    turn = F.md5(F.concat_ws(":", F.col("slot").cast("string"), F.col("player_id").cast("string"), (F.col("seed") + F.col("pick_number") + F.col("current_bid")).cast("string")))
    best = d.groupBy("draft", "player_id").agg(F.min(F.struct(turn.alias("turn"), "slot", "bid")).alias("b"))
    return best.select("draft", "player_id", "b.slot", "b.bid")


def fit_by_count(rosters: DataFrame, slots: DataFrame) -> DataFrame:
    """The simple test of a roster: players of a position are fewer than the slots that accept it.

    ``rosters(roster, position)``, ``slots(position, open)`` with the slots that accept each position.
    """
    have = rosters.groupBy("roster", "position").agg(F.count("*").alias("have"))
    d = rosters.select("roster").distinct().crossJoin(F.broadcast(slots)).join(have, ["roster", "position"], "left")  # a few positions
    return d.select("roster", "position", (F.coalesce("have", F.lit(0)) < F.col("open")).alias("fits"))


def settle(bids: DataFrame, budgets: DataFrame) -> DataFrame:
    """Each lot goes to its highest bid (the earliest on ties); budgets less what was paid: ``roster, won, left``."""
    won = bids.groupBy("lot").agg(F.max(F.struct("amount", (-F.col("at")).alias("early"), (-F.col("roster")).alias("neg"))).alias("b"))
    paid = won.select((-F.col("b.neg")).alias("roster"), F.col("b.amount").alias("amount")).groupBy("roster").agg(F.count("*").alias("won"), F.sum("amount").alias("paid"))
    d = budgets.join(paid, "roster", "left")
    return d.select("roster", F.coalesce("won", F.lit(0)).alias("won"), (F.col("budget") - F.coalesce("paid", F.lit(0))).alias("left"))
