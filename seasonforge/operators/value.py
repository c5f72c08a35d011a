"""Scoring, value over replacement, ranks, tiers and publication."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from .windows import numbered

# Points for statistics, by preset.  ``*_yards`` are yards for a point.
RULES = {
    "passing_yards": 25.0, "passing_tds": 4.0, "interceptions": -2.0, "passing_2pt": 2.0, "rushing_yards": 10.0, "rushing_tds": 6.0, "rushing_2pt": 2.0,
    "receptions": 0.0, "receiving_yards": 10.0, "receiving_tds": 6.0, "receiving_2pt": 2.0, "fumbles_lost": -2.0,
}
PRESETS = {"standard": RULES, "half_ppr": RULES | {"receptions": 0.5}, "ppr": RULES | {"receptions": 1.0}}


@dataclass(frozen=True)
class League:
    """Who starts: slots by position, and slots open to several positions."""

    teams: int = 12
    starters: dict[str, int] = field(default_factory=lambda: {"QB": 1, "RB": 2, "WR": 3, "TE": 1})
    flex: int = 1
    superflex: int = 0
    window: int = 3
    least: int = 8

    def demand(self) -> dict[str, int]:
        return {p: self.teams * n for p, n in self.starters.items()}

    def flexible(self) -> list[str]:
        return ["RB", "WR", "TE"] + (["QB"] if self.superflex else [])


def points(stats: list[str], rules: dict[str, float]) -> Column:
    """Points of a row: null statistics count 0; yards divide by the yards for a point, unless that is 0."""
    total = F.lit(0.0)
    for s in stats:
        x, k = F.coalesce(F.col(s).cast("double"), F.lit(0.0)), rules.get(s, 0.0)
        total = total + ((x / F.lit(k) if k else F.lit(0.0)) if s.endswith("_yards") else x * F.lit(k))
    return total


def score_presets(rows: DataFrame, stats: list[str], presets: dict[str, dict] = PRESETS) -> DataFrame:
    """Each row once per preset, with its points: one scan, no join."""
    each = F.array(*[F.struct(F.lit(n).alias("preset"), points(stats, r).alias("points")) for n, r in presets.items()])
    return rows.withColumn("_p", F.explode(each)).select(*rows.columns, "_p.preset", "_p.points")


def _literal(values: dict, key: str) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])[F.col(key)]


def replacement_levels(players: DataFrame, league: League = League(), fixed: dict[str, int] | None = None) -> DataFrame:
    """Points at replacement level: ``position, rank, level``.

    Demand is starters plus the share that a position gets of the flexible slots, which go to the best of
    those left over.  The level is the mean of ``window`` players around that rank; a position with fewer
    than ``least`` players has its last player's points.  Only the players up to the needed ranks of four
    positions are looked at beyond the two rankings.
    """
    pool = players.where(F.col("position").isin(*league.starters))
    rank = Window.partitionBy("position").orderBy(F.col("points").desc(), "player_id")
    ranked = pool.select("position", "points", "player_id", F.row_number().over(rank).alias("place"))
    if fixed is None:
        slots = league.teams * (league.flex + league.superflex)
        left = ranked.where(F.col("position").isin(*league.flexible()) & (F.col("place") > _literal(league.demand(), "position")))
        taken = left.orderBy(F.col("points").desc(), "player_id").limit(slots).groupBy("position").agg(F.count("*").alias("more"))
        sizes = ranked.groupBy("position").agg(F.count("*").alias("n"))
        need = sizes.join(taken, "position", "left").select("position", "n", (_literal(league.demand(), "position") + F.coalesce("more", F.lit(0))).alias("want"))
    else:
        need = ranked.groupBy("position").agg(F.count("*").alias("n")).select("position", "n", _literal(fixed, "position").alias("want"))
    need = need.withColumn("rank", F.least(F.greatest("want", F.lit(1)), "n"))
    start = F.greatest(F.col("rank") - league.window // 2 - 1, F.lit(0))
    inside = (F.col("place") > start) & (F.col("place") <= start + league.window)
    chosen = F.when(F.col("n") < league.least, F.col("place") == F.col("n")).otherwise(inside)
    return ranked.join(F.broadcast(need), "position").where(chosen).groupBy("position", "rank").agg(F.avg("points").alias("level"))  # a row per position


def client_levels(players: DataFrame, league: League = League()) -> DataFrame:
    """Points at replacement level as a reader's page has them: ``position, rank, level``.

    Demand as in ``replacement_levels``, but the level is the mean of the player at that rank and his
    neighbours that exist, also for the first rank and for positions of few players.  Every task passes on no
    more players of a position than the league can need.
    """
    base, slots = league.demand(), league.teams * (league.flex + league.superflex)
    rank = Window.partitionBy("position").orderBy(F.col("points").desc(), "player_id")
    pool = players.where(F.col("position").isin(*league.starters))
    ranked = pool.select("position", "points", "player_id", F.row_number().over(rank).alias("place")).where(F.col("place") <= max(base.values()) + slots + 2)
    left = ranked.where(F.col("position").isin(*league.flexible()) & (F.col("place") > _literal(base, "position")))
    taken = left.orderBy(F.col("points").desc(), "player_id").limit(slots).groupBy("position").agg(F.count("*").alias("more"))
    need = pool.groupBy("position").agg(F.count("*").alias("n")).join(taken, "position", "left")
    need = need.select("position", "n", F.greatest(_literal(base, "position") + F.coalesce("more", F.lit(0)), F.lit(1)).alias("rank"))
    at = F.least(F.col("rank"), F.col("n"))  # the player's place
    near = (F.col("place") >= at - 1) & (F.col("place") <= at + 1)
    return ranked.join(F.broadcast(need), "position").where(near).groupBy("position", "rank").agg(F.avg("points").alias("level"))  # a row per position


def rerank(
    entries: DataFrame, stats: list[str], rules: dict[str, float], league: League = League(), position: str | None = None, rookie: bool | None = None, text: str | None = None, by: str = "overall"
) -> DataFrame:
    """A reader's ranking: entries scored by rules, against levels of all of them, then filtered, sorted and numbered (``display_rank``).

    ``entries``: ``player_id, position, name, rookie, games, ppr_points, confidence, has_stats`` and statistics;
    without statistics an entry keeps its points.  ``by``: points, ppg, vorp, confidence, or overall (value,
    then points per game); ties go to the smaller id.
    """
    d = entries.withColumn("points", F.when(F.col("has_stats"), points(stats, rules)).otherwise(F.col("ppr_points")))
    d = with_vorp(d, client_levels(d, league)).withColumn("ppg", F.col("points") / F.greatest(F.col("games"), F.lit(1)))
    keep = F.lit(True)
    for c, v in (("position", position), ("rookie", rookie)):
        keep = keep if v is None else keep & (F.col(c) == F.lit(v))
    if text:
        keep = keep & F.contains(F.lower("name"), F.lit(text.lower()))
    first = F.col({"points": "points", "ppg": "ppg", "confidence": "confidence"}.get(by, "vorp"))
    order = [first, *([F.col("ppg").desc()] if by == "overall" else []), F.col("player_id")]
    return numbered(d.where(keep), {"display_rank": order}).drop("level")


def with_vorp(players: DataFrame, levels: DataFrame) -> DataFrame:
    """Players with ``vorp``; positions without a level count from 0."""
    small = levels.select("position", "level")  # a row per position
    return players.join(F.broadcast(small), "position", "left").withColumn("vorp", F.col("points") - F.coalesce("level", F.lit(0.0)))



def rank_players(players: DataFrame, risk: float = 0.35) -> DataFrame:
    """Five rankings of players with vorp, points, points_per_game, low_points and high_points, and the place in their position.

    Risk value takes ``risk`` times half the distance to the low estimate off the value.
    """
    spread = F.col("high_points") - F.col("low_points")
    d = players.withColumn("risk_value", F.col("vorp") - F.lit(risk) * F.greatest(F.col("points") - F.col("low_points"), F.lit(0.0)) / 2)
    desc = lambda c: F.col(c).desc()
    rest = [desc("points_per_game"), desc("points"), spread.asc(), F.col("player_id").asc()]
    own = F.col("player_id").asc()
    orders = {
        "overall_rank": [F.col("vorp"), *rest], "points_rank": [F.col("points"), own], "per_game_rank": [F.col("points_per_game"), own],
        "upside_rank": [F.col("high_points"), own], "risk_rank": [F.col("risk_value"), own], "position_rank": [F.col("vorp"), *rest],
    }
    return numbered(d, orders, inside={"position_rank": ("position",)})


def gap_tiers(ranked: DataFrame, most: int = 10, smallest: int = 2, sigma: float = 1.0) -> DataFrame:
    """``player_id, tier`` of a whole ranking (``overall_rank`` from 1 without holes): a new tier at a gap over the threshold.

    The threshold is the mean gap plus ``sigma`` deviations, or 1.5 times the mean without deviation.  A
    tier has ``smallest`` players at least.  A tier passes over ``smallest`` - 1 such gaps at most, so the walk
    needs the first ``most * smallest`` of them only.
    """
    here = ranked.select("overall_rank", "vorp")
    after = ranked.select((F.col("overall_rank") - 1).alias("overall_rank"), F.col("vorp").alias("_next"))
    gaps = here.join(after, "overall_rank").select("overall_rank", F.coalesce(F.col("vorp") - F.col("_next"), F.lit(0.0)).alias("gap"))
    limit = gaps.agg(F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("std"))
    limit = limit.select(F.when(F.col("std") > 1e-9, F.col("mean") + F.lit(sigma) * F.col("std")).otherwise(F.col("mean") * 1.5).alias("limit"))
    wide = gaps.join(F.broadcast(limit), F.col("gap") > F.col("limit")).orderBy("overall_rank").limit(most * smallest)  # a single row
    one = wide.agg(F.array_sort(F.collect_list("overall_rank")).alias("a"))
    first = F.struct(F.lit(1).alias("start"), F.array().cast("array<int>").alias("starts"))

    def step(s, i):
        new = (i - s["start"] + 1 >= smallest) & (F.size(s["starts"]) < most - 1)
        at = (i + 1).cast("int")
        return F.struct(F.when(new, at).otherwise(s["start"]).alias("start"), F.when(new, F.concat(s["starts"], F.array(at))).otherwise(s["starts"]).alias("starts"))

    one = one.select(F.aggregate("a", first, step, lambda s: s["starts"]).alias("starts"))
    passed = F.size(F.filter("starts", lambda x: x <= F.col("overall_rank")))
    return ranked.join(F.broadcast(one)).select("player_id", (passed + 1).alias("tier"))  # a single row


def publish(ranked: DataFrame, limit: int, included: list) -> DataFrame:
    """The best ``limit`` players and the included ones, ranked anew; ``model_rank`` keeps the rank before."""
    d = ranked.where((F.col("overall_rank") <= limit) | F.col("player_id").isin(*included)).withColumn("model_rank", F.col("overall_rank"))
    return d.withColumn("overall_rank", F.row_number().over(Window.orderBy("model_rank"))).withColumn("warning", F.when(F.col("model_rank") > limit, "included by request"))


def constrain(rows: DataFrame) -> DataFrame:
    """Plausible projections: games 0 to 17, counts not negative, yards over -50, completions and receptions within attempts and targets."""
    names = set(rows.columns)
    d = rows.withColumns({c: clip(c, -50.0 if c.endswith("_yards") else 0.0, 17.0 if c == "games" else None) for c in names - {"player_id", "position", "name"}})
    both = [(a, b) for a, b in (("completions", "attempts"), ("receptions", "targets")) if a in names and b in names]
    return d.withColumns({a: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.least(a, b)).otherwise(F.col(a)) for a, b in both})


def ordered_range(low: str, mid: str, high: str) -> list[Column]:
    """Low, middle and high estimate in order, the middle kept."""
    return [F.least(low, mid).alias(low), F.col(mid), F.greatest(mid, high).alias(high)]
