"""The driver's tables in the roles of the domain, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..operators import aggregates, windows
from ..operators.lineage import written

SEGMENTS = {"AUTOMOBILE": "QB", "BUILDING": "RB", "FURNITURE": "WR", "HOUSEHOLD": "TE"}
STATS = ["carries", "rushing_yards", "receptions", "rushing_tds"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player-weeks: customers are players, years seasons, months weeks, nations of suppliers teams."""
    t = lambda n: table(spark, sf_dir, n)
    d = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = d.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return d.select(
        F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.month("o_orderdate").alias("week"), F.col("n_name").alias("team"),
        lookup("c_mktsegment", SEGMENTS).alias("position"), F.when(F.col("o_orderstatus") == "P", "POST").otherwise("REG").alias("season_type"),
        F.col("l_quantity").cast("long").alias("carries"), F.floor("l_extendedprice").alias("rushing_yards"), F.floor(F.col("l_discount") * 100 + 0.5).alias("receptions"),
        F.col("l_linenumber").cast("long").alias("rushing_tds"), F.col("l_orderkey").alias("game_id"), F.col("l_linenumber").alias("down"), F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"),
    )


WEEKLY = """weekly AS (SELECT o_custkey AS player_id, year(o_orderdate)::INT AS season, month(o_orderdate)::INT AS week, n_name AS team,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' WHEN 'HOUSEHOLD' THEN 'TE' END AS position,
  CASE WHEN o_orderstatus = 'P' THEN 'POST' ELSE 'REG' END AS season_type, l_quantity::BIGINT AS carries, floor(l_extendedprice)::BIGINT AS rushing_yards,
  floor(l_discount * 100 + 0.5)::BIGINT AS receptions, l_linenumber::BIGINT AS rushing_tds, l_orderkey AS game_id, l_linenumber AS down, c_nationkey AS home, s_nationkey AS away
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.player_seasons(weekly(spark, sf_dir), STATS)


def stored_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seasons as a table, for those that read them several times: the weekly facts are joined once."""
    return written(seasons(spark, sf_dir))


SEASONS = WEEKLY + """, reg AS (SELECT * FROM weekly WHERE season_type = 'REG'),
  seasons AS (SELECT s.*, l.team, p.position FROM (SELECT player_id, season, count(DISTINCT week) AS games, count(DISTINCT team) AS teams,
    sum(carries)::BIGINT AS carries, sum(rushing_yards)::BIGINT AS rushing_yards, sum(receptions)::BIGINT AS receptions, sum(rushing_tds)::BIGINT AS rushing_tds FROM reg GROUP BY ALL) s
  JOIN (SELECT player_id, season, team FROM reg QUALIFY row_number() OVER (PARTITION BY player_id, season ORDER BY week DESC, team DESC) = 1) l USING (player_id, season)
  LEFT JOIN (SELECT player_id, season, position FROM reg WHERE position IS NOT NULL QUALIFY row_number() OVER (PARTITION BY player_id, season ORDER BY week DESC, position DESC) = 1) p USING (player_id, season))"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.features import modelling_pairs

    s = stored_seasons(spark, sf_dir)
    f = windows.lag_features(s, ["carries"]).withColumn("prev2_carries", F.lag("carries", 2).over(windows.by_season()))
    return written(modelling_pairs(f, s, ["carries"]))  # most readers read it several times


PAIRS = SEASONS + """, lagged AS (SELECT *, lag(carries) OVER w AS prev_carries, lag(carries, 2) OVER w AS prev2_carries FROM seasons WINDOW w AS (PARTITION BY player_id ORDER BY season)),
  pairs AS (SELECT l.*, t.target_season, t.target_season - l.season - 1 AS seasons_since, coalesce(o.carries, 0) AS outcome_carries, CASE WHEN o.player_id IS NULL THEN 0 ELSE 1 END AS target_played
    FROM lagged l JOIN (SELECT DISTINCT season AS target_season FROM seasons) t ON t.target_season BETWEEN l.season + 1 AND l.season + 3
    LEFT JOIN seasons o ON o.player_id = l.player_id AND o.season = t.target_season
    QUALIFY row_number() OVER (PARTITION BY l.player_id, t.target_season ORDER BY l.season DESC) = 1)"""


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankable units: one row per player, over all seasons."""
    s = weekly(spark, sf_dir).where("position is not null").groupBy("player_id", "position").agg(F.sum("carries").alias("c"), F.sum("receptions").alias("r"), F.sum("rushing_tds").alias("t"), F.countDistinct("season", "week").alias("games"))
    d = s.select("player_id", "position", (F.col("c") / F.lit(10.0) + F.col("r") * F.lit(1.0) + F.col("t") * F.lit(6.0)).alias("points"), "games")
    return d.select("player_id", "position", "points", (F.col("points") / F.col("games")).alias("points_per_game"), (F.col("points") * 0.75).alias("low_points"), (F.col("points") * 1.5).alias("high_points"))


PLAYERS = WEEKLY + """, players AS (SELECT player_id, position, points, points / games AS points_per_game, points * 0.75::DOUBLE AS low_points, points * 1.5::DOUBLE AS high_points FROM (
  SELECT player_id, position, sum(carries) / 10.0::DOUBLE + sum(receptions) * 1.0::DOUBLE + sum(rushing_tds) * 6.0::DOUBLE AS points, count(DISTINCT (season, week)) AS games
  FROM weekly WHERE position IS NOT NULL GROUP BY ALL))"""
BOARD = PLAYERS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player_id) AS place FROM players),
  demand AS (SELECT * FROM (VALUES ('QB', 12), ('RB', 24), ('WR', 36), ('TE', 12)) d(position, base)),
  flex AS (SELECT position, count(*) AS more FROM (SELECT r.position FROM ranked r JOIN demand USING (position) WHERE place > base AND position <> 'QB' ORDER BY points DESC, player_id LIMIT 12) GROUP BY ALL),
  need AS (SELECT position, n, least(greatest(base + coalesce(more, 0), 1), n) AS rank FROM (SELECT position, count(*) AS n FROM ranked GROUP BY ALL) JOIN demand USING (position) LEFT JOIN flex USING (position)),
  levels AS (SELECT position, rank, avg(points) AS level FROM ranked JOIN need USING (position)
    WHERE CASE WHEN n < 8 THEN place = n ELSE place > greatest(rank - 2, 0) AND place <= greatest(rank - 2, 0) + 3 END GROUP BY ALL),
  board AS (SELECT p.*, level, points - coalesce(level, 0) AS vorp FROM players p LEFT JOIN levels USING (position))"""
