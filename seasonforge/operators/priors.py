"""Back-off priors: means of groups at several levels in one aggregate, the finest with enough rows counts; priors of rookies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from .ranks import matched

# A team's usual volume, and the weight of a college season.
TEAM_PASSES, TEAM_RUSHES, COLLEGE = 560.0, 420.0, 0.35
STATS = (
    "games", "pass_attempts", "completions", "passing_yards", "passing_tds", "interceptions", "carries", "rushing_yards", "rushing_tds", "targets", "receptions",
    "receiving_yards", "receiving_tds", "fumbles_lost",
)


def draft_bucket(pick: Column) -> Column:
    return F.when(pick <= 10, 1).when(pick <= 32, 2).when(pick <= 64, 3).when(pick <= 100, 4).otherwise(5)


def backoff_table(rows: DataFrame, levels: list[list[str]], values: dict[str, str]) -> DataFrame:
    """Means and counts of every level: ``keys, level, n`` and the named values (name -> column); level 0 is the first.

    ``levels`` are lists of keys, the finest first; an empty one is the whole table.  One pass over the rows
    by grouping sets; a null key is a group like any other.
    """
    keys = list(dict.fromkeys(k for level in levels for k in level))
    sets = rows.groupingSets(levels, *keys)
    d = sets.agg(F.grouping_id(*keys).alias("_g"), F.count("*").alias("n"), *[F.avg(c).alias(v) for v, c in values.items()])
    code = [sum(1 << len(keys) - 1 - i for i, k in enumerate(keys) if k not in level) for level in levels]
    at = F.coalesce(*[F.when(F.col("_g") == c, i) for i, c in enumerate(code)])
    return d.select(*keys, at.alias("level"), "n", *values)


def backed_off(rows: DataFrame, table: DataFrame, levels: list[list[str]], values: list[str], least: int = 1) -> DataFrame:
    """Rows with ``prior_*``, ``prior_n`` and ``prior_level``: the finest level that has ``least`` rows; null if none has."""
    d = rows
    for i, keys in enumerate(levels):
        part = table.where((F.col("level") == i) & (F.col("n") >= least)).select(*keys, F.struct(F.lit(i).alias("level"), "n", *values).alias(f"_l{i}"))
        d = matched(d, part, keys)
    best = F.coalesce(*[f"_l{i}" for i in range(len(levels))])
    d = d.withColumn("_best", best)
    return d.withColumns({f"prior_{v}": F.col(f"_best.{v}") for v in values} | {"prior_n": F.col("_best.n"), "prior_level": F.col("_best.level")}).drop("_best", *[f"_l{i}" for i in range(len(levels))])


def rookie_priors(rows: DataFrame) -> DataFrame:
    """First-season priors ``rookie_*`` of each position's statistics, from curves, college and the team's volume.

    ``rows``: ``position, draft_pick``, ``prior_*`` where the curves have them (0 counts as none), and where
    known ``college_final_pass_attempts, college_final_rush_attempts, college_final_receptions,
    team_pass_attempts, player_pass_attempts, team_rush_attempts``.  Without a curve a statistic follows from
    draft capital; without a pick that is one of 180.  Statistics that a position has not are null.
    """
    have = set(rows.columns)

    def known(name: str) -> Column:
        return F.nullif(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(None).cast("double")

    def curve(name: str, other: Column) -> Column:
        return F.coalesce(known(f"prior_{name}"), other)

    def blended(start: Column, college: Column, most: float) -> Column:
        return F.when(college.isNull(), start).otherwise((1 - COLLEGE) * start + COLLEGE * F.least(college, F.lit(most)))

    p = F.col("position")
    pick = F.when(F.col("draft_pick") > 0, F.col("draft_pick").cast("double")).otherwise(180.0)
    capital = clip(1 / (1 + (pick - 1) / 55.0), 0.18, 1.0)
    passes = clip(F.coalesce(known("team_pass_attempts"), known("player_pass_attempts"), F.lit(TEAM_PASSES)) / TEAM_PASSES, 0.85, 1.15)
    rushes = clip(F.coalesce(known("team_rush_attempts"), F.lit(TEAM_RUSHES)) / TEAM_RUSHES, 0.85, 1.15)

    attempts = blended(curve("pass_attempts", 450 * capital), known("college_final_pass_attempts"), 600.0) * passes
    own_carries = curve("carries", 30 * capital)
    qb = {
        "pass_attempts": attempts, "completions": curve("completions", attempts * 0.64), "passing_yards": curve("passing_yards", attempts * 7.1), "passing_tds": curve("passing_tds", attempts * 0.045),
        "interceptions": curve("interceptions", attempts * 0.022), "carries": own_carries, "rushing_yards": curve("rushing_yards", own_carries * 4.5), "rushing_tds": curve("rushing_tds", 1.5 * capital),
        "fumbles_lost": curve("fumbles_lost", F.lit(0.6)),
    }
    carries = blended(curve("carries", 180 * capital), known("college_final_rush_attempts") * 0.65, 280.0) * rushes
    targets = curve("targets", 35 * capital) * passes
    rb = {
        "carries": carries, "rushing_yards": curve("rushing_yards", carries * 4.2), "rushing_tds": curve("rushing_tds", 6 * capital), "targets": targets, "receptions": curve("receptions", targets * 0.72),
        "receiving_yards": curve("receiving_yards", targets * 7.5), "receiving_tds": curve("receiving_tds", 1.5 * capital), "fumbles_lost": curve("fumbles_lost", F.lit(0.7)),
    }
    wide = p == "WR"
    thrown = blended(curve("targets", F.when(wide, 110).otherwise(70) * capital), known("college_final_receptions") * 1.05, 160.0) * passes
    other = {
        "targets": thrown, "receptions": curve("receptions", thrown * F.when(wide, 0.62).otherwise(0.68)), "receiving_yards": curve("receiving_yards", thrown * F.when(wide, 12.0).otherwise(10.0)),
        "receiving_tds": curve("receiving_tds", F.when(wide, 6).otherwise(4) * capital), "carries": curve("carries", 2 * capital), "rushing_yards": curve("rushing_yards", 10 * capital),
        "rushing_tds": curve("rushing_tds", F.lit(0.1)), "fumbles_lost": curve("fumbles_lost", F.lit(0.4)),
    }
    none = F.lit(None).cast("double")
    new = {"games": curve("games", 15.0 * (0.85 + 0.15 * capital))}
    new |= {s: F.when(p == "QB", qb.get(s, none)).when(p == "RB", rb.get(s, none)).otherwise(other.get(s, none)) for s in STATS if s != "games"}
    return rows.withColumns({f"rookie_{s}": c for s, c in new.items()})
