"""Projected statistics: shrunk priors, missing totals from rates, and multipliers of age, move and depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, safe_ratio, zero_sum

# Age multipliers as (age up to which, factor); the last holds beyond.
AGE = {
    "RB": ((24, 1.03), (26, 1.0), (28, 0.94), (30, 0.86), (None, 0.75)), "WR": ((26, 1.02), (29, 1.0), (32, 0.93), (None, 0.85)),
    "TE": ((28, 1.01), (31, 0.97), (None, 0.90)), "QB": ((32, 1.0), (36, 0.96), (None, 0.90)),
}
MOVED = {"QB": 0.95, "RB": 0.88, "WR": 0.86, "TE": 0.90}
#: Statistics of opportunity, for which a small prior bounds the projection.
OPPORTUNITY = ("games", "pass_attempts", "carries", "targets")
# A missing total is volume times the prior's rate: total -> (volume, positions, rate without a prior, least, most).
RATES = {
    "completions": ("pass_attempts", ("QB",), 0.64, 0.5, 0.75), "passing_yards": ("pass_attempts", ("QB",), 7.1, 5.5, 9.0),
    "passing_tds": ("pass_attempts", ("QB",), 0.045, 0.02, 0.07), "interceptions": ("pass_attempts", ("QB",), 0.022, 0.01, 0.04),
    "receptions": ("targets", ("RB", "WR", "TE"), 0.65, 0.45, 0.8), "receiving_yards": ("targets", ("RB", "WR", "TE"), 12.0, 5.0, 16.0),
    "receiving_tds": ("targets", ("RB", "WR", "TE"), 0.05, 0.01, 0.12),
    "rushing_yards": ("carries", ("RB", "QB", "WR"), 4.2, 2.5, 6.5), "rushing_tds": ("carries", ("RB", "QB", "WR"), 0.03, 0.005, 0.08),
}
YARDS_FOR_A_BACK = 8.0


def age_factor(position: str = "position", age: str = "age") -> Column:
    """Factor by position and age; unknown ages have none, other positions age as quarterbacks."""
    a = F.col(age)
    def steps(table) -> Column:
        out = None
        for limit, k in table[:-1]:
            out = F.when(a <= limit, k) if out is None else out.when(a <= limit, k)
        return out.otherwise(table[-1][1])
    by = F.when(F.col(position) == "RB", steps(AGE["RB"])).when(F.col(position) == "WR", steps(AGE["WR"])).when(F.col(position) == "TE", steps(AGE["TE"])).otherwise(steps(AGE["QB"]))
    return F.when(a.isNull() | F.isnan(a.cast("double")), 1.0).otherwise(by)


def move_factor(position: str = "position", changed: str = "team_changed") -> Column:
    by = reduce(lambda w, x: w.when(F.col(position) == x[0], x[1]), MOVED.items(), F.when(F.lit(False), 0.9)).otherwise(0.9)
    return F.when(F.coalesce(F.col(changed).cast("boolean"), F.lit(False)), by).otherwise(1.0)


def depth_factor(starter: str = "starter", rank: str = "depth_rank") -> Column:
    r = F.col(rank)
    return F.when(F.col(starter).cast("boolean"), 1.04).when(r <= 1.5, 1.03).when(r >= 3, 0.88).otherwise(1.0)


def prior_means(rows: DataFrame, stats: list[str]) -> DataFrame:
    """Mean of each statistic by position, nulls left out."""
    return rows.groupBy("position").agg(*[F.avg(s).alias(s) for s in stats])


def shrunk(prior: Column, mean: Column) -> Column:
    """A prior drawn to its mean, more strongly from 1.35 times the mean on; the other of the two where one is missing."""
    w = F.when(prior > 1.35 * mean, 0.38).otherwise(0.28)
    return F.when(prior.isNull(), mean).when(mean.isNull(), prior).otherwise((1 - w) * prior + w * mean)


def fallback(rows: DataFrame, stats: list[str]) -> DataFrame:
    """``pred_*`` of statistics without a model: the prior drawn to the mean of its position."""
    means = prior_means(rows, stats).select("position", *[F.col(s).alias(f"_mean_{s}") for s in stats])
    d = rows.join(means, "position", "left")
    return d.withColumns({f"pred_{s}": shrunk(F.col(s).cast("double"), F.col(f"_mean_{s}")) for s in stats}).drop(*[f"_mean_{s}" for s in stats])


def compose(rows: DataFrame) -> DataFrame:
    """Missing ``pred_*`` totals from the predicted volume and the prior's rate, kept in bounds; lost fumbles are 0.9 of the prior's, or of its kinds' sum."""
    have = set(rows.columns)
    new = {}
    for total, (volume, positions, default, least, most) in RATES.items():
        if f"pred_{volume}" not in have or total not in have:
            continue
        plain = F.when(F.col("position") == "RB", YARDS_FOR_A_BACK).otherwise(default) if total == "receiving_yards" else F.lit(default)
        rate = F.when(F.coalesce(F.col(volume), F.lit(0)) > 0, F.coalesce(F.col(total), F.lit(0)) / F.col(volume)).otherwise(plain)
        made = F.when(F.col("position").isin(*positions), F.col(f"pred_{volume}") * clip(rate, least, most))
        new[f"pred_{total}"] = F.coalesce(F.col(f"pred_{total}"), made) if f"pred_{total}" in have else made
    kinds = [c for c in ("rushing_fumbles_lost", "receiving_fumbles_lost", "sack_fumbles_lost") if c in have]
    if "fumbles_lost" in have or kinds:
        prior = zero_sum(*kinds) if kinds else F.lit(0)
        prior = F.coalesce("fumbles_lost", prior) if "fumbles_lost" in have else prior
        lost = F.greatest(F.lit(0.0), prior * 0.9)
        new["pred_fumbles_lost"] = F.coalesce(F.col("pred_fumbles_lost"), lost) if "pred_fumbles_lost" in have else lost
    return rows.withColumns(new)


def adjust(rows: DataFrame, stats: list[str], most: float = 1.15) -> DataFrame:
    """``pred_*`` times the factors of age, move and depth, at most ``most`` times the prior; games stay.

    Opportunity over a prior under 20 is held to 1.35 times the prior, or 0.85 of the value if that is more,
    unless the depth chart speaks for the player.
    """
    factor, depth = age_factor() * move_factor() * depth_factor(), depth_factor()

    def one(s: str) -> Column:
        prior, x = F.col(s).cast("double"), F.col(f"pred_{s}") * factor
        x = F.when(prior > 0, F.least(x, prior * most)).otherwise(x)
        small = (prior > 0) & (prior < 20) & (depth < 1.02) if s in OPPORTUNITY else F.lit(False)
        return F.when(F.col(f"pred_{s}").isNotNull(), F.when(small, F.least(x, F.greatest(prior * 1.35, x * 0.85))).otherwise(x))

    return rows.withColumns({f"pred_{s}": one(s) for s in stats if s != "games"})


def project(rows: DataFrame, stats: list[str], composed: list[str] = ()) -> DataFrame:
    """Priors drawn to means, missing totals composed, multipliers applied."""
    return adjust(compose(fallback(rows, stats)), [*stats, *composed])


def stats_of(stats: list[str], games: float = 15.0) -> dict[str, Column]:
    """Each statistic as predicted, else as before, else 0; no games count as ``games``."""
    out = {s: F.coalesce(F.col(f"pred_{s}"), F.col(s).cast("double"), F.lit(0.0)) for s in stats}
    if "games" in out:
        out["games"] = F.when(out["games"] == 0, games).otherwise(out["games"])
    return out


# Weights of the parts of confidence, and its labels.
CONFIDENCE = {"sample_size": 0.22, "feature_coverage": 0.18, "interval_width": 0.25, "role_stability": 0.20, "model_agreement": 0.15}
HIGH, MEDIUM = 0.70, 0.45


def interval_score(low: str, mid: str, high: str) -> Column:
    """1 for a narrow estimate, 0 from one and a half times its middle (20 at least) on."""
    width = F.greatest(F.col(high) - F.col(low), F.lit(0.0)) / F.greatest(F.abs(F.col(mid)), F.lit(20.0))
    return clip(1 - width / 1.5, 0.0, 1.0)


def confidence(parts: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """Weighted trust in a projection and its label; parts that are no finite numbers count 0."""
    parts = parts or {k: F.col(k) for k in CONFIDENCE}
    safe = lambda c: F.when(F.isnan(c.cast("double")) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(clip(c.cast("double"), 0.0, 1.0))
    score = clip(reduce(lambda a, b: a + b, [F.lit(w) * safe(parts[k]) for k, w in CONFIDENCE.items()]), 0.0, 1.0)
    return score, F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


# ---- plain forecasts


def previous_total(stat: str) -> Column:
    return F.coalesce(F.col(stat).cast("double"), F.lit(0.0))


def previous_rate(stat: str, games: str = "games", expected: str | None = None) -> Column:
    """The rate of a game before, times the games expected (else those before)."""
    g = F.coalesce(F.col(games).cast("double"), F.lit(0.0))
    n = F.coalesce(F.col(expected).cast("double"), F.lit(0.0)) if expected else F.when(g > 0, g).otherwise(16.0)
    return F.coalesce(safe_ratio(previous_total(stat), g), F.lit(0.0)) * n


def coverage(rows: DataFrame, names: list[str]) -> DataFrame:
    """Share of rows with a value, by column: ``name, coverage``.  One pass."""
    one = rows.agg(*[F.avg(F.col(n).isNotNull().cast("double")).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(n, F.lit(0.0)).alias("coverage")) for n in names])).alias("x")).select("x.*")


def select_features(rows: DataFrame, wanted: list[str], least: float = 0.35, most: int | None = 45, pinned: tuple[str, ...] = (), importance: dict[str, float] | None = None) -> list[str]:
    """Numeric columns that are covered or pinned; with more than ``most`` the pinned come first, the rest by importance or as listed."""
    numeric = [f.name for f in rows.schema if f.dataType.simpleString().partition("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    names = [n for n in wanted if n in numeric]
    found = {r.name: r.coverage for r in coverage(rows, names).collect()} if names else {}  # a row for each column
    kept = [n for n in names if n in pinned or found[n] >= least]
    if most is None or len(kept) <= most:
        return kept
    if importance:
        kept.sort(key=lambda n: (-importance.get(n, 0.0), n))
    first = [n for n in kept if n in pinned]
    return first + [n for n in kept if n not in pinned][: max(0, most - len(first))]
