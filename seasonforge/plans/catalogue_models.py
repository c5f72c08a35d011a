"""Queries on models from sufficient statistics, ranks and correlations in groups, and quantile sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, moments, past, ranks, reports, sketches, windows
from ..operators.features import modelling_pairs
from ..operators.lineage import written
from . import base
from .base import PAIRS, SEASONS, STATS
from .catalogue import PREDICTIONS, _predictions, query

DESIGN = moments.Design(("carries", "receptions", "prev_carries"), tuple(f"outcome_{s}" for s in STATS))
ALPHAS = [1.0, 1e4, 1e6, 1e8]


def _pairs(s, d):
    t = base.stored_seasons(s, d)
    return modelling_pairs(windows.lag_features(t, ["carries"]), t, STATS).where("position is not null")


def _backtest(s, d, pairs=None):
    return moments.Backtest(_pairs(s, d) if pairs is None else pairs, DESIGN)


PAIRS4 = SEASONS + """, lagged AS (SELECT *, lag(carries) OVER w AS prev_carries FROM seasons WINDOW w AS (PARTITION BY player_id ORDER BY season)),
  pr AS (SELECT l.position, l.player_id, t.target_season, l.carries::DOUBLE AS x1, l.receptions::DOUBLE AS x2, coalesce(l.prev_carries, 0)::DOUBLE AS x3,
      coalesce(o.carries, 0)::DOUBLE AS outcome_carries, coalesce(o.rushing_yards, 0)::DOUBLE AS outcome_rushing_yards, coalesce(o.receptions, 0)::DOUBLE AS outcome_receptions, coalesce(o.rushing_tds, 0)::DOUBLE AS outcome_rushing_tds
    FROM lagged l JOIN (SELECT DISTINCT season AS target_season FROM seasons) t ON t.target_season BETWEEN l.season + 1 AND l.season + 3
    LEFT JOIN seasons o ON o.player_id = l.player_id AND o.season = t.target_season
    QUALIFY row_number() OVER (PARTITION BY l.player_id, t.target_season ORDER BY l.season DESC) = 1),
  long AS (UNPIVOT (SELECT * FROM pr WHERE position IS NOT NULL) ON outcome_carries, outcome_rushing_yards, outcome_receptions, outcome_rushing_tds INTO NAME target VALUE y),
  fold AS (SELECT position, target_season AS fold, lag(target_season) OVER w AS past, lag(target_season, 2) OVER w AS past2, lag(target_season, 3) OVER w AS past3
    FROM (SELECT DISTINCT position, target_season FROM long) WINDOW w AS (PARTITION BY position ORDER BY target_season))"""


def _ridge(trials: str) -> str:
    """Weights of every trial learned from all seasons of a position up to each of its seasons, by Cramer's rule."""
    return f""", trials AS (SELECT * FROM (VALUES {trials}) t(trial, alpha)),
  cut AS (SELECT DISTINCT position, target_season AS past FROM long),
  s AS (SELECT c.position, c.past, target, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x1 * x3) AS s13, sum(x2 * x2) AS s22, sum(x2 * x3) AS s23, sum(x3 * x3) AS s33,
      sum(y) AS sy, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(x3 * y) AS s3y FROM cut c JOIN long l ON l.position = c.position AND l.target_season <= c.past GROUP BY ALL),
  c AS (SELECT position, past, target, n, trial, s1 / n AS m1, s2 / n AS m2, s3 / n AS m3, sy / n AS my, s11 - s1 * s1 / n + alpha AS a11, s12 - s1 * s2 / n AS a12, s13 - s1 * s3 / n AS a13, s22 - s2 * s2 / n + alpha AS a22,
      s23 - s2 * s3 / n AS a23, s33 - s3 * s3 / n + alpha AS a33, s1y - s1 * sy / n AS b1, s2y - s2 * sy / n AS b2, s3y - s3 * sy / n AS b3 FROM s, trials),
  w AS (SELECT position, past, target, trial, n, m1, m2, m3, my, (b1 * (a22 * a33 - a23 * a23) - a12 * (b2 * a33 - a23 * b3) + a13 * (b2 * a23 - a22 * b3)) / det AS w1,
      (a11 * (b2 * a33 - a23 * b3) - b1 * (a12 * a33 - a23 * a13) + a13 * (a12 * b3 - b2 * a13)) / det AS w2, (a11 * (a22 * b3 - b2 * a23) - a12 * (a12 * b3 - b2 * a13) + b1 * (a12 * a23 - a22 * a13)) / det AS w3
    FROM (SELECT *, a11 * (a22 * a33 - a23 * a23) - a12 * (a12 * a33 - a23 * a13) + a13 * (a12 * a23 - a22 * a13) AS det FROM c))"""


GUESS = "my + w1 * (x1 - m1) + w2 * (x2 - m2) + w3 * (x3 - m3)"
RIDGE, TRIALS = PAIRS4 + _ridge("(1, 10.0)"), PAIRS4 + _ridge(", ".join(f"({i}, {a}::DOUBLE)" for i, a in enumerate(ALPHAS, 1)))
TUNED = TRIALS + f""", held AS (SELECT position, fold, coalesce(past3, past2) AS before, unnest(CASE WHEN past3 IS NULL THEN [past] ELSE [past, past2] END) AS season FROM fold WHERE past2 IS NOT NULL),
  err AS (SELECT h.position, h.fold, w.target, w.trial, avg(abs({GUESS} - y)) AS mae FROM held h JOIN long l ON l.position = h.position AND l.target_season = h.season
    JOIN w ON w.position = h.position AND w.past = h.before AND w.target = l.target GROUP BY ALL),
  best AS (SELECT position, fold, target, trial, mae FROM err QUALIFY row_number() OVER (PARTITION BY position, fold, target ORDER BY mae, trial) = 1)"""


@query(f"""WITH {RIDGE} SELECT l.position, l.target_season, l.target, l.player_id, 'ridge_baseline' AS model, round({GUESS}, 1) AS predicted, y AS actual
FROM long l JOIN fold f ON f.position = l.position AND f.fold = l.target_season JOIN w ON w.position = l.position AND w.past = f.past AND w.target = l.target WHERE n >= 150""")
def m10_rolling_ridge(s, d):
    out = _backtest(s, d).predictions(moments.parameter_sets(s, {"alpha": [10.0]}), "ridge_baseline")
    return out.withColumn("predicted", F.round("predicted", 1))


@query(f"WITH {TUNED} SELECT position, fold, target, trial, round(mae, 4) AS mae FROM best")
def m08_tuning(s, d):
    return _backtest(s, d).tuned(moments.parameter_sets(s, {"alpha": ALPHAS})).withColumn("mae", F.round("mae", 4))


def _compared(s, d):
    pairs = written(_pairs(s, d))  # read by both kinds of models
    b = _backtest(s, d, pairs)
    tuned = written(b.predictions(moments.parameter_sets(s, {"alpha": ALPHAS}), "ridge", tuned=True))  # read for its folds too
    known = tuned.select("position", "target_season").distinct()  # folds with enough rows before them
    plain = pairs.join(F.broadcast(known), ["position", "target_season"])  # a row for each group and season
    each = [F.struct(F.lit(f"outcome_{t}").alias("target"), F.col(t).cast("double").alias("predicted"), F.col(f"outcome_{t}").cast("double").alias("actual")) for t in STATS]
    last = plain.withColumn("_t", F.explode(F.array(*each))).select("position", "target_season", "_t.target", "player_id", F.lit("previous_total").alias("model"), "_t.predicted", "_t.actual")
    return tuned.unionByName(last)


@query(f"""WITH {TUNED}, p AS (SELECT l.position, l.target_season, l.target, 'ridge' AS model, {GUESS} AS predicted, y FROM long l JOIN fold f ON f.position = l.position AND f.fold = l.target_season
    LEFT JOIN best b ON b.position = l.position AND b.fold = l.target_season AND b.target = l.target
    JOIN w ON w.position = l.position AND w.past = f.past AND w.target = l.target AND w.trial = coalesce(b.trial, 1) WHERE n >= 150
  UNION ALL SELECT l.position, l.target_season, l.target, 'previous_total', CASE l.target WHEN 'outcome_carries' THEN x1 WHEN 'outcome_receptions' THEN x2 WHEN 'outcome_rushing_yards' THEN s.rushing_yards ELSE s.rushing_tds END, y
    FROM long l JOIN (SELECT DISTINCT w.position, fold FROM w JOIN fold f ON f.position = w.position AND f.past = w.past WHERE n >= 150) k ON k.position = l.position AND k.fold = l.target_season
    JOIN (SELECT player_id, t.target_season, arg_max(rushing_yards, season) AS rushing_yards, arg_max(rushing_tds, season) AS rushing_tds FROM seasons JOIN (SELECT DISTINCT season AS target_season FROM seasons) t ON t.target_season BETWEEN season + 1 AND season + 3 GROUP BY ALL) s
      ON s.player_id = l.player_id AND s.target_season = l.target_season),
  m AS (SELECT position, target, target_season, model, count(*) AS n, avg(abs(predicted - y)) AS mae, avg(predicted - y) AS bias FROM p GROUP BY ALL),
  a AS (SELECT position, target, model, avg(mae) AS mae, avg(bias) AS bias, sum(n)::BIGINT AS n, count(*) AS folds FROM m GROUP BY ALL)
SELECT position, target, model, round(mae, 4) AS mae, round(bias, 4) AS bias, n, folds, model = first_value(model) OVER (PARTITION BY position, target ORDER BY a.mae, model) AS selected FROM a""")
def a27_comparison(s, d):
    m = models.regression_metrics(_compared(s, d), ["position", "target", "target_season", "model"])
    out = moments.comparison(m, ["position", "target"])
    return out.select("position", "target", "model", F.round("mae", 4).alias("mae"), F.round("bias", 4).alias("bias"), "n", "folds", "selected")


def _registry(s, d):
    """All models of two targets, each season's superseding the one before; tight ends have none."""
    m = _backtest(s, d).models(moments.parameter_sets(s, {"alpha": [10.0]})).where("position <> 'TE' and target in ('outcome_carries', 'outcome_receptions') and n >= 150")
    names = F.array(*map(F.lit, DESIGN.features))
    rows = m.select("position", F.substring("target", 9, 99).alias("target"), F.concat(F.lit("v"), "past").alias("model_version"), F.col("past").alias("trained_at"), names.alias("features"), F.col("weights")[0].alias("intercept"), F.slice("weights", 2, 3).alias("weights"))
    return moments.register(moments.register(None, rows.where("trained_at < 1996")), rows)


@query(f"""WITH {RIDGE}, last AS (SELECT * FROM w WHERE position <> 'TE' AND n >= 150 AND target IN ('outcome_carries', 'outcome_receptions') QUALIFY row_number() OVER (PARTITION BY position, target ORDER BY past DESC) = 1),
  r AS (SELECT s.player_id, s.position, s.carries, s.receptions, g.prev_carries, avg(s.carries) OVER (PARTITION BY s.position) AS mc, avg(s.receptions) OVER (PARTITION BY s.position) AS mr
    FROM seasons s JOIN lagged g USING (player_id, season) WHERE season = 1997 AND s.position IS NOT NULL)
SELECT r.player_id, r.position, round(CASE WHEN c.w1 IS NOT NULL THEN c.my + c.w1 * (carries - c.m1) + c.w2 * (receptions - c.m2) + c.w3 * (coalesce(prev_carries, 0) - c.m3) WHEN carries > 1.35 * mc THEN 0.62 * carries + 0.38 * mc ELSE 0.72 * carries + 0.28 * mc END, 3) AS pred_carries, 'v' || c.past AS version_carries,
  round(CASE WHEN p.w1 IS NOT NULL THEN p.my + p.w1 * (carries - p.m1) + p.w2 * (receptions - p.m2) + p.w3 * (coalesce(prev_carries, 0) - p.m3) WHEN receptions > 1.35 * mr THEN 0.62 * receptions + 0.38 * mr ELSE 0.72 * receptions + 0.28 * mr END, 3) AS pred_receptions, 'v' || p.past AS version_receptions
FROM r LEFT JOIN last c ON c.position = r.position AND c.target = 'outcome_carries' LEFT JOIN last p ON p.position = r.position AND p.target = 'outcome_receptions'""")
def m16_registry(s, d):
    rows = windows.lag_features(base.seasons(s, d), ["carries"]).where("season = 1997 and position is not null")
    out = moments.predicted(rows, _registry(s, d), ["carries", "receptions"])
    return out.select("player_id", "position", F.round("pred_carries", 3).alias("pred_carries"), "version_carries", F.round("pred_receptions", 3).alias("pred_receptions"), "version_receptions")


# ---- ranks and correlations within groups


@query(f"""WITH {SEASONS}, s AS (SELECT * FROM seasons) SELECT season, player_id, rank() OVER (PARTITION BY season ORDER BY carries DESC) + (count(*) OVER (PARTITION BY season, carries) - 1) / 2.0::DOUBLE AS season_rank,
 rank() OVER (PARTITION BY season ORDER BY receptions DESC) + (count(*) OVER (PARTITION BY season, receptions) - 1) / 2.0::DOUBLE AS other_rank FROM s""")
def w14_ranks_in_groups(s, d):
    r = ranks.mean_ranks(base.seasons(s, d), ["season"], {"season_rank": F.col("carries"), "other_rank": F.col("receptions")})
    return r.select("season", "player_id", "season_rank", "other_rank")


@query(f"""WITH {PREDICTIONS}, pairs2 AS (SELECT x.target_season, sign(x.predicted - y.predicted) AS s, sign(x.actual - y.actual) AS t FROM preds x JOIN preds y ON x.target_season = y.target_season AND x.player_id < y.player_id)
SELECT target_season, (1 + sqrt(1 + 8 * count(*)))::BIGINT // 2 AS n, round(sum(s * t) / (sqrt(sum(abs(s))) * sqrt(sum(abs(t)))), 6) AS kendall FROM pairs2 GROUP BY ALL""")
def a33_kendall(s, d):
    return ranks.kendall(_predictions(s, d), ["target_season"], "predicted", "actual").withColumn("kendall", F.round("kendall", 6))


@query(f"""WITH {PREDICTIONS}, k AS (SELECT *, count(*) OVER (PARTITION BY target_season) AS n, rank() OVER (PARTITION BY target_season ORDER BY predicted DESC) + (count(*) OVER (PARTITION BY target_season, predicted) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY target_season ORDER BY actual DESC) + (count(*) OVER (PARTITION BY target_season, actual) - 1) / 2.0::DOUBLE AS a,
 row_number() OVER (PARTITION BY target_season ORDER BY predicted DESC, player_id) AS pi, row_number() OVER (PARTITION BY target_season ORDER BY actual DESC, player_id) AS ai FROM preds)
SELECT target_season, any_value(n) AS n, round(covar_pop(p, a) / (stddev_pop(p) * stddev_pop(a)), 6) AS spearman, round(avg(abs(p - a)), 6) AS mean_rank_error, quantile_disc(abs(p - a), 0.5) AS median_rank_error,
 CASE WHEN count(*) >= 12 THEN count(*) FILTER (pi <= 12 AND ai <= 12) / 12.0::DOUBLE END AS top12, CASE WHEN count(*) >= 100 THEN count(*) FILTER (pi <= 100 AND ai <= 100) / 100.0::DOUBLE END AS top100,
 CASE WHEN count(*) >= 36 THEN count(*) FILTER (pi <= 36 AND ai <= 36) / 36.0::DOUBLE END AS starter_precision FROM k GROUP BY ALL""")
def m12_group_metrics(s, d):
    m = ranks.rank_metrics(_predictions(s, d), ["target_season"], starters=36)
    return m.select("target_season", "n", F.round("spearman", 6).alias("spearman"), F.round("mean_rank_error", 6).alias("mean_rank_error"), "median_rank_error", "top12", "top100", "starter_precision")


# ---- quantile sketches


@query(f"""WITH {PREDICTIONS}, e AS (SELECT list_sort(list_distinct(quantile_disc(predicted, [0.25, 0.5, 0.75]))) AS edges FROM preds WHERE predicted IS NOT NULL),
  t AS (SELECT len(list_filter(edges, lambda x: x < predicted))::INT AS tier, actual - predicted AS r FROM preds, e WHERE predicted IS NOT NULL AND actual IS NOT NULL),
  g AS (SELECT quantile_disc(r, 0.2) AS lo, quantile_disc(r, 0.8) AS hi FROM t), o AS (SELECT tier, count(*) AS n, quantile_disc(r, 0.2) AS lo, quantile_disc(r, 0.8) AS hi FROM t GROUP BY ALL)
SELECT i.tier::INT AS tier, coalesce(n, 0) AS n, CASE WHEN n >= 40 THEN o.lo ELSE g.lo END AS low, CASE WHEN n >= 40 THEN o.hi ELSE g.hi END AS high FROM range(4) i(tier) LEFT JOIN o USING (tier), g""")
def m15_sketched_intervals(s, d):
    return sketches.fit_intervals(_predictions(s, d), "predicted", k=32768).drop("edges")


@query(f"""WITH {PREDICTIONS} SELECT target_season, count(actual) AS n, quantile_disc(actual, 0.25) AS low, quantile_disc(actual, 0.5) AS mid, quantile_disc(actual, 0.9) AS high FROM preds WHERE actual IS NOT NULL GROUP BY ALL
UNION ALL SELECT NULL, count(actual), quantile_disc(actual, 0.25), quantile_disc(actual, 0.5), quantile_disc(actual, 0.9) FROM preds WHERE actual IS NOT NULL""")
def a32_merged_sketches(s, d):
    parts = sketches.states(_predictions(s, d), ["target_season"], F.col("actual"), 32768)
    both = parts.unionByName(sketches.merged(parts, []).withColumn("target_season", F.lit(None).cast("int")))
    return both.select("target_season", "n", *[sketches.quantile("state", p).alias(c) for c, p in (("low", 0.25), ("mid", 0.5), ("high", 0.9))])


# ---- reports


def _folds(s, d):
    p = _compared(s, d)
    return p.select(F.col("target_season").alias("season"), "position", "target", "model", (F.col("model") == "previous_total").alias("is_baseline"), "player_id", "predicted", "actual")


@query(f"""WITH {TUNED}, p AS (SELECT l.position, l.target_season, l.target, l.player_id, {GUESS} AS predicted, y AS actual FROM long l JOIN fold f ON f.position = l.position AND f.fold = l.target_season
    LEFT JOIN best b ON b.position = l.position AND b.fold = l.target_season AND b.target = l.target
    JOIN w ON w.position = l.position AND w.past = f.past AND w.target = l.target AND w.trial = coalesce(b.trial, 1) WHERE n >= 150),
  k AS (SELECT *, rank() OVER (PARTITION BY position, target, target_season ORDER BY round(predicted, 6)) + (count(*) OVER (PARTITION BY position, target, target_season, round(predicted, 6)) - 1) / 2.0 AS a,
    rank() OVER (PARTITION BY position, target, target_season ORDER BY actual) + (count(*) OVER (PARTITION BY position, target, target_season, actual) - 1) / 2.0 AS b FROM p)
SELECT target_season AS season, position, target, round(avg(abs(predicted - actual)), 4) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 4) AS rmse, count(*) AS n, round(corr(a, b), 5) AS spearman FROM k GROUP BY ALL""")
def m22_fold_summary(s, d):
    p = _folds(s, d).where("model = 'ridge'").withColumn("predicted", F.round("predicted", 6))
    return reports.fold_summary(p).select("season", "position", "target", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), "n", F.round("spearman", 5).alias("spearman"))


# ---- forecasts without a model


@query(f"""WITH {PAIRS4}, p AS (SELECT *, 20 + player_id % 15 AS age, CASE WHEN 20 + player_id % 15 < 24 THEN 'a' WHEN 20 + player_id % 15 < 27 THEN 'b' WHEN 20 + player_id % 15 < 30 THEN 'c' WHEN 20 + player_id % 15 < 33 THEN 'd' ELSE 'e' END AS band FROM pr WHERE position IS NOT NULL),
  tr AS (SELECT f.fold AS for_fold, p.* FROM fold f JOIN p ON p.position = f.position AND p.target_season < f.fold), cnt AS (SELECT position, for_fold FROM tr GROUP BY ALL HAVING count(*) >= 150),
  e AS (SELECT position, for_fold, list_sort(list_distinct(quantile_disc(x1, [0.25, 0.5, 0.75]))) AS edges FROM tr GROUP BY ALL),
  m AS (SELECT position, for_fold, len(list_filter(edges, lambda x: x < x1)) AS tier, quantile_disc(outcome_carries, 0.5) AS c, quantile_disc(outcome_receptions, 0.5) AS r FROM tr JOIN e USING (position, for_fold) GROUP BY ALL),
  w AS (SELECT position, for_fold, quantile_disc(outcome_carries, 0.5) AS c, quantile_disc(outcome_receptions, 0.5) AS r, avg(outcome_carries) AS ac, avg(outcome_receptions) AS ar FROM tr GROUP BY ALL),
  b AS (SELECT position, for_fold, band, avg(outcome_carries) AS ac, avg(outcome_receptions) AS ar FROM tr GROUP BY ALL),
  t AS (SELECT p.position, target_season, player_id, coalesce(b.ac, w.ac) AS ac, coalesce(b.ar, w.ar) AS ar, coalesce(m.c, w.c) AS mc, coalesce(m.r, w.r) AS mr FROM p JOIN cnt ON cnt.position = p.position AND for_fold = target_season JOIN e ON e.position = p.position AND e.for_fold = target_season
    JOIN w ON w.position = p.position AND w.for_fold = target_season LEFT JOIN b ON b.position = p.position AND b.for_fold = target_season AND b.band = p.band LEFT JOIN m ON m.position = p.position AND m.for_fold = target_season AND m.tier = len(list_filter(edges, lambda x: x < x1)))
SELECT position, target_season, player_id, 'outcome_carries' AS target, 'position_age_group_average' AS model, round(ac, 4) AS predicted FROM t UNION ALL SELECT position, target_season, player_id, 'outcome_receptions', 'position_age_group_average', round(ar, 4) FROM t
UNION ALL SELECT position, target_season, player_id, 'outcome_carries', 'historical_median_comparable_opportunity', mc FROM t UNION ALL SELECT position, target_season, player_id, 'outcome_receptions', 'historical_median_comparable_opportunity', mr FROM t""")
def m05_fold_baselines(s, d):
    stats = ["carries", "receptions"]
    seasons = base.stored_seasons(s, d)
    t = windows.lag_features(seasons, stats).withColumns({f"prev2_{c}": F.lag(c, 2).over(windows.by_season()) for c in stats})
    p = modelling_pairs(t, seasons, STATS).where("position is not null").withColumn("age", 20 + F.col("player_id") % 15)
    out = past.fold_baselines(p, stats, opportunity="carries", exact=True).where(F.col("model").isin("position_age_group_average", "historical_median_comparable_opportunity"))
    return out.select("position", "target_season", "player_id", "target", "model", F.when(F.col("model") == "position_age_group_average", F.round("predicted", 4)).otherwise(F.col("predicted")).alias("predicted"))
