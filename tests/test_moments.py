"""Models from sums of products against plain numpy on the rows themselves; tuning, registry."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonforge.operators import moments

DESIGN = moments.Design(("a", "b"), ("y", "z"))


def made(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.gauss(0, 2), rng.gauss(1, 1)
        out.append((i, "QB" if i % 3 else "RB", 2000 + i // 3 % 6, None if i % 11 == 0 else a, None if i % 7 == 0 else b, 3 * a - b + rng.gauss(0, 1), None if i % 13 == 0 else b * 2 + rng.gauss(0, 1)))
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(made(), "player_id int, position string, target_season int, a double, b double, y double, z double")


def design(rows, impute, scale, train):
    x = np.array([[np.nan if v is None else v for v in r[3:5]] for r in rows])
    t = np.array([[np.nan if v is None else v for v in r[3:5]] for r in train])
    fill = np.nanmean(t, axis=0) if impute == "mean" else np.zeros(2)
    full = np.where(np.isnan(x), fill, x)
    if not scale:
        return full
    both, train_both = np.hstack([full, np.isnan(x)]), np.hstack([np.where(np.isnan(t), fill, t), np.isnan(t)])
    return (both - train_both.mean(0)) / np.where(train_both.std(0) > 1e-12, train_both.std(0), 1)


def plain(train, test, target, alpha, l1, impute, scale):
    x, t = design(train, impute, scale, train), design(test, impute, scale, train)
    y = np.array([r[5 + target] or 0.0 for r in train])
    mean = x.mean(0)
    c, yc = x - mean, y - y.mean()
    if l1 == 0:
        w = np.linalg.solve(c.T @ c + alpha * np.eye(c.shape[1]), c.T @ yc)
    else:  # proximal gradient, far enough
        w, n = np.zeros(c.shape[1]), len(y)
        step = 1 / (np.linalg.norm(c, 2) ** 2 / n + alpha * (1 - l1))
        for _ in range(4000):
            g = c.T @ (c @ w - yc) / n + alpha * (1 - l1) * w
            w = w - step * g
            w = np.sign(w) * np.maximum(0, np.abs(w) - step * alpha * l1)
    return y.mean() + (t - mean) @ w


@pytest.mark.parametrize("alpha,l1,impute,scale", [(10.0, 0.0, "zero", False), (5.0, 0.0, "mean", False), (3.0, 0.0, "mean", True), (0.1, 0.5, "mean", True), (0.5, 1.0, "zero", False)])
def test_predictions_equal_fits_on_rows(spark, pairs, alpha, l1, impute, scale):
    trials = moments.parameter_sets(spark, {"alpha": [alpha], "l1": [l1], "impute": [impute], "scale": [scale]})
    got = {(r.position, r.target_season, r.target, r.player_id): r.predicted for r in moments.Backtest(pairs, DESIGN, least=30).predictions(trials, "m").collect()}
    want = {}
    for position in ("QB", "RB"):
        rows = [r for r in made() if r[1] == position]
        for season in range(2001, 2006):
            train, test = [r for r in rows if r[2] < season], [r for r in rows if r[2] == season]
            if len(train) >= 30:
                for k, target in enumerate(("y", "z")):
                    want |= {(position, season, target, r[0]): p for r, p in zip(test, plain(train, test, k, alpha, l1, impute, scale), strict=True)}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_folds_keep_the_season_itself_out(spark, pairs):
    b = moments.Backtest(pairs, DESIGN, least=1)
    f = {(r.position, r.fold): (r.past, sorted(r.held), r.before) for r in moments.folds(b.sums, ["position"], "target_season").collect()}
    assert f["QB", 2001] == (2000, [2000], None)
    assert f["QB", 2002] == (2001, [2001], 2000)
    assert f["QB", 2005] == (2004, [2003, 2004], 2002)


def test_tuning_takes_the_least_error_and_repeats(spark, pairs):
    space = {"alpha": [1.0, 1e3, 1e6], "impute": ["zero", "mean"]}
    trials = moments.parameter_sets(spark, space)
    b = moments.Backtest(pairs, DESIGN, least=1)
    got = {(r.position, r.fold, r.target): (r.trial, r.mae) for r in b.tuned(trials).collect()}
    sets = {r.trial: (r.alpha, r.l1, r.impute, r.scale) for r in trials.collect()}
    for (position, fold, target), (trial, mae) in got.items():
        rows = [r for r in made() if r[1] == position and r[2] < fold]
        seasons = sorted({r[2] for r in rows})
        held = seasons[-1:] if len(seasons) <= 2 else seasons[-2:]
        train, test = [r for r in rows if r[2] not in held], [r for r in rows if r[2] in held]
        k = ("y", "z").index(target)
        errors = {t: np.mean(np.abs(plain(train, test, k, *s) - [r[5 + k] or 0.0 for r in test])) for t, s in sets.items()}
        assert abs(mae - min(errors.values())) < 1e-9 and abs(errors[trial] - min(errors.values())) < 1e-9
    assert len(got) == 2 * 2 * 4
    again = {(r.position, r.fold, r.target): r.trial for r in moments.Backtest(pairs, DESIGN, least=1).tuned(moments.parameter_sets(spark, space)).collect()}
    assert again == {k: t for k, (t, _) in got.items()}


def test_sampled_parameter_sets_are_seeded_and_different(spark):
    space = {"alpha": [1.0, 2.0, 3.0, 3.0], "l1": [0.0, 0.5], "scale": [False, True]}
    one, two, other = (moments.parameter_sets(spark, space, 5, seed).collect() for seed in (1, 1, 2))
    assert one == two and one != other and len({r[1:] for r in one}) == 5
    assert moments.parameter_sets(spark, space).count() == 12 and moments.parameter_sets(spark, space, 99).count() == 12


def test_comparison_selects_the_least_mean_error(spark):
    m = spark.createDataFrame([("QB", "a", 1.0, 1.0, 0.1, 0.0, 5), ("QB", "a", 3.0, 1.0, 0.1, 0.0, 5), ("QB", "b", 2.0, 1.0, 0.1, 0.0, 7), ("QB", "c", None, None, None, None, 1)], "position string, model string, mae double, rmse double, r2 double, bias double, n int")
    got = {r.model: (r.mae, r.n, r.folds, r.selected) for r in moments.comparison(m, ["position"]).collect()}
    assert got == {"a": (2.0, 10, 2, True), "b": (2.0, 7, 1, False), "c": (None, 1, 1, False)}


REGISTRY = "position string, target string, model_version string, trained_at int, features array<string>, intercept double, weights array<double>"


def test_registry_supersedes_and_falls_back(spark, tmp_path):
    old = spark.createDataFrame([("QB", "carries", "v1", 1, ["a"], 1.0, [2.0]), ("QB", "carries", "v2", 2, ["a", "gone"], 5.0, [1.0, 9.0]), ("QB", "targets", "v1", 1, ["a"], 0.0, [1.0])], REGISTRY)
    new = spark.createDataFrame([("QB", "carries", "v2", 3, ["a"], 7.0, [3.0]), ("QB", "carries", "v2", 1, ["a"], 0.0, [0.0])], REGISTRY)
    both = moments.register(moments.register(None, old), new)
    assert {(r.target, r.model_version, r.trained_at) for r in both.collect()} == {("carries", "v1", 1), ("carries", "v2", 3), ("targets", "v1", 1)}
    moments.save_registry(moments.register(None, old), str(tmp_path), 1)
    moments.save_registry(both, str(tmp_path), 2)
    stored = moments.load_registry(spark, str(tmp_path))
    rows = spark.createDataFrame([(1, "QB", 10.0, 4.0, 4.0), (2, "RB", 10.0, 100.0, None), (3, "RB", None, 20.0, 8.0), (4, None, 1.0, 2.0, 3.0)], "player_id int, position string, a double, carries double, targets double")
    got = {r.player_id: (r.pred_carries, r.version_carries, r.pred_targets) for r in moments.predicted(rows, stored, ["carries", "targets"]).collect()}
    assert got[1] == (37.0, "v2", 10.0)
    assert got[2] == (pytest.approx(0.62 * 100 + 0.38 * 60), None, 8.0)  # beyond 1.35 times the mean; a missing prior is the mean
    assert got[3][0] == pytest.approx(0.72 * 20 + 0.28 * 60) and got[3][2] == 8.0
    report = {(r.position, r.target): r.source for r in moments.registry_report(rows, stored, ["carries", "targets"]).collect()}
    assert report == {("QB", "carries"): "model", ("QB", "targets"): "model", ("RB", "carries"): "fallback", ("RB", "targets"): "fallback"}


def test_whole_projection_from_a_registry(spark):
    registry = spark.createDataFrame([("WR", "targets", "v1", 1, ["targets"], 10.0, [1.0])], REGISTRY)
    rows = spark.createDataFrame([(1, "WR", 16.0, 100.0, 60.0, 25.0, False, False, 2.0)], "player_id int, position string, games double, targets double, receptions double, age double, moved boolean, starter boolean, depth_rank double")
    rows = rows.withColumns({"team_changed": F.lit(0), "depth": F.lit(2.0)})
    r = moments.project_registered(rows, registry, ["games", "targets"], ["receptions"]).first()
    assert r.pred_targets == pytest.approx(min(110 * 1.02, 115)) and r.pred_receptions == pytest.approx(min(110 * 0.6 * 1.02, 69)) and r.version_targets == "v1"


def test_empty_pairs(spark, pairs):
    b = moments.Backtest(pairs.where("false"), DESIGN)
    trials = moments.parameter_sets(spark, {"alpha": [1.0, 2.0]})
    assert b.predictions(trials, "m").count() == 0 and b.tuned(trials).count() == 0
