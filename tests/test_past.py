"""Forecasts of all folds at once against plain ones, fold by fold."""

import random

import numpy as np
import pytest

from seasonforge.operators import past


def made():
    rng = random.Random(9)
    out = []
    for i in range(600):
        x = rng.choice([None, float(rng.randint(0, 60))])
        out.append((i, ["QB", "RB"][i % 2], 2000 + i // 2 % 5, x, rng.choice([None, 5.0]), rng.choice([None, 7.0]), rng.choice([0, 8, None]), rng.choice([None, 21.0, 25.0, 31.0, 40.0]), rng.choice([None, float(rng.randint(0, 30))]), rng.choice([None, float(rng.randint(0, 90))])))
    return out


def band(age):
    return "u" if age is None else sum(age >= e for e in (24, 27, 30, 33))


def test_fold_baselines(spark):
    rows = made()
    d = spark.createDataFrame(rows, "player_id int, position string, target_season int, x double, prev_x double, prev2_x double, games int, age double, opportunity double, outcome_x double")
    got = {(r.player_id, r.model): (r.predicted, r.actual) for r in past.fold_baselines(d, ["x"], opportunity="opportunity", least=60).collect()}
    seen = 0
    for r in rows:
        train = [t for t in rows if t[1] == r[1] and t[2] < r[2]]
        if len(train) < 60:
            assert (r[0], past.NAMES[0]) not in got
            continue
        seen += 1
        y = np.array([t[9] or 0.0 for t in train])
        o = np.array([t[8] or 0.0 for t in train])
        edges = np.unique(np.quantile(o, [0.25, 0.5, 0.75], method="inverted_cdf"))
        tier, own = np.digitize(o, edges, right=True), int(np.digitize(r[8] or 0.0, edges, right=True))
        same = [t[9] or 0.0 for t in train if band(t[7]) == band(r[7])]
        x, g = r[3] or 0.0, r[6] or 0
        weigh = lambda pairs: sum(v * w for v, w in pairs if v is not None) / max(1e-12, sum(w for v, w in pairs if v is not None)) if any(v is not None for v, _ in pairs) else 0.0
        want = [
            x, (x / g if g else 0.0) * (g or 16.0), weigh([(r[3], 0.65), (r[4], 0.35)]), weigh([(r[3], 0.5), (r[4], 0.3), (r[5], 0.2)]), np.mean(same) if same else y.mean(),
            np.quantile(y[tier == own] if (tier == own).any() else y, 0.5, method="inverted_cdf"),
        ]
        for name, v in zip(past.NAMES, want, strict=True):
            assert got[r[0], name] == (pytest.approx(v), r[9] or 0.0), name
    assert len(got) == seen * len(past.NAMES) and seen > 200


def test_no_fold_has_enough_rows(spark):
    d = spark.createDataFrame(made()[:20], "player_id int, position string, target_season int, x double, prev_x double, prev2_x double, games int, age double, opportunity double, outcome_x double")
    assert past.fold_baselines(d, ["x"], opportunity="opportunity").count() == 0
    assert past.fold_baselines(d.where("false"), ["x"], opportunity="opportunity").count() == 0
