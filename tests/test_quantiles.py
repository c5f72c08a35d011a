"""Exact quantiles of groups against numpy, and what is computed once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonforge.operators import aggregates, models, past, ranks


@pytest.mark.parametrize("linear", [True, False])
def test_quantiles_of_groups(spark, linear):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, rng.gauss(0, 9), float(rng.randint(0, 9))])) for _ in range(3000)] + [("one", 4.0), ("none", None)]
    at = {"least": 0.0, "low": 0.2, "mid": 0.5, "high": 0.9, "most": 1.0}
    d = spark.createDataFrame(rows, "g string, v double")
    for by in (["g"], []):
        got = {r["g"] if by else None: r for r in ranks.quantiles(d, by, F.col("v"), at, linear, buckets=8).collect()}
        for g in got:
            v = np.array([x for k, x in rows if x is not None and (not by or k == g)])
            assert got[g]["n"] == len(v)
            for name, p in at.items():
                assert got[g][name] == pytest.approx(np.quantile(v, p, method="linear" if linear else "inverted_cdf")), (g, name)
        assert set(got) == ({"a", "b", None, "one"} if by else {None})
    assert ranks.quantiles(d.where("false"), [], F.col("v"), at, linear).first()["mid"] is None


def test_weights_count_as_rows(spark):
    d = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 5)], "v double, w int")
    assert ranks.quantiles(d, [], F.col("v"), {"q": 0.5}, linear=False, weight=F.col("w")).first()["q"] == 9.0
    assert ranks.quantiles(d, [], F.col("v"), {"q": 0.5}, weight=F.col("w")).first()["n"] == 9


def test_fold_medians_are_exact(spark):
    """A sketch of a small size is off here; exact medians are not."""
    rng = random.Random(4)
    rows = [(i, "QB", 2000 + i % 3, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(6000)]
    d = spark.createDataFrame(rows, "player_id int, position string, target_season int, x double, outcome_x double")
    d = d.select("*", F.col("x").alias("prev_x"), F.col("x").alias("prev2_x"), F.lit(8).alias("games"), F.lit(25.0).alias("age"), F.col("x").alias("opportunity"))
    got = {r.player_id: r.predicted for r in past.fold_baselines(d, ["x"], opportunity="opportunity", k=8, exact=True).where(F.col("model") == past.NAMES[5]).collect()}
    train = np.array([r[3:] for r in rows if r[2] < 2002])
    edges = np.quantile(train[:, 0], [0.25, 0.5, 0.75], method="inverted_cdf")
    tiers = np.digitize(train[:, 0], edges, right=True)
    for r in [r for r in rows if r[2] == 2002][:200]:
        assert got[r[0]] == np.quantile(train[tiers == np.digitize(r[3], edges, right=True), 1], 0.5, method="inverted_cdf")


def test_exact_forms_collect_no_group(spark):
    """Neither bounds nor tier medians gather a group's values in one task by Spark's percentile."""
    d = spark.createDataFrame([(i % 3, float(i), float(i * i % 97)) for i in range(300)], "g int, predicted double, actual double")
    for out in (models.interval_bounds(d, ["g"], exact=True), models.tier_median(d, d, "predicted", "actual", "guess", exact=True)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan


def test_pace_deals_games_to_tasks_by_their_number(spark):
    d = spark.range(5000).select((F.col("id") % 3).alias("team"), (F.col("id") % 2).alias("season"), (F.col("id") % 700).alias("game_id"), (F.col("id") % 991).alias("clock"))
    out = aggregates.pace(d, about=5000, most=300)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(game_id" in plan and ", 17)" in plan and "hashpartitioning(team#" in plan
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, aggregates.pace(d).collect()))  # sums of whole numbers
