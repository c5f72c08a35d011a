"""Ranks, correlations and quantiles in groups against plain versions; ties, nulls, heavy values, small buckets."""

import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seasonforge.operators import models, ranks, season, sketches


def made(n=700, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = rng.choice([None, 5.0, 5.0, 5.0, float(rng.randint(0, 9)), rng.random() * 10])
        y = (x or 0) * rng.choice([-1, 1]) + rng.randint(0, 4)
        out.append((i, rng.choice(["a", "b", None]), x, None if i % 17 == 0 else float(y)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(), "player_id int, g string, x double, y double")


@pytest.mark.parametrize("buckets", [2, 5, 64])
def test_mean_ranks(spark, rows, buckets):
    got = {r.player_id: (r.rx, r.ry) for r in ranks.mean_ranks(rows, ["g"], {"rx": F.col("x"), "ry": -F.col("y")}, buckets).collect()}
    d = pd.DataFrame(made(), columns=["i", "g", "x", "y"])
    d["g"] = d["g"].fillna("none")
    d["rx"], d["ry"] = d.groupby("g")["x"].rank(ascending=False), d.groupby("g")["y"].rank()
    for r in d.itertuples():
        for a, b in zip(got[r.i], (r.rx, r.ry), strict=True):
            assert (a is None and np.isnan(b)) or a == b
    assert len(got) == len(d)


def test_ranks_of_the_whole_table_and_of_nothing(spark, rows):
    got = [r.r for r in ranks.mean_ranks(rows.where("x is not null"), [], {"r": F.col("x")}).orderBy("player_id").collect()]
    want = pd.Series([x for _, _, x, _ in made() if x is not None]).rank(ascending=False)
    assert got == list(want)
    assert ranks.mean_ranks(rows.where("false"), ["g"], {"r": F.col("x")}).count() == 0


def tau(rows):
    s = t1 = t2 = 0
    for (a, b), (c, d) in combinations(rows, 2):
        u, v = np.sign(a - c), np.sign(b - d)
        s, t1, t2 = s + u * v, t1 + abs(u), t2 + abs(v)
    return None if not t1 * t2 else s / np.sqrt(t1 * t2)


@pytest.mark.parametrize("buckets", [2, 3, 8, 64])
def test_kendall_equals_all_pairs(spark, rows, buckets):
    got = {r.g: (r.n, r.kendall) for r in ranks.kendall(rows, ["g"], "x", "y", buckets).collect()}
    for g in ("a", "b", None):
        own = [(x, y) for _, k, x, y in made() if k == g and x is not None and y is not None]
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(tau(own), abs=1e-12)


def test_kendall_of_one_value_and_the_whole_table(spark, rows):
    one = spark.createDataFrame([(i, "a", 1.0, float(i)) for i in range(20)], "player_id int, g string, x double, y double")
    assert ranks.kendall(one, ["g"], "x", "y").first().kendall is None
    own = [(x, y) for _, _, x, y in made() if x is not None and y is not None]
    assert ranks.kendall(rows, [], "x", "y", 6).first().kendall == pytest.approx(tau(own), abs=1e-12)


def test_signed_pairs():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 37, 200):
        a, b, w = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 4, n)
        want = sum(w[i] * w[j] * np.sign(a[i] - a[j]) * np.sign(b[i] - b[j]) for i, j in combinations(range(n), 2))
        assert ranks.signed_pairs(a, b, w) == want


def test_rank_metrics(spark):
    d = spark.createDataFrame([(i, "big", float(i % 50), float((i * 7) % 31)) for i in range(120)] + [(i, "small", float(i), float(-i)) for i in range(2)], "player_id int, g string, predicted double, actual double")
    got = {r.g: r for r in ranks.rank_metrics(d, ["g"], starters=20, buckets=4).collect()}
    p = pd.DataFrame([(i, i % 50, (i * 7) % 31) for i in range(120)], columns=["i", "p", "a"])
    rp, ra = p["p"].rank(ascending=False), p["a"].rank(ascending=False)
    r = got["big"]
    top = lambda c, k: set(p.sort_values([c, "i"], ascending=[False, True])["i"][:k])
    assert r.n == 120 and r.spearman == pytest.approx(rp.corr(ra)) and r.mean_rank_error == pytest.approx((rp - ra).abs().mean())
    assert abs(r.median_rank_error - (rp - ra).abs().median()) <= 1
    assert [r.top12, r.top100, r.starter_precision, r.starter_recall] == [len(top("p", k) & top("a", k)) / k for k in (12, 100, 20, 20)]
    assert got["small"].n == 2 and got["small"].spearman is None and got["small"].top12 is None


def test_correlations_need_rows_and_spread(spark):
    d = spark.createDataFrame([(float(i), float(i * i), 1.0, float(i) if i < 20 else None, float(i)) for i in range(40)], "a double, b double, c double, d double, y double")
    got = {r.feature: (r.n, r.pearson, r.spearman) for r in ranks.correlations(d, ["a", "b", "c", "d"], "y").collect()}
    assert got["a"][1:] == (pytest.approx(1), pytest.approx(1)) and got["b"][2] == pytest.approx(1) and got["b"][1] < 1
    assert got["c"][1:] == (None, None) and got["d"] == (20, None, None)


def test_feature_research(spark):
    d = spark.createDataFrame([(float(i), float(i - 1) if i else None, None if i % 3 else float(i), None if i % 5 == 0 else float(2 * i)) for i in range(60)], "a double, a_lag1 double, b double, y double")
    got = {r.feature: r for r in season.feature_research(d, ["a", "b"], "y", least=10).collect()}
    y = pd.Series([0.0 if i % 5 == 0 else 2.0 * i for i in range(60)])
    assert got["a"].pearson == pytest.approx(pd.Series(range(60), dtype=float).corr(y)) and got["a"].stability == pytest.approx(1.0) and got["a"].std == pytest.approx(np.std(range(60)))
    assert got["b"].coverage == pytest.approx(1 / 3) and got["b"].decision == "excluded" and got["b"].stability is None and {got["a"].rank, got["b"].rank} == {1, 2}


# ---- sketches


def test_sketched_quantiles_are_close_in_rank_and_merge(spark):
    d = spark.range(200_000).select((F.col("id") % 5).alias("g"), F.expr("pow(rand(7), 3) * 1000").alias("v"))
    values = np.sort(np.array([r.v for r in d.collect()]))
    parts = sketches.states(d, ["g"], F.col("v"), 512)
    whole = sketches.merged(parts, []).select("n", *[sketches.quantile("state", p).alias(f"q{i}") for i, p in enumerate((0.05, 0.25, 0.5, 0.8, 0.99))]).first()
    assert whole.n == 200_000
    for i, p in enumerate((0.05, 0.25, 0.5, 0.8, 0.99)):
        assert abs(np.searchsorted(values, whole[f"q{i}"]) / 200_000 - p) < 0.01
    assert parts.count() == 5


def test_sketched_intervals(spark):
    rng = np.random.default_rng(2)
    rows = [(float(o), float(p), float(p + r)) for o, p, r in zip(rng.integers(0, 100, 2000), rng.random(2000) * 50, rng.normal(0, 5, 2000), strict=True)] + [(1e6, 1.0, None), (None, 1.0, 2.0)]
    d = spark.createDataFrame(rows, "opportunity double, predicted double, actual double")
    fitted = sketches.fit_intervals(d, "opportunity")
    f = {r.tier: r for r in fitted.collect()}
    edges = f[0].edges
    assert set(f) == {0, 1, 2, 3} and len(edges) == 3
    for t, r in f.items():
        own = [a - p for o, p, a in rows if a is not None and o is not None and sum(e < o for e in edges) == t]
        assert r.n == len(own) and r.low == pytest.approx(np.quantile(own, 0.2, method="inverted_cdf")) and r.high == pytest.approx(np.quantile(own, 0.8, method="inverted_cdf"))
    out = sketches.intervals(d.where("actual is not null and opportunity is not null"), fitted, "opportunity")
    assert out.where("low > mid or high < mid").count() == 0
    plain = sketches.intervals(d, None, "opportunity").where("predicted < 20").first()
    assert plain.high - plain.mid == pytest.approx(5)
    few = sketches.fit_intervals(d.limit(50), "opportunity")  # tiers under 40 rows have those of all rows
    assert len({(r.low, r.high) for r in few.collect()}) == 1
    assert sketches.fit_intervals(d.limit(5), "opportunity").first().edges == []


def test_bounds_and_tiers_by_sketches_are_close_to_exact_ones(spark):
    d = spark.range(3000).select((F.col("id") % 4).alias("g"), (F.col("id") % 101).cast("double").alias("predicted"), (F.col("id") % 37).cast("double").alias("actual"))
    a, b = ({r.g: r for r in models.interval_bounds(d, ["g"], exact=e).collect()} for e in (True, False))
    assert all(abs(a[g].lo - b[g].lo) <= 1 and abs(a[g].hi - b[g].hi) <= 1 for g in a)
    x, y = ([r.guess for r in models.tier_median(d, d, "predicted", "actual", "guess", exact=e).orderBy("g", "predicted").limit(50).collect()] for e in (True, False))
    assert max(abs(p - q) for p, q in zip(x, y, strict=True)) <= 1
