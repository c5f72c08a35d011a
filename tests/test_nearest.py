"""Neighbours by boxes against plain comparisons, and how many rows they compare."""

import random

import numpy as np
import pytest

from seasonforge.operators import nearest, season

SCHEMA = "player_id int, season int, position string, a double, b double, c double"


def plain(rows, asked, columns, k):
    x = np.array([[np.nan if r[3 + c] is None else r[3 + c] for c in columns] for r in rows])
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0))
    out = {}
    for i, q in enumerate(rows):
        if asked(q) and q[2] is not None:
            d = np.round(np.sqrt(((z - z[i]) ** 2).sum(axis=1)), 9)
            near = sorted((d[j], r[0], r[1]) for j, r in enumerate(rows) if r[2] == q[2] and r[0] != q[0])[:k]
            out |= {(q[0], q[1], n): v for n, v in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("columns", [(0,), (0, 1), (0, 1, 2)])
def test_both_operators_against_all_pairs(spark, columns):
    rng = random.Random(5)
    rows = [(i // 4, 2000 + i % 4, "QB" if i % 9 else None, float(rng.randint(0, 9)), rng.choice([None, 0.0, rng.gauss(0, 9)]), rng.gauss(3, 1)) for i in range(1200)] + [(900 + i, 2000, "TE", 1.0, 1.0, 1.0) for i in range(3)]
    want = plain(rows, lambda r: r[0] % 10 == 0, columns, 4)
    d, names = spark.createDataFrame(rows, SCHEMA), ["abc"[c] for c in columns]
    for find in (nearest.nearest, season.neighbours) if len(columns) == 2 else (nearest.nearest,):
        got = {(r.player_id, r.season, r["rank"]): (r.distance, r.other_id, r.other_season) for r in find(d, d.where("player_id % 10 = 0"), names, k=4).collect()}
        assert got.keys() == want.keys()
        for key, (far, *who) in want.items():
            assert got[key][0] == pytest.approx(far, abs=2e-9) and list(got[key][1:]) == who


def test_comparisons_stay_few_among_equal_rows(spark):
    rows = [(i, 2000, "QB", float(i % 40), float(i // 40 % 25), 0.0) for i in range(20_000)]  # 1,000 points of 20 rows
    d = spark.createDataFrame(rows, SCHEMA)
    few, many = (nearest.comparisons(d.where(f"player_id < {n}"), d.where(f"player_id < {n} and player_id % 50 = 0"), ["a", "b"], k=3) for n in (5_000, 20_000))
    assert many[1] == 16 * few[1]
    assert many[0] < 8 * few[0] and many[0] < 400 * 200


def test_distances_may_stay_unrounded(spark):
    d = spark.createDataFrame([(1, 2000, "QB", 0.0), (2, 2000, "QB", 1.0), (3, 2000, "QB", 3.1234567890123)], "player_id int, season int, position string, a double")
    plain, nine = ([r.distance for r in season.neighbours(d, d, ["a"], rounded=r).orderBy("player_id", "rank").collect()] for r in (False, True))
    assert plain != nine and [round(x, 9) for x in plain] == nine
