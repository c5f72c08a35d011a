"""Tiers of a whole ranking against a plain walk."""

import random

import pytest

from seasonforge.operators import value
from seasonforge.plans import catalogue

SF = "/root/testdata/sf0.001"


def walk(v, most=10, smallest=2, sigma=1.0):
    tiers = [1] * len(v)
    gaps = [a - b for a, b in zip(v, v[1:])]
    if not gaps:
        return tiers
    mean = sum(gaps) / len(gaps)
    std = (sum((g - mean) ** 2 for g in gaps) / len(gaps)) ** 0.5
    limit = mean + sigma * std if std > 1e-9 else mean * 1.5
    tier = size = 1
    for i, g in enumerate(gaps):
        tier, size = (tier + 1, 1) if g > limit and size >= smallest and tier < most else (tier, size + 1)
        tiers[i + 1] = tier
    return tiers


@pytest.mark.parametrize(("n", "smallest"), [(0, 2), (1, 2), (2, 1), (40, 1), (400, 2), (400, 3)])
def test_walk(spark, n, smallest):
    rng = random.Random(n)
    v = sorted((rng.choice((1, 1, 1, 50)) * rng.random() for _ in range(n)), reverse=True)
    d = spark.createDataFrame([(i, i + 1, x) for i, x in enumerate(v)], "player_id long, overall_rank int, vorp double")
    got = {r.player_id: r.tier for r in value.gap_tiers(d, smallest=smallest).collect()}
    assert [got[i] for i in range(n)] == walk(v, smallest=smallest) and len(got) == n


def test_every_ranked_player_has_a_tier(spark):
    # one small sample of players beyond the published 160
    d = spark.createDataFrame([(i, i + 1, 1000.0 - i - 50.0 * (i > 200)) for i in range(300)], "player_id long, overall_rank int, vorp double")
    assert {r.player_id: r.tier for r in value.gap_tiers(d).collect()} == {i: 1 + (i > 200) for i in range(300)}
    board = value.rank_players(catalogue._board(spark, SF)).select("player_id", "overall_rank", "vorp").orderBy("overall_rank").collect()
    got = {r.player_id: r.tier for r in catalogue.QUERIES["r09_gap_tiers"][0](spark, SF).collect()}
    assert [got[r.player_id] for r in board] == walk([r.vorp for r in board]) and len(got) == len(board)
