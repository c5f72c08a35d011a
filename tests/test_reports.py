"""Readers' rankings, reports of a backtest, and small functions against plain versions."""

import json
import random
import re
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonforge.functions import columns as C
from seasonforge.operators import reports, value

# ---- readers' rankings


def plain_levels(players, league):
    by = {p: sorted((x for x in players if x[1] == p), key=lambda x: (-x[2], x[0])) for p in league.starters}
    base = league.demand()
    left = sorted((x for p in league.flexible() for x in by[p][base[p] :]), key=lambda x: (-x[2], x[0]))[: league.teams * (league.flex + league.superflex)]
    out = {}
    for p, own in by.items():
        if own:
            rank = max(1, base[p] + sum(x[1] == p for x in left))
            i = min(rank - 1, len(own) - 1)
            near = own[max(0, i - 1) : min(len(own), i + 2)]
            out[p] = (rank, sum(x[2] for x in near) / len(near))
    return out


@pytest.mark.parametrize("league", [value.League(), value.League(teams=4, superflex=1), value.League(teams=1, flex=0, starters={"QB": 0, "RB": 1, "WR": 1, "TE": 1})])
def test_client_levels(spark, league):
    rng = random.Random(6)
    for n in (3, 60, 400):
        rows = [(i, rng.choice(["QB", "RB", "WR", "TE", "K"]), float(rng.randint(0, 300))) for i in range(n)]
        d = spark.createDataFrame(rows, "player_id int, position string, points double")
        got = {r.position: (r.rank, pytest.approx(r.level)) for r in value.client_levels(d, league).collect()}
        assert got == plain_levels(rows, league)


def test_rerank(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["QB", "RB", "WR", "TE"]), f"Name {i}", i % 4 == 0, i % 17, float(rng.randint(0, 90)), rng.random(), i % 5 != 0, float(rng.randint(0, 900))) for i in range(150)]
    d = spark.createDataFrame(rows, "player_id int, position string, name string, rookie boolean, games int, ppr_points double, confidence double, has_stats boolean, rushing_yards double")
    score = {r[0]: r[8] / 10 if r[7] else r[5] for r in rows}
    levels = plain_levels([(r[0], r[1], score[r[0]]) for r in rows], value.League())
    vorp = {r[0]: score[r[0]] - levels[r[1]][1] for r in rows}
    for by, key in (("overall", lambda r: (-vorp[r[0]], -score[r[0]] / max(r[4], 1), r[0])), ("points", lambda r: (-score[r[0]], r[0])), ("confidence", lambda r: (-r[6], r[0]))):
        got = value.rerank(d, ["rushing_yards"], value.RULES, rookie=False, text="NAME 1", by=by).orderBy("display_rank").collect()
        want = sorted((r for r in rows if not r[3] and "name 1" in r[2].lower()), key=key)
        assert [r.player_id for r in got] == [r[0] for r in want] and [r.display_rank for r in got] == list(range(1, len(want) + 1))
        assert all(r.vorp == pytest.approx(vorp[r.player_id]) for r in got)
    assert value.rerank(d, [], {}, position="K").count() == 0


# ---- reports


def test_backtest_reports(spark, tmp_path):
    rng = random.Random(2)
    rows = [(s, p, t, m, m == "base", i, float(rng.randint(0, 50)), float(rng.randint(0, 50))) for s in (2020, 2021) for p in ("QB", "RB") for t in ("carries", "points") for m in ("base", "ridge") for i in range(20)]
    d = spark.createDataFrame(rows, "season int, position string, target string, model string, is_baseline boolean, player_id int, predicted double, actual double")
    tables = reports.backtest_tables(d, "points")
    assert tables["backtest-summary"].count() == 16 and tables["model-comparison"].count() == 8 and tables["rank-performance"].count() == 8
    errors = {(p, t, m): np.mean([np.mean([abs(r[6] - r[7]) for r in rows if r[:4] == (s, p, t, m)]) for s in (2020, 2021)]) for p in ("QB", "RB") for t in ("carries", "points") for m in ("base", "ridge")}
    want = {f"{p}:{t}": min(("base", "ridge"), key=lambda m: (errors[p, t, m], m)) for p in ("QB", "RB") for t in ("carries", "points")}
    reports.write_backtest(tables, str(tmp_path))
    reports.write_backtest(tables, str(tmp_path))  # again: replaced
    assert {r.key: r.model for r in spark.read.json(f"{tmp_path}/selected-models").collect()} == want
    stored = spark.read.option("header", True).csv(f"{tmp_path}/model-comparison")
    assert {(r.position, r.target, r.model): float(r.mae) for r in stored.collect()} == {k: pytest.approx(v) for k, v in errors.items()}
    assert spark.read.parquet(f"{tmp_path}/backtest-predictions").where("error = predicted - actual").count() == len(rows)
    assert all(json.loads(line) for f in Path(tmp_path, "selected-models").glob("part-*") for line in f.read_text().splitlines())


def test_calibration_summary(spark):
    d = spark.createDataFrame([("QB", 1.0, 3.0, 2.0), ("QB", 1.0, 3.0, 3.0), ("QB", 1.0, 3.0, 9.0), ("QB", None, 3.0, 9.0)], "position string, low double, high double, actual double")
    r = reports.calibration_summary(d, 0.6).first()
    assert (r.nominal_coverage, r.mean_interval_width, r.n) == (0.6, 2.0, 3) and r.empirical_coverage == pytest.approx(2 / 3)


# ---- small functions


def one(spark, column, values, kind):
    return [r.x for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_rookie_keys(spark):
    def plain(v):
        t = re.sub(r"[^a-z0-9\s]", "", (v or "").lower())
        return re.sub(r"\s+", " ", re.sub(r"\s+(jr|sr|ii|iii|iv|v)$", "", t)).strip()

    names = ["José  O'Neil Jr.", "A.J. Smith II", "Bob Jr ", "Kenneth Walker III", "  x  ", "", None, "V", "Ann v", "Team\tIV"]
    assert one(spark, C.rookie_key, names, "string") == [plain(n) for n in names]


def test_fixed_decimals(spark):
    values = [0.25, 0.75, 4.35, 1.005, -0.25, -0.04, 1234567.891, 0.0, 2.5, None, float("nan")]
    assert one(spark, lambda c: C.fixed_decimals(c, 1), values, "double") == ["0.3", "0.8", "4.3", "1.0", "-0.3", "-0.0", "1234567.9", "0.0", "2.5", "-", "-"]
    assert one(spark, lambda c: C.fixed_decimals(c, 2), [1.005, 0.125, 8.345], "double") == ["1.00", "0.13", "8.35" if f"{8.345:.20f}" > "8.345" else "8.34"]


def test_ages_and_bands(spark):
    assert one(spark, lambda c: C.age_by_year(c, F.lit(2026)), ["2000-12-31", "bad", None, "1999"], "string") == [26, None, None, 27]
    assert one(spark, C.age_band, [23.9, 24.0, 26.9, 27.0, 33.0, None, float("inf")], "double") == ["under 24", "24-26", "24-26", "27-29", "33 and over", "unknown", "unknown"]
    assert one(spark, C.experience_band, [-1.0, 0.0, 1.0, 1.5, 3.0, 7.0, 8.0, None], "double") == ["rookie", "rookie", "2nd season", "3rd-4th season", "3rd-4th season", "5th-8th season", "9th season and beyond", "unknown"]


def test_seeded_values_are_the_same_in_every_run(spark):
    texts = [f"p{i}" for i in range(500)]
    a, b, c = (one(spark, lambda x, s=s: C.seeded_place(x, s), texts, "string") for s in (1, 1, 2))
    assert a == b != c and min(a) >= 0 and max(a) < 1000 and len(set(a)) > 350
    ids, again = (one(spark, lambda x: C.seeded_id(7, x), texts, "string") for _ in range(2))
    assert ids == again and len(set(ids)) == 500 and all(uuid.UUID(x).version == 4 and uuid.UUID(x).variant == uuid.RFC_4122 for x in ids)
