"""Column functions and small operators on hand-made rows, in few Spark jobs."""

import datetime
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from seasonforge.functions import columns as C
from seasonforge.operators import draft, features, models, pool, projection, value


def one(spark, exprs, rows=((1,),), schema="x int"):
    """Values of named expressions on rows, in order."""
    d = spark.createDataFrame(list(rows), schema)
    return [r.asDict() for r in d.select(*[e.alias(n) for n, e in exprs.items()]).collect()]


def test_texts(spark):
    lit = F.lit
    got = one(spark, {
        "name": C.normal_name(lit(" José  Ñúñez-O'Neil Jr. ")), "stacked": C.normal_name(lit("Al B Jr III"), True), "slug": C.slug(lit("Éric  D'Angelo II")), "key": C.alnum_key(lit("A.J. Brown")),
        "short": C.short_name(lit("Patrick Lavon Mahomes")), "single": C.short_name(lit("Pele")), "yes": C.truth(lit(" YES ")), "no": C.truth(lit("0")), "blank": C.truth(lit(""), True),
        "label": C.label(lit("half_ppr")), "listed": C.listed(F.array(lit("a"), lit("b"), lit("c")), 2), "prefix": C.date_prefix(lit("2024-02-29T10:00")), "bad": C.date_prefix(lit("soon")),
    })[0]
    assert got == {
        "name": "jose nunezoneil", "stacked": "al b", "slug": "eric-d-angelo-ii", "key": "ajbrown", "short": "P. Mahomes", "single": "Pele", "yes": True, "no": False, "blank": True,
        "label": "Half Ppr", "listed": "a; b", "prefix": datetime.date(2024, 2, 29), "bad": None,
    }


def test_codes(spark):
    teams = {" kc ": "KC", "ufa": "FA", "RFA": "FA", "ret": "FA", "": "FA", None: "FA", "OAK": "LV", "SD": "LAC", "STL": "LA"}
    rows = one(spark, {"t": F.col("x"), "code": C.normal_team("x")}, [(t,) for t in teams], "x string")
    known = {r["t"]: r["code"] for r in rows}
    assert {k: known[k] for k in (" kc ", "ufa", "RFA", "ret", "", None)} == {k: teams[k] for k in (" kc ", "ufa", "RFA", "ret", "", None)}
    places = one(spark, {"p": C.normal_position("x")}, [("hb",), ("FB",), (" wr ",), ("zz",), (None,)], "x string")
    assert [r["p"] for r in places][1:] == ["RB", "WR", None, None]


@pytest.mark.parametrize(("pick", "worth", "group"), [(1, 1.0, "top10"), (10, 1 / (1 + 9 / 55), "top10"), (11, 1 / (1 + 10 / 55), "round1"), (33, 1 / (1 + 32 / 55), "round2"), (65, 1 / (1 + 64 / 55), "round3"), (101, 1 / (1 + 100 / 55), "late"), (262, 0.18, "late")])
def test_picks(spark, pick, worth, group):
    got = one(spark, {"w": C.capital_curve("x"), "g": C.pick_bucket("x")}, [(pick,)])[0]
    assert got["w"] == pytest.approx(max(worth, 0.18)) and got["g"] == group


def test_numbers(spark):
    rows = [(10.0, 4.0, 1.0), (None, 2.0, float("nan")), (3.0, 0.0, float("inf")), (None, None, 2.0)]
    got = one(spark, {
        "ratio": C.safe_ratio("a", "b"), "least": C.safe_ratio("a", "b", 5), "sum": C.zero_sum("a", "b"), "mean": C.mean_of_present("a", "b"), "weighted": C.weighted_present([("a", 0.65), ("b", 0.35)]),
        "finite": C.finite("c"), "clip": C.clip("a", 4.0, 8.0), "digit": C.digitize("a", [3, 5]), "blend": C.blend("a", "b", 0.25),
    }, rows, "a double, b double, c double")
    assert [r["ratio"] for r in got] == [2.5, None, None, None] and got[0]["least"] is None
    assert [r["sum"] for r in got] == [14.0, 2.0, 3.0, 0.0] and [r["mean"] for r in got] == [7.0, 2.0, 1.5, None]
    assert got[0]["weighted"] == pytest.approx(7.9) and got[1]["weighted"] == pytest.approx(2.0) and got[3]["weighted"] is None
    assert [r["finite"] for r in got] == [1.0, None, None, 2.0] and got[0]["clip"] == 8.0 and got[2]["clip"] == 4.0
    assert [r["digit"] for r in got] == [2, None, 0, None] and got[0]["blend"] == 8.5


def test_dates_and_timers(spark):
    got = one(spark, {
        "january": C.season_of(F.lit("2024-01-05").cast("date")), "march": C.season_of(F.lit("2024-03-05").cast("date")), "age": F.round(C.age_at(F.lit("2000-09-01").cast("date"), F.lit(2024)), 2),
        "none": C.timer(F.lit(None).cast("long")), "short": C.timer(F.lit(65)), "hours": C.timer(F.lit(7380)), "days": C.timer(F.lit(90_061)), "left": C.remaining(F.lit(10_001), F.lit(9_000)), "over": C.remaining(F.lit(1), F.lit(9_000)),
    })[0]
    assert got == {"january": 2023, "march": 2024, "age": 24.0, "none": "No limit", "short": "1:05", "hours": "2h 3m", "days": "1d 1h", "left": 2, "over": 0}


def test_hashes(spark):
    def mixed(seed, text):
        h = (seed ^ 0x9E3779B9) & 0xFFFFFFFF
        for c in text:
            h = (h ^ ord(c)) * 2654435761 % 2**32
        return h % 1000003 / 1000003

    got = one(spark, {"m": C.mixed_unit(7, "x"), "s": C.stable_unit("x")}, [("1:2:abc",), ("",), ("player-77",)], "x string")
    assert [r["m"] for r in got] == [pytest.approx(mixed(7, t)) for t in ("1:2:abc", "", "player-77")]
    assert [r["s"] for r in got] == [pytest.approx(int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF) for t in ("1:2:abc", "", "player-77")]


def test_body_routes_and_eras(spark):
    d = spark.createDataFrame([(1, 2021, None, 2018, 2017, 70.0, 210.0, None, 500.0, 0.6, 80.0, 700.0), (2, 2019, 2015, None, None, 0.0, 200.0, 1, 10.0, 0.5, 3.0, 20.0)],
        "player_id int, season int, rookie_year int, entry_year int, draft_year int, height double, weight double, draft_pick int, snaps double, team_pass_rate double, targets double, receiving_yards double")
    a, b = sorted(features.era_flags(features.routes(features.body_and_capital(d))).collect(), key=lambda r: r.player_id)
    assert (a.entry_season, a.experience, a.is_undrafted, a.draft_capital_log, a.routes, a.anomalous_season, a.seventeen_games) == (2018, 3, 1, 0.0, 300.0, 1, 1)
    assert a.bmi == pytest.approx(703 * 210 / 4900) and b.bmi is None and a.yards_per_route == pytest.approx(700 / 300) and b.yards_per_route is None
    assert b.draft_capital_log == pytest.approx(math.log1p(262)) and (b.anomalous_season, b.seventeen_games) == (0, 0)


def test_scoring(spark):
    """A stat line under the presets: yards divide, receptions tell the presets apart, nulls count nothing."""
    d = spark.createDataFrame([(1, 250.0, 2, 1, None, 6, 72.0)], "player_id int, passing_yards double, passing_tds int, interceptions int, rushing_yards double, receptions int, receiving_yards double")
    stats = ["passing_yards", "passing_tds", "interceptions", "rushing_yards", "receptions", "receiving_yards"]
    got = {r.preset: r.points for r in value.score_presets(d, stats).collect()}
    base = 10 + 8 - 2 + 7.2
    assert got == {"standard": pytest.approx(base), "half_ppr": pytest.approx(base + 3), "ppr": pytest.approx(base + 6)}


def test_constraints(spark):
    d = spark.createDataFrame([(1, 19.0, 30.0, 20.0, -80.0, -3.0, None, 9.0)], "player_id int, games double, completions double, attempts double, rushing_yards double, carries double, receptions double, targets double")
    r = value.constrain(d).first()
    assert (r.games, r.completions, r.rushing_yards, r.carries, r.receptions, r.targets) == (17.0, 20.0, -50.0, 0.0, None, 9.0)


def test_published_players(spark):
    d = spark.createDataFrame([(i, i) for i in range(1, 8)], "player_id int, overall_rank int")
    got = [tuple(r) for r in value.publish(d, 3, [6, 2]).orderBy("overall_rank").collect()]
    assert [(g[0], g[1]) for g in got] == [(1, 1), (2, 2), (3, 3), (6, 4)] and got[3][2:] == (6, "included by request") and got[1][3] is None


# ---- drafts


@pytest.mark.parametrize(("kind", "reversed_", "want"), [("linear", False, [1, 2, 3, 4] * 4), ("snake", False, [1, 2, 3, 4, 4, 3, 2, 1] * 2), ("snake", True, [1, 2, 3, 4, 4, 3, 2, 1, 4, 3, 2, 1, 1, 2, 3, 4])])
def test_draft_order(spark, kind, reversed_, want):
    got = draft.draft_order(spark, 4, 4, kind, reversed_).orderBy("pick").collect()
    assert [r.slot for r in got] == want and [r.round for r in got] == [1 + i // 4 for i in range(16)]


@pytest.mark.parametrize("teams", range(4, 23, 2))
def test_each_team_picks_once_a_round(teams):
    """The closed form of the order, in plain numbers."""
    for third in (False, True):
        for r in range(1, 6):
            back = (r in (2, 3) or r > 3 and r % 2 == 1) if third else r % 2 == 0
            slots = [teams + 1 - p if back else p for p in range(1, teams + 1)]
            assert sorted(slots) == list(range(1, teams + 1))


def test_slots():
    assert draft.fits(("RB", "RB", "WR"), ("RB", "FLEX", "WR")) and not draft.fits(("QB", "QB"), ("QB", "FLEX"))
    assert draft.fits(("QB", "QB", "RB"), ("SUPERFLEX", "QB", "BENCH")) and draft.accepts("LB", "IDP_FLEX") and not draft.accepts("K", "FLEX")
    assert draft.assign(("RB", "WR", "RB"), ("FLEX", "RB", "WR")) == [1, 2, 0] and draft.assign(("K",), ("QB",)) is None


def test_auction(spark):
    rows = [(200, 15, 10, 11), (200, 15, 186, 187), (200, 0, 1, 1), (3, 5, None, 1), (20, 3, 17, 18)]
    got = one(spark, {"most": draft.max_bid(F.col("budget"), F.col("empty")), "ok": draft.bid_valid(F.col("bid"), F.col("current"), F.col("budget"), F.col("empty"))}, rows, "budget int, empty int, current int, bid int")
    assert [r["most"] for r in got] == [186, 186, 0, 0, 18] and [r["ok"] for r in got] == [True, False, False, False, True]
    bid = pool.counter_bid(F.col("points"), F.col("current"), F.col("remaining"), F.col("picks"), F.lit(15), F.lit(200), F.lit(1))
    c = one(spark, {"b": bid}, [(450.0, 50, 200, 14), (450.0, 90, 200, 14), (450.0, 50, 60, 0), (450.0, 45, 60, 0), (1.0, 1, 200, 5), (119.7, 26, 200, 14)], "points double, current int, remaining int, picks int")
    assert [r["b"] for r in c] == [51, None, None, 46, 2, 27]  # fourteen open slots keep one each; 26.6 rounds to 27


def test_room_settings(spark):
    rows = [(12, 15, 15, False, "snake"), (11, 15, 15, False, "snake"), (12, 14, 15, False, "snake"), (12, 15, 15, True, "linear"), (24, 15, 15, False, "snake")]
    got = draft.valid_settings(spark.createDataFrame(rows, "teams int, rounds int, slots int, third_reversed boolean, kind string")).collect()
    assert [r.valid for r in got] == [True, False, False, False, False]


# ---- models and checks


def test_empty_backtest(spark):
    d = spark.createDataFrame([(1, 2000, 1.0, 2.0)], "player_id int, target_season int, x double, outcome_y double")
    out = models.backtest(d, ["x"], "outcome_y", [2000], ["ridge"])
    assert out.columns == ["player_id", "target_season", "model", "predicted", "actual"] and out.count() == 0


def test_selected_features(spark):
    d = spark.createDataFrame([(1.0, None, 2.0, "a"), (2.0, None, None, "b"), (3.0, 1.0, 1.0, "c")], "a double, b double, c double, t string")
    assert projection.select_features(d, ["a", "b", "c", "t", "zz"], 0.5) == ["a", "c"]
    assert projection.select_features(d, ["a", "b", "c"], 0.5, 2, ("b",)) == ["b", "a"]
    assert projection.select_features(d, ["a", "c"], 0.5, 1, (), {"c": 2.0}) == ["c"]


def test_browse(spark):
    rows = [(1, "Ann Lee", "KC", "QB", False, 2, 5.0), (2, "Bo Day", "LV", "RB", True, 1, None), (3, "Cy Ann", "SF", "RB", False, 3, 9.0)]
    d = spark.createDataFrame(rows, "player_id int, name string, team string, position string, rookie boolean, overall_rank int, points double")
    ids = lambda **k: [r.player_id for r in pool.browse(d, **k).orderBy("row").collect()]
    assert ids() == [2, 1, 3] and ids(text="ANN") == [1, 3] and ids(position="RB", rookie=True) == [2] and ids(by="points", descending=True) == [3, 1, 2]
