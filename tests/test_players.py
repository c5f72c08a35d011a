"""Identities, priors, rosters, bids, the pool, neighbours and single rules against plain versions."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from seasonforge.functions import sql as functions_sql
from seasonforge.operators import capacity, draft, features, identity_graph, nearest, pool, priors, roster, season

# ---- identities


def grouped(rows):
    of = {r[0]: r[0] for r in rows}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    first = {}
    for r in rows:
        for kind, value in enumerate(r[1:]):
            if value and value.strip() not in ("", "0", "NA"):
                a, b = sorted((root(r[0]), root(first.setdefault((kind, value.strip()), r[0]))))
                of[b] = a
    return {x: root(x) for x in of}


def test_identity_groups(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "0", f"c{rng.randint(0, 90)}"]), rng.choice([None, f" e{rng.randint(0, 120)} ", "NA"]), rng.choice([None, f"p{rng.randint(0, 120)}"])) for i in range(150)]
    rows += [(1000 + i, None, f"x{i}", f"y{i // 2}") if i % 2 else (1000 + i, None, f"x{i - 1}" if i else "x0", f"y{i // 2}") for i in range(60)]  # long chains
    rows += [(2000 + i, None, f"l{i // 2}", f"m{(i + 1) // 2}") for i in range(70)]
    d = spark.createDataFrame(rows, "record long, canonical string, espn string, pfr string")
    got = {r.record: r for r in identity_graph.identity_groups(d, "record", "canonical", ["espn", "pfr"]).collect()}
    want = grouped(rows)
    assert {k: r.group for k, r in got.items()} == want
    for k, r in got.items():
        own = [x for x in rows if want[x[0]] == want[k]]
        ids = {x[1] for x in own if x[1] and x[1] != "0"}
        assert (r.group_size, r.canonical_ids, r.status) == (len(own), len(ids), "resolved" if len(ids) == 1 else "conflict" if ids else "unknown")
        assert r.resolved_id == (min(ids) if len(ids) == 1 else None)
        assert r.clashing == ",".join(n for j, n in enumerate(("canonical", "espn", "pfr"), 1) if len({x[j].strip() for x in own if x[j] and x[j].strip() not in ("", "0", "NA")}) > 1)


def test_names_resolve_in_three_steps(spark):
    dim = spark.createDataFrame([("1", "Ann Lee", "QB", "A"), ("2", "Bo Ray", "QB", "A"), ("3", "Bo Ray", "RB", "B"), ("4", "Cy Fox", "TE", "C"), ("5", "Cy Fox", "TE", "D"), ("6", "Di Orr", None, "A"), ("7", "Bo Ray", "WR", "B")], "player_id string, name string, position string, team string")
    asked = [("ANN LEE", "QB", None), ("Ann Lee", "RB", None), ("Ann Lee", None, None), ("Bo Ray", None, "A"), ("Bo Ray", None, "B"), ("Bo Ray", None, None), ("Cy Fox", "TE", "C"), ("Cy Fox", None, "C"), ("Di Orr", None, None), (None, "QB", "A"), (" ", None, None)]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "k int, name string, position string, team string")
    got = [(r.player_id, r.step, r.reason) for r in identity_graph.resolve_names(rows, dim).orderBy("k").collect()]
    assert got == [
        ("1", 1, "name and position"), (None, 1, "no such name and position"), ("1", 2, "only one of this name"), ("2", 3, "team"), (None, 3, "several of this name"), (None, 3, "several of this name"),
        (None, 1, "several of this name and position"), (None, 2, "no such name"), (None, 2, "no such name"), (None, 0, "no name"), (None, 0, "no name"),
    ]


def test_dimension_and_issues(spark):
    players = spark.createDataFrame([("1", "Ann Lee", "QB", None, "A"), ("1", "Ann Lee", "QB", "e1", "A"), ("2", "Ann Lee", "QB", None, "B"), ("3", "Bo Ray", "RB", None, None), (" ", "No Id", "RB", None, None), (None, "No Id", "RB", None, None)], "gsis_id string, full_name string, position string, espn_id string, team string")
    crosswalk = spark.createDataFrame([("3", "e3"), ("1", "e9")], "player_id string, espn_id string")
    corrections = spark.createDataFrame([("3", "team", "Z", 1), ("3", "hat", "x", 2), ("", "team", "x", 3)], "player_id string, field string, new_value string, line int")
    d = identity_graph.build_dimension(players, crosswalk, corrections, {"position": ("position",), "espn_id": ("espn_id",), "team": ("latest_team", "team"), "college": ("college",)})
    got = {r.player_id: r for r in d.collect()}
    assert {k: (r.espn_id, r.team, r.college) for k, r in got.items()} == {"1": ("e1", "A", None), "2": (None, "B", None), "3": ("e3", "Z", None)}
    assert got["1"].slug != got["2"].slug and got["3"].slug == "bo-ray"
    found = {(r.issue_type, r.severity, r.identifier, r.name, r.n) for r in identity_graph.issues(players.withColumnRenamed("gsis_id", "player_id"), d, corrections).collect()}
    assert found == {("duplicate_id", "warning", "1", "", 2), ("ambiguous_name", "info", "1", "ann lee (QB)", 2), ("invalid_correction", "warning", "3", "hat", 1), ("invalid_correction", "warning", "", "team", 1)}


# ---- priors


def test_backoff_takes_the_finest_level_with_enough_rows(spark):
    rows = spark.createDataFrame([("QB", 1, 10.0)] * 3 + [("QB", 2, 4.0)] + [("RB", 1, 7.0)] + [(None, 1, 99.0)] * 3, "position string, bucket int, x double")
    levels = [["position", "bucket"], ["position"], []]
    t = priors.backoff_table(rows, levels, {"x": "x"})
    asked = spark.createDataFrame([(1, "QB", 1), (2, "QB", 2), (3, "RB", 1), (4, "TE", 5), (5, None, 1)], "k int, position string, bucket int")
    got = {r.k: (r.prior_x, r.prior_n, r.prior_level) for r in priors.backed_off(asked, t, levels, ["x"], least=3).collect()}
    whole = (30 + 4 + 7 + 297) / 8
    assert got == {1: (10.0, 3, 0), 2: (8.5, 4, 1), 3: (whole, 8, 2), 4: (whole, 8, 2), 5: (99.0, 3, 0)}
    assert {r.k: r.prior_level for r in priors.backed_off(asked, t, levels, ["x"], least=9).collect()} == dict.fromkeys(range(1, 6))


def test_rookie_priors(spark):
    kind = "k int, position string, draft_pick int, prior_carries double, college_final_pass_attempts double, college_final_rush_attempts double, college_final_receptions double, team_pass_attempts double, player_pass_attempts double, team_rush_attempts double"
    rows = [(1, "QB", 1, None, 500.0, None, None, 616.0, None, None), (2, "RB", 33, 100.0, None, 400.0, None, None, 280.0, 462.0), (3, "WR", None, 0.0, None, None, 0.0, None, None, None), (4, "TE", 0, None, None, None, 200.0, None, None, None)]
    got = {r.k: r for r in priors.rookie_priors(spark.createDataFrame(rows, kind)).collect()}
    cap = lambda p: max(0.18, min(1.0, 1 / (1 + (p - 1) / 55)))
    a = got[1]
    assert a.rookie_pass_attempts == pytest.approx((0.65 * 450 + 0.35 * 500) * 1.1) and a.rookie_completions == pytest.approx(a.rookie_pass_attempts * 0.64) and a.rookie_games == 15.0 and a.rookie_targets is None
    b = got[2]
    assert b.rookie_carries == pytest.approx((0.65 * 100 + 0.35 * 260) * 1.1) and b.rookie_targets == pytest.approx(35 * cap(33) * 0.85) and b.rookie_rushing_yards == pytest.approx(b.rookie_carries * 4.2)
    c = got[3]
    assert c.rookie_targets == pytest.approx(110 * cap(180)) and c.rookie_carries == pytest.approx(2 * cap(180)) and c.rookie_receiving_yards == pytest.approx(c.rookie_targets * 12)
    assert got[4].rookie_targets == pytest.approx(0.65 * 70 * cap(180) + 0.35 * 160)


# ---- rosters, bids, pool


def test_capacity_equals_the_search(spark):
    rng = random.Random(8)
    for slots in (["QB", "RB", "WR", "FLEX", "SUPERFLEX"], ["QB", "RB", "RB", "WR", "TE", "FLEX", "BENCH", "BENCH"], ["LB", "IDP_FLEX", "K", "DEF"], ["BENCH"], ["QB"]):
        rows = [(i, [rng.choice(["QB", "RB", "WR", "TE", "K", "LB", "DB", "P"]) for _ in range(rng.randint(0, len(slots) + 1))]) for i in range(150)] + [(999, None)]
        got = {r.i: r.fits for r in capacity.roster_fits(spark.createDataFrame(rows, "i int, positions array<string>"), slots).collect()}
        assert got == {i: draft.fits(tuple(sorted(p or [])), tuple(slots)) for i, p in rows}


def test_candidates_that_fit(spark):
    rosters = spark.createDataFrame([(1, "QB"), (1, "RB"), (2, "QB"), (2, "QB")], "roster int, position string")
    asked = spark.createDataFrame([(r, p) for r in (1, 2, 3) for p in ("QB", "RB", "K")], "roster int, position string")
    got = {(r.roster, r.position): r.fits for r in capacity.candidate_fits(rosters, asked, ["QB", "SUPERFLEX", "RB"]).collect()}
    have = {1: ["QB", "RB"], 2: ["QB", "QB"], 3: []}
    assert got == {(r, p): draft.fits(tuple(have[r] + [p]), ("QB", "SUPERFLEX", "RB")) for r in (1, 2, 3) for p in ("QB", "RB", "K")}


def test_counter_bids_keep_a_reserve_and_the_least_bid(spark):
    a = "draft int, player_id int, points double, current_bid int, highest_slot int, seconds double, seed int, pick_number int, rounds int, budget int, minimum int"
    auctions = spark.createDataFrame([(1, 1, 119.7, 26, 1, None, 0, 1, 3, 200, 1), (1, 2, 119.7, 27, 1, None, 0, 1, 3, 200, 1), (1, 3, 0.0, 0, 1, 5.0, 0, 1, 3, 10, 2), (1, 4, 900.0, 5, 1, 0.5, 0, 1, 3, 200, 1), (1, 5, 900.0, 49, 2, 1.0, 0, 1, 3, 200, 1), (1, 6, 900.0, 48, 2, 1.0, 0, 1, 3, 200, 1)], a)
    slots = spark.createDataFrame([(1, 1, True, 50, 1), (1, 2, True, 50, 1), (1, 3, False, 500, 0)], "draft int, slot int, is_cpu boolean, remaining int, picks int")
    fits = auctions.select("draft", "player_id").crossJoin(F.broadcast(slots.select("slot")))
    got = {r.player_id: (r.slot, r.bid) for r in pool.counter_bids(auctions, slots, fits).collect()}
    assert got == {1: (2, 27), 3: (2, 2), 6: (1, 49)}  # 26.6 rounds to 27; the least bid is always allowed; one is kept for the slot left open
    assert pool.counter_bids(auctions, slots, fits.where("slot <> 2")).where("player_id = 1").count() == 0


def test_baseline_points(spark):
    unit = lambda t: int(hashlib.sha256(t.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    players = spark.createDataFrame([("a", "K"), ("b", "LB"), ("c", "DL"), ("d", "S"), ("e", "K")], "player_id string, position string")
    stats = spark.createDataFrame([("a", 1, 1, None, 3, None), ("a", 1, 0, 1, 0, None), ("b", None, None, None, None, 4), ("b", None, None, None, None, 6)], "player_id string, fg_made int, fg_made_50_59 int, fg_made_60_ int, pat_made int, def_tackles_solo int")
    got = {r.player_id: r.points for r in pool.baseline_points(players, stats).collect()}
    assert got == {"a": 12.0, "b": 15.0, "c": round(72 + unit("c") * 18, 2), "d": round(60 + unit("d") * 18, 2), "e": 0.0}


def test_published_pool(spark):
    projected = spark.createDataFrame([("p1", "A", None, "QB", False, 25, 1, 300.004, 20.0, 1), ("p2", "B", "T1", "K", True, 22, 3, 100.0, 6.0, 2)], "player_id string, name string, team string, position string, rookie boolean, age int, tier int, points double, points_per_game double, overall_rank int")
    rosters = spark.createDataFrame([(f"k{i:02}", f"K{i:02}", "T", "K", 1, "1990-01-01") for i in range(45)] + [("p2", "B", "T1", "K", 0, "2000-01-01"), ("w", "W", "T", "WR", 1, None), ("b", None, None, "LB", None, "bad")], "player_id string, name string, team string, position string, years_exp int, birth_date string")
    stats = spark.createDataFrame([(f"k{i:02}", i) for i in range(45)] + [("p2", 1000)], "player_id string, pat_made int")
    teams = spark.createDataFrame([("X", 0), ("Y", 8)], "team string, place int")
    got = pool.published_pool(projected, rosters, stats, teams, 2026).orderBy("overall_rank").collect()
    assert [r.player_id for r in got[:4]] == ["p1", "p2", "b", "k44"] or [r.player_id for r in got[:4]] == ["p1", "p2", "k44", "b"] or got[2].points >= got[3].points
    kickers = [r for r in got if r.position == "K"]
    assert len(kickers) == 40 and kickers[0].player_id == "p2" and kickers[0].source == "projection"  # p2 took one of the forty places
    assert [r.position_rank for r in kickers] == list(range(1, 41)) and kickers[12].tier == 2 and kickers[11].tier == 1
    assert [(r.player_id, r.tier, r.adp) for r in got[-2:]] == [("DEF-X", 1, 999.0), ("DEF-Y", 2, 999.0)]
    one = next(r for r in got if r.player_id == "b")
    assert (one.name, one.team, one.rookie, one.age) == ("b", "FA", True, None) and got[0].points == 300.0 and got[0].team == "FA" and kickers[1].age == 36


# ---- neighbours


def test_neighbours_equal_all_pairs_with_fewer_comparisons(spark):
    rng = random.Random(3)
    rows = [(i // 3, 2000 + i % 3, ["QB", "RB", None][i % 7 % 3] if i % 7 < 6 else "QB", rng.gauss(0, 1) + i % 5 * 4, rng.choice([None, 1.0, rng.gauss(i % 5 * 3, 1)])) for i in range(1500)]
    d = spark.createDataFrame(rows, "player_id int, season int, position string, a double, b double")
    q = d.where("player_id % 25 = 0")
    got = {(r.player_id, r.season, r["rank"]): (r.other_id, r.other_season, r.distance) for r in nearest.nearest(d, q, ["a", "b"], k=4).collect()}
    want = {(r.player_id, r.season, r["rank"]): (r.other_id, r.other_season, r.distance) for r in season.neighbours(d, q, ["a", "b"], k=4).collect()}
    assert got == want
    some, every = nearest.comparisons(d, q, ["a", "b"], k=4)
    assert some < every / 3


def test_neighbours_of_few_rows(spark):
    d = spark.createDataFrame([(1, 2000, "QB", 1.0), (1, 2001, "QB", 1.0), (2, 2000, "QB", 1.0), (3, 2000, "RB", 1.0)], "player_id int, season int, position string, a double")
    got = sorted((r.player_id, r.season, r.other_id, r["rank"]) for r in nearest.nearest(d, d, ["a"], k=3).collect())
    assert got == [(1, 2000, 2, 1), (1, 2001, 2, 1), (2, 2000, 1, 1), (2, 2000, 1, 2)]
    assert nearest.nearest(d.where("false"), d.where("false"), ["a"]).count() == 0


# ---- rules


def test_single_rules(spark):
    d = spark.createDataFrame([(100, 1000, None, 2), (100, 1000, 3, None), (10, 100, 1, 1)], "attempts int, passing_yards int, passing_tds int, interceptions int")
    assert [r.adjusted_yards for r in features.adjusted_yards(d).collect()] == [9.1, 10.6, None]
    b = spark.createDataFrame([(0,), (None,), (1,), (264,), (300,)], "draft_pick int").selectExpr("*", "null as rookie_year", "2020 as entry_year", "2019 as draft_year", "2021 as season", "200.0 as weight", "70.0 as height")
    got = [r.draft_capital_log for r in features.body_and_capital(b).collect()]
    assert got[:2] == [0.0, 0.0] and got[2] == pytest.approx(math.log1p(262)) and got[3] == float("-inf") and math.isnan(got[4])
    r = features.rates(spark.createDataFrame([(30, 300)], "carries int, rushing_yards int"), features.RUSHING)
    assert set(features.RUSHING) <= set(r.columns) and r.first().yards_per_carry == 10.0 and r.first().catch_rate is None
    p = spark.createDataFrame([("A", 1, "REG", "pass", 5, 0.5, 500, 0.1), ("A", 1, "POST", "run", 5, 0.5, 500, 0.1)], "team string, season int, season_type string, play_type string, yardline int, wp double, half_seconds int, epa double")
    assert season.team_plays(p).first().team_plays == 1
    s = spark.createDataFrame([(1, 1, 1, 10, 0.5, "REG"), (1, 1, 2, 10, 0.5, "WC")], "foreign_id int, season int, week int, snaps int, share double, game_type string")
    assert season.snap_totals(s, spark.createDataFrame([(7, 1)], "player_id int, foreign_id int")).first().snaps == 10


def test_audit_counts_moves_away_and_conflicts(spark):
    kind = "player_id string, new_team string, old_team string, effective_season int, transaction_type string, roster_status string, on_roster boolean, eligible boolean, priority string, expected_rank string, as_of_date string"
    moves = spark.createDataFrame([("1", "B", "A", 2026, "trade", "active", True, True, "P2", None, "d"), ("2", "B", "A", 2026, "re_signed", "active", True, True, "P2", None, "d"), ("3", "B", "C", 2026, "trade", "active", True, True, "P1", None, "d")], kind)
    rows = spark.createDataFrame([(k, 2025, "A", "A", "A", 1.0) for k in "123"], "player_id string, season int, team string, next_team string, projected_team string, depth_rank double")
    got = {r.kind: r.n for r in roster.audit(rows, moves, 2026).collect()}
    assert got["stuck_before"] == 2  # the move away of 1, the conflict of 3; 2 stays by the kind of its move


def test_functions_of_sql(spark):
    functions_sql.register(spark)
    for kind, reverse in (("snake", False), ("snake", True), ("linear", False)):
        got = [r.slot for r in spark.sql(f"SELECT slot_for_pick(pick, 10, '{kind}', {str(reverse).lower()}) AS slot FROM draft_order(10, 5) ORDER BY pick").collect()]
        want = [r.slot for r in draft.draft_order(spark, 10, 5, kind, reverse).orderBy("pick").collect()]
        assert got == want
    assert spark.sql("SELECT count(*) FROM draft_order(0, 5)").first()[0] == 0
    assert tuple(spark.sql("SELECT pick_label(13, 12), valid_draft(12, 15, 15, 'linear', true), bid_limit(5, 10, 1)").first()) == ("2.01", False, 0)


def test_patched_projections_tell_the_role(spark):
    kind = "player_id string, new_team string, old_team string, effective_season int, transaction_type string, roster_status string, on_roster boolean, eligible boolean, priority string, expected_rank string, as_of_date string, starter_confidence string, role_uncertainty string"
    moves = spark.createDataFrame([("1", "B", "A", 2026, "trade", "active", False, True, "P2", "2", "2026-01", "low", "new scheme"), ("1", "C", "A", 2026, "trade", "active", True, True, "P1", "x", "2026-02", "high", None)], kind)
    rows = spark.createDataFrame([(k, 2025, "A", "A", "A", 1.0) for k in "12"], "player_id string, season int, team string, next_team string, projected_team string, depth_rank double")
    got = {r.player_id: r for r in roster.patch_projection(rows, moves, 2026).collect()}
    assert (got["1"].projected_team, got["1"].starter_confidence, got["1"].role_uncertainty, got["1"].offseason_active_roster, got["1"].depth_rank) == ("C", "high", None, True, 1.0)
    assert (got["2"].projected_team, got["2"].starter_confidence, got["2"].offseason_active_roster) == ("A", None, None)


def test_lost_fumbles_from_their_kinds(spark):
    from seasonforge.operators import projection

    d = spark.createDataFrame([("QB", None, 2.0, None, 1.0), ("QB", 5.0, 9.0, 9.0, 9.0), ("QB", -1.0, 0.0, 0.0, 0.0)], "position string, fumbles_lost double, rushing_fumbles_lost double, receiving_fumbles_lost double, sack_fumbles_lost double")
    assert [r.pred_fumbles_lost for r in projection.compose(d).collect()] == [pytest.approx(2.7), 4.5, 0.0]
