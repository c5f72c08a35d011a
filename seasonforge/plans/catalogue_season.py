"""Queries on moves, projections, the season table, entrants and the draft pool; they join the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pool, projection, quality, roster, season, windows
from . import base
from .base import PLAYERS, SEASONS, WEEKLY, table
from .catalogue import query

# ---- moves


def _raw_moves(s, d):
    k = F.col("c_custkey")
    before = base.seasons(s, d).where("season = 1996").select(F.col("player_id").alias("c_custkey"), F.col("team").alias("was"))
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(before, "c_custkey", "left")
    return c.select(
        F.when(k % 17 != 0, F.concat(F.lit(" "), k.cast("string"), F.lit(" "))).alias("player_id"), F.col("c_name").alias("name"),
        F.when(k % 11 == 0, F.lit("ret")).when(k % 4 == 0, F.lower("was")).otherwise(F.lower("n_name")).alias("new_team"), F.lower("was").alias("old_team"),
        F.when(k % 3 == 0, 1998).otherwise(1997).alias("effective_season"), F.when(k % 4 == 0, "re_signed").otherwise("trade").alias("transaction_type"),
        F.when(k % 13 == 0, "unsigned").when(k % 11 == 0, "retired").otherwise("active").alias("roster_status"),
        F.when(k % 5 == 0, "No").when(k % 5 == 1, "yes").when(k % 5 == 2, "TRUE").otherwise("1").alias("active_roster"), F.when(k % 2 == 0, "1").otherwise("no").alias("projection_eligible"),
        F.when(k % 7 < 4, "P1").otherwise("P2").alias("priority"), F.when(k % 4 == 0, "x").otherwise((k % 4).cast("string")).alias("expected_rank"),
        F.concat(F.lit("2026-0"), (1 + k % 9).cast("string"), F.lit("-01")).alias("as_of_date"), F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").alias("starter_confidence"), F.when(k % 5 == 0, "camp battle").alias("role_uncertainty"),
    )


def _moves(s, d):
    return roster.clean_moves(_raw_moves(s, d))


MOVES = SEASONS + """, raw AS (SELECT CASE WHEN c_custkey % 17 <> 0 THEN c_custkey::VARCHAR END AS player_id, c_name AS name,
    upper(CASE WHEN c_custkey % 11 = 0 THEN 'ret' WHEN c_custkey % 4 = 0 THEN s.team ELSE n_name END) AS new_team, upper(s.team) AS old_team,
    CASE WHEN c_custkey % 3 = 0 THEN 1998 ELSE 1997 END::INT AS effective_season, CASE WHEN c_custkey % 4 = 0 THEN 're_signed' ELSE 'trade' END AS transaction_type,
    CASE WHEN c_custkey % 13 = 0 THEN 'unsigned' WHEN c_custkey % 11 = 0 THEN 'retired' ELSE 'active' END AS roster_status,
    c_custkey % 5 <> 0 AS on_roster, c_custkey % 2 = 0 AS eligible, CASE WHEN c_custkey % 7 < 4 THEN 'P1' ELSE 'P2' END AS priority,
    CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 4)::DOUBLE END AS expected_rank, '2026-0' || (1 + c_custkey % 9) || '-01' AS as_of_date, CASE WHEN c_custkey % 3 = 0 THEN 'high' WHEN c_custkey % 3 = 1 THEN 'low' END AS starter_confidence, CASE WHEN c_custkey % 5 = 0 THEN 'camp battle' END AS role_uncertainty
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN seasons s ON s.player_id = c_custkey AND s.season = 1996),
  moves AS (SELECT *, CASE WHEN new_team IN ('RET', 'RETIRED') THEN 'FA' ELSE new_team END AS dest FROM raw)"""
NOW = MOVES + ", now AS (SELECT * FROM moves WHERE effective_season = 1997 AND player_id IS NOT NULL)"


@query(f"WITH {MOVES} SELECT player_id, new_team, old_team, effective_season, on_roster, eligible, dest FROM moves")
def i11_moves(s, d):
    return _moves(s, d).select("player_id", "new_team", "old_team", "effective_season", "on_roster", "eligible", roster.destination().alias("dest"))


@query(f"WITH {MOVES} SELECT max(as_of_date) AS as_of_date FROM moves")
def i17_as_of(s, d):
    return roster.as_of(_moves(s, d))


def _text_id(d):
    return d.withColumn("player_id", F.col("player_id").cast("string"))


def _week_one(s, d):
    w = base.weekly(s, d)
    return roster.week_one_teams(w, _text_id(base.seasons(s, d)).select("player_id", "season", "team"), 1996)


WEEK_ONE = """w1 AS (SELECT player_id, season, max(team) AS week1_team FROM (SELECT player_id::VARCHAR AS player_id, season, team FROM weekly WHERE week = 1 AND season <> 1996
    UNION ALL SELECT player_id::VARCHAR, season, team FROM seasons WHERE season = 1996) GROUP BY ALL)"""


@query(f"WITH {SEASONS}, {WEEK_ONE} SELECT * FROM w1")
def i10_week_one(s, d):
    return _text_id(_week_one(s, d))


@query(f"""WITH {NOW}, {WEEK_ONE}, old AS (SELECT * FROM w1 WHERE season <> 1997), seed AS (SELECT player_id, week1_team FROM w1 WHERE season = 1996)
SELECT player_id, season, week1_team FROM old UNION ALL SELECT coalesce(s.player_id, n.player_id), 1997, coalesce(n.dest, s.week1_team) FROM seed s FULL JOIN now n ON s.player_id = n.player_id""")
def i12_patch_week_one(s, d):
    return roster.patch_week_one(_text_id(_week_one(s, d)).where("season <> 1997"), _moves(s, d), 1997)


def _projected(s, d):
    rows = _text_id(base.seasons(s, d)).where("season = 1996").withColumn("team", F.upper("team"))
    k = F.col("player_id").cast("long")
    return rows.select("player_id", "season", "team", "carries", "receptions", F.when(k % 6 == 0, F.lit(None)).otherwise(F.col("team")).alias("next_team"), F.when(k % 5 != 0, F.col("team")).alias("projected_team"), (k % 3).cast("double").alias("depth_rank"))


ROWS = """r AS (SELECT player_id::VARCHAR AS player_id, season, upper(team) AS team, carries, receptions, CASE WHEN player_id % 6 <> 0 THEN upper(team) END AS next_team,
    CASE WHEN player_id % 5 <> 0 THEN upper(team) END AS projected_team, (player_id % 3)::DOUBLE AS depth_rank FROM seasons WHERE season = 1996),
  patched AS (SELECT r.player_id, r.season, r.team, carries, receptions, coalesce(dest, next_team) AS next_team, coalesce(dest, projected_team, next_team) AS projected_team,
    coalesce(expected_rank, depth_rank) AS depth_rank, coalesce(dest <> r.team, false)::INT AS team_changed, roster_status AS offseason_status, eligible AS projection_eligible, priority AS offseason_priority, starter_confidence, role_uncertainty, on_roster AS offseason_active_roster
    FROM r LEFT JOIN now n USING (player_id))"""


@query(f"WITH {NOW}, {ROWS} SELECT * FROM patched")
def i13_patch_projection(s, d):
    return roster.patch_projection(_projected(s, d), _moves(s, d), 1997)


@query(f"WITH {NOW}, {ROWS} SELECT r.player_id, projected_team, roster_status, dest AS expected_team FROM r JOIN now USING (player_id) WHERE now.priority = 'P1' AND projected_team <> dest")
def i14_conflicts(s, d):
    return roster.conflicts(_projected(s, d), _moves(s, d), 1997)


@query(f"""WITH {NOW}, {ROWS}, f AS (SELECT 'stuck_before' AS kind, (SELECT count(*) FROM r JOIN now n USING (player_id) WHERE n.new_team <> n.old_team AND n.transaction_type NOT IN ('re_signed', 'extended', 'revised_contract', 'franchise_tagged', 'new_contract') AND r.projected_team = n.old_team)
    + (SELECT count(*) FROM r JOIN now n USING (player_id) WHERE n.priority = 'P1' AND r.projected_team <> n.dest) AS n
  UNION ALL SELECT 'conflicts', (SELECT count(*) FROM patched p JOIN now n USING (player_id) WHERE n.priority = 'P1' AND p.projected_team <> n.dest)
  UNION ALL SELECT 'off_roster_on_team', (SELECT count(*) FROM patched p JOIN now n USING (player_id) WHERE (n.roster_status <> 'active' OR NOT n.on_roster) AND p.projected_team NOT IN ('FA', 'UNKNOWN', 'RET', 'RETIRED'))
  UNION ALL SELECT 'unresolved', (SELECT count(*) FROM moves WHERE effective_season = 1997 AND player_id IS NULL))
SELECT kind, n, n = 0 OR kind IN ('stuck_before', 'unresolved') AS ok FROM f""")
def i15_audit(s, d):
    return roster.audit(_projected(s, d), _moves(s, d), 1997)


@query(f"""WITH {NOW} SELECT s.team, count(*) AS leavers, sum(s.carries)::BIGINT AS vacated_carries, sum(s.receptions)::BIGINT AS vacated_receptions
FROM (SELECT * REPLACE (player_id::VARCHAR AS player_id, upper(team) AS team) FROM seasons WHERE season = 1996) s JOIN now n ON n.player_id = s.player_id AND n.old_team = s.team WHERE n.new_team <> n.old_team GROUP BY s.team""")
def a22_vacated_audit(s, d):
    rows = _text_id(base.seasons(s, d)).withColumn("team", F.upper("team"))
    return roster.vacated_by_team(rows, _moves(s, d), 1996, ["carries", "receptions"])


@query("SELECT c_custkey, upper(replace(c_name, '#', '-')) AS name, c_custkey % 3 = 0 AS present FROM customer")
def i16_listed_present(s, d):
    c = table(s, d, "customer")
    wanted = c.select("c_custkey", F.upper(F.regexp_replace("c_name", "#", "-")).alias("name"))
    return roster.listed_present(wanted, c.where("c_custkey % 3 = 0").select(F.col("c_name").alias("name")))


@query("""WITH p AS (SELECT c_custkey AS player_id, 'p' || c_custkey % 50 AS name, c_mktsegment AS position, CASE WHEN c_custkey % 2 = 0 THEN 'ACT' ELSE 'RES' END AS status FROM customer),
m AS (SELECT DISTINCT name, 'BUILDING' AS position FROM p)
SELECT m.name, m.position, p.player_id FROM m JOIN p ON p.name = m.name QUALIFY row_number() OVER (PARTITION BY m.name ORDER BY p.position <> m.position, p.status <> 'ACT', p.player_id) = 1""")
def i18_resolve_moves(s, d):
    c = table(s, d, "customer")
    k = F.col("c_custkey")
    p = c.select(k.alias("player_id"), F.concat(F.lit("p"), (k % 50).cast("string")).alias("name"), F.col("c_mktsegment").alias("position"), F.when(k % 2 == 0, "ACT").otherwise("RES").alias("status"))
    moves = p.select(F.upper("name").alias("name")).distinct().withColumn("position", F.lit("BUILDING"))
    return roster.resolve_moves(moves, p).withColumn("name", F.lower("name"))


# ---- projections


def _priors(s, d):
    k = F.col("player_id")
    r = base.seasons(s, d).where("season = 1997 and position is not null")
    return r.select(
        "player_id", "position", F.col("games").cast("double").alias("games"), F.when(k % 9 != 0, F.col("carries").cast("double") / (1 + k % 40)).alias("carries"),
        F.when(k % 8 != 0, F.col("receptions").cast("double") + 10).alias("targets"), F.col("receptions").cast("double").alias("receptions"), F.col("rushing_yards").cast("double").alias("rushing_yards"),
        F.when(k % 7 != 0, (20 + k % 20).cast("double")).alias("age"), (k % 3 == 0).alias("team_changed"), (k % 5 == 0).alias("starter"), (1 + k % 4).cast("double").alias("depth_rank"),
    )


PRIORS = SEASONS + """, pr AS (SELECT player_id, position, games::DOUBLE AS games, CASE WHEN player_id % 9 <> 0 THEN carries::DOUBLE / (1 + player_id % 40) END AS carries,
    CASE WHEN player_id % 8 <> 0 THEN receptions::DOUBLE + 10 END AS targets, receptions::DOUBLE AS receptions, rushing_yards::DOUBLE AS rushing_yards,
    CASE WHEN player_id % 7 <> 0 THEN 20 + player_id % 20 END AS age, player_id % 3 = 0 AS moved, player_id % 5 = 0 AS starter, 1 + player_id % 4 AS depth FROM seasons WHERE season = 1997 AND position IS NOT NULL),
  mn AS (SELECT position, avg(games) AS mg, avg(carries) AS mc, avg(targets) AS mt FROM pr GROUP BY ALL),
  fac AS (SELECT *, CASE WHEN starter THEN 1.04 WHEN depth <= 1.5 THEN 1.03 WHEN depth >= 3 THEN 0.88 ELSE 1.0 END::DOUBLE AS df,
    (CASE WHEN moved THEN CASE position WHEN 'QB' THEN 0.95 WHEN 'RB' THEN 0.88 WHEN 'WR' THEN 0.86 WHEN 'TE' THEN 0.90 ELSE 0.9 END ELSE 1.0 END)::DOUBLE AS mf,
    (CASE WHEN age IS NULL THEN 1.0 WHEN position = 'RB' THEN CASE WHEN age <= 24 THEN 1.03 WHEN age <= 26 THEN 1.0 WHEN age <= 28 THEN 0.94 WHEN age <= 30 THEN 0.86 ELSE 0.75 END
      WHEN position = 'WR' THEN CASE WHEN age <= 26 THEN 1.02 WHEN age <= 29 THEN 1.0 WHEN age <= 32 THEN 0.93 ELSE 0.85 END
      WHEN position = 'TE' THEN CASE WHEN age <= 28 THEN 1.01 WHEN age <= 31 THEN 0.97 ELSE 0.90 END
      ELSE CASE WHEN age <= 32 THEN 1.0 WHEN age <= 36 THEN 0.96 ELSE 0.90 END END)::DOUBLE AS af FROM pr JOIN mn USING (position)),
  raw AS (SELECT *, CASE WHEN games > 1.35 * mg THEN 0.62 * games + 0.38 * mg ELSE 0.72 * games + 0.28 * mg END AS g0,
    CASE WHEN carries IS NULL THEN mc WHEN carries > 1.35 * mc THEN 0.62 * carries + 0.38 * mc ELSE 0.72 * carries + 0.28 * mc END AS c0,
    CASE WHEN targets IS NULL THEN mt WHEN targets > 1.35 * mt THEN 0.62 * targets + 0.38 * mt ELSE 0.72 * targets + 0.28 * mt END AS t0, af * mf * df AS k FROM fac),
  comp AS (SELECT *, CASE WHEN position IN ('RB', 'WR', 'TE') THEN t0 * least(0.8, greatest(0.45, CASE WHEN targets > 0 THEN receptions / targets ELSE 0.65 END)) END AS r0,
    CASE WHEN position IN ('RB', 'QB', 'WR') THEN c0 * least(6.5, greatest(2.5, CASE WHEN carries > 0 THEN rushing_yards / carries ELSE 4.2 END)) END AS y0 FROM raw),
  cap AS (SELECT *, CASE WHEN carries > 0 THEN least(c0 * k, carries * 1.15) ELSE c0 * k END AS c1, CASE WHEN targets > 0 THEN least(t0 * k, targets * 1.15) ELSE t0 * k END AS t1 FROM comp)"""


@query(f"""WITH {PRIORS} SELECT player_id, position, round(g0, 6) AS pred_games,
  round(CASE WHEN carries > 0 AND carries < 20 AND df < 1.02 THEN least(c1, greatest(carries * 1.35, c1 * 0.85)) ELSE c1 END, 6) AS pred_carries,
  round(CASE WHEN targets > 0 AND targets < 20 AND df < 1.02 THEN least(t1, greatest(targets * 1.35, t1 * 0.85)) ELSE t1 END, 6) AS pred_targets,
  round(CASE WHEN r0 IS NOT NULL AND receptions > 0 THEN least(r0 * k, receptions * 1.15) ELSE r0 * k END, 6) AS pred_receptions, round(CASE WHEN y0 IS NOT NULL AND rushing_yards > 0 THEN least(y0 * k, rushing_yards * 1.15) ELSE y0 * k END, 6) AS pred_rushing_yards FROM cap""")
def m17_projection(s, d):
    out = projection.project(_priors(s, d), ["games", "carries", "targets"], ["receptions", "rushing_yards"])
    return out.select("player_id", "position", *[F.round(f"pred_{c}", 6).alias(f"pred_{c}") for c in ("games", "carries", "targets", "receptions", "rushing_yards")])


@query(f"WITH {PRIORS} SELECT player_id, CASE WHEN games = 0 THEN 15.0 ELSE games END::DOUBLE AS games, coalesce(c0, carries, 0.0)::DOUBLE AS carries FROM raw")
def m20_stats_of(s, d):
    p = projection.fallback(_priors(s, d), ["carries"]).withColumn("pred_games", F.lit(None).cast("double"))
    return p.select("player_id", *[c.alias(n) for n, c in projection.stats_of(["games", "carries"]).items()])


@query(f"""WITH {PRIORS}, c AS (SELECT player_id, least(greatest(0.22 * least(games / 16, 1) + 0.18 * (carries IS NOT NULL)::INT + 0.25 * least(greatest(1 - (greatest(games * 3 - games, 0) / greatest(games * 2, 20.0)) / 1.5, 0), 1)
  + 0.20 * (1.0 / depth) + 0.15 * CASE WHEN age IS NULL THEN 0 ELSE least(age / 30.0, 1) END, 0), 1)::DOUBLE AS score FROM pr) SELECT player_id, round(score, 9) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS label FROM c""")
def f42_confidence(s, d):
    g = F.col("games")
    p = _priors(s, d).withColumns({"low": g, "mid": g * 2, "high": g * 3})
    parts = {
        "sample_size": g / 16, "feature_coverage": F.col("carries").isNotNull().cast("double"), "interval_width": projection.interval_score("low", "mid", "high"),
        "role_stability": 1 / F.col("depth_rank"), "model_agreement": F.coalesce(F.col("age") / 30, F.lit(float("nan"))),
    }
    score, label = projection.confidence(parts)
    return p.select("player_id", F.round(score, 9).alias("score"), label.alias("label"))


@query(f"WITH {PRIORS} SELECT player_id, coalesce(carries, 0.0)::DOUBLE AS total, coalesce(carries / nullif(games, 0), 0)::DOUBLE * CASE WHEN games > 0 THEN games ELSE 16 END AS rate FROM pr")
def m04_previous(s, d):
    return _priors(s, d).select("player_id", projection.previous_total("carries").alias("total"), projection.previous_rate("carries").alias("rate"))


@query(f"WITH {PRIORS} SELECT 'age' AS name, avg((age IS NOT NULL)::INT) AS coverage FROM pr UNION ALL SELECT 'carries', avg((carries IS NOT NULL)::INT) FROM pr UNION ALL SELECT 'games', avg((games IS NOT NULL)::INT) FROM pr")
def m03_coverage(s, d):
    return projection.coverage(_priors(s, d), ["age", "carries", "games"])


# ---- the season table


def _players(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("player_id"), F.when(k % 4 != 0, F.date_add(F.lit("1965-01-01").cast("date"), (k % 4000).cast("int"))).alias("birth_date"), F.when(k % 6 != 0, (66 + k % 12).cast("double")).alias("height"),
        (180 + k % 90).cast("double").alias("weight"), F.when(k % 7 != 0, 1990 + k % 5).alias("rookie_year"), F.when(k % 3 != 0, F.lit(1991)).alias("draft_year"), F.when(k % 300 < 262, 1 + k % 300).alias("draft_pick"),
    )


def _rosters(s, d):
    k = F.col("player_id")
    return base.seasons(s, d).select("player_id", "season", F.when(k % 2 == 0, 1992).alias("entry_year"), F.lit("1970-01-01").cast("date").alias("birth_date"), F.lit(70.0).alias("height"), F.lit(200.0).alias("weight"), F.when(k % 5 == 0, "RES").when(k % 5 == 1, "A01").when(k % 5 == 2, F.lit(None)).otherwise("ACT").alias("status"))


@query(f"""WITH {SEASONS}, p AS (SELECT c_custkey AS player_id, CASE WHEN c_custkey % 6 <> 0 THEN 66 + c_custkey % 12 ELSE 70 END AS height, 180 + c_custkey % 90 AS weight,
    coalesce(CASE WHEN c_custkey % 7 <> 0 THEN 1990 + c_custkey % 5 END, CASE WHEN c_custkey % 2 = 0 THEN 1992 END, CASE WHEN c_custkey % 3 <> 0 THEN 1991 END) AS entry_season,
    CASE WHEN c_custkey % 300 < 262 THEN 1 + c_custkey % 300 END AS draft_pick FROM customer), t AS (SELECT team, season, sum(carries) AS team_rush_attempts FROM seasons GROUP BY ALL),
  te AS (SELECT team, season, sum(receptions) AS te FROM seasons WHERE position = 'TE' GROUP BY ALL)
SELECT s.player_id, s.season, s.team, entry_season::INT AS entry_season, CASE WHEN entry_season IS NOT NULL THEN greatest(s.season - entry_season, 0) END::INT AS experience, round(703.0 * weight / (height * height), 6)::DOUBLE AS bmi,
  (draft_pick IS NULL)::INT AS is_undrafted, round(CASE WHEN draft_pick IS NULL THEN 0 ELSE ln(1 + 263.0 - draft_pick) END, 6)::DOUBLE AS draft_capital_log,
  CASE s.player_id % 5 WHEN 0 THEN 0 WHEN 2 THEN NULL ELSE 1 END::INT AS roster_active, team_rush_attempts::BIGINT AS own_team_rush_attempts,
  round(s.carries::DOUBLE / nullif(team_rush_attempts, 0), 9) AS rush_share, (s.carries + 2 * s.receptions)::BIGINT AS weighted_opportunity,
  round(CASE WHEN s.carries > 20 THEN s.rushing_yards::DOUBLE / s.carries END, 6) AS yards_per_carry, round(s.receptions::DOUBLE / nullif(te, 0), 9) AS te_target_share
FROM seasons s JOIN p USING (player_id) JOIN t USING (team, season) LEFT JOIN te USING (team, season)""")
def e01_season_table(s, d):
    seasons = base.seasons(s, d).withColumn("targets", F.col("receptions"))
    context = seasons.groupBy("team", "season").agg(F.sum("carries").alias("team_rush_attempts"))
    depth = seasons.select("player_id", "season", (F.col("player_id") % 4).cast("double").alias("depth_rank"), (F.col("player_id") % 4 == 0).cast("int").alias("starter"))
    t = season.season_table(seasons, _players(s, d), _rosters(s, d), context, depth, (None,))
    rounded = {"bmi": 6, "draft_capital_log": 6, "rush_share": 9, "yards_per_carry": 6, "te_target_share": 9}
    names = ["player_id", "season", "team", "entry_season", "experience", "bmi", "is_undrafted", "draft_capital_log", "roster_active", "own_team_rush_attempts", "rush_share", "weighted_opportunity", "yards_per_carry", "te_target_share"]
    return t.withColumns({c: F.round(c, n) for c, n in rounded.items()} | {"entry_season": F.col("entry_season").cast("int"), "experience": F.col("experience").cast("int")}).select(*names)


@query(f"""WITH {WEEKLY}, p AS (SELECT team, season, CASE WHEN down % 2 = 0 THEN 'pass' ELSE 'run' END AS play_type, carries AS yardline, receptions / 10.0::DOUBLE AS wp, rushing_yards % 1000 AS half_seconds, rushing_yards / 1000.0::DOUBLE AS epa FROM weekly WHERE down <> 5 AND season_type = 'REG')
SELECT team, season, count(*) AS team_plays, count(*) FILTER (yardline <= 20) AS team_rz_plays, count(*) FILTER (yardline <= 20 AND play_type = 'pass') AS team_rz_pass_plays, count(*) FILTER (yardline <= 20 AND play_type = 'run') AS team_rz_rush_plays,
  avg((play_type = 'pass')::INT) FILTER (wp BETWEEN 0.2 AND 0.8 AND half_seconds > 120) AS team_neutral_pass_rate, round(avg(epa), 6) AS team_epa FROM p GROUP BY ALL""")
def a15_team_plays(s, d):
    w = base.weekly(s, d)
    kind = F.when(F.col("down") == 5, "punt").when(F.col("down") % 2 == 0, "pass").otherwise("run")
    p = w.select("team", "season", "season_type", kind.alias("play_type"), F.col("carries").alias("yardline"), (F.col("receptions") / F.lit(10.0)).alias("wp"), (F.col("rushing_yards") % 1000).alias("half_seconds"), (F.col("rushing_yards") / F.lit(1000.0)).alias("epa"))
    return season.team_plays(p).withColumn("team_epa", F.round("team_epa", 6))


@query(f"""WITH {WEEKLY}, g AS (SELECT player_id * 2 AS fid, season, sum(carries)::DOUBLE AS snaps, avg(receptions) AS snap_share, count(DISTINCT week) AS snap_games FROM weekly WHERE season_type = 'REG' GROUP BY ALL)
SELECT season, snaps, snap_share, snap_games, c_custkey AS player_id FROM g JOIN customer ON fid = c_custkey * 2 AND c_custkey % 3 <> 0""")
def a07_snap_totals(s, d):
    w = base.weekly(s, d).select((F.col("player_id") * 2).alias("foreign_id"), "season", "week", F.col("carries").alias("snaps"), F.col("receptions").alias("share"), F.col("season_type").alias("game_type"))
    k = F.col("c_custkey")
    return season.snap_totals(w, table(s, d, "customer").select(k.alias("player_id"), F.when(k % 3 != 0, k * 2).alias("foreign_id")))


@query(f"WITH {SEASONS} SELECT team, season, sum(carries)::DOUBLE AS team_plays, NULL::DOUBLE AS team_pace FROM seasons GROUP BY ALL")
def e26_team_context(s, d):
    t = base.seasons(s, d).groupBy("team", "season").agg(F.sum("carries").alias("team_plays"))
    return season.team_context(t, None, ["team_plays", "team_pace"])


@query(f"WITH {SEASONS} SELECT s.player_id, s.season, s.carries, o.carries AS carries_next FROM seasons s LEFT JOIN (SELECT player_id, season - 1 AS season, carries FROM seasons) o USING (player_id, season)")
def j04_suffixed(s, d):
    x = base.seasons(s, d).select("player_id", "season", "carries")
    return season.attach_suffixed(x, x.withColumn("season", F.col("season") - 1), ["player_id", "season"], "_next")


def _first_pairs(s, d):
    f = base.seasons(s, d).withColumn("experience", F.row_number().over(windows.by_season()))
    return f.withColumn("draft_pick", F.when(F.col("player_id") % 300 < 262, 1 + F.col("player_id") % 300))


@query(f"""WITH {SEASONS}, f AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY season) AS experience, CASE WHEN player_id % 300 < 262 THEN 1 + player_id % 300 END AS pick FROM seasons)
SELECT position, CASE WHEN pick <= 10 THEN 1 WHEN pick <= 32 THEN 2 WHEN pick <= 64 THEN 3 WHEN pick <= 100 THEN 4 ELSE 5 END::INT AS bucket, count(*) AS n, round(avg(carries), 6) AS carries, round(avg(receptions), 6) AS receptions FROM f WHERE experience = 1 GROUP BY ALL""")
def a23_year_one(s, d):
    c = season.year_one_curves(_first_pairs(s, d), ["carries", "receptions"])
    return c.withColumns({x: F.round(x, 6) for x in ("carries", "receptions")})


@query(f"WITH {SEASONS} SELECT team, round(avg(carries), 6) AS carries FROM seasons GROUP BY ALL")
def a24_team_priors(s, d):
    return season.team_priors(base.seasons(s, d), ["carries"]).withColumn("carries", F.round("carries", 6))


def _entrants(s, d, offset):
    k = F.col("c_custkey")
    c = table(s, d, "customer")
    college = c.where("c_custkey % 2 = 0").select((k + offset).alias("college_id"), F.concat(F.lit("n"), (k % 97).cast("string")).alias("name_key"), k.cast("double").alias("yards"), (1990 + k % 3).cast("int").alias("college_season"))
    return season.enrich_entrants(c.select(k.alias("player_id"), k.alias("college_id"), F.concat(F.lit("n"), (k % 97).cast("string")).alias("name_key"), (k % 260).alias("draft_pick")), college)


@query("""WITH c AS (SELECT 'n' || c_custkey % 97 AS key, arg_max(c_custkey, (1990 + c_custkey % 3) * 1000000000 + c_custkey)::DOUBLE AS yards FROM customer WHERE c_custkey % 2 = 0 GROUP BY ALL)
SELECT 'by_id' AS kind, c_custkey AS player_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE END AS yards, round(1.0 / greatest(c_custkey % 260, 1), 9)::DOUBLE AS capital_inverse, round(ln(1 + c_custkey % 260), 9)::DOUBLE AS capital_log FROM customer
UNION ALL SELECT 'by_name', c_custkey, yards, round(1.0 / greatest(c_custkey % 260, 1), 9)::DOUBLE, round(ln(1 + c_custkey % 260), 9)::DOUBLE FROM customer LEFT JOIN c ON key = 'n' || c_custkey % 97""")
def j05_entrants(s, d):
    a, b = _entrants(s, d, 0).withColumn("kind", F.lit("by_id")), _entrants(s, d, 10**12).withColumn("kind", F.lit("by_name"))
    return a.unionByName(b).select("kind", "player_id", "yards", F.round("capital_inverse", 9).alias("capital_inverse"), F.round("capital_log", 9).alias("capital_log"))


@query(f"""WITH {SEASONS}, x AS (SELECT CASE WHEN player_id % 5 <> 0 THEN carries END AS carries, receptions, CASE WHEN player_id % 3 = 0 THEN carries END AS rare, lag(receptions) OVER (PARTITION BY player_id ORDER BY season) AS receptions_lag1,
    coalesce(CASE WHEN player_id % 7 <> 0 THEN rushing_yards END, 0)::DOUBLE AS y FROM seasons),
  l AS (UNPIVOT (SELECT carries::DOUBLE AS carries, receptions::DOUBLE AS receptions, rare::DOUBLE AS rare, y FROM x) ON carries, receptions, rare INTO NAME feature VALUE v),
  k AS (SELECT feature, v, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS a, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS b FROM l WHERE v IS NOT NULL),
  c AS (SELECT feature, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, corr(v, y) AS pearson, corr(a, b) AS spearman FROM k GROUP BY ALL),
  t AS (SELECT corr(receptions, receptions_lag1) AS stability FROM x), s AS (SELECT corr(a, b) AS rank_stability FROM (SELECT rank() OVER (ORDER BY receptions) + (count(*) OVER (PARTITION BY receptions) - 1) / 2.0 AS a,
    rank() OVER (ORDER BY receptions_lag1) + (count(*) OVER (PARTITION BY receptions_lag1) - 1) / 2.0 AS b FROM x WHERE receptions_lag1 IS NOT NULL)),
  all_rows AS (SELECT count(*) AS m FROM x)
SELECT feature, round(n / m, 6) AS coverage, round(1 - n / m, 6) AS missing_rate, round(mean, 4) AS mean, round(std, 4) AS std, CASE WHEN n / m >= 0.35 THEN 'included' ELSE 'excluded' END AS decision, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman,
  round(pearson * pearson, 6) AS r2, CASE WHEN feature = 'receptions' THEN round(stability, 6) END AS stability, CASE WHEN feature = 'receptions' THEN round(rank_stability, 6) END AS rank_stability, round(abs(pearson), 6) AS importance,
  row_number() OVER (ORDER BY abs(pearson) DESC, feature)::INT AS rank FROM c, t, s, all_rows""")
def e30_feature_research(s, d):
    k = F.col("player_id")
    x = base.seasons(s, d).withColumn("receptions_lag1", F.lag("receptions").over(windows.by_season()))
    x = x.withColumns({"rare": F.when(k % 3 == 0, F.col("carries")), "carries": F.when(k % 5 != 0, F.col("carries")), "y": F.when(k % 7 != 0, F.col("rushing_yards"))})
    r = season.feature_research(x, ["carries", "receptions", "rare"], "y")
    return r.withColumns({c: F.round(c, 4 if c in ("mean", "std") else 6) for c in r.columns if c not in ("feature", "decision", "rank")})


@query(f"""WITH {SEASONS}, f AS (SELECT player_id, season, team, dense_rank() OVER (PARTITION BY player_id, team ORDER BY season) AS seasons_with_team FROM seasons) SELECT * FROM f""")
def w08_seasons_with_team(s, d):
    return windows.seasons_with_team(base.seasons(s, d)).select("player_id", "season", "team", "seasons_with_team")


# ---- the draft pool


def _pool(s, d):
    p = base.players(s, d).select("player_id", F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("team"), "position", F.round("points", 3).alias("points"))
    k = F.col("s_suppkey")
    others = table(s, d, "supplier").select((k * 3).alias("player_id"), F.col("s_name").alias("name"), F.lit("X").alias("team"), F.when(k % 2 == 0, "K").otherwise("DEF").alias("position"), (k % 100).cast("double").alias("points"))
    return pool.build_pool(p, others, limits={"K": 5})


POOL = PLAYERS + """, src AS (SELECT player_id, 'Player ' || player_id AS name, 'FA' AS team, position, round(points, 3) AS points, 0 AS source FROM players
    UNION ALL SELECT s_suppkey * 3, s_name, 'X', CASE WHEN s_suppkey % 2 = 0 THEN 'K' ELSE 'DEF' END, (s_suppkey % 100)::DOUBLE, 1 FROM supplier),
  one AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY source, points DESC) = 1),
  placed AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY source, points DESC, player_id)::INT AS position_rank FROM one),
  pool AS (SELECT *, row_number() OVER (ORDER BY source, points DESC, player_id)::INT AS overall_rank FROM placed WHERE position <> 'K' OR position_rank <= 5)"""


@query(f"WITH {POOL} SELECT player_id, source::INT AS source, name, team, position, points, position_rank, overall_rank FROM pool")
def r16_pool(s, d):
    return _pool(s, d)


@query(f"WITH {POOL} SELECT player_id, name, row_number() OVER (ORDER BY points DESC, player_id)::INT AS row FROM pool WHERE position = 'QB' AND contains(lower(name), 'r 1') AND player_id % 4 <> 0")
def p20_available(s, d):
    p = _pool(s, d).withColumn("rookie", F.lit(False))
    return pool.available(p, p.where("player_id % 4 = 0"), position="QB", text="R 1", by="points", descending=True).select("player_id", "name", "row")


@query(f"WITH {POOL}, c AS (SELECT * FROM pool WHERE player_id IN (3, 6, 9)) SELECT m AS measure, max(v) FILTER (player_id = 3) AS \"3\", max(v) FILTER (player_id = 6) AS \"6\", max(v) FILTER (player_id = 9) AS \"9\" FROM (SELECT player_id, 'points' AS m, points AS v FROM c UNION ALL SELECT player_id, 'overall_rank', overall_rank FROM c) GROUP BY m")
def r18_compare(s, d):
    return pool.compare(_pool(s, d), [3, 6, 9], ["points", "overall_rank"])


@query("SELECT 'some' AS kind, n_nationkey FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'none', n_nationkey FROM nation")
def p15_or_all(s, d):
    n = table(s, d, "nation")
    some, none = (pool.or_all(n, F.col("n_regionkey") == k).select(F.lit(name).alias("kind"), "n_nationkey") for k, name in ((1, "some"), (99, "none")))
    return some.unionByName(none)


def _defenders(s, d):
    k = F.col("s_suppkey")
    position = F.when(k % 5 == 0, "K").when(k % 5 == 1, "LB").when(k % 5 == 2, "DL").when(k % 5 == 3, "DB").otherwise("WR")
    r = table(s, d, "supplier").select((k * 3).cast("string").alias("player_id"), F.col("s_name").alias("name"), F.when(k % 7 != 0, F.concat(F.lit("T"), F.col("s_nationkey").cast("string"))).alias("team"), position.alias("position"), (k % 4).alias("years_exp"), F.when(k % 6 != 0, F.concat((1990 + k % 10).cast("string"), F.lit("-05-01"))).otherwise("?").alias("birth_date"))
    n = F.col("l_linenumber")
    t = table(s, d, "lineitem").where("l_suppkey % 3 <> 0 and l_orderkey % 20 = 1")
    t = t.select((F.col("l_suppkey") * 3).cast("string").alias("player_id"), n.alias("fg_made"), (n % 2).alias("fg_made_50_59"), F.when(n % 3 == 0, 1).alias("fg_made_60_"), (n % 4).alias("pat_made"), n.alias("def_tackles_solo"), (n % 3).alias("def_tackle_assists"), (n % 2).alias("def_sacks"), (n % 5 == 0).cast("int").alias("def_interceptions"), (n % 4 == 0).cast("int").alias("def_fumbles_forced"), (n % 6 == 0).cast("int").alias("def_fumbles"), (n % 2).alias("def_pass_defended"), (n % 7 == 0).cast("int").alias("def_tds"), (n % 7 == 1).cast("int").alias("def_safeties"))
    return r, t


DEFENDERS = """ros AS (SELECT (s_suppkey * 3)::VARCHAR AS player_id, s_name AS name, CASE WHEN s_suppkey % 7 <> 0 THEN 'T' || s_nationkey END AS team, ['K', 'LB', 'DL', 'DB', 'WR'][s_suppkey % 5 + 1] AS position, s_suppkey % 4 AS years_exp,
    CASE WHEN s_suppkey % 6 <> 0 THEN 1990 + s_suppkey % 10 END AS born FROM supplier),
  sums AS (SELECT (l_suppkey * 3)::VARCHAR AS player_id, sum(3 * n + n % 2 + 2 * (n % 3 = 0)::INT + n % 4)::DOUBLE AS k,
      sum(1.5 * n + 0.75 * (n % 3) + 4 * (n % 2) + 5 * (n % 5 = 0)::INT + 3 * (n % 4 = 0)::INT + 3 * (n % 6 = 0)::INT + n % 2 + 6 * (n % 7 = 0)::INT + 2 * (n % 7 = 1)::INT)::DOUBLE AS d
    FROM (SELECT l_suppkey, l_linenumber AS n FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_orderkey % 20 = 1) GROUP BY ALL),
  worth AS (SELECT r.player_id, position, round(CASE WHEN position = 'K' THEN coalesce(k, 0) WHEN d > 0 THEN d
      ELSE CASE position WHEN 'LB' THEN 82 WHEN 'DL' THEN 72 WHEN 'DB' THEN 68 ELSE 60 END + ('0x' || sha256(r.player_id)[:8])::BIGINT / 4294967295.0::DOUBLE * 18 END, 2)::DOUBLE AS points FROM ros r LEFT JOIN sums USING (player_id))"""


@query(f"WITH {DEFENDERS} SELECT * FROM worth")
def a28_baseline_points(s, d):
    return pool.baseline_points(*_defenders(s, d))


@query(f"""WITH {PLAYERS}, {DEFENDERS}, teams AS (SELECT 'T' || n_nationkey AS team, n_nationkey AS place FROM nation),
  a AS (SELECT player_id::VARCHAR AS player_id, 'Player ' || player_id AS name, 'FA' AS team, position, player_id % 9 = 0 AS rookie, 20 + player_id % 15 AS age, 1 + player_id % 6 AS tier, round(points, 2) AS points, round(points_per_game + 0.0001, 2) AS points_per_game,
    row_number() OVER (ORDER BY points DESC, player_id)::DOUBLE AS adp, 'projection' AS source, 0 AS s, row_number() OVER (ORDER BY points DESC, player_id) AS o FROM players),
  b AS (SELECT player_id, name, coalesce(team, 'FA') AS team, position, years_exp = 0 AS rookie, 2026 - born AS age, NULL AS tier, points, round(points / 17, 2) AS points_per_game, 999.0::DOUBLE AS adp, 'roster-baseline' AS source, 1 AS s, 0 AS o
    FROM (SELECT ros.*, points FROM ros JOIN worth USING (player_id) WHERE ros.position <> 'WR' QUALIFY row_number() OVER (PARTITION BY ros.position ORDER BY points DESC, name, player_id) <= CASE WHEN ros.position = 'K' THEN 40 ELSE 60 END)),
  c AS (SELECT 'DEF-' || team AS player_id, team || ' Defense' AS name, team, 'DEF' AS position, false AS rookie, NULL AS age, 1 + place // 8 AS tier, points, round(points / 17, 2) AS points_per_game, 999.0::DOUBLE AS adp, 'team-defense' AS source, 2 AS s, place AS o
    FROM (SELECT *, round(112 - place * 0.7::DOUBLE + ('0x' || sha256(team)[:8])::BIGINT / 4294967295.0::DOUBLE * 8, 2)::DOUBLE AS points FROM teams)),
  u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c), one AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY s, o) = 1),
  r AS (SELECT *, row_number() OVER (ORDER BY s, o, points DESC, name, player_id)::INT AS overall_rank, row_number() OVER (PARTITION BY position ORDER BY s, o, points DESC, name, player_id)::INT AS position_rank FROM one)
SELECT player_id, name, team, position, rookie, age::INT AS age, coalesce(tier, 1 + (position_rank - 1) // 12)::INT AS tier, points, points_per_game, adp, source, overall_rank, position_rank FROM r""")
def r16_published_pool(s, d):
    k = F.col("player_id")
    p = windows.numbered(base.players(s, d), {"overall_rank": [F.col("points"), k]})
    p = p.select(k.cast("string").alias("player_id"), F.concat(F.lit("Player "), k.cast("string")).alias("name"), F.lit(None).cast("string").alias("team"), "position", (k % 9 == 0).alias("rookie"), (20 + k % 15).cast("int").alias("age"), (1 + k % 6).cast("int").alias("tier"), "points", (F.col("points_per_game") + 0.0001).alias("points_per_game"), "overall_rank")
    teams = table(s, d, "nation").select(F.concat(F.lit("T"), F.col("n_nationkey").cast("string")).alias("team"), F.col("n_nationkey").alias("place"))
    return pool.published_pool(p, *_defenders(s, d), teams, 2026)


@query("""SELECT o_orderkey, o_custkey AS room FROM orders o WHERE o_orderkey % 5 = 0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def g15_visible(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("room"), (F.col("o_orderkey") % 5 == 0).alias("is_public"))
    return pool.visible(o, table(s, d, "customer").select(F.col("c_custkey").alias("room"), F.col("c_nationkey").alias("user_id")), 3).drop("is_public")


AUCTIONS = """au AS (SELECT o_custkey % 40 AS draft, o_orderkey AS player_id, o_totalprice::DOUBLE / 1000 AS points, o_orderkey % 50 AS current_bid, 1 + o_orderkey % 12 AS highest_slot, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 3)::DOUBLE END AS seconds,
    7 AS seed, o_orderkey % 100 AS pick_number, 15 AS rounds, 200 AS budget, 1 + o_orderkey % 2 AS minimum FROM orders WHERE o_orderkey % 8 = 1),
  sl AS (SELECT c_custkey % 40 AS draft, 1 + c_custkey // 40 % 12 AS slot, max(c_custkey % 3) > 0 AS is_cpu, min(20 + c_custkey % 150)::BIGINT AS remaining, min(c_custkey % 16)::BIGINT AS picks FROM customer GROUP BY ALL)"""


@query(f"""WITH {AUCTIONS}, x AS (SELECT *, current_bid + minimum AS bid, md5(slot || ':' || player_id || ':' || (seed + pick_number + current_bid)) AS turn FROM au JOIN sl USING (draft)
  WHERE is_cpu AND slot <> highest_slot AND (seconds IS NULL OR seconds >= 1) AND (slot + player_id) % 4 <> 0 AND current_bid + minimum <= remaining - greatest(0, rounds - picks - 1) * minimum
    AND current_bid + minimum <= greatest(minimum, round(budget * least(0.42::DOUBLE, greatest(0.015::DOUBLE, points / 900)))))
SELECT draft, player_id, slot, bid FROM x QUALIFY row_number() OVER (PARTITION BY draft, player_id ORDER BY turn) = 1""")
def g10_counter_bid(s, d):
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    auctions = table(s, d, "orders").where(k % 8 == 1).select(
        (F.col("o_custkey") % 40).alias("draft"), k.alias("player_id"), (F.col("o_totalprice").cast("double") / 1000).alias("points"), (k % 50).alias("current_bid"), (1 + k % 12).alias("highest_slot"), F.when(k % 5 != 0, (k % 3).cast("double")).alias("seconds"),
        F.lit(7).alias("seed"), (k % 100).alias("pick_number"), F.lit(15).alias("rounds"), F.lit(200).alias("budget"), (1 + k % 2).alias("minimum"),
    )
    slots = table(s, d, "customer").groupBy((c % 40).alias("draft"), (1 + F.floor(c / 40) % 12).alias("slot")).agg((F.max(c % 3) > 0).alias("is_cpu"), F.min(20 + c % 150).alias("remaining"), F.min(c % 16).alias("picks"))
    fits = auctions.select("draft", "player_id").join(slots.select("draft", "slot"), "draft").where("(slot + player_id) % 4 <> 0")
    return pool.counter_bids(auctions, slots, fits)


@query("""WITH w AS (SELECT o_orderkey % 100 AS lot, o_custkey % 12 AS roster, floor(o_totalprice)::BIGINT % 60 AS amount, o_orderkey AS moment FROM orders),
b AS (SELECT roster, amount FROM w QUALIFY row_number() OVER (PARTITION BY lot ORDER BY amount DESC, moment, roster) = 1), p AS (SELECT roster, count(*) AS won, sum(amount) AS paid FROM b GROUP BY ALL)
SELECT r::BIGINT AS roster, coalesce(won, 0) AS won, (2000 - coalesce(paid, 0))::BIGINT AS left FROM range(12) t(r) LEFT JOIN p ON r = roster""")
def g11_settle(s, d):
    o = table(s, d, "orders").select((F.col("o_orderkey") % 100).alias("lot"), (F.col("o_custkey") % 12).alias("roster"), (F.floor("o_totalprice") % 60).alias("amount"), F.col("o_orderkey").alias("at"))
    return pool.settle(o, s.range(12).select(F.col("id").alias("roster"), F.lit(2000).cast("long").alias("budget")))


@query("""WITH r AS (SELECT o_custkey % 40 AS roster, CASE WHEN o_orderkey % 7 < 3 THEN 'RB' WHEN o_orderkey % 7 < 5 THEN 'WR' ELSE 'QB' END AS position FROM orders WHERE o_orderkey % 37 = 0), s AS (SELECT * FROM (VALUES ('RB', 4), ('WR', 5), ('QB', 2)) s(position, open))
SELECT g.roster, s.position, coalesce(n, 0) < open AS fits FROM (SELECT DISTINCT roster FROM r) g CROSS JOIN s LEFT JOIN (SELECT roster, position, count(*) AS n FROM r GROUP BY ALL) h ON h.roster = g.roster AND h.position = s.position""")
def g06_fit_by_count(s, d):
    k = F.col("o_orderkey")
    r = table(s, d, "orders").where("o_orderkey % 37 = 0").select((F.col("o_custkey") % 40).alias("roster"), F.when(k % 7 < 3, "RB").when(k % 7 < 5, "WR").otherwise("QB").alias("position"))
    return pool.fit_by_count(r, s.createDataFrame([("RB", 4), ("WR", 5), ("QB", 2)], "position string, open int"))


# ---- neighbours and keys


@query(f"""WITH {SEASONS}, m AS (SELECT avg(carries) AS mc, stddev_pop(carries) AS sc, avg(receptions) AS mr, stddev_pop(receptions) AS sr FROM seasons),
z AS (SELECT player_id, season, position, (carries - mc) / sc AS c, (receptions - mr) / sr AS r FROM seasons, m)
SELECT a.player_id, a.season, b.player_id AS other_id, round(sqrt((a.c - b.c) ** 2 + (a.r - b.r) ** 2), 6) AS distance, (row_number() OVER (PARTITION BY a.player_id, a.season ORDER BY round(sqrt((a.c - b.c) ** 2 + (a.r - b.r) ** 2), 9), b.player_id, b.season))::INT AS rank
FROM z a JOIN z b ON a.position = b.position AND a.player_id <> b.player_id WHERE a.player_id % 50 = 0 QUALIFY rank <= 3""")
def j21_neighbours(s, d):
    r = base.stored_seasons(s, d)
    n = season.neighbours(r, r.where("player_id % 50 = 0"), ["carries", "receptions"], rounded=False)
    return n.select("player_id", "season", "other_id", F.round("distance", 6).alias("distance"), "rank")


# ---- checks, with rows that offend


@query("""SELECT 'not_empty' AS "check", true AS passed, 0::BIGINT AS count UNION ALL SELECT 'not_empty', count(*) > 0, 1 - count(*) FROM nation WHERE n_nationkey < 0
UNION ALL SELECT 'known_o_orderstatus', count(*) = 0, count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def q03_presence(s, d):
    n = table(s, d, "nation")
    return quality.report(quality.not_empty(n), quality.not_empty(n.where("n_nationkey < 0")), quality.known_values(table(s, d, "orders"), "o_orderstatus", ["O", "F"]))


CONTRACT = "r AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN c_custkey + 1 ELSE c_custkey END AS rank, c_custkey // 2 AS slug, -c_custkey * CASE WHEN c_custkey % 40 = 0 THEN 0.5 ELSE 1 END AS v FROM customer)"


@query(f"""WITH {CONTRACT}, j AS (SELECT r.rank, r.v, b.v AS before, b.rank AS prev FROM r LEFT JOIN r b ON b.rank + 1 = r.rank)
SELECT 'dense_ranks' AS "check", count(*) = 0 AS passed, count(*) AS count FROM j WHERE rank > 1 AND prev IS NULL OR rank < 1
UNION ALL SELECT 'falling_v', count(*) = 0, count(*) FROM j WHERE v > before UNION ALL SELECT 'unique_slug', count(*) = 0, count(*) FROM (SELECT slug FROM r GROUP BY slug HAVING count(*) > 1)""")
def q14_contract(s, d):
    k = F.col("c_custkey")
    r = table(s, d, "customer").select(F.when(k % 50 == 0, k + 1).otherwise(k).alias("rank"), F.floor(k / 2).alias("slug"), (-k * F.when(k % 40 == 0, 0.5).otherwise(1.0)).alias("v"))
    return quality.contract(r, "rank", ["slug"], "v")


PLANTED = SEASONS + """, pl AS (SELECT player_id, season, CASE WHEN player_id % 7 = 0 THEN season WHEN player_id % 11 = 0 THEN season + 5 ELSE season + 1 END AS target_season, carries, CASE WHEN player_id % 13 = 0 THEN carries - 1 ELSE carries END AS career_carries,
  2.0 * carries + 1 AS outcome_carries, CASE WHEN player_id % 5 = 0 THEN -1.0 ELSE carries END::DOUBLE AS x, CASE WHEN player_id % 9 = 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS y, CASE WHEN player_id % 4 = 0 THEN 17 ELSE 20 END AS age FROM seasons)"""


def _planted(s, d):
    k = F.col("player_id")
    return base.seasons(s, d).select(
        "player_id", "season", F.when(k % 7 == 0, F.col("season")).when(k % 11 == 0, F.col("season") + 5).otherwise(F.col("season") + 1).alias("target_season"), "carries",
        F.when(k % 13 == 0, F.col("carries") - 1).otherwise(F.col("carries")).alias("career_carries"), (2.0 * F.col("carries") + 1).alias("outcome_carries"),
        F.when(k % 5 == 0, -1.0).otherwise(F.col("carries").cast("double")).alias("x"), F.when(k % 9 == 0, float("inf")).otherwise(1.0).alias("y"), F.when(k % 4 == 0, 17).otherwise(20).alias("age"),
    )


@query(f"""WITH {PLANTED} SELECT 'season_before_target' AS "check", count(*) = 0 AS passed, count(*) AS count FROM pl WHERE season >= target_season
UNION ALL SELECT 'one_season_ahead', count(*) = 0, count(*) FROM pl WHERE target_season - season > 3 UNION ALL SELECT 'copy_carries_outcome_carries', abs(corr(carries, outcome_carries)) < 0.999, (abs(corr(carries, outcome_carries)) >= 0.999)::BIGINT FROM pl
UNION ALL SELECT 'backward_carries', count(*) = 0, count(*) FROM pl WHERE carries > career_carries""")
def l02_planted_leakage(s, d):
    return quality.leakage(_planted(s, d), ["carries"], ["outcome_carries"])


@query(f"""WITH {PLANTED} SELECT 'negative_x' AS "check", count(*) = 0 AS passed, count(*) AS count FROM pl WHERE x < 0 UNION ALL SELECT 'finite_y', count(*) = 0, count(*) FROM pl WHERE y = 'inf'::DOUBLE UNION ALL SELECT 'finite_x', true, 0
UNION ALL SELECT 'negative_y', true, 0 UNION ALL SELECT 'negative_age', true, 0 UNION ALL SELECT 'ages', count(*) = 0, count(*) FROM pl WHERE age < 18 UNION ALL SELECT 'ratio_x_y', count(*) = 0, count(*) FROM pl WHERE x > y + 1e-6""")
def q07_planted_rows(s, d):
    return quality.row_checks(_planted(s, d).select("x", "y", "age"), {}, [("x", "y")], [], "age")


# ---- the whole season table


def _full_table(s, d):
    w = base.weekly(s, d)
    t = base.seasons(s, d).withColumns({
        "targets": F.col("receptions") * 2, "fumbles_lost": F.col("rushing_tds") % 3, "pass_attempts": F.when(F.col("position") == "QB", F.col("carries")), "completions": F.floor(F.col("carries") / 2),
        "passing_yards": F.when(F.col("position") == "QB", F.col("rushing_yards")), "passing_tds": F.lit(None).cast("long"), "interceptions": F.col("rushing_tds") % 4, "receiving_yards": F.col("rushing_yards"),
    })
    t = t.withColumn("fantasy_points_ppr", F.when(F.col("player_id") % 13 != 0, F.col("carries") / F.lit(10.0) + F.col("receptions") * F.lit(1.0) + F.col("rushing_tds") * F.lit(6.0)))
    reg = w.where("season_type = 'REG'")
    situations = reg.groupBy("player_id", "season").agg(F.count_if(F.col("carries") <= 20).alias("rz_carries"), F.count_if(F.col("carries") <= 5).alias("inside_five_carries"))
    snaps = reg.where("player_id % 4 <> 0").groupBy("player_id", "season").agg(F.sum("carries").cast("double").alias("snaps"), F.avg(F.col("receptions") / F.lit(10.0)).alias("snap_share"))
    context = t.groupBy("team", "season").agg(F.sum("carries").alias("team_rush_attempts"), F.sum("targets").alias("team_targets"), (F.sum("receptions") / F.sum("carries")).alias("team_pass_rate"), F.sum("receptions").alias("team_dropbacks"), F.count("*").alias("team_rz_rush_plays"))
    schedule = t.groupBy("season").agg((F.max("games") + 2).cast("int").alias("scheduled_games"))
    return season.full_season_table(t, _players(s, d), _rosters(s, d), context, schedule, None, (situations, None, snaps))


@query(f"""WITH {SEASONS}, t AS (SELECT *, receptions * 2 AS targets, rushing_tds % 3 AS fumbles_lost, CASE WHEN position = 'QB' THEN carries END AS pass_attempts, CASE WHEN position = 'QB' THEN rushing_yards END AS passing_yards, rushing_tds % 4 AS interceptions,
    CASE WHEN player_id % 13 <> 0 THEN carries / 10.0::DOUBLE + receptions * 1.0::DOUBLE + rushing_tds * 6.0::DOUBLE END AS pts FROM seasons),
  sit AS (SELECT player_id, season, count(*) FILTER (carries <= 20) AS rz, count(*) FILTER (carries <= 5) AS five FROM reg GROUP BY ALL), sn AS (SELECT player_id, season, sum(carries)::DOUBLE AS snaps, avg(receptions / 10.0::DOUBLE) AS share FROM reg WHERE player_id % 4 <> 0 GROUP BY ALL),
  ctx AS (SELECT team, season, sum(carries) AS ra, sum(targets) AS ta, sum(receptions)::DOUBLE / sum(carries) AS pr, sum(receptions) AS db, count(*) AS rzp FROM t GROUP BY ALL), sch AS (SELECT season, max(games) + 2 AS sg FROM t GROUP BY ALL),
  j AS (SELECT t.*, rz, five, snaps, share, ra, ta, pr, db, rzp, sg, pts / games AS ppg, targets::DOUBLE / games AS tpg, carries::DOUBLE / games AS cpg, least(greatest(games / sg::DOUBLE, 0), 1) AS played
    FROM t LEFT JOIN sit USING (player_id, season) LEFT JOIN sn USING (player_id, season) JOIN ctx USING (team, season) JOIN sch USING (season) WHERE position IS NOT NULL),
  h AS (SELECT *, lag(pts) OVER w AS p1, lag(pts, 2) OVER w AS p2, lag(ppg) OVER w AS g1, lag(tpg) OVER w AS t1, lag(cpg) OVER w AS c1, lag(share) OVER w AS s1, lag(games) OVER w AS prev_games, lag(played) OVER w AS d1, lag(played, 2) OVER w AS d2, lag(sg - games) OVER w AS m1,
      CASE WHEN pts IS NOT NULL THEN sum(pts) OVER w END AS cp, sum(games) OVER w AS cg, CASE WHEN pts IS NOT NULL THEN max(pts) OVER w END AS best, count(*) OVER w AS seen, sum(targets) OVER w AS ct, CASE WHEN pass_attempts IS NOT NULL THEN sum(pass_attempts) OVER w END AS ca
    FROM j WINDOW w AS (PARTITION BY player_id ORDER BY season)),
  f AS (SELECT *, tpg - t1 AS tt, cpg - c1 AS ctr, share - s1 AS st FROM h)
SELECT player_id, season, sg::INT AS scheduled, round(played, 9) AS played_share, m1::INT AS prev1_missed, round((0.5 * played + coalesce(0.3 * d1, 0) + coalesce(0.2 * d2, 0)) / (0.5 + CASE WHEN d1 IS NULL THEN 0 ELSE 0.3 END + CASE WHEN d2 IS NULL THEN 0 ELSE 0.2 END), 6)::DOUBLE AS durability,
  round(ppg, 6) AS fantasy_points_ppr_per_game, round(fumbles_lost::DOUBLE / games, 6) AS fumbles_lost_per_game, round(CASE WHEN pass_attempts > 50 THEN (passing_yards - 45.0 * interceptions) / pass_attempts END, 5)::DOUBLE AS adjusted_yards,
  round(rz::DOUBLE / nullif(rzp, 0), 6) AS rz_carry_share, round(five::DOUBLE / nullif(rz, 0), 6) AS goal_line_share, round(snaps * pr, 5) AS routes, round(CASE WHEN snaps * pr > 50 THEN targets / (snaps * pr) END, 6) AS targets_per_route, round(snaps * pr / nullif(db, 0), 6) AS route_participation,
  round(targets::DOUBLE / nullif(ta, 0), 9) AS target_share, round(CASE WHEN pts IS NULL AND p1 IS NULL THEN NULL ELSE (coalesce(0.65 * pts, 0) + coalesce(0.35 * p1, 0)) / (CASE WHEN pts IS NULL THEN 0 ELSE 0.65 END + CASE WHEN p1 IS NULL THEN 0 ELSE 0.35 END) END, 5)::DOUBLE AS fantasy_points_ppr_w2,
  round(cp, 4) AS career_fantasy_points, cg::BIGINT AS career_games, round(best, 4) AS best_season_fantasy_points, seen AS seasons_observed, round(ppg - g1, 5) AS fantasy_points_ppr_trend, ct::BIGINT AS career_targets, ca::BIGINT AS career_pass_attempts, prev_games, round(cp / nullif(cg, 0), 5) AS career_fantasy_points_per_game,
  round((coalesce(tt, 0) + coalesce(ctr, 0) + coalesce(st, 0)) / nullif((tt IS NOT NULL)::INT + (ctr IS NOT NULL)::INT + (st IS NOT NULL)::INT, 0), 5) AS opportunity_trend, (season IN (2020, 2021))::INT AS anomalous_season FROM f""")
def e04_full_season_table(s, d):
    t = _full_table(s, d)
    digits = {"played_share": 9, "durability": 6, "fantasy_points_ppr_per_game": 6, "fumbles_lost_per_game": 6, "adjusted_yards": 5, "rz_carry_share": 6, "goal_line_share": 6, "routes": 5, "targets_per_route": 6, "route_participation": 6, "target_share": 9, "fantasy_points_ppr_w2": 5, "career_fantasy_points": 4, "best_season_fantasy_points": 4, "fantasy_points_ppr_trend": 5, "career_fantasy_points_per_game": 5, "opportunity_trend": 5}
    names = ["player_id", "season", "scheduled", "prev1_missed", "career_games", "seasons_observed", "career_targets", "career_pass_attempts", "prev_games", "anomalous_season"]
    return t.withColumn("prev1_missed", F.col("prev1_missed").cast("int")).select(*names, *[F.round(c, n).alias(c) for c, n in digits.items()])
