"""Queries on identities, back-off priors, roster capacity, functions of SQL and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..functions import sql as functions_sql
from ..operators import capacity, identity_graph, nearest, priors, value, windows
from . import base
from .base import PLAYERS, SEASONS, table
from .catalogue import query

# ---- identities


def _records(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.alias("record"), F.when(k % 3 != 0, F.floor(k / 4).cast("string")).otherwise("").alias("canonical"), F.when(k % 4 != 0, F.concat(F.lit("e"), F.floor(k / 2).cast("string"))).alias("espn_id"),
        F.when(k % 5 == 0, F.concat(F.lit("p"), F.floor(k / 15).cast("string"))).when(k % 5 == 1, "0").alias("pfr_id"),
    )


RECORDS = """rec AS (SELECT c_custkey AS record, CASE WHEN c_custkey % 3 <> 0 AND c_custkey >= 4 THEN (c_custkey // 4)::VARCHAR END AS canonical, CASE WHEN c_custkey % 4 <> 0 THEN 'e' || (c_custkey // 2) END AS espn_id, CASE WHEN c_custkey % 5 = 0 THEN 'p' || (c_custkey // 15) END AS pfr_id FROM customer),
  keys AS (SELECT record, 'c' || canonical AS key FROM rec WHERE canonical IS NOT NULL UNION ALL SELECT record, espn_id FROM rec WHERE espn_id IS NOT NULL UNION ALL SELECT record, pfr_id FROM rec WHERE pfr_id IS NOT NULL),
  near AS (SELECT DISTINCT a.record AS x, b.record AS y FROM keys a JOIN keys b USING (key)),
  reach(x, y) AS (SELECT record, record FROM rec UNION SELECT r.x, n.y FROM reach r JOIN near n ON n.x = r.y),
  of_group AS (SELECT x AS record, min(y) AS grp FROM reach GROUP BY x),
  facts AS (SELECT grp, count(*) AS group_size, count(DISTINCT canonical) AS canonical_ids, min(canonical) AS one, concat_ws(',', CASE WHEN count(DISTINCT canonical) > 1 THEN 'canonical' END, CASE WHEN count(DISTINCT espn_id) > 1 THEN 'espn_id' END, CASE WHEN count(DISTINCT pfr_id) > 1 THEN 'pfr_id' END) AS clashing
    FROM rec JOIN of_group USING (record) GROUP BY grp)"""


@query(f"""WITH RECURSIVE {RECORDS} SELECT record, grp AS "group", group_size, canonical_ids, clashing, CASE WHEN canonical_ids = 1 THEN 'resolved' WHEN canonical_ids > 1 THEN 'conflict' ELSE 'unknown' END AS status,
  CASE WHEN canonical_ids = 1 THEN one END AS resolved_id FROM of_group JOIN facts USING (grp)""")
def i01_identity_groups(s, d):
    return identity_graph.identity_groups(_records(s, d), "record", "canonical", ["espn_id", "pfr_id"]).drop("canonical", "espn_id", "pfr_id")


def _people(s, d):
    k = F.col("c_custkey")
    return table(s, d, "customer").select(
        k.cast("string").alias("player_id"), F.concat(F.lit("Name "), F.col("c_nationkey").cast("string"), F.lit(" "), (k % 40).cast("string"), F.when(k % 6 == 0, " Jr.").otherwise("")).alias("name"),
        base.lookup("c_mktsegment", base.SEGMENTS).alias("position"), F.when(k % 7 != 0, F.concat(F.lit("T"), (k % 32).cast("string"))).alias("team"),
    )


def _mentions(s, d):
    k = F.col("o_orderkey")
    name = F.concat(F.when(k % 3 == 0, "NAME ").otherwise("Name "), (F.col("o_custkey") % 27).cast("string"), F.lit(" "), (k % 40).cast("string"))
    return table(s, d, "orders").where(k % 4 == 1).select(
        k.alias("mention"), F.when(k % 29 != 1, name).alias("name"), F.when(k % 8 == 1, F.element_at(F.array(*map(F.lit, ["QB", "RB", "WR", "TE"])), (F.col("o_custkey") % 4 + 1).cast("int"))).alias("position"),
        F.when(k % 16 != 5, F.concat(F.lit("T"), (F.col("o_custkey") % 32).cast("string"))).alias("team"),
    )


PEOPLE = """people AS (SELECT c_custkey::VARCHAR AS player_id, 'name ' || c_nationkey || ' ' || (c_custkey % 40) AS n, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'QB' WHEN 'BUILDING' THEN 'RB' WHEN 'FURNITURE' THEN 'WR' WHEN 'HOUSEHOLD' THEN 'TE' END AS position,
    CASE WHEN c_custkey % 7 <> 0 THEN 'T' || (c_custkey % 32) END AS team FROM customer),
  mentions AS (SELECT o_orderkey AS mention, CASE WHEN o_orderkey % 29 <> 1 THEN 'name ' || (o_custkey % 27) || ' ' || (o_orderkey % 40) END AS n, CASE WHEN o_orderkey % 8 = 1 THEN ['QB', 'RB', 'WR', 'TE'][o_custkey % 4 + 1] END AS position,
    CASE WHEN o_orderkey % 16 <> 5 THEN 'T' || (o_custkey % 32) END AS team FROM orders WHERE o_orderkey % 4 = 1),
  pairs AS (SELECT n, position, count(*) AS many, min(player_id) AS id, min(team) AS team FROM people WHERE position IS NOT NULL GROUP BY n, position),
  names AS (SELECT n, count(DISTINCT id) AS ids, min(id) AS loose FROM pairs WHERE many = 1 GROUP BY n),
  there AS (SELECT n, team, count(DISTINCT id) AS near_n, min(id) AS id FROM pairs WHERE many = 1 AND team IS NOT NULL GROUP BY ALL),
  found AS (SELECT mention, m.n, CASE WHEN m.n IS NULL THEN 0 WHEN m.position IS NOT NULL THEN 1 WHEN coalesce(ids, 0) <= 1 THEN 2 ELSE 3 END AS step, many, p.id AS exact, ids, loose, near_n, t.id AS placed
    FROM mentions m LEFT JOIN pairs p ON p.n = m.n AND p.position = m.position LEFT JOIN names s ON s.n = m.n LEFT JOIN there t ON t.n = m.n AND t.team = m.team),
  res AS (SELECT mention, n, step, CASE WHEN step = 1 AND many = 1 THEN exact WHEN step = 2 THEN loose WHEN step = 3 AND near_n = 1 THEN placed END AS player_id,
    CASE step WHEN 0 THEN 'no name' WHEN 1 THEN CASE WHEN many = 1 THEN 'name and position' WHEN many > 1 THEN 'several of this name and position' ELSE 'no such name and position' END
      WHEN 2 THEN CASE WHEN ids = 1 THEN 'only one of this name' ELSE 'no such name' END ELSE CASE WHEN near_n = 1 THEN 'team' ELSE 'several of this name' END END AS reason FROM found)"""


@query(f"WITH {PEOPLE} SELECT mention, player_id, step, reason FROM res")
def i05_resolved_names(s, d):
    return identity_graph.resolve_names(_mentions(s, d), _people(s, d)).select("mention", "player_id", "step", "reason")


@query(f"""WITH RECURSIVE {RECORDS}, {PEOPLE}, twice AS (SELECT player_id, count(*) AS n FROM (SELECT player_id FROM people UNION ALL SELECT player_id FROM people WHERE player_id::BIGINT % 90 = 0) GROUP BY ALL HAVING count(*) > 1)
SELECT 'duplicate_id' AS issue_type, 'warning' AS severity, player_id AS identifier, '' AS name, n FROM twice
UNION ALL SELECT 'ambiguous_name', 'info', id, n || ' (' || position || ')', many FROM pairs WHERE many > 1
UNION ALL SELECT 'conflicting_ids', 'error', grp::VARCHAR, clashing, canonical_ids FROM facts WHERE canonical_ids > 1
UNION ALL SELECT 'unresolved_name', 'info', coalesce(o.name, ''), reason, count(*) FROM res JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 29 <> 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'NAME ' ELSE 'Name ' END || (o_custkey % 27) || ' ' || (o_orderkey % 40) END AS name FROM orders) o ON o_orderkey = mention WHERE player_id IS NULL GROUP BY ALL
UNION ALL SELECT 'invalid_correction', 'warning', k::VARCHAR, 'shoe_size', 1 FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 = 1)""")
def i08_issues(s, d):
    p = _people(s, d)
    doubled = p.unionByName(p.where("CAST(player_id AS BIGINT) % 90 = 0"))
    dimension = identity_graph.build_dimension(doubled, columns={"position": ("position",), "team": ("latest_team", "team")})
    corrections = p.where("CAST(player_id AS BIGINT) % 50 = 1").select("player_id", F.lit("shoe_size").alias("field"), F.lit("1").alias("new_value"), F.lit(1).alias("line"))
    corrections = corrections.unionByName(p.where("CAST(player_id AS BIGINT) % 50 = 2").select("player_id", F.lit("team").alias("field"), F.lit("T1").alias("new_value"), F.lit(2).alias("line")))
    groups = identity_graph.identity_groups(_records(s, d), "record", "canonical", ["espn_id", "pfr_id"])
    return identity_graph.issues(doubled, dimension, corrections, groups, identity_graph.resolve_names(_mentions(s, d), dimension))


# ---- priors

LEVELS = [["position", "bucket"], ["position"], []]
CURVES = {"carries": "carries", "receptions": "receptions", "rushing_yards": "rushing_yards", "rushing_tds": "rushing_tds"}


def _first_seasons(s, d):
    n = F.row_number().over(windows.by_season())
    k = F.col("player_id")
    t = base.seasons(s, d).withColumn("_n", n).where("_n = 1").withColumn("pick", F.when(k % 300 < 262, 1 + k % 300))
    return t.withColumn("bucket", priors.draft_bucket(F.col("pick")))


FIRST = SEASONS + """, first AS (SELECT *, CASE WHEN pick <= 10 THEN 1 WHEN pick <= 32 THEN 2 WHEN pick <= 64 THEN 3 WHEN pick <= 100 THEN 4 ELSE 5 END AS bucket
    FROM (SELECT *, CASE WHEN player_id % 300 < 262 THEN 1 + player_id % 300 END AS pick FROM seasons QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY season) = 1)),
  curve AS (SELECT position, bucket, grouping(position) + grouping(bucket) AS level, count(*) AS n, avg(carries) AS carries, avg(receptions) AS receptions, avg(rushing_yards) AS rushing_yards, avg(rushing_tds) AS rushing_tds
    FROM first GROUP BY GROUPING SETS ((position, bucket), (position), ()))"""


@query(f"WITH {FIRST} SELECT position, bucket::INT AS bucket, level::INT AS level, n, round(carries, 6) AS carries, round(receptions, 6) AS receptions, round(rushing_yards, 4) AS rushing_yards, round(rushing_tds, 6) AS rushing_tds FROM curve")
def a23_backoff_table(s, d):
    t = priors.backoff_table(_first_seasons(s, d), LEVELS, CURVES)
    return t.withColumns({c: F.round(c, 4 if c == "rushing_yards" else 6) for c in CURVES})


@query(f"""WITH {FIRST}, e AS (SELECT c_custkey AS player_id, ['QB', 'RB', 'WR', 'TE'][c_custkey % 4 + 1] AS position, CASE WHEN c_custkey % 9 <> 0 THEN 1 + c_custkey % 262 END AS draft_pick, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 700 END AS att, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 500 END AS rush,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 180 END AS rec, CASE WHEN c_custkey % 7 <> 0 THEN 400 + c_custkey % 300 END AS tp, CASE WHEN c_custkey % 11 <> 0 THEN 300 + c_custkey % 300 END AS tr FROM customer),
  b AS (SELECT *, CASE WHEN draft_pick <= 10 THEN 1 WHEN draft_pick <= 32 THEN 2 WHEN draft_pick <= 64 THEN 3 WHEN draft_pick <= 100 THEN 4 ELSE 5 END AS bucket FROM e),
  p AS (SELECT b.*, CASE WHEN f.n >= 25 THEN 0 WHEN g.n >= 25 THEN 1 WHEN w.n >= 25 THEN 2 END AS lvl, CASE WHEN f.n >= 25 THEN f.carries WHEN g.n >= 25 THEN g.carries WHEN w.n >= 25 THEN w.carries END AS hc, CASE WHEN f.n >= 25 THEN f.receptions WHEN g.n >= 25 THEN g.receptions WHEN w.n >= 25 THEN w.receptions END AS hr,
      greatest(0.18, least(1.0, 1 / (1 + (coalesce(draft_pick, 180)::DOUBLE - 1) / 55))) AS cap, greatest(0.85, least(1.15, coalesce(tp, 560) / 560.0::DOUBLE)) AS pe, greatest(0.85, least(1.15, coalesce(tr, 420) / 420.0::DOUBLE)) AS re
    FROM b LEFT JOIN curve f ON f.level = 0 AND f.position = b.position AND f.bucket = b.bucket LEFT JOIN curve g ON g.level = 1 AND g.position = b.position LEFT JOIN curve w ON w.level = 2)
SELECT player_id, lvl::INT AS prior_level, round(15.0 * (0.85 + 0.15 * cap) + 1e-7, 5)::DOUBLE AS rookie_games,
  round(CASE WHEN position = 'QB' THEN (CASE WHEN nullif(att, 0) IS NOT NULL THEN 0.65 * 450 * cap + 0.35 * least(att, 600) ELSE 450 * cap END) * pe END + 1e-7, 5)::DOUBLE AS rookie_pass_attempts,
  round(CASE position WHEN 'QB' THEN coalesce(nullif(hc, 0), 30 * cap) WHEN 'RB' THEN (CASE WHEN nullif(rush, 0) IS NOT NULL THEN 0.65 * coalesce(nullif(hc, 0), 180 * cap) + 0.35 * least(rush * 0.65, 280) ELSE coalesce(nullif(hc, 0), 180 * cap) END) * re ELSE coalesce(nullif(hc, 0), 2 * cap) END + 1e-7, 5)::DOUBLE AS rookie_carries,
  round(CASE position WHEN 'RB' THEN 35 * cap * pe WHEN 'WR' THEN (CASE WHEN nullif(rec, 0) IS NOT NULL THEN 0.65 * 110 * cap + 0.35 * least(rec * 1.05, 160) ELSE 110 * cap END) * pe WHEN 'TE' THEN (CASE WHEN nullif(rec, 0) IS NOT NULL THEN 0.65 * 70 * cap + 0.35 * least(rec * 1.05, 160) ELSE 70 * cap END) * pe END + 1e-7, 5)::DOUBLE AS rookie_targets,
  round(CASE WHEN position <> 'QB' THEN hr END + 1e-7, 5)::DOUBLE AS rookie_receptions FROM p""")
def e29_rookie_priors(s, d):
    k = F.col("c_custkey")
    e = table(s, d, "customer").select(
        k.alias("player_id"), F.element_at(F.array(*map(F.lit, ["QB", "RB", "WR", "TE"])), (k % 4 + 1).cast("int")).alias("position"), F.when(k % 9 != 0, 1 + k % 262).alias("draft_pick"), F.when(k % 3 == 0, k % 700).alias("college_final_pass_attempts"),
        F.when(k % 2 == 0, k % 500).alias("college_final_rush_attempts"), F.when(k % 5 != 0, k % 180).alias("college_final_receptions"), F.when(k % 7 != 0, 400 + k % 300).alias("team_pass_attempts"), F.when(k % 11 != 0, 300 + k % 300).alias("team_rush_attempts"),
    ).withColumn("bucket", priors.draft_bucket(F.col("draft_pick")))
    t = priors.backoff_table(_first_seasons(s, d), LEVELS, CURVES)
    out = priors.rookie_priors(priors.backed_off(e, t, LEVELS, list(CURVES), least=25))
    return out.select("player_id", "prior_level", *[F.round(F.col(f"rookie_{c}") + 1e-7, 5).alias(f"rookie_{c}") for c in ("games", "pass_attempts", "carries", "targets", "receptions")])


# ---- rosters

SLOTS = ["QB", "RB", "RB", "WR", "WR", "TE", "FLEX", "SUPERFLEX", "BENCH"]


@query("""WITH r AS (SELECT o_custkey AS roster, ['QB', 'RB', 'WR', 'TE', 'K'][o_orderkey % 5 + 1] AS position FROM orders WHERE o_orderkey % 2 = 1),
  c AS (SELECT roster, extra, count(*) FILTER (p = 'QB') AS q, count(*) FILTER (p = 'RB') AS b, count(*) FILTER (p = 'WR') AS w, count(*) FILTER (p = 'TE') AS t, count(*) FILTER (p = 'K') AS k
    FROM (SELECT x.roster, extra, r.position AS p FROM (SELECT DISTINCT roster, unnest(['QB', 'RB', 'K']) AS extra FROM r) x JOIN r USING (roster) UNION ALL SELECT DISTINCT roster, e, e FROM r, (SELECT unnest(['QB', 'RB', 'K']) AS e)) GROUP BY ALL),
  l AS (SELECT roster, extra, q, b, w, t, k, greatest(q - 1, 0) AS lq, greatest(b - 2, 0) + greatest(w - 2, 0) + greatest(t - 1, 0) AS lf FROM c)
SELECT roster, extra AS position, greatest(greatest(lf - 1, 0) + lq - 1, 0) + k <= 1 AS fits FROM l""")
def g03_candidate_fits(s, d):
    k = F.col("o_orderkey")
    r = table(s, d, "orders").where(k % 2 == 1).select(F.col("o_custkey").alias("roster"), F.element_at(F.array(*map(F.lit, ["QB", "RB", "WR", "TE", "K"])), (k % 5 + 1).cast("int")).alias("position"))
    asked = r.select("roster").distinct().select("roster", F.explode(F.array(*map(F.lit, ["QB", "RB", "K"]))).alias("position"))
    return capacity.candidate_fits(r, asked, SLOTS)


# ---- functions of SQL


@query("""SELECT o_orderkey, CASE WHEN (o_orderkey - 1) // 12 % 2 = 1 THEN 12 - (o_orderkey - 1) % 12 ELSE (o_orderkey - 1) % 12 + 1 END AS slot,
  CASE WHEN (o_orderkey - 1) // 12 IN (1, 2) OR ((o_orderkey - 1) // 12 > 2 AND (o_orderkey - 1) // 12 % 2 = 0) THEN 12 - (o_orderkey - 1) % 12 ELSE (o_orderkey - 1) % 12 + 1 END AS slot_reversed,
  ((o_orderkey - 1) // 12 + 1) || '.' || lpad(((o_orderkey - 1) % 12 + 1)::VARCHAR, 2, '0') AS label, o_orderkey % 23 BETWEEN 4 AND 22 AND o_orderkey % 23 % 2 = 0 AS valid, CASE WHEN o_orderkey % 5 > 0 THEN greatest(200 - (o_orderkey % 5 - 1) * 60, 0) ELSE 0 END AS bid_limit FROM orders""")
def x07_sql_functions(s, d):
    functions_sql.register(s)
    table(s, d, "orders").createOrReplaceTempView("x07_orders")
    return s.sql("""SELECT o_orderkey, slot_for_pick(o_orderkey, 12, 'snake', false) AS slot, slot_for_pick(o_orderkey, 12, 'snake', true) AS slot_reversed, pick_label(o_orderkey, 12) AS label,
        valid_draft(CAST(o_orderkey % 23 AS INT), 15, 15, 'snake', false) AS valid, bid_limit(200, CAST(o_orderkey % 5 AS INT), 60) AS bid_limit FROM x07_orders""")


@query("""WITH u AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0), h AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS row, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT user_id, event_id AS id, row, total FROM h JOIN u USING (user_id) WHERE row > 5 AND row <= 10""")
def x07_history_page(s, d):
    table(s, d, "events").selectExpr("user_id AS owner", "ts AS at", "event_id AS id").createOrReplaceTempView("x07_history")
    functions_sql.register(s, "x07_history")
    return s.sql("SELECT u.owner AS user_id, h.id, h.row, h.total FROM (SELECT DISTINCT owner FROM x07_history WHERE owner % 3 = 0) u, LATERAL history_page(u.owner, 5, 2) h")


@query("""WITH n AS (SELECT n_regionkey AS region, count(*)::INT AS teams FROM nation GROUP BY ALL) SELECT region, p AS pick, ((p - 1) // teams + 1)::INT AS round, ((p - 1) % teams + 1)::INT AS pick_in_round,
  CASE WHEN (p - 1) // teams % 2 = 1 THEN teams - (p - 1) % teams ELSE (p - 1) % teams + 1 END AS slot FROM (SELECT *, unnest(range(1, teams * 3 + 1)) AS p FROM n)""")
def x07_draft_orders(s, d):
    functions_sql.register(s)
    table(s, d, "nation").createOrReplaceTempView("x07_nation")
    return s.sql("""SELECT region, o.pick, o.round, o.pick_in_round, slot_for_pick(o.pick, teams, 'snake', false) AS slot
        FROM (SELECT n_regionkey AS region, CAST(count(*) AS INT) AS teams FROM x07_nation GROUP BY n_regionkey), LATERAL draft_order(teams, 3) o""")


# ---- neighbours


@query(f"""WITH {SEASONS}, m AS (SELECT avg(carries) AS mc, stddev_pop(carries) AS sc, avg(receptions) AS mr, stddev_pop(receptions) AS sr FROM seasons),
  z AS (SELECT player_id, season, position, (carries - mc) / sc AS x, (receptions - mr) / sr AS y FROM seasons, m WHERE position IS NOT NULL),
  p AS (SELECT a.player_id, a.season, b.player_id AS other_id, b.season AS other_season, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9) AS distance FROM z a JOIN z b ON a.position = b.position AND a.player_id <> b.player_id)
SELECT player_id, season, other_id, other_season, round(distance, 6) AS distance, row_number() OVER (PARTITION BY player_id, season ORDER BY distance, other_id, other_season)::INT AS rank FROM p QUALIFY rank <= 5""")
def j21_nearest_by_index(s, d):
    r = base.stored_seasons(s, d)
    return nearest.nearest(r, r, ["carries", "receptions"], k=5).withColumn("distance", F.round("distance", 6))


# ---- what readers of a ranking see

SUPER = value.League(superflex=1)
CLIENT = PLAYERS + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY points DESC, player_id) AS place, count(*) OVER (PARTITION BY position) AS n FROM players),
  demand AS (SELECT * FROM (VALUES ('QB', 12), ('RB', 24), ('WR', 36), ('TE', 12)) d(position, base)),
  flex AS (SELECT position, count(*) AS more FROM (SELECT r.position FROM ranked r JOIN demand USING (position) WHERE place > base ORDER BY points DESC, player_id LIMIT 24) GROUP BY ALL),
  need AS (SELECT position, greatest(base + coalesce(more, 0), 1) AS rank FROM demand LEFT JOIN flex USING (position)),
  levels AS (SELECT position, rank, avg(points) AS level FROM ranked JOIN need USING (position) WHERE place BETWEEN least(rank, n) - 1 AND least(rank, n) + 1 GROUP BY ALL)"""


@query(f"WITH {CLIENT} SELECT position, rank::INT AS rank, round(level, 6) AS level FROM levels")
def r07_client_levels(s, d):
    return value.client_levels(base.players(s, d), SUPER).select("position", F.col("rank").cast("int").alias("rank"), F.round("level", 6).alias("level"))


@query(f"""WITH {CLIENT}, e AS (SELECT p.*, coalesce(level, 0) AS level, points - coalesce(level, 0) AS vorp, points / greatest(player_id % 18, 1) AS ppg FROM players p LEFT JOIN levels USING (position))
SELECT player_id, round(vorp, 4) AS vorp, round(ppg, 4) AS ppg, row_number() OVER (ORDER BY vorp DESC, ppg DESC, player_id)::INT AS display_rank FROM e WHERE position = 'WR' AND player_id % 9 <> 0 AND contains('player ' || player_id, 'r 1')""")
def r17_rerank(s, d):
    k = F.col("player_id")
    e = base.players(s, d).select("player_id", "position", F.concat(F.lit("Player "), k.cast("string")).alias("name"), (k % 9 == 0).alias("rookie"), (k % 18).alias("games"), F.col("points").alias("ppr_points"), F.lit(0.5).alias("confidence"), F.lit(False).alias("has_stats"))
    out = value.rerank(e, [], {}, SUPER, position="WR", rookie=False, text="R 1")
    return out.select("player_id", F.round("vorp", 4).alias("vorp"), F.round("ppg", 4).alias("ppg"), "display_rank")


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || CASE WHEN c_custkey % 3 = 0 THEN ' O''Neïl  Jr' ELSE ' iv' END), '[^a-z0-9\\s]', '', 'g'), '\\s+(jr|sr|ii|iii|iv|v)$', ''), '\\s+', ' ', 'g')) AS rookie_key,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 2026 - (1980 + c_custkey % 25) END::INT AS age, printf('%.1f', round(c_custkey / 10.0::DOUBLE, 1)) AS shown,
  CASE WHEN c_custkey % 40 < 24 THEN 'under 24' WHEN c_custkey % 40 < 27 THEN '24-26' WHEN c_custkey % 40 < 30 THEN '27-29' WHEN c_custkey % 40 < 33 THEN '30-32' ELSE '33 and over' END AS age_band,
  CASE WHEN c_custkey % 11 = 0 THEN 'rookie' WHEN c_custkey % 11 = 1 THEN '2nd season' WHEN c_custkey % 11 <= 3 THEN '3rd-4th season' WHEN c_custkey % 11 <= 7 THEN '5th-8th season' ELSE '9th season and beyond' END AS experience_band,
  substr(md5('7' || chr(31) || c_custkey), 1, 8) AS id_head FROM customer""")
def f03_keys_and_bands(s, d):
    k = F.col("c_custkey")
    t = table(s, d, "customer")
    name = F.concat("c_name", F.when(k % 3 == 0, " O'Neïl  Jr").otherwise(" iv"))
    born = F.when(k % 5 == 0, "unknown").otherwise(F.concat((1980 + k % 25).cast("string"), F.lit("-03-04")))
    return t.select(
        "c_custkey", columns.rookie_key(name).alias("rookie_key"), columns.age_by_year(born, F.lit(2026)).alias("age"), columns.fixed_decimals(k / F.lit(10.0)).alias("shown"), columns.age_band(k % 40).alias("age_band"),
        columns.experience_band(k % 11).alias("experience_band"), F.substring(columns.seeded_id(7, k), 1, 8).alias("id_head"),
    )
