"""All queries on the reference operators: name -> (function, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import aggregates, draft, features, identity, models, quality, value, windows
from ..sources import tables
from ..streaming import rooms
from . import base
from .base import BOARD, PAIRS, PLAYERS, SEASONS, STATS, WEEKLY, table

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _round(d: DataFrame, *names: str) -> DataFrame:
    return d.withColumns({n: F.round(n, 6) for n in names})


# ---- aggregates


@query(f"WITH {SEASONS} SELECT * FROM seasons")
def a01_player_seasons(s, d):
    return base.seasons(s, d)


@query(f"WITH {WEEKLY} SELECT player_id, season, sum(receptions * carries)::DOUBLE / nullif(sum(carries), 0) AS rate FROM weekly GROUP BY ALL")
def a02_weighted_rate(s, d):
    return base.weekly(s, d).groupBy("player_id", "season").agg(aggregates.weighted_rate("receptions", "carries").alias("rate"))


@query(f"""WITH {WEEKLY}, t AS (SELECT team, season, count(DISTINCT week) AS team_games, sum(carries)::BIGINT AS team_carries, sum(rushing_yards)::BIGINT AS team_rushing_yards FROM weekly GROUP BY ALL)
SELECT *, team_carries::DOUBLE / team_games AS team_carries_per_game, team_rushing_yards::DOUBLE / team_games AS team_rushing_yards_per_game FROM t""")
def a04_team_seasons(s, d):
    return aggregates.team_seasons(base.weekly(s, d), ["carries", "rushing_yards"])


def _schedule(s, d):
    return base.weekly(s, d).select("season", F.col("home").alias("home_team"), F.col("away").alias("away_team"), F.col("carries").alias("home_score"), F.col("receptions").alias("away_score"))


@query(f"""WITH {WEEKLY}, g AS (SELECT season, home AS t FROM weekly UNION ALL SELECT season, away FROM weekly), c AS (SELECT season, t, count(*) AS n FROM g GROUP BY ALL)
SELECT season, max(n) AS games FROM c GROUP BY ALL""")
def a05_games_per_season(s, d):
    return aggregates.games_per_season(_schedule(s, d))


@query(f"WITH {WEEKLY} SELECT team, season, avg(score) AS points_per_game FROM (SELECT season, home AS team, carries AS score FROM weekly UNION ALL SELECT season, away, receptions FROM weekly) GROUP BY ALL")
def a06_points_per_game(s, d):
    return aggregates.points_per_game(_schedule(s, d))


@query("""WITH e AS (SELECT o_custkey AS player_id, year(o_orderdate)::INT AS season, o_orderkey AS day, substr(o_orderpriority, 1, 1)::INT AS rank, o_orderstatus AS team FROM orders)
SELECT player_id, season, median(rank) AS median_rank, arg_max(rank, day) AS final_rank, arg_max(team, day) AS final_team, median(rank) <= 1 AS starter FROM e GROUP BY ALL""")
def a08_depth_summary(s, d):
    o = table(s, d, "orders")
    return aggregates.depth_summary(o.select(F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.col("o_orderkey").alias("at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("rank"), F.col("o_orderstatus").alias("team")))


@query(f"WITH {WEEKLY}, w AS (SELECT *, week % 6 AS wk FROM weekly) SELECT player_id, season, CASE WHEN max(CASE WHEN wk = 0 THEN 1 ELSE 0 END) = 1 THEN avg(CASE WHEN wk = 0 THEN carries END) ELSE avg(carries) END AS carries FROM w GROUP BY ALL")
def a09_prefer_totals(s, d):
    return aggregates.prefer_totals(base.weekly(s, d).withColumn("week", F.col("week") % 6), ["carries"])


@query(f"""WITH {WEEKLY}, p AS (SELECT player_id, season, carries AS yardline, down, receptions - 4 AS gained FROM weekly)
SELECT player_id, season, count(*) FILTER (yardline <= 20) AS red_zone, count(*) FILTER (yardline <= 5) AS inside_five, avg((gained >= 10)::INT) AS explosive_rate,
 avg((gained <= 0)::INT) AS stuffed_rate, avg((gained > 0)::INT) AS success_rate, avg((gained > 0)::INT) FILTER (down = 3) AS third_down_rate FROM p GROUP BY ALL""")
def a14_situational(s, d):
    return aggregates.situational(base.weekly(s, d).select("player_id", "season", F.col("carries").alias("yardline"), "down", (F.col("receptions") - 4).alias("gained")))


@query(f"""WITH {WEEKLY}, g AS (SELECT team, season, game_id, max(rushing_yards) - min(rushing_yards) AS span, count(*) AS plays FROM weekly GROUP BY ALL)
SELECT team, season, sum(span)::DOUBLE / sum(plays) AS pace FROM g GROUP BY ALL""")
def a16_pace(s, d):
    return aggregates.pace(base.weekly(s, d).withColumn("clock", F.col("rushing_yards")), about=table(s, d, "lineitem").count())


def _next(s, d):
    return base.seasons(s, d).withColumn("next_team", F.lead("team").over(windows.by_season()))


NEXT = SEASONS + ", nxt AS (SELECT *, lead(team) OVER (PARTITION BY player_id ORDER BY season) AS next_team FROM seasons)"


@query(f"""WITH {NEXT}, v AS (SELECT team, season, sum(CASE WHEN next_team <> team THEN carries ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN next_team IS NOT NULL THEN carries END), 0) AS vacated_share FROM nxt GROUP BY ALL)
SELECT *, 1 - vacated_share AS returning_share FROM v""")
def a19_vacated(s, d):
    return aggregates.vacated(_next(s, d), "carries")


@query("SELECT o_custkey, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) WHERE n > 1")
def a20_duplicates(s, d):
    return aggregates.duplicates(table(s, d, "orders"), ["o_custkey"])


@query("SELECT c_nationkey, count(*) AS n, array_to_string(list_sort(list(c_custkey)), ',') AS ids FROM customer GROUP BY ALL")
def a21_collected(s, d):
    return table(s, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH {SEASONS} SELECT 'position' AS "column", avg((position IS NOT NULL)::INT) AS coverage FROM seasons UNION ALL SELECT 'carries', avg((carries IS NOT NULL)::INT) FROM seasons""")
def a26_coverage(s, d):
    return aggregates.coverage(base.seasons(s, d), ["position", "carries"])


@query("SELECT event_type, count(*) AS n, count(*) OVER () AS total FROM events GROUP BY event_type ORDER BY event_type LIMIT 3 OFFSET 1")
def a30_paged_with_total(s, d):
    n = table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("total", F.count("*").over(Window.partitionBy()))
    return n.orderBy("event_type").offset(1).limit(3)


@query("SELECT c_mktsegment, median(c_acctbal) AS mid, quantile_cont(c_acctbal, 0.2) AS low, quantile_cont(c_acctbal, 0.8) AS high FROM customer GROUP BY ALL")
def a32_quantiles(s, d):
    return table(s, d, "customer").groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("mid"), F.percentile("c_acctbal", F.lit(0.2)).alias("low"), F.percentile("c_acctbal", F.lit(0.8)).alias("high"))


@query(f"WITH {SEASONS} SELECT position, round(covar_pop(carries, rushing_yards) / nullif(stddev_pop(carries) * stddev_pop(rushing_yards), 0), 6) AS r FROM seasons GROUP BY ALL")
def a33_correlation(s, d):
    return _round(base.seasons(s, d).groupBy("position").agg(aggregates.pearson("carries", "rushing_yards").alias("r")), "r")


@query("""SELECT user_id, sum(event_id) FILTER (event_type = 'view')::BIGINT AS user_view, sum(event_id) FILTER (event_type = 'click')::BIGINT AS user_click, sum(event_id) FILTER (event_type = 'purchase')::BIGINT AS user_purchase FROM events GROUP BY user_id""")
def s10_long_to_wide(s, d):
    e = table(s, d, "events").withColumn("kind", F.lit("USER"))
    return aggregates.long_to_wide(e, ["user_id"], "kind", "event_type", "event_id", ["user_view", "user_click", "user_purchase"])


@query("SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def f51_json_fields(s, d):
    return table(s, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")).where("k is not null")


@query("SELECT count(*) AS rows, array_to_string(list_sort(list(DISTINCT year(o_orderdate)::INT)), ',') AS present, '1994' AS missing, 'partial' AS status FROM orders")
def s18_coverage(s, d):
    c = tables.coverage(table(s, d, "orders").select(F.year("o_orderdate").alias("season")), list(range(1994, 2002)))
    return c.select("rows", *[F.array_join(F.transform(n, lambda x: x.cast("string")), ",").alias(n) for n in ("present", "missing")], "status")


# ---- windows


@query(f"""WITH {SEASONS} SELECT *, lag(carries) OVER w AS prev_carries, carries - lag(carries) OVER w AS carries_trend,
 round((carries * 0.65::DOUBLE + coalesce(lag(carries) OVER w, 0) * 0.35::DOUBLE) / (0.65::DOUBLE + CASE WHEN lag(carries) OVER w IS NULL THEN 0 ELSE 0.35::DOUBLE END), 6) AS carries_w2,
 round((carries * 0.55::DOUBLE + coalesce(lag(carries) OVER w, 0) * 0.3::DOUBLE + coalesce(lag(carries, 2) OVER w, 0) * 0.15::DOUBLE)
  / (0.55::DOUBLE + CASE WHEN lag(carries) OVER w IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN lag(carries, 2) OVER w IS NULL THEN 0 ELSE 0.15::DOUBLE END), 6) AS carries_w3,
 sum(carries) OVER w::BIGINT AS career_carries, max(carries) OVER w AS best_carries, count(carries) OVER w AS carries_seasons
 FROM seasons WINDOW w AS (PARTITION BY player_id ORDER BY season)""".replace("sum(carries) OVER w::BIGINT", "(sum(carries) OVER w)::BIGINT"))
def w01_lag_features(s, d):
    return _round(windows.lag_features(base.seasons(s, d), ["carries"]), "carries_w2", "carries_w3")


@query(f"""WITH {SEASONS}, a AS (SELECT player_id, season, team, games, least(greatest(games / 12.0::DOUBLE, 0), 1) AS played_share, greatest(12 - games, 0) AS missed FROM seasons),
b AS (SELECT *, lag(missed) OVER w AS prev1_missed, lag(missed, 2) OVER w AS prev2_missed, (sum(missed) OVER (PARTITION BY player_id ORDER BY season ROWS 2 PRECEDING))::BIGINT AS missed_3yr,
 lag(played_share) OVER w AS p1, lag(played_share, 2) OVER w AS p2, CASE WHEN lag(team) OVER w IS NOT DISTINCT FROM team THEN 0 ELSE 1 END AS ch FROM a WINDOW w AS (PARTITION BY player_id ORDER BY season)),
c AS (SELECT *, sum(ch) OVER (PARTITION BY player_id ORDER BY season) AS spell FROM b)
SELECT player_id, season, team, games, played_share, missed, prev1_missed, prev2_missed, missed_3yr,
 round((played_share * 0.5::DOUBLE + coalesce(p1, 0) * 0.3::DOUBLE + coalesce(p2, 0) * 0.2::DOUBLE) / (0.5::DOUBLE + CASE WHEN p1 IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN p2 IS NULL THEN 0 ELSE 0.2::DOUBLE END), 6) AS durability,
 count(*) OVER (PARTITION BY player_id, spell ORDER BY season) AS seasons_with_team FROM c""")
def w07_availability(s, d):
    out = windows.availability(base.seasons(s, d).select("player_id", "season", "team", "games"), F.lit(12))
    return _round(out.drop("scheduled"), "durability")


@query(f"""WITH {SEASONS} SELECT season, player_id, carries, rank() OVER (PARTITION BY season ORDER BY carries DESC) + (count(*) OVER (PARTITION BY season, carries) - 1) / 2.0::DOUBLE AS avg_rank FROM seasons""")
def w14_average_rank(s, d):
    d = base.seasons(s, d).select("season", "player_id", "carries")
    return windows.average_rank(d.withColumn("neg", -F.col("carries")), F.col("neg"), "avg_rank", ["season"]).drop("neg")


@query(f"WITH {SEASONS} SELECT season, player_id, carries, row_number() OVER (PARTITION BY season ORDER BY carries DESC, player_id)::INT AS rank FROM seasons QUALIFY rank <= 40")
def t06_top_per_season(s, d):
    return windows.top_per_group(base.seasons(s, d).select("season", "player_id", "carries"), ["season"], [F.col("carries").desc(), F.col("player_id")], 40)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def t04_top_n(s, d):
    return table(s, d, "customer").select("c_custkey", "c_name", "c_acctbal").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(25)


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL")
def u05_keep_last(s, d):
    return windows.latest(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY ALL")
def u04_keep_first(s, d):
    return windows.earliest(table(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("""WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size > 25 THEN p_size END AS size, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS kind FROM part)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (size IS NOT NULL)::INT + (kind IS NOT NULL)::INT DESC, p_partkey) = 1""")
def u06_most_complete(s, d):
    p = table(s, d, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).alias("kind"))
    return windows.most_complete(p, ["p_brand"], "p_partkey")


@query("SELECT l_returnflag, 'quantity' AS stat, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY ALL UNION ALL SELECT l_returnflag, 'lines', count(*) FROM lineitem GROUP BY ALL")
def u10_unpivot(s, d):
    w = table(s, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count("*").alias("lines"))
    return w.unpivot(["l_returnflag"], ["quantity", "lines"], "stat", "total")


# ---- joins and sets


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def j01_left(s, d):
    o = table(s, d, "orders").where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey")
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return c.join(o, c.c_custkey == o.o_custkey, "left").drop("o_custkey")


@query("""SELECT coalesce(a.k, b.k) AS nation, customers, suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY ALL) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 3000 GROUP BY ALL) b ON a.k = b.k""")
def j07_full(s, d):
    a = table(s, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(s, d, "supplier").where("s_acctbal > 3000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j09_anti(s, d):
    o = table(s, d, "orders")
    c = table(s, d, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def j18_semi(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders").where("o_totalprice > 250000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("""WITH b AS (SELECT o_custkey AS id, o_orderstatus AS team FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1),
p AS (SELECT o_custkey AS id, o_orderpriority AS team FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
SELECT id, team FROM b WHERE id NOT IN (SELECT id FROM p) UNION ALL SELECT id, team FROM p""")
def j10_upsert(s, d):
    o = table(s, d, "orders")
    first = windows.earliest(o.select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderstatus").alias("team")), ["id"], "o_orderkey").select("id", "team")
    patch = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderpriority").alias("team"))
    return identity.upsert(first, patch, ["id"], "o_orderkey").select("id", "team")


@query(f"WITH {NEXT} SELECT a.player_id, a.season, a.team AS was, b.team AS now FROM nxt a JOIN nxt b ON a.player_id = b.player_id AND b.season = a.season + 1 AND b.team <> a.team")
def j13_moved_teams(s, d):
    a, b = (_next(s, d).select("player_id", "season", F.col("team").alias(n)) for n in ("was", "now"))
    return a.join(b.withColumn("season", F.col("season") - 1), ["player_id", "season"]).where("was <> now")


@query(f"WITH {PAIRS} SELECT player_id, season, target_season, seasons_since, carries FROM pairs")
def j15_latest_before(s, d):
    p = base.seasons(s, d)
    return windows.latest_before(p.select("player_id", "season", "carries"), p).select("player_id", "season", "target_season", "seasons_since", "carries")


@query("SELECT o_custkey, count(*) AS n, (SELECT count(*) FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P') AS pending FROM orders o GROUP BY ALL")
def j20_correlated_count(s, d):
    return table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u08_intersect(s, d):
    return table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey"))


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def u03_diagonal_union(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return a.unionByName(table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")), allowMissingColumns=True)


# ---- columns


SLUG = "regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"""WITH a AS (SELECT p_partkey, p_name, {SLUG} AS s, p_partkey::VARCHAR AS k FROM part), b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY s) > 1 THEN s || '-' || right(k, 4) ELSE s END AS t FROM a)
SELECT p_partkey, p_name, CASE WHEN count(*) OVER (PARTITION BY t) > 1 THEN t || '-' || substr(k, 1, 4) ELSE t END AS slug FROM b""")
def f06_unique_slugs(s, d):
    return identity.unique_slugs(table(s, d, "part").select("p_partkey", "p_name"), "p_partkey", "p_name")


@query("""WITH w AS (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[^A-Za-zÀ-ÿ ]', ' ', 'g'), ' ')) AS name FROM documents)
SELECT name, trim(regexp_replace(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(name)), 'ß', 'ss'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), '( (jr|sr|ii|iii|iv|v))$', '')) AS plain FROM w""")
def f02_normal_name(s, d):
    w = table(s, d, "documents").select(F.explode(F.split(F.regexp_replace("text", "[^A-Za-zÀ-ÿ ]", " "), " ")).alias("name")).distinct()
    return w.select("name", C.normal_name("name").alias("plain"))


@query("SELECT p_partkey, CASE WHEN len(string_split(p_name, ' ')) > 1 THEN substr(p_name, 1, 1) || '. ' || string_split(p_name, ' ')[-1] ELSE p_name END AS short FROM part")
def f07_short_name(s, d):
    return table(s, d, "part").select("p_partkey", C.short_name("p_name").alias("short"))


@query("""SELECT c_custkey, CASE WHEN t = '' THEN 'FA' WHEN t = 'OAK' THEN 'LV' WHEN t = 'STL' THEN 'LA' ELSE t END AS team, CASE WHEN p = 'HB' THEN 'RB' WHEN p = 'TE' THEN 'TE' END AS position FROM
(SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'OAK' WHEN 1 THEN '' WHEN 2 THEN 'STL' ELSE 'SEA' END AS t, CASE c_custkey % 3 WHEN 0 THEN 'HB' WHEN 1 THEN 'TE' ELSE 'LS' END AS p FROM customer)""")
def f08_codes(s, d):
    k = F.col("c_custkey")
    raw = table(s, d, "customer").select("c_custkey", F.when(k % 4 == 0, " oak").when(k % 4 == 1, " ").when(k % 4 == 2, "STL").otherwise("sea ").alias("t"), F.when(k % 3 == 0, "hb").when(k % 3 == 1, "TE ").otherwise("LS").alias("p"))
    return raw.select("c_custkey", C.normal_team("t").alias("team"), C.normal_position("p").alias("position"))


@query("""SELECT o_orderkey, CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS timer
FROM (SELECT o_orderkey, (o_orderkey * 37) % 100000 AS s FROM orders)""")
def f15_timer(s, d):
    return table(s, d, "orders").select("o_orderkey", C.timer((F.col("o_orderkey") * 37) % 100000).alias("timer"))


@query("SELECT o_orderkey, (year(o_orderdate) - CASE WHEN month(o_orderdate) < 3 THEN 1 ELSE 0 END)::INT AS season, date_diff('day', o_orderdate::DATE, make_date(year(o_orderdate)::INT + 30, 9, 1)) / 365.25::DOUBLE AS age FROM orders")
def f22_seasons_and_ages(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", C.season_of(F.col("o_orderdate")).alias("season"), C.age_at(F.to_date("o_orderdate"), F.year("o_orderdate") + 30).alias("age"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 20 THEN l_extendedprice / l_quantity END AS rate, least(greatest(l_quantity, 10), 40) AS clipped,
CASE WHEN l_quantity <= 10 THEN 'top10' WHEN l_quantity <= 32 THEN 'round1' ELSE 'round2' END AS pick, least(greatest(1.0 / (1.0 + (l_quantity - 1) / 55.0::DOUBLE), 0.18), 1.0) AS capital,
(l_quantity > 10)::INT + (l_quantity > 20)::INT AS tier FROM lineitem""")
def f30_numeric_columns(s, d):
    q = "l_quantity"
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", C.safe_ratio("l_extendedprice", q, 20).alias("rate"), C.clip(q, 10.0, 40.0).alias("clipped"), C.pick_bucket(q).alias("pick"), C.capital_curve(q).alias("capital"), C.digitize(q, [10, 20]).alias("tier"))


@query("SELECT c_custkey, ('0x' || substr(sha256(c_name), 1, 8))::BIGINT / 4294967295.0::DOUBLE AS unit FROM customer")
def f43_stable_unit(s, d):
    return table(s, d, "customer").select("c_custkey", C.stable_unit("c_name").alias("unit"))


@query()
def f44_mixed_unit(s, d):
    return table(s, d, "customer").select("c_custkey", C.mixed_unit(371, "c_name").alias("unit"))


# ---- identity


@query("""WITH o AS (SELECT o_custkey AS id, o_orderpriority AS code FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) = 1)
SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, code) AS code FROM customer LEFT JOIN o ON id = c_custkey""")
def i02_crosswalk_fill(s, d):
    b = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("code"))
    return identity.fill_from(b, table(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("code")), "id", ["code"])


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'fixed ' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS nation FROM customer""")
def i03_corrections(s, d):
    b = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    names = b.where("id % 5 = 0").select("id", F.lit("name").alias("field"), F.explode(F.array(F.struct(F.lit(1).alias("line"), F.lit("old").alias("v")), F.struct(F.lit(2).alias("line"), F.concat(F.lit("fixed "), F.col("id").cast("string")).alias("v")))).alias("x"))
    bad = b.where("id % 7 = 0").select("id", F.lit("nation").alias("field"), F.struct(F.lit(3).alias("line"), F.lit("not a number").alias("v")).alias("x"))
    return identity.correct(b, names.unionByName(bad).select("id", "field", F.col("x.v").alias("new_value"), F.col("x.line").alias("line")), "id")


@query(f"""WITH n AS (SELECT p_partkey AS id, lower(p_name) AS name, p_brand AS position FROM part), e AS (SELECT name, position, min(id) AS x FROM n GROUP BY ALL HAVING count(DISTINCT id) = 1), l AS (SELECT name, min(id) AS y FROM n GROUP BY ALL HAVING count(DISTINCT id) = 1)
SELECT p_partkey AS line, p_name AS name, p_brand AS position, coalesce(x, y) AS id FROM part LEFT JOIN e ON e.name = lower(p_name) AND e.position = p_brand LEFT JOIN l ON l.name = lower(p_name)""")
def i06_attach_by_name(s, d):
    p = table(s, d, "part")
    dim = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("position"))
    return identity.attach_by_name(p.select(F.col("p_partkey").alias("line"), F.upper("p_name").alias("name"), F.col("p_brand").alias("position")), dim, "id").select("line", F.lower("name").alias("name"), "position", "id")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL")
def i07_unknown_ids(s, d):
    return identity.unknown(table(s, d, "orders"), table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 100.0::DOUBLE * 1.5::DOUBLE WHEN c_custkey % 4 = 1 THEN c_acctbal * 0.5::DOUBLE ELSE c_acctbal END AS stat, c_custkey % 4 < 2 AS overridden FROM customer""")
def r13_overrides(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("stat"))
    row = lambda line, v, m: F.struct(F.lit(line).cast("long").alias("line"), F.lit(v).cast("double").alias("set_to"), F.lit(m).cast("double").alias("multiplier"))
    o = c.where("id % 4 < 2").select("id", F.explode(F.when(F.col("id") % 4 == 0, F.array(row(2, None, 1.5), row(1, 100.0, None))).otherwise(F.array(row(1, None, 0.5)))).alias("o")).select("id", "o.*")
    return identity.override(c, o, "id", "stat")


# ---- features


@query(f"WITH {SEASONS} SELECT player_id, season, CASE WHEN carries > 20 THEN rushing_yards::DOUBLE / carries END AS yards_per_carry, CASE WHEN carries > 20 THEN rushing_tds::DOUBLE / carries END AS rush_td_rate, carries::DOUBLE / games AS carries_per_game FROM seasons")
def e11_rates(s, d):
    return features.rates(base.seasons(s, d), features.RUSHING).select("player_id", "season", "yards_per_carry", "rush_td_rate", "carries_per_game")


@query(f"WITH {PAIRS} SELECT player_id, target_season, season, carries, outcome_carries, target_played FROM pairs")
def e18_modelling_pairs(s, d):
    return base.pairs(s, d).select("player_id", "target_season", "season", "carries", "outcome_carries", "target_played")


@query(f"""WITH {SEASONS}, b AS (SELECT team, season, player_id AS leader, rushing_yards AS leader_rushing_yards FROM seasons QUALIFY row_number() OVER (PARTITION BY team, season ORDER BY carries DESC, player_id) = 1)
SELECT *, (lag(leader) OVER (PARTITION BY team ORDER BY season) <> leader)::INT AS leader_changed FROM b""")
def e21_leader_context(s, d):
    return features.leader_context(base.seasons(s, d), "carries", "rushing_yards")


@query(f"""WITH {NEXT}, n AS (SELECT *, coalesce(next_team, team) AS projected_team FROM nxt WHERE season = 1999), r AS (SELECT next_team, sum(carries) AS room FROM n WHERE next_team IS NOT NULL GROUP BY ALL)
SELECT player_id, projected_team, CASE WHEN room > 0 THEN (room - carries)::DOUBLE / room END AS competition FROM n LEFT JOIN r ON projected_team = r.next_team""")
def e22_competition(s, d):
    n = _next(s, d).where("season = 1999").withColumn("projected_team", F.coalesce("next_team", "team"))
    return features.competition(n, n, "carries").select("player_id", "projected_team", "competition")


@query(f"WITH {SEASONS} SELECT player_id, season, team, carries::DOUBLE / sum(carries) OVER (PARTITION BY team, season) AS share FROM seasons")
def j11_own_share(s, d):
    return features.own_share(base.seasons(s, d), "carries", ["team", "season"], "share").select("player_id", "season", "team", "share")


# ---- value


@query(f"""WITH {SEASONS} SELECT player_id, season, preset, rushing_yards / 10.0::DOUBLE + rushing_tds * 6.0::DOUBLE + receptions * w AS points FROM seasons, (VALUES ('standard', 0.0::DOUBLE), ('half_ppr', 0.5::DOUBLE), ('ppr', 1.0::DOUBLE)) p(preset, w)""")
def r01_score_presets(s, d):
    return value.score_presets(base.seasons(s, d), ["rushing_yards", "rushing_tds", "receptions"]).select("player_id", "season", "preset", "points")


@query(f"WITH {BOARD} SELECT position, rank::INT AS rank, round(level, 6) AS level FROM levels")
def r05_replacement_levels(s, d):
    return _round(value.replacement_levels(base.players(s, d)).select("position", F.col("rank").cast("int").alias("rank"), "level"), "level")


def _board(s, d):
    p = base.players(s, d)
    return value.with_vorp(p, value.replacement_levels(p))


DRAFT = "vorp DESC, points_per_game DESC, points DESC, high_points - low_points, player_id"
RANKS = f"""{BOARD}, r AS (SELECT *, vorp - 0.35::DOUBLE * greatest(points - low_points, 0) / 2 AS risk_value FROM board),
ranks AS (SELECT player_id, position, row_number() OVER (ORDER BY {DRAFT})::INT AS overall_rank, row_number() OVER (ORDER BY points DESC, player_id)::INT AS points_rank,
 row_number() OVER (ORDER BY points_per_game DESC, player_id)::INT AS per_game_rank, row_number() OVER (ORDER BY high_points DESC, player_id)::INT AS upside_rank,
 row_number() OVER (ORDER BY risk_value DESC, player_id)::INT AS risk_rank, row_number() OVER (PARTITION BY position ORDER BY {DRAFT})::INT AS position_rank FROM r)"""
RANK_COLUMNS = ["player_id", "position", "overall_rank", "points_rank", "per_game_rank", "upside_rank", "risk_rank", "position_rank"]


@query(f"WITH {RANKS} SELECT * FROM ranks")
def r08_vorp_board(s, d):
    return value.rank_players(_board(s, d)).select(*RANK_COLUMNS)


@query()
def r09_gap_tiers(s, d):
    return value.gap_tiers(value.rank_players(_board(s, d)))


@query(f"WITH {RANKS} SELECT player_id, row_number() OVER (ORDER BY overall_rank)::INT AS overall_rank, overall_rank AS model_rank, CASE WHEN overall_rank > 160 THEN 'included by request' END AS warning FROM ranks WHERE overall_rank <= 160 OR player_id IN (7, 11, 100)")
def r10_published(s, d):
    return value.publish(value.rank_players(_board(s, d)), 160, [7, 11, 100]).select("player_id", "overall_rank", "model_rank", "warning")


@query(f"WITH {SEASONS} SELECT player_id, least(greatest(games * 2.0::DOUBLE, 0), 17) AS games, least(greatest(receptions * 3.0::DOUBLE, 0), greatest(carries * 1.0::DOUBLE, 0)) AS receptions, greatest(carries * 1.0::DOUBLE, 0) AS targets FROM seasons")
def r11_constraints(s, d):
    b = base.seasons(s, d)
    return value.constrain(b.select("player_id", (F.col("games") * 2.0).alias("games"), (F.col("receptions") * 3.0).alias("receptions"), (F.col("carries") * 1.0).alias("targets")))


@query(f"WITH {PLAYERS} SELECT player_id, least(high_points, points) AS high_points, points, greatest(points, low_points) AS low_points FROM players")
def r12_ordered_range(s, d):
    return base.players(s, d).select("player_id", *value.ordered_range("high_points", "points", "low_points"))


# ---- quality


@query(f"""WITH {SEASONS} SELECT 'no_nulls_position' AS "check", count(*) FILTER (position IS NULL) = 0 AS passed, count(*) FILTER (position IS NULL) AS count FROM seasons
UNION ALL SELECT 'bounds_games', count(*) FILTER (games > 6) = 0, count(*) FILTER (games > 6) FROM seasons UNION ALL SELECT 'ratio_receptions_carries', count(*) FILTER (receptions > carries + 1e-6) = 0, count(*) FILTER (receptions > carries + 1e-6) FROM seasons
UNION ALL SELECT 'negative_' || c, true, 0 FROM (VALUES ('player_id'), ('season'), ('games'), ('teams'), ('carries'), ('rushing_yards'), ('receptions'), ('rushing_tds')) v(c)""")
def q06_row_checks(s, d):
    return quality.row_checks(base.seasons(s, d), {"games": (0, 6)}, [("receptions", "carries")], ["position"])


@query("SELECT 'unique_l_orderkey_l_linenumber' AS \"check\", count(*) = 0 AS passed, count(*) AS count FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def q04_unique_key(s, d):
    return quality.unique_key(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"WITH {SEASONS} SELECT 'games_within_schedule' AS \"check\", count(*) = 0 AS passed, count(*) AS count FROM seasons WHERE games > CASE WHEN season >= 2000 THEN 2 ELSE 12 END")
def q08_within_schedule(s, d):
    b = base.seasons(s, d)
    g = b.select("season").distinct().withColumn("games", F.when(F.col("season") >= 2000, 2).otherwise(12))
    return quality.within_schedule(b, g)


@query(f"""WITH {PAIRS} SELECT 'season_before_target' AS "check", true AS passed, 0::BIGINT AS count UNION ALL SELECT 'one_season_ahead', true, 0 UNION ALL SELECT 'copy_carries_outcome_carries', true, 0 UNION ALL SELECT 'backward_carries', true, 0""")
def l01_leakage(s, d):
    return quality.leakage(base.pairs(s, d), ["carries"], ["outcome_carries"])


# ---- models


def _predictions(s, d):
    return base.pairs(s, d).select("player_id", "target_season", F.col("carries").cast("double").alias("predicted"), F.col("outcome_carries").cast("double").alias("actual"))


PREDICTIONS = PAIRS + ", preds AS (SELECT player_id, target_season, carries::DOUBLE AS predicted, outcome_carries::DOUBLE AS actual FROM pairs)"


@query(f"""WITH {PREDICTIONS} SELECT target_season, count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae, round(sqrt(avg((predicted - actual) ** 2)), 6) AS rmse, round(median(abs(predicted - actual)), 6) AS median_error,
 round((var_pop(actual) - avg((predicted - actual) ** 2)) / var_pop(actual), 6) AS r2, round(avg(predicted - actual), 6) AS bias FROM preds GROUP BY ALL""")
def m11_regression_metrics(s, d):
    return _round(models.regression_metrics(_predictions(s, d), ["target_season"]), "mae", "rmse", "median_error", "r2", "bias")


@query(f"""WITH {PREDICTIONS}, k AS (SELECT *, rank() OVER (PARTITION BY target_season ORDER BY predicted DESC) + (count(*) OVER (PARTITION BY target_season, predicted) - 1) / 2.0::DOUBLE AS p, rank() OVER (PARTITION BY target_season ORDER BY actual DESC) + (count(*) OVER (PARTITION BY target_season, actual) - 1) / 2.0::DOUBLE AS a,
 row_number() OVER (PARTITION BY target_season ORDER BY predicted DESC, player_id) AS pi, row_number() OVER (PARTITION BY target_season ORDER BY actual DESC, player_id) AS ai FROM preds)
SELECT target_season, round(covar_pop(p, a) / (stddev_pop(p) * stddev_pop(a)), 6) AS spearman, round(avg(abs(p - a)), 6) AS rank_error, count(*) FILTER (pi <= 12 AND ai <= 12) / 12.0::DOUBLE AS top12, count(*) FILTER (pi <= 24 AND ai <= 24) / 24.0::DOUBLE AS top24, count(*) FILTER (pi <= 50 AND ai <= 50) / 50.0::DOUBLE AS top50 FROM k GROUP BY ALL""")
def m12_rank_metrics(s, d):
    return _round(models.rank_metrics(_predictions(s, d), ["target_season"]), "spearman", "rank_error")


@query(f"""WITH {PREDICTIONS}, r AS (SELECT *, actual - predicted AS r FROM preds), g AS (SELECT target_season, count(*) AS n, quantile_cont(r, 0.2) AS lo, quantile_cont(r, 0.8) AS hi FROM r GROUP BY ALL)
SELECT target_season, count(*) AS n, avg((actual >= predicted + lo AND actual <= predicted + hi)::INT) AS coverage, round(avg(hi - lo), 6) AS width FROM preds JOIN g USING (target_season) GROUP BY ALL""")
def m13_calibration(s, d):
    p = _predictions(s, d)
    return _round(models.calibration(p, models.interval_bounds(p, ["target_season"], exact=True), ["target_season"]), "width")


@query(f"""WITH {PAIRS}, tr AS (SELECT * FROM pairs WHERE target_season < 1999), te AS (SELECT * FROM pairs WHERE target_season = 1999),
f AS (SELECT position, teams, avg(outcome_carries) AS a FROM tr WHERE position IS NOT NULL GROUP BY ALL HAVING count(*) >= 5), p AS (SELECT position, avg(outcome_carries) AS b FROM tr WHERE position IS NOT NULL GROUP BY ALL), w AS (SELECT avg(outcome_carries) AS c FROM tr)
SELECT player_id, coalesce(a, b, c) AS guess FROM te LEFT JOIN f USING (position, teams) LEFT JOIN p USING (position), w""")
def m04_group_mean(s, d):
    p = base.pairs(s, d)
    return models.group_mean(p.where("target_season < 1999"), p.where("target_season = 1999"), ["position", "teams"], "outcome_carries", "guess").select("player_id", "guess")


@query(f"""WITH {PAIRS}, tr AS (SELECT * FROM pairs WHERE target_season < 1999), te AS (SELECT * FROM pairs WHERE target_season = 1999), q AS (SELECT quantile_cont(carries, 0.25) AS a, quantile_cont(carries, 0.5) AS b, quantile_cont(carries, 0.75) AS c FROM tr),
m AS (SELECT (a < carries)::INT + (b < carries)::INT + (c < carries)::INT AS t, median(outcome_carries) AS guess FROM tr, q GROUP BY ALL)
SELECT player_id, guess FROM te, q LEFT JOIN m ON t = (a < carries)::INT + (b < carries)::INT + (c < carries)::INT""")
def m04_tier_median(s, d):
    p = base.pairs(s, d)
    return models.tier_median(p.where("target_season < 1999"), p.where("target_season = 1999"), "carries", "outcome_carries", "guess", exact=True).select("player_id", "guess")


def _errors(s, d):
    p = base.pairs(s, d)
    each = F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("predicted")) for n, c in models.baselines("carries").items()])
    long = p.withColumn("_m", F.explode(each)).select("player_id", "target_season", "_m.model", "_m.predicted", F.col("outcome_carries").cast("double").alias("actual"))
    return models.regression_metrics(long, ["model", "target_season"])


ERRORS = PAIRS + """, long AS (SELECT target_season, outcome_carries AS actual, 'previous_total' AS model, carries::DOUBLE AS predicted FROM pairs UNION ALL SELECT target_season, outcome_carries, 'per_game', carries::DOUBLE / games * 17 FROM pairs
 UNION ALL SELECT target_season, outcome_carries, 'two_year', (carries * 0.65::DOUBLE + coalesce(prev_carries, 0) * 0.35::DOUBLE) / (0.65::DOUBLE + CASE WHEN prev_carries IS NULL THEN 0 ELSE 0.35::DOUBLE END) FROM pairs
 UNION ALL SELECT target_season, outcome_carries, 'three_year', (carries * 0.5::DOUBLE + coalesce(prev_carries, 0) * 0.3::DOUBLE + coalesce(prev2_carries, 0) * 0.2::DOUBLE) / (0.5::DOUBLE + CASE WHEN prev_carries IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN prev2_carries IS NULL THEN 0 ELSE 0.2::DOUBLE END) FROM pairs),
 folds AS (SELECT model, target_season, avg(abs(predicted - actual)) AS mae FROM long GROUP BY ALL), errors AS (SELECT model, avg(mae) AS mae, count(*) AS folds FROM folds GROUP BY ALL)"""


@query(f"WITH {ERRORS} SELECT model, round(mae, 6) AS mae, folds FROM errors ORDER BY errors.mae, model LIMIT 1")
def t07_best_baseline(s, d):
    return _round(models.best_models(_errors(s, d)), "mae")


@query(f"WITH {ERRORS}, b AS (SELECT * FROM errors ORDER BY mae, model LIMIT 3) SELECT model, round((1 / mae) / sum(1 / mae) OVER (), 6) AS weight FROM b")
def t08_ensemble_weights(s, d):
    return _round(models.ensemble_weights(_errors(s, d)).select("model", "weight"), "weight")


@query()
def m10_backtest(s, d):
    return models.backtest(base.pairs(s, d), ["carries", "games", "prev_carries", "career_carries"], "outcome_carries", [1999, 2000], ["ridge"])


# ---- draft rooms and events


@query("""SELECT o_orderkey, p AS pick, ((p - 1) // 12) + 1 AS round, ((p - 1) % 12) + 1 AS pick_in_round, CASE WHEN r IN (2, 3) OR (r > 3 AND r % 2 = 1) THEN 13 - (((p - 1) % 12) + 1) ELSE ((p - 1) % 12) + 1 END AS slot
FROM (SELECT o_orderkey, o_orderkey % 180 + 1 AS p, (o_orderkey % 180) // 12 + 1 AS r FROM orders)""")
def g01_draft_order(s, d):
    p = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 180 + 1).alias("pick"))
    return draft.placed_picks(p, 12, third_reversed=True)


@query("""WITH k AS (SELECT user_id AS roster, CASE event_type WHEN 'view' THEN 'RB' WHEN 'click' THEN 'WR' WHEN 'purchase' THEN 'QB' ELSE 'TE' END AS position FROM events), n AS (SELECT * FROM (VALUES ('QB', 1), ('RB', 2), ('WR', 3)) v(position, slots))
SELECT roster, position, greatest(slots - coalesce(have, 0), 0) AS need FROM (SELECT * FROM (SELECT DISTINCT roster FROM k), n) LEFT JOIN (SELECT roster, position, count(*) AS have FROM k GROUP BY ALL) h USING (roster, position)""")
def g05_needs(s, d):
    e = table(s, d, "events")
    k = e.select(F.col("user_id").alias("roster"), F.coalesce(C.lookup("event_type", {"view": "RB", "click": "WR", "purchase": "QB"}), F.lit("TE")).alias("position"))
    return draft.needs(k, {"QB": 1, "RB": 2, "WR": 3})


@query("SELECT o_orderkey, b, e, CASE WHEN e > 0 THEN greatest(b - (e - 1), 0) ELSE 0 END AS most, bid >= 6 AND bid <= CASE WHEN e > 0 THEN greatest(b - (e - 1), 0) ELSE 0 END AS valid FROM (SELECT o_orderkey, (o_orderkey % 200)::INT AS b, (o_custkey % 16)::INT AS e, (o_orderkey % 50)::INT AS bid FROM orders)")
def g09_auction(s, d):
    o = table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 200).cast("int").alias("b"), (F.col("o_custkey") % 16).cast("int").alias("e"), (F.col("o_orderkey") % 50).cast("int").alias("bid"))
    return o.select("o_orderkey", "b", "e", draft.max_bid(F.col("b"), F.col("e")).alias("most"), draft.bid_valid(F.col("bid"), F.lit(5), F.col("b"), F.col("e")).alias("valid"))


def room_events(s, d):
    e = table(s, d, "events")
    action = F.when(F.col("event_id") % 97 == 0, "pause").when(F.col("event_id") % 89 == 0, "undo").otherwise(C.lookup("event_type", {"view": "start", "click": "pick", "purchase": "pick", "signup": "resume", "error": "bid"}))
    return e.select(F.col("user_id").alias("room"), "event_id", action.alias("action"), (F.col("event_id") % 211).alias("player"), (F.unix_timestamp(F.col("ts").cast("timestamp")) * 1.0).alias("at"), F.lit(60).alias("total"), F.lit(90.0).alias("limit"))


@query()
def g12_rooms(s, d):
    return rooms.rooms_batch(room_events(s, d))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(floor(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def x01_tumbling_windows(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("cents", F.floor(F.col("value") * 100))
    return rooms.windowed(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a)
SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k""")
def x02_sessions(s, d):
    e = table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rooms.sessions(e).withColumn("start", F.col("start").cast("timestamp_ntz"))
