"""Sources, sinks and the registry; draft rooms as a batch, as a stream and in plain Python; preparation of features."""

import json

import pytest
from pyspark.sql import functions as F

from seasonforge.operators import models, quality
from seasonforge.sources import tables
from seasonforge.streaming import rooms


def test_round_trips(spark, tmp_path):
    d = spark.createDataFrame([(1, "a,b", 2020), (2, None, 2021)], "id long, name string, season int")
    tables.write_table(d, str(tmp_path / "t"), ["season"])
    tables.write_table(d.where("id = 1"), str(tmp_path / "t"), ["season"])  # replaces
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "t")).select("id", "name", "season").collect()] == [(1, "a,b", 2020)]
    tables.write_csv(d, str(tmp_path / "c"))
    text = tables.read_csv(spark, str(tmp_path / "c")).orderBy("id")
    assert [f.dataType.simpleString() for f in text.schema] == ["string"] * 3 and [tuple(r) for r in text.collect()] == [("1", "a,b", "2020"), ("2", None, "2021")]
    typed = tables.read_csv(spark, str(tmp_path / "c"), "id long, name string, season int")
    assert sorted(r.season for r in typed.collect()) == [2020, 2021]


def test_documents(spark, tmp_path):
    d = spark.createDataFrame([(1, 2.5, [1, 2])], "id long, points double, picks array<int>")
    r = tables.as_documents(d, ["id"], {"version": "7"}).first()
    assert r.id == 1 and json.loads(r.json) == {"version": "7", "data": {"id": 1, "points": 2.5, "picks": [1, 2]}}
    (tmp_path / "a.json").write_text('[{"x": {"y": 1, "z": "q"}, "w": 3}, {"w": "no number"}]')
    j = tables.read_json(spark, str(tmp_path / "a.json"), "x struct<y: int, z: string>, w int")
    flat = tables.flattened(j)
    assert flat.columns == ["x_y", "x_z", "w"] and sorted(map(tuple, flat.collect()), key=str) == sorted([(1, "q", 3), (None, None, None)], key=str)


def test_drift(spark):
    d = spark.createDataFrame([(1, "KC", 2020)], "id int, recent_team string, season int")
    assert tables.existing(d, ["id", "gone"]).columns == ["id"]
    got = tables.first_available(d, {"team": ["team", "recent_team"], "other": ["x"]}).first()
    assert (got.team, got.other) == ("KC", None)
    assert tables.with_missing(d, {"id": "int", "pts": "double"}).dtypes[-1] == ("pts", "double")
    c = tables.coverage(d, [2019, 2020]).first()
    assert (c.rows, c.present, c.missing, c.status) == (1, [2020], [2019], "partial") and tables.coverage(d.limit(0), [2020]).first().status == "unavailable"


def test_registry(spark):
    calls = []

    def load(s, fail=0):
        calls.append(1)
        if len(calls) <= fail:
            raise OSError("not there")
        return s.createDataFrame([(1, 2001), (2, 2005)], "id int, season int")

    c = tables.Catalogue()
    c.add(tables.Dataset("stats", True, True, ("id",), 2004, {"fail": 2}), load)
    assert [r.id for r in c.load(spark, "stats", [2001, 2005], delay=0).collect()] == [2] and len(calls) == 3
    assert c.load(spark, "stats", [1999]) is None
    c.add(tables.Dataset("odd", True, False, ("nope",)), load)
    with pytest.raises(ValueError, match="nope"):
        c.load(spark, "odd")

    def broken(s):
        raise OSError("gone")

    c.add(tables.Dataset("optional"), broken)
    c.add(tables.Dataset("needed", True), broken)
    assert c.load(spark, "optional", retries=2, delay=0) is None
    with pytest.raises(OSError, match="gone"):
        c.load(spark, "needed", retries=1)


def test_cache_and_manifest(spark):
    assert tables.fresh(100.0, 50, 149.0) and not tables.fresh(100.0, 50, 150.0) and not tables.fresh(100.0, 0, 100.0)
    long = tables.cache_key("x/" * 200)
    assert tables.cache_key("a b/c") == "a-b-c" and len(long) <= 120 and long != tables.cache_key("x/" * 201)
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    m = json.loads(tables.manifest(d, "t"))
    assert m == json.loads(tables.manifest(d.orderBy(F.col("id").desc()), "t")) and m["rows"] == 2 and m != json.loads(tables.manifest(d.where("id = 1"), "t"))


def test_example_players(spark):
    spark.dataSource.register(tables.GeneratedPlayers)
    d = spark.read.format("example_players").option("players", 50).load()
    rows = d.collect()
    assert len(rows) == 50 and len({r.player_id for r in rows}) == 50 and rows == d.collect() and {r.position for r in rows} == {"QB", "RB", "WR", "TE"}


def test_checks(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b")], "k int, t string")
    assert quality.required_columns(d, ["k", "zz"]) == ["zz"] and quality.forbidden_names(["a", "outcome_b", "target_played"]) == ["outcome_b", "target_played"]
    found = quality.report(quality.unique_key(d, ["k"]), quality.fold_overlap(d.where("t = 'a'"), d.where("t = 'b'"), ["k"])).collect()
    assert [(r.check, r.passed, r["count"]) for r in found] == [("unique_k", False, 1), ("fold_overlap", False, 1)]


# ---- rooms


EVENTS = [
    (1, 1, "pick", 5, 0.0), (1, 2, "start", 0, 1.0), (1, 3, "pick", 5, 2.0), (1, 4, "pick", 5, 3.0), (1, 5, "pause", 0, 4.0), (1, 6, "pick", 6, 5.0), (1, 7, "resume", 0, 6.0),
    (1, 8, "bid", 0, 30.0), (1, 9, "bid", 0, 31.0), (1, 10, "bid", 0, 99.0), (1, 11, "undo", 0, 99.5), (1, 12, "pick", 5, 100.0), (1, 13, "pick", 7, 101.0), (1, 14, "start", 0, 102.0), (1, 15, "undo", 0, 103.0), (2, 16, "undo", 0, 1.0),
]
WANT = [
    (1, False, "lobby", 1, 0.0), (2, True, "active", 1, 31.0), (3, True, "active", 2, 32.0), (4, False, "active", 2, 32.0), (5, True, "paused", 2, 32.0), (6, False, "paused", 2, 32.0), (7, True, "active", 2, 36.0),
    (8, True, "active", 2, 40.0), (9, True, "active", 2, 41.0), (10, False, "active", 2, 41.0), (11, True, "active", 1, 41.0), (12, True, "active", 2, 130.0), (13, True, "completed", 3, 131.0), (14, False, "completed", 3, 131.0),
    (15, True, "active", 2, 131.0), (16, False, "lobby", 1, 0.0),
]


def _events(spark):
    return spark.createDataFrame([(*e, 2, 30.0) for e in EVENTS], "room long, event_id long, action string, player long, at double, total int, limit double")


def test_rooms_in_batch(spark):
    got = rooms.rooms_batch(_events(spark)).collect()
    assert sorted((r.event_id, r.accepted, r.status, r.next_pick, r.deadline) for r in got) == WANT


def test_rooms_in_a_stream(spark, tmp_path):
    """Two files, two batches: the state of a room is carried over."""
    e = _events(spark)
    for k, part in enumerate((e.where("event_id <= 6"), e.where("event_id > 6"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = rooms.rooms_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), None).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == (6, 16)[k]
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.event_id, r.accepted, r.status, r.next_pick, r.deadline) for r in got) == WANT


def test_preparation_learns_from_training_rows_only(spark):
    train = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None)], "player_id int, x double")
    other = spark.createDataFrame([(9, None), (8, 1000.0)], "player_id int, x double")
    prep = models.Preparation(["x"]).fit(train)
    got = {r.player_id: r for r in prep.transform(other).collect()}
    name = prep.outputs()[0]
    assert got[9][name] == pytest.approx(2.0, abs=1.01) and got[8][name] <= 1000.0
