"""Upserts of a stream: a replayed or failed batch changes nothing."""

import pytest
from pyspark.sql import types as T

from seasonforge.streaming.upserts import UpsertTable

SCHEMA = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("v", T.StringType())])


def rows(d):
    return sorted(tuple(r) for r in d.collect())


@pytest.fixture
def table(tmp_path):
    return UpsertTable(str(tmp_path / "t"), ("k",), "at", SCHEMA, buckets=4)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_upserts_and_replays(spark, table):
    assert rows(table.read(spark)) == []
    first = frame(spark, [(1, 1, "a"), (2, 5, "b"), (2, 4, "old"), (3, 1, "c")])
    table.apply(first, 0)
    assert rows(table.read(spark)) == [(1, 1, "a"), (2, 5, "b"), (3, 1, "c")]
    second = frame(spark, [(1, 2, "A"), (2, 1, "late"), (4, 1, "d")])
    table.apply(second, 1)
    want = [(1, 2, "A"), (2, 5, "b"), (3, 1, "c"), (4, 1, "d")]
    assert rows(table.read(spark)) == want
    for batch, number in ((second, 1), (first, 0), (second, 1)):
        table.apply(batch, number)
        assert rows(table.read(spark)) == want and table.committed(spark) == [0, 1]


def test_a_batch_that_fails_before_it_is_recorded_is_not_seen(spark, table, monkeypatch):
    table.apply(frame(spark, [(1, 1, "a"), (2, 1, "b")]), 0)
    batch = frame(spark, [(1, 9, "new"), (5, 1, "e")])
    with monkeypatch.context() as m:
        m.setattr(UpsertTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.apply(batch, 1)
    assert rows(table.read(spark)) == [(1, 1, "a"), (2, 1, "b")]
    table.apply(batch, 1)  # the same batch again
    assert rows(table.read(spark)) == [(1, 9, "new"), (2, 1, "b"), (5, 1, "e")]


def test_stream(spark, table, tmp_path):
    source = str(tmp_path / "in")
    frame(spark, [(i % 7, i, f"v{i}") for i in range(50)]).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = table.start(stream, str(tmp_path / "check"))
    q.awaitTermination(120)
    want = [(k, max(i for i in range(50) if i % 7 == k), f"v{max(i for i in range(50) if i % 7 == k)}") for k in range(7)]
    assert rows(table.read(spark)) == want and len(table.committed(spark)) == 3
    again = table.start(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), str(tmp_path / "other"))  # as if the checkpoint were lost
    again.awaitTermination(120)
    assert rows(table.read(spark)) == want


def test_feed_reloads_what_has_changed(spark, table, tmp_path):
    from seasonforge.streaming import feed

    table.apply(frame(spark, [(1, 1, "a"), (2, 1, "b"), (3, 1, "c")]), 0)
    source, seen = str(tmp_path / "feed"), []
    frame(spark, [(1, 7, None), (1, 8, None), (None, 9, None), (3, 9, None)]).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = feed.follow(stream, "k", lambda: table.read(spark), lambda d, n: seen.append((n, rows(d))), str(tmp_path / "c"), every=None)
    q.awaitTermination(120)
    assert seen == [(0, [(1, 1, "a"), (3, 1, "c")])]
    table.apply(frame(spark, [(1, 2, "A")]), 1)
    assert rows(feed.reload(frame(spark, [(1, 0, None)]), "k", table.read(spark))) == [(1, 2, "A")]


def test_vacuum_keeps_what_readers_see(spark, table):
    for n in range(8):
        table.apply(frame(spark, [(n % 3, n, f"v{n}"), (100 + n, n, "own")]), n)
    want = rows(table.read(spark))
    behind = rows(table.read(spark, before=6))
    assert table.vacuum(spark, keep=3) > 0
    assert rows(table.read(spark)) == want and rows(table.read(spark, before=6)) == behind
    assert table.vacuum(spark, keep=3) == 0
    table.apply(frame(spark, [(0, 99, "last")]), 8)
    assert (0, 99, "last") in rows(table.read(spark)) and len(rows(table.read(spark))) == len(want)
    assert UpsertTable(table.path + "-none", ("k",), "at", SCHEMA).vacuum(spark) == 0
