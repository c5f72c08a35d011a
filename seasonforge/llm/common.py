"""Helpers shared by the training-data operators: cutting lineage, components, linking groups."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only in local mode, where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path or _own_dir()


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="seasonforge-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Deletes the table behind a frame returned by ``cut`` once nothing reads it any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's context cleaner remove the shuffle files of finished jobs; it takes two collections."""
    for pause in (0.4, 0.2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(pause)


def connected_components(edges: DataFrame) -> DataFrame:
    """Nodes of ``edges(a long, b long)`` with the smallest node they reach: ``node, component``.

    Alternating large-star and small-star steps.  The smallest neighbour of each node is aggregated into a
    table of its own before edges meet it: the join's sides are then plain shuffles, of which Spark's skew
    join splits a hub's edges over tasks.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v").where("u <> v").distinct()
        )
        new = cut(small)
        drop_cut(e)
        drop_cut(low)
        e = new
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


#: Largest group whose remaining pairs are tested as rows, and rows of a block in larger groups.
SMALL_GROUP, BLOCK = 48, 512

Match = Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray]]


def link_groups(members: DataFrame, items: Callable[[DataFrame], DataFrame], test: Callable[[Column, Column], Column], match: Match) -> DataFrame:
    """Components of the ids that share a key and pass the test: ``node, component``.

    ``members(key long, id long)``; ``items`` gives ``id, item`` for the distinct ids it gets; ``test`` is
    the link test on two items, ``match`` the same test on two Arrow arrays of items, giving the places of
    the pairs that pass.

    Aggregates of keys and groups are tables of their own before rows meet them, so that Spark's skew join
    splits the rows of a large one.  A group (ids connected by keys) of n is not expanded into its n * n
    pairs.  The ids of a key are tested against the key's smallest id, then all of a group against its
    best-linked id.  Whatever is then not in the group's largest component is compared with the whole
    group: as pairs of rows sharing a key in small groups, in blocks that emit one link for each component
    in larger ones.
    """
    spark = members.sparkSession
    groups = cut(members.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("z")).where("c <> z").drop("z"))
    release(spark)
    star = cut(members.join(groups, "key"))
    drop_cut(groups)
    release(spark)
    pairs = cut(star.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct())
    item = cut(items(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))

    def passing(p: DataFrame) -> DataFrame:
        p = p.join(item.select(F.col("id").alias("a"), F.col("item").alias("_x")), "a").join(item.select(F.col("id").alias("b"), F.col("item").alias("_y")), "b")
        return cut(p.where(test(F.col("_x"), F.col("_y"))).select("a", "b"))

    links = passing(pairs)
    group = cut(connected_components(pairs).toDF("id", "g"))
    of = cut(_placed(group, links))
    hubs = cut(of.groupBy("g").agg(F.max(F.struct("deg", (-F.col("id")).alias("neg"), "comp")).alias("h"), F.count("*").alias("size")))
    more = of.join(hubs.where("size > 2"), "g").where("comp <> h.comp").select(F.least("id", -F.col("h.neg")).alias("a"), F.greatest("id", -F.col("h.neg")).alias("b"))
    more = passing(more.join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        links = links.unionByName(more)
        of = cut(_placed(group, links))
    comps = of.groupBy("g", "comp").agg(F.count("*").alias("n"))
    main = comps.groupBy("g").agg(F.max_by("comp", F.struct("n", (-F.col("comp")).alias("x"))).alias("main"), F.sum("n").alias("size"), (F.sum("n") - F.max("n")).alias("others"))
    main = cut(main)
    rest = cut(of.join(main.where("others > 0 and size > 2"), "g"))

    small = rest.where(F.col("size") <= SMALL_GROUP).select("id", "comp").join(star.select("key", "id"), "id")
    x, y = small.select("key", F.col("id").alias("a"), F.col("comp").alias("ca")), small.select("key", F.col("id").alias("b"), F.col("comp").alias("cb"))
    few = x.join(y, "key").where("a < b and ca <> cb").select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti")
    links = links.unionByName(passing(few))

    large = rest.where(F.col("size") > SMALL_GROUP).join(item, "id")
    homes, guests = F.ceil(F.col("others") / BLOCK).cast("long"), F.ceil(F.col("size") / BLOCK).cast("long")
    left = large.where("comp <> main").withColumn("h", F.pmod(F.xxhash64("id"), homes)).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), guests - 1)))
    right = large.withColumn("k", F.pmod(F.xxhash64("id"), guests)).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), homes - 1)))
    keys = ["g", "h", "k"]
    left, right = (side.select(*[F.col(c).alias(c) for c in (*keys, "id", "comp", "item")]) for side in (left, right))

    def compare(t: pa.Table, o: pa.Table) -> pa.Table:
        if not t.num_rows or not o.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        i, j = match(t["item"].combine_chunks(), o["item"].combine_chunks())
        found = np.stack([t["comp"].to_numpy()[i], o["comp"].to_numpy()[j]], axis=1)
        found = np.unique(np.sort(found[found[:, 0] != found[:, 1]], axis=1), axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    links = links.unionByName(cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long")))
    out = connected_components(links)
    for done in (star, pairs, item, group, hubs, main, rest):
        drop_cut(done)
    return out


def _placed(group: DataFrame, links: DataFrame) -> DataFrame:
    """``id, g, comp, deg``: each id with its group, its component under ``links`` and its number of links."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    comp = connected_components(links).withColumnRenamed("node", "id").join(ends, "id")
    return group.join(comp, "id", "left").select("id", "g", F.coalesce("component", "id").alias("comp"), F.coalesce("deg", F.lit(0)).alias("deg"))
