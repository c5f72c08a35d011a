"""Roster feasibility by Hall's condition: an aggregate over the sets of positions instead of a search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .draft import ACCEPTS, accepts

#: Stands for every position that no slot names.
OTHER = "*"


def capacities(spark: SparkSession, slots: list[str]) -> DataFrame:
    """``set, position, capacity``: of each set of positions its members, and the slots that accept any of them.

    Positions that the slots name, by themselves or as part of a flexible slot, and one for all others: 2 to
    their number sets, whatever the rosters.
    """
    names = sorted({p for s in slots for p in ACCEPTS.get(s, () if s == "BENCH" else (s,))}) + [OTHER]
    d = spark.range(1, 1 << len(names)).withColumnRenamed("id", "set")
    took = [(1 << i, p) for i, p in enumerate(names)]
    open_ = F.lit(0)
    for s in slots:
        mask = sum(bit for bit, p in took if accepts(p, s))
        open_ = open_ + F.col("set").bitwiseAND(F.lit(mask)).cast("boolean").cast("int")
    members = F.filter(F.array(*[F.struct(F.lit(bit).cast("long").alias("bit"), F.lit(p).alias("position")) for bit, p in took]), lambda m: F.col("set").bitwiseAND(m["bit"]) > 0)
    return d.select("set", open_.alias("capacity"), F.explode(members).alias("m")).select("set", "m.position", "capacity")


def feasible(counts: DataFrame, by: list[str], slots: list[str]) -> DataFrame:
    """``by, fits`` of ``counts(by, position, n)``: whether the players of each group all find a slot.

    They do if no set of positions has more players than slots that accept any of the set (Hall's condition).
    """
    sets = capacities(counts.sparkSession, slots)
    known = [r.position for r in sets.select("position").distinct().collect()]  # the positions of the slots
    c = counts.withColumn("position", F.when(F.col("position").isin(*known), F.col("position")).otherwise(OTHER)).groupBy(*by, "position").agg(F.sum("n").alias("n"))
    full = c.join(F.broadcast(sets), "position").groupBy(*by, "set", "capacity").agg(F.sum("n").alias("n"))  # 2 to the number of positions sets
    return full.groupBy(*by).agg((F.count_if(F.col("n") > F.col("capacity")) == 0).alias("fits"))


def roster_fits(rosters: DataFrame, slots: list[str]) -> DataFrame:
    """``fits`` for each row's array of positions: each different collection of positions is tested once.

    An empty or null array fits; positions that no slot names need a bench.
    """
    d = rosters.withColumn("_c", F.array_sort(F.coalesce("positions", F.array().cast("array<string>"))))
    kinds = d.select("_c").distinct()
    counts = kinds.select("_c", F.explode("_c").alias("position")).groupBy("_c", "position").agg(F.count("*").alias("n"))
    return d.join(feasible(counts, ["_c"], slots), "_c", "left").withColumn("fits", F.coalesce("fits", F.lit(True))).drop("_c")


def candidate_fits(rosters: DataFrame, candidates: DataFrame, slots: list[str]) -> DataFrame:
    """``roster, position, fits``: whether a roster could take one more player of each position.

    ``rosters(roster, position)`` has a row for each player, ``candidates(roster, position)`` the positions asked for.
    """
    have = rosters.groupBy("roster", "position").agg(F.count("*").alias("n"))
    asked = candidates.distinct().withColumnRenamed("position", "extra")
    own = asked.join(have, "roster").select("roster", "extra", "position", "n")
    plus = own.unionByName(asked.select("roster", "extra", F.col("extra").alias("position"), F.lit(1).cast("long").alias("n")))
    counts = plus.groupBy("roster", "extra", "position").agg(F.sum("n").alias("n"))
    return feasible(counts, ["roster", "extra"], slots).withColumnRenamed("extra", "position")
