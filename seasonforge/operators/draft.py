"""Draft order, rosters, automatic picks, auctions."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import mixed_unit

# Positions that a slot accepts beside its own; a bench takes all.
ACCEPTS = {"FLEX": ("RB", "WR", "TE"), "SUPERFLEX": ("QB", "RB", "WR", "TE"), "IDP_FLEX": ("DL", "LB", "DB")}


def accepts(position: str, slot: str) -> bool:
    return slot in ("BENCH", position) or position in ACCEPTS.get(slot, ())


def slot_of_pick(pick: Column, teams: int, kind: str = "snake", third_reversed: bool = False) -> Column:
    """Slot on the clock at a pick (from 1), in closed form."""
    zero = (pick - 1).cast("long")
    round_, place = F.floor(zero / teams) + 1, F.pmod(zero, F.lit(teams).cast("long")) + 1
    if kind == "linear":
        return place
    back = F.pmod(round_, F.lit(2).cast("long")) == 0
    if third_reversed:
        back = (round_ == 2) | (round_ == 3) | ((round_ > 3) & (F.pmod(round_, F.lit(2).cast("long")) == 1))
    return F.when(back, F.lit(teams) + 1 - place).otherwise(place)


def placed_picks(picks: DataFrame, teams: int, kind: str = "snake", third_reversed: bool = False) -> DataFrame:
    """Picks (``pick``, from 1) with ``round, pick_in_round, slot``."""
    zero = (F.col("pick") - 1).cast("long")
    return picks.select("*", (F.floor(zero / teams) + 1).alias("round"), (F.pmod(zero, F.lit(teams).cast("long")) + 1).alias("pick_in_round"), slot_of_pick(F.col("pick"), teams, kind, third_reversed).alias("slot"))


def draft_order(spark: SparkSession, teams: int, rounds: int, kind: str = "snake", third_reversed: bool = False) -> DataFrame:
    """All picks of a draft."""
    return placed_picks(spark.range(1, teams * rounds + 1).withColumnRenamed("id", "pick"), teams, kind, third_reversed)


@lru_cache(maxsize=65_536)
def fits(positions: tuple[str, ...], slots: tuple[str, ...]) -> bool:
    """Whether all positions find a slot: by augmenting paths."""
    of: dict[int, int] = {}

    def place(i: int, tried: set[int]) -> bool:
        for j, s in enumerate(slots):
            if j not in tried and accepts(positions[i], s):
                tried.add(j)
                if j not in of or place(of[j], tried):
                    of[j] = i
                    return True
        return False

    return all(place(i, set()) for i in range(len(positions)))


def assign(positions: tuple[str, ...], slots: tuple[str, ...]) -> list[int] | None:
    """A slot for each position: own slots before flexible ones before the bench, most constrained position first."""
    cost = lambda p, s: 0 if s == p else 2 if s == "BENCH" else 1
    order = sorted(range(len(positions)), key=lambda i: (sum(accepts(positions[i], s) for s in slots), i))
    out: dict[int, int] = {}
    for n, i in enumerate(order):
        rest = tuple(positions[k] for k in order[n + 1 :])
        for j in sorted((j for j, s in enumerate(slots) if j not in out.values() and accepts(positions[i], s)), key=lambda j: (cost(positions[i], slots[j]), j)):
            if fits(rest, tuple(s for k, s in enumerate(slots) if k != j and k not in out.values())):
                out[i] = j
                break
        else:
            return None
    return [out[i] for i in range(len(positions))]


def needs(picks: DataFrame, slots: dict[str, int]) -> DataFrame:
    """Direct slots of each roster not yet filled: ``roster, position, need``."""
    all_ = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.lit(n).alias("slots")) for p, n in slots.items()]))
    d = picks.select("roster").distinct().select("roster", all_.alias("s")).select("roster", "s.position", "s.slots")
    have = picks.groupBy("roster", "position").agg(F.count("*").alias("have"))
    return d.join(have, ["roster", "position"], "left").select("roster", "position", F.greatest(F.col("slots") - F.coalesce("have", F.lit(0)), F.lit(0)).alias("need"))


def preset_multiplier(preset: str) -> Column:
    """Worth of a player under a scoring preset: position, and age and rookies in dynasties."""
    p, m = F.col("position"), F.lit(1.0)
    if preset.endswith("standard"):
        m = m * F.when(p.isin("WR", "TE"), 0.9).when(p == "RB", 0.96).otherwise(1.0)
    if preset.endswith("half_ppr"):
        m = m * F.when(p.isin("WR", "TE"), 0.96).otherwise(1.0)
    if preset == "two_qb":
        m = m * F.when(p == "QB", 1.38).otherwise(1.0)
    if preset == "idp":
        m = m * F.when(p.isin("DL", "LB", "DB"), 1.25).otherwise(1.0)
    if preset.startswith("dynasty_"):
        prime = F.when(p == "QB", 28).otherwise(25)
        m = m * F.when(F.col("age") > 0, F.greatest(F.lit(0.72), 1 + (prime - F.col("age")) * 0.028) * F.when(F.col("rookie"), 1.08).otherwise(1.0)).otherwise(1.0)
    return m


def cpu_score(preset: str, seed: int, round_: int, rounds: int, slot: int) -> Column:
    """Score of a free player for an automatic pick; ``need`` and ``quarterbacks`` are columns of the row."""
    noise = mixed_unit(seed, F.concat(F.lit(f"{slot}:{round_}:"), F.col("player_id").cast("string"))) * 13
    late = F.when(F.col("position").isin("K", "DEF"), -120 if round_ < rounds - 2 else 0).otherwise(0)
    two = F.when(F.col("position") == "QB", F.greatest(F.lit(0), 46 - F.col("quarterbacks") * 22)).otherwise(0) if preset == "two_qb" else F.lit(0)
    youth = F.when(F.col("age") > 0, F.greatest(F.lit(-20), (27 - F.col("age")) * 4)).otherwise(0) if preset.startswith("dynasty_") else F.lit(0)
    return F.col("points") * preset_multiplier(preset) - F.col("overall_rank") * 0.24 + F.when(F.col("need") > 0, 24).otherwise(0) + noise + late + two + youth


def best_available(players: DataFrame, taken: DataFrame, queue: DataFrame, score: Column) -> DataFrame:
    """Each roster's automatic pick: the first of its queue that is free, else the best by score.

    ``queue(roster, player_id, place)``; ``players`` has a row for each free choice of a roster.
    """
    free = players.join(taken.select("player_id"), "player_id", "left_anti").join(queue, ["roster", "player_id"], "left")
    w = Window.partitionBy("roster").orderBy(F.col("place").asc_nulls_last(), score.desc(), "player_id")
    return free.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("roster", "player_id")


def max_bid(budget: Column, empty: Column, least: int = 1) -> Column:
    """Budget less the least bid for each other empty slot."""
    return F.when(empty > 0, F.greatest(budget - (empty - 1) * least, F.lit(0))).otherwise(0)


def bid_valid(bid: Column, current: Column, budget: Column, empty: Column, least: int = 1) -> Column:
    return (bid >= F.coalesce(current + 1, F.lit(least))) & (bid <= max_bid(budget, empty, least))


def valid_settings(rows: DataFrame) -> DataFrame:
    """Even teams from 4 to 22, rounds as roster slots, third-round reversal in snake drafts only."""
    ok = (F.col("teams").between(4, 22)) & (F.col("teams") % 2 == 0) & (F.col("rounds") == F.col("slots")) & (~F.col("third_reversed") | (F.col("kind") == "snake"))
    return rows.withColumn("valid", ok)
