"""The player dimension: records that share foreign ids, names resolved in steps, and a report of what is doubtful."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normal_name, short_name
from .identity import correct, fill_from, unique_slugs
from .lineage import discard, written
from .ranks import matched
from .windows import most_complete

#: Values of a foreign id that stand for none.
NO_ID = ("", "0", "NA", "None", "null")


def shared_keys(members: DataFrame) -> DataFrame:
    """``node, group`` of ``members(node, key)``: the smallest node reachable through shared keys.

    Each round gives a key the smallest group of its nodes, a node the smallest of its keys, and then the
    group of its group, so that long chains take few rounds.  Lineage is cut each round.
    """
    links = written(members.where("node is not null and key is not null").distinct())
    of = written(links.groupBy("node").agg(F.min("node").alias("group")))
    while True:
        low = links.join(of, "node").groupBy("key").agg(F.min("group").alias("low"))
        near = links.join(low, "key").groupBy("node").agg(F.min("low").alias("group"))
        step = written(near)
        far = step.select(F.col("node").alias("group"), F.col("group").alias("_next"))
        new = written(step.join(far, "group").select("node", F.least("group", "_next").alias("group")))
        moved = not new.join(of.withColumnRenamed("group", "_old"), "node").where("group <> _old").isEmpty()
        discard(step)
        discard(of)
        of = new
        if not moved:
            discard(links)
            return of


def identity_groups(records: DataFrame, record: str, canonical: str, foreign: list[str]) -> DataFrame:
    """Each record with its group and what the group says of its player.

    Records that share a canonical or a foreign id of one kind are of one group.  Adds ``group`` (its smallest
    record), ``group_size``, ``canonical_ids`` (how many), ``clashing`` (kinds of ids with several values in the
    group, in order), ``status``: resolved (one canonical id), conflict (several), unknown (none), and
    ``resolved_id``: the one.  Empty and placeholder ids link nothing; a record without ids is alone.
    """
    kinds = [canonical, *foreign]
    clean = lambda c: F.when(~F.trim(F.col(c).cast("string")).isin(*NO_ID), F.trim(F.col(c).cast("string")))
    d = records.withColumns({f"_i_{c}": clean(c) for c in kinds})
    keys = F.array(F.concat(F.lit("record="), F.col(record).cast("string")), *[F.concat(F.lit(f"{c}="), f"_i_{c}") for c in kinds])
    of = shared_keys(d.select(F.col(record).alias("node"), F.explode(F.array_compact(keys)).alias("key")))
    d = d.join(of.withColumnRenamed("node", record), record)
    several = [F.when(F.min(f"_i_{c}") != F.max(f"_i_{c}"), F.lit(c)) for c in kinds]
    one = F.min(f"_i_{canonical}")
    facts = d.groupBy("group").agg(
        F.count("*").alias("group_size"), F.count_distinct(f"_i_{canonical}").alias("canonical_ids"), F.array_join(F.array_compact(F.array(*several)), ",").alias("clashing"), one.alias("_one")
    )
    status = F.when(F.col("canonical_ids") == 1, "resolved").when(F.col("canonical_ids") > 1, "conflict").otherwise("unknown")
    out = d.join(facts, "group").withColumns({"status": status, "resolved_id": F.when(F.col("canonical_ids") == 1, F.col("_one"))})
    return out.select(*records.columns, "group", "group_size", "canonical_ids", "clashing", "status", "resolved_id")


def resolve_names(rows: DataFrame, dimension: DataFrame, key: str = "player_id") -> DataFrame:
    """Rows (``name, position, team``) with the id of the player meant, the step that found it, and the reason.

    A row with a position is found by name and position alone (step 1).  Without one, by a name that one
    player has over all positions (step 2), else among players of the name by the team they were last at (step
    3).  Names and positions that several players share are never used; a row that is not found keeps a null
    id, the last step tried, and why.  ``dimension``: key, ``name, position, team``.  No row is dropped or doubled.
    """
    dim = dimension.where("position is not null").select(normal_name("name").alias("_n"), F.col("position").alias("_p"), F.col("team").alias("_team"), F.col(key).alias("_id"))
    pairs = dim.groupBy("_n", "_p").agg(F.count("*").alias("_many"), F.min("_id").alias("_id"), F.min("_team").alias("_team"))
    index = pairs.where("_many = 1")
    names = index.groupBy("_n").agg(F.count_distinct("_id").alias("_ids"), F.min("_id").alias("_loose"))
    teams = index.where("_team is not null").groupBy("_n", F.col("_team").alias("team")).agg(F.count_distinct("_id").alias("_at"), F.min("_id").alias("_there"))
    d = rows.withColumn("_n", F.nullif(normal_name("name"), F.lit("")))
    d = matched(d, pairs.select("_n", F.col("_p").alias("position"), "_many", F.col("_id").alias("_exact")), ["_n", "position"])
    d = d.join(names, "_n", "left").join(teams, ["_n", "team"], "left")
    named, placed = F.col("_n").isNotNull(), F.col("position").isNotNull()
    count = F.coalesce(F.col("_ids"), F.lit(0))
    step = F.when(~named, 0).when(placed, 1).when(count <= 1, 2).otherwise(3)
    found = F.when(step == 1, F.when(F.col("_many") == 1, F.col("_exact"))).when(step == 2, F.col("_loose")).when(step == 3, F.when(F.col("_at") == 1, F.col("_there")))
    reason = (
        F.when(step == 0, "no name")
        .when(step == 1, F.when(F.col("_many") == 1, "name and position").when(F.col("_many") > 1, "several of this name and position").otherwise("no such name and position"))
        .when(step == 2, F.when(count == 1, "only one of this name").otherwise("no such name"))
        .otherwise(F.when(F.col("_at") == 1, "team").otherwise("several of this name"))
    )
    return d.withColumns({key: found, "step": step, "reason": reason}).select(*[c for c in rows.columns if c != key], key, "step", "reason")


def build_dimension(players: DataFrame, crosswalk: DataFrame | None = None, corrections: DataFrame | None = None, columns: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per player: ``player_id, name``, wanted columns, ``name_key, slug, short_name``.

    ``columns``: name -> candidates, of which the first that is there counts, null if none is.  Of several
    rows of an id the one with the most values stays.  Missing ids come from the crosswalk, then cells are
    corrected, then slugs made unique.
    """
    have = set(players.columns)
    pick = lambda names: next((F.col(c) for c in names if c in have), F.lit(None).cast("string"))
    wanted = {"player_id": ("player_id", "gsis_id"), "name": ("name", "display_name", "full_name")} | (columns or {})
    d = players.select(*[pick(c).alias(n) for n, c in wanted.items()]).withColumn("player_id", F.col("player_id").cast("string"))
    d = most_complete(d.where(F.trim("player_id") != ""), ["player_id"], "name")
    if crosswalk is not None:
        d = fill_from(d, crosswalk.withColumn("player_id", F.col("player_id").cast("string")), "player_id", [c for c in crosswalk.columns if c != "player_id"])
    if corrections is not None:
        d = correct(d, corrections, "player_id")
    return unique_slugs(d.withColumn("name_key", normal_name("name")), "player_id", "name").withColumn("short_name", short_name("name"))


def issues(players: DataFrame, dimension: DataFrame, corrections: DataFrame | None = None, groups: DataFrame | None = None, resolved: DataFrame | None = None) -> DataFrame:
    """``issue_type, severity, identifier, name, n`` of what a dimension leaves doubtful.

    Ids of several rows (warning), names that players of one position share (info), corrections of unknown
    fields or without an id (warning), groups with several canonical ids (error), and names that were not
    resolved, with the reason as the name (info).
    """

    def found(d: DataFrame, kind: str, severity: str, identifier: Column, name: Column, n: Column) -> DataFrame:
        return d.select(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), identifier.cast("string").alias("identifier"), name.alias("name"), n.cast("long").alias("n"))

    none = F.lit("")
    twice = players.where(F.trim(F.col("player_id").cast("string")) != "").groupBy("player_id").agg(F.count("*").alias("n")).where("n > 1")
    shared = dimension.where("position is not null").groupBy("name_key", "position").agg(F.count("*").alias("n"), F.min("player_id").alias("first")).where("n > 1")
    out = found(twice, "duplicate_id", "warning", F.col("player_id"), none, F.col("n"))
    out = out.unionByName(found(shared, "ambiguous_name", "info", F.col("first"), F.concat_ws(" ", "name_key", F.concat(F.lit("("), "position", F.lit(")"))), F.col("n")))
    if corrections is not None:
        fields = [c for c in dimension.columns if c != "player_id"]
        bad = corrections.where(~F.coalesce(F.col("field").isin(*fields), F.lit(False)) | (F.coalesce(F.trim(F.col("player_id").cast("string")), none) == ""))
        out = out.unionByName(found(bad.groupBy("player_id", "field").agg(F.count("*").alias("n")), "invalid_correction", "warning", F.coalesce(F.col("player_id").cast("string"), none), F.coalesce(F.col("field"), none), F.col("n")))
    if groups is not None:
        clash = groups.where("status = 'conflict'").groupBy("group").agg(F.max("canonical_ids").alias("n"), F.max("clashing").alias("clashing"))
        out = out.unionByName(found(clash, "conflicting_ids", "error", F.col("group"), F.col("clashing"), F.col("n")))
    if resolved is not None:
        lost = resolved.where("player_id is null").groupBy("name", "reason").agg(F.count("*").alias("n"))
        out = out.unionByName(found(lost, "unresolved_name", "info", F.coalesce(F.col("name"), none), F.col("reason"), F.col("n")))
    return out
