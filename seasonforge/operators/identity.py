"""Identities: crosswalks, corrections, names, slugs, patches of rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import normal_name, slug


def fill_from(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base values, and where they are null those of ``other``; its first row of a key by value counts."""
    one = other.groupBy(key).agg(F.min(F.struct(*columns)).alias("_o"))
    d = base.join(one, key, "left")
    return d.select(*[F.coalesce(c, f"_o.{c}").alias(c) if c in columns else F.col(c) for c in base.columns])


def correct(base: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Cells replaced by ``corrections(key, field, new_value, line)``: the last line of a field wins; values that don't cast are null."""
    fields = [c for c in base.columns if c != key]
    last = corrections.where(F.col("field").isin(*fields)).groupBy(key).pivot("field", fields).agg(F.max(F.struct("line", "new_value")))
    last = last.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    kinds = dict(base.dtypes)
    new = lambda c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.new_value").try_cast(kinds[c])).otherwise(F.col(c)).alias(c)
    return base.join(last, key, "left").select(key, *[new(c) for c in fields])


def unique_slugs(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``slug`` by name; where several share it, with the last four characters of the key, then the first four too."""
    text = F.col(key).cast("string")
    d = rows.withColumn("_s", slug(name))
    many = F.count("*").over(Window.partitionBy("_s")) > 1
    d = d.withColumn("_t", F.when(many, F.concat_ws("-", "_s", F.right(text, F.lit(4)))).otherwise(F.col("_s")))
    again = F.count("*").over(Window.partitionBy("_t")) > 1
    return d.withColumn("slug", F.when(again, F.concat_ws("-", "_t", F.substring(text, 1, 4))).otherwise(F.col("_t"))).drop("_s", "_t")


def name_index(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Names (with further columns) that belong to one key only."""
    return rows.groupBy(*by).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).where("_lo = _hi").select(*by, F.col("_lo").alias(key))


def attach_by_name(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows with the key found by normalised name and position, else by a name unique over positions.  No row is dropped."""
    d = dimension.withColumn("_n", normal_name("name"))
    exact = name_index(d, key, ["_n", "position"]).withColumnRenamed(key, "_exact")
    loose = name_index(d, key, ["_n"]).withColumnRenamed(key, "_loose")
    out = rows.withColumn("_n", normal_name("name")).join(exact, ["_n", "position"], "left").join(loose, "_n", "left")
    return out.withColumn(key, F.coalesce("_exact", "_loose")).drop("_n", "_exact", "_loose")


def upsert(base: DataFrame, patch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``base`` without a patch, and the last patch of each key."""
    rest = [c for c in patch.columns if c not in keys]
    last = patch.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_p")).select(*keys, *[F.col(f"_p.{c}").alias(c) for c in rest])
    return base.join(last, keys, "left_anti").unionByName(last, allowMissingColumns=True)


def patched(rows: DataFrame, patch: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Columns of ``rows`` replaced by columns of ``patch`` where those are present."""
    p = patch.select(F.col(key), *[F.col(v).alias(f"_{k}") for k, v in columns.items()])
    d = rows.join(p, key, "left")
    return d.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def unknown(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Keys that the dimension does not have, with their number of rows."""
    return rows.join(dimension, key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def override(rows: DataFrame, overrides: DataFrame, key: str, stat: str) -> DataFrame:
    """A statistic after all overrides of its player in order of lines: each sets it or multiplies it.

    ``overrides(key, line, set_to, multiplier)``; the list of one player is folded in line order.
    """
    steps = overrides.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line", "set_to", "multiplier"))).alias("_s"))
    d = rows.join(steps, key, "left")
    new = F.aggregate(F.coalesce("_s", F.array().cast("array<struct<line:long,set_to:double,multiplier:double>>")), F.col(stat).cast("double"), lambda x, o: F.coalesce(o["set_to"], x * F.coalesce(o["multiplier"], F.lit(1.0))))
    return d.withColumn(stat, new).withColumn("overridden", F.col("_s").isNotNull()).drop("_s")
