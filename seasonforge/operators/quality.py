"""Checks: each gives one row of findings ``check, passed, count``; several share one pass over the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .aggregates import pearson


def _findings(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """Counts of offending rows, all from one aggregate."""
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()])
    long = one.unpivot([], list(counts), "check", "count")
    return long.select("check", (F.col("count") == 0).alias("passed"), "count")


def row_checks(rows: DataFrame, bounds: dict[str, tuple[float, float]], ratios: list[tuple[str, str]], required: list[str], ages: str | None = None) -> DataFrame:
    """Nulls in required columns, values out of bounds, parts over their whole, numbers that are not finite or negative, ages off 18 to 50."""
    numbers = [f.name for f in rows.schema if isinstance(f.dataType, T.NumericType)]
    floats = [f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    counts = {f"no_nulls_{c}": F.count_if(F.col(c).isNull()) for c in required}
    counts |= {f"bounds_{c}": F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in bounds.items()}
    counts |= {f"ratio_{a}_{b}": F.count_if(F.col(a) > F.col(b) + 1e-6) for a, b in ratios}
    counts |= {f"negative_{c}": F.count_if(F.col(c) < 0) for c in numbers}
    counts |= {f"finite_{c}": F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))) for c in floats}
    if ages:
        counts["ages"] = F.count_if((F.col(ages) < 18) | (F.col(ages) > 50))
    return _findings(rows, counts)


def unique_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("count"))
    return n.select(F.lit("unique_" + "_".join(keys)).alias("check"), (F.col("count") == 0).alias("passed"), "count")


def not_empty(rows: DataFrame) -> DataFrame:
    """One finding if there are no rows; a single row is looked for."""
    some = rows.limit(1).agg(F.count("*").alias("n"))
    return some.select(F.lit("not_empty").alias("check"), (F.col("n") > 0).alias("passed"), (1 - F.col("n")).alias("count"))


def known_values(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Values that are not among the known ones; null is not flagged."""
    return _findings(rows, {f"known_{column}": F.count_if(~F.col(column).isin(*values))})


def contract(rows: DataFrame, rank: str, ids: list[str], descending: str) -> DataFrame:
    """Output contract: ranks from 1 without holes, unique ids, a value that does not rise with the rank.

    Holes and rises are found by joining each rank with the one before, not by a window over the table.
    """
    before = rows.select((F.col(rank) + 1).alias(rank), F.col(descending).alias("_before"))
    d = rows.join(before, rank, "left")
    counts = {"dense_ranks": F.count_if((F.col(rank) > 1) & F.col("_before").isNull() | (F.col(rank) < 1)), f"falling_{descending}": F.count_if(F.col(descending) > F.col("_before"))}
    return report(_findings(d, counts), *[unique_key(rows, [i]) for i in ids])


def required_columns(rows: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n not in rows.columns]


def within_schedule(rows: DataFrame, games: DataFrame) -> DataFrame:
    """More games than the season had."""
    bad = rows.join(games.withColumnRenamed("games", "_most"), "season").where(F.col("games") > F.col("_most"))
    return bad.agg(F.count("*").alias("count")).select(F.lit("games_within_schedule").alias("check"), (F.col("count") == 0).alias("passed"), "count")


def leakage(pairs: DataFrame, features: list[str], outcomes: list[str]) -> DataFrame:
    """Season order, season gaps, copies of the target (|r| of 0.999), running values under the value itself."""
    counts = {"season_before_target": F.count_if(F.col("season") >= F.col("target_season")), "one_season_ahead": F.count_if(F.col("target_season") - F.col("season") > 3)}
    counts |= {f"copy_{f}_{o}": F.when(F.abs(pearson(f, o)) >= 0.999, 1).otherwise(0) for f in features for o in outcomes}
    counts |= {f"backward_{f}": F.count_if(F.col(f) > F.col(f"career_{f}") + 1e-6) for f in features if f"career_{f}" in pairs.columns}
    return _findings(pairs, counts)


def forbidden_names(columns: list[str], prefixes: tuple[str, ...] = ("outcome_", "target_played")) -> list[str]:
    return [c for c in columns if c.startswith(prefixes)]


def fold_overlap(train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on both sides of a split."""
    n = train.select(*keys).distinct().join(test.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("count"))
    return n.select(F.lit("fold_overlap").alias("check"), (F.col("count") == 0).alias("passed"), "count")


def report(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def content_hash(rows: DataFrame) -> DataFrame:
    """Order-free hash of a table: count, xor and sum of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    return rows.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("sum"))
