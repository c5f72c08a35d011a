"""Ranks and rank correlations within groups of any size: no task holds a whole group.

Values of a group are dealt to buckets by quantiles of that group, numbered in their bucket, and moved by the
rows of the buckets before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

#: Buckets of a group.
BUCKETS = 64


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A join by keys that may be null; the columns of ``right`` come after those of ``left``."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return (left.join(r, on, how) if keys else left.join(F.broadcast(r), F.lit(True), how)).drop(*[f"_r_{k}" for k in keys])  # without keys: one row or none


def _edges(rows: DataFrame, within: list[str], value: str, buckets: int) -> DataFrame:
    """``within, _edges``: quantiles of each group, ``buckets`` at most: a mergeable aggregate."""
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return rows.groupBy(*within).agg(F.array_distinct(F.percentile_approx(value, at, F.lit(20 * buckets))).alias("_edges"))


def mean_ranks(rows: DataFrame, within: list[str], orders: dict[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """Ranks within groups, the greatest first, ties at their mean, for each named order.

    ``within`` may be empty (the whole table) or hold nulls; a null value has no rank.  Equal values are one
    row while they are counted, so ties of any number fit a task.
    """
    out = rows
    for name, by in orders.items():
        out = out.withColumn("_v", by.cast("double"))
        values = out.where("_v is not null").groupBy(*within, "_v").agg(F.count("*").alias("_n"))
        values = matched(values, _edges(values, within, "_v", buckets), within)
        values = values.withColumn("_b", F.size(F.filter("_edges", lambda e: e > F.col("_v")))).drop("_edges")
        upto = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
        before = values.groupBy(*within, "_b").agg(F.sum("_n").alias("_m")).select(*within, "_b", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_before"))
        own = F.coalesce(F.sum("_n").over(Window.partitionBy(*within, "_b").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = matched(values.withColumn("_own", own), before, [*within, "_b"])
        rank = F.col("_before") + F.col("_own") + (F.col("_n") + 1) / F.lit(2.0)
        out = matched(out, placed.select(*within, "_v", rank.alias(name)), [*within, "_v"]).drop("_v")
    return out


def quantiles(rows: DataFrame, by: list[str], value: Column, at: dict[str, float], linear: bool = True, weight: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``by, n`` and a column for each name of ``at``: exact quantiles of the present values of each group.

    Linear between values, or else the smallest value that so large a share of the rows does not exceed.  Equal
    values are one row; only the buckets in which a quantile lies are sorted, so no task holds a group.
    """
    some = rows.select(*by, value.cast("double").alias("_v"), (F.lit(1) if weight is None else weight).cast("long").alias("_w")).where("_v is not null")
    d = written(some.groupBy(*by, "_v").agg(F.sum("_w").alias("_n")))  # it is read for the edges, for the buckets and for the values
    d = matched(d, _edges(d, by, "_v", buckets), by).withColumn("_b", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    group = Window.partitionBy(*by)  # a row for each bucket
    b = d.groupBy(*by, "_b").agg(F.sum("_n").alias("_m")).withColumns({"_upto": F.sum("_m").over(group.orderBy("_b")), "n": F.sum("_m").over(group)})
    n = F.col("n").cast("double")
    place = {name: (n - 1) * F.lit(float(p)) if linear else F.greatest(F.lit(1.0), n - F.floor(n - n * F.lit(float(p)))) - 1 for name, p in at.items()}
    each = [F.struct(F.lit(name).alias("name"), F.lit(up).alias("up"), ((F.ceil(x) if up else F.floor(x)) + 1).cast("long").alias("rank")) for name, x in place.items() for up in (False, True)]
    b = b.select(*by, "_b", "n", (F.col("_upto") - F.col("_m")).alias("_before"), "_upto", F.explode(F.array(*each)).alias("_place"))
    b = written(b.where((F.col("_place.rank") > F.col("_before")) & (F.col("_place.rank") <= F.col("_upto"))))  # two rows for each group and quantile
    own = F.sum("_n").over(Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = matched(d, b.select(*by, "_b").distinct(), [*by, "_b"], "inner").withColumn("_run", own)
    found = matched(b, near, [*by, "_b"], "inner").where((F.col("_place.rank") - F.col("_before")).between(F.col("_run") - F.col("_n") + 1, F.col("_run")))
    side = lambda name, up: F.max(F.when((F.col("_place.name") == name) & (F.col("_place.up") == up), F.col("_v")))
    out = found.groupBy(*by).agg(F.max("n").alias("n"), *[side(name, up).alias(f"_{name}_{int(up)}") for name in at for up in (False, True)])
    low, high = (lambda name: F.col(f"_{name}_0")), (lambda name: F.col(f"_{name}_1"))
    between = lambda name, x: F.when(low(name) == high(name), low(name)).otherwise((F.ceil(x) - x) * low(name) + (x - F.floor(x)) * high(name))
    return out.select(*by, "n", *[between(name, x).alias(name) for name, x in place.items()])


def first_k(rows: DataFrame, within: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group with their numbers; every task passes on ``k`` rows of a group at most."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order))).where(F.col(name) <= k)


def signed_pairs(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Weighted concordant minus discordant pairs of two columns, by counting inversions."""
    return _inversions(a, -b, w) - _inversions(a, b, w)


def _inversions(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """Weight of the pairs with a smaller ``a`` and a greater ``b``: a merge count, a level of blocks at a time."""
    order = np.lexsort((b, a))
    rank, w = np.unique(b[order], return_inverse=True)[1].astype(np.int64), w[order].astype(float)
    at, wide, total, half = np.arange(len(w)), int(len(w)) + 1, 0.0, 1
    while half < len(w):
        block, right = at // (2 * half), at // half % 2 == 1
        left_keys, left_w = (block * wide + rank)[~right], w[~right]
        s = np.argsort(left_keys, kind="stable")
        left_keys, upto = left_keys[s], np.concatenate([[0.0], np.cumsum(left_w[s])])
        end = np.searchsorted(left_keys, (block[right] + 1) * wide)
        total += float(w[right] @ (upto[end] - upto[np.searchsorted(left_keys, (block * wide + rank)[right], side="right")]))
        half *= 2
    return total


def kendall(rows: DataFrame, within: list[str], x: str, y: str, buckets: int = BUCKETS) -> DataFrame:
    """Kendall's tau-b within groups: ``within, n, kendall`` (null where a column has one value only).

    Values are dealt to buckets, those that are common to buckets of their own.  Pairs of different buckets
    of both columns are counted from the table of buckets, pairs of one bucket in that bucket by inversions.
    """
    if not within:
        return kendall(rows.withColumn("_whole", F.lit(0)), ["_whole"], x, y, buckets).drop("_whole")
    d = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*within, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_w"))
    d = written(d)  # it is read for the edges of both columns, and to be dealt
    for v in ("x", "y"):  # between two edges: an even number; at an edge: an odd one
        d = matched(d, _edges(d, within, f"_{v}", buckets).withColumnRenamed("_edges", "_e"), within)
        d = d.withColumn(f"_{v}b", 2 * F.size(F.filter("_e", lambda e: e < F.col(f"_{v}"))) + F.array_contains("_e", F.col(f"_{v}")).cast("int")).drop("_e")  # noqa: B023
    d = written(d)  # it is read five times
    kinds = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in within) + ", _s double"

    def scored(a: str, b: str):
        def run(t: pa.Table) -> pa.Table:
            s = signed_pairs(t[a].to_numpy(), t[b].to_numpy(), t["_w"].to_numpy())
            return pa.table([*[t[c].slice(0, 1).combine_chunks() for c in within], pa.array([s])], [*within, "_s"])

        return run

    def cells(t: pa.Table) -> pa.Table:
        """Pairs of different buckets in both columns, of a table of 2 * BUCKETS by 2 * BUCKETS at most."""
        g = np.zeros((2 * buckets + 2, 2 * buckets + 2))
        np.add.at(g, (t["_xb"].to_numpy(), t["_yb"].to_numpy()), t["_w"].to_numpy())
        below = np.cumsum(g, axis=0) - g
        less, upto = np.cumsum(below, axis=1) - below, np.cumsum(below, axis=1)
        s = float((g * (less - (below.sum(axis=1, keepdims=True) - upto))).sum())
        return pa.table([*[t[c].slice(0, 1).combine_chunks() for c in within], pa.array([s])], [*within, "_s"])

    far = d.groupBy(*within, "_xb", "_yb").agg(F.sum("_w").alias("_w")).groupBy(*within).applyInArrow(cells, kinds)
    same_x = d.where("_xb % 2 = 0").groupBy(*within, "_xb").applyInArrow(scored("_x", "_y"), kinds)
    same_y = d.where("_yb % 2 = 0").groupBy(*within, "_yb", "_xb", "_y").agg(F.sum("_w").alias("_w")).groupBy(*within, "_yb").applyInArrow(scored("_xb", "_y"), kinds)
    s = far.unionByName(same_x).unionByName(same_y).groupBy(*within).agg(F.sum("_s").alias("_s"))
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    tied = [d.groupBy(*within, v).agg(F.sum("_w").alias("_t")).groupBy(*within).agg(pairs("_t").alias(f"_t{v}"), F.sum("_t").alias("n")) for v in ("_x", "_y")]
    out = matched(matched(tied[0], tied[1].drop("n"), within), s, within)
    whole = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return out.select(*within, "n", F.try_divide(F.col("_s"), F.sqrt((whole - F.col("_t_x")) * (whole - F.col("_t_y")))).alias("kendall"))


def rank_metrics(rows: DataFrame, by: list[str], predicted: str = "predicted", actual: str = "actual", key: str = "player_id", tops: tuple[int, ...] = (12, 24, 50, 100), starters: int | None = None, buckets: int = BUCKETS, with_kendall: bool = True, least: int = 3, whole: bool = True) -> DataFrame:
    """``by, n, spearman, kendall, mean_rank_error, median_rank_error, top*, starter_precision, starter_recall`` of groups.

    Rows without either value are left out; a group of less than ``least`` has its ``n`` only.  Correlations are
    null where a column has one value.  ``top k`` is the share of the actual first k that are predicted first
    k, null in smaller groups (if ``whole``); ties go to the smaller ``key``.  Precision and recall take the first
    ``starters``.  The median of rank errors is from a quantile sketch, exact in groups under 10,000 rows.
    """
    nan = F.isnan(F.col(predicted).cast("double")) | F.isnan(F.col(actual).cast("double"))
    d = written(rows.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull() & ~nan).select(*by, key, F.col(predicted).alias("_p"), F.col(actual).alias("_a")))  # it is read several times
    r = mean_ranks(d, by, {"_pr": F.col("_p"), "_ar": F.col("_a")}, buckets)
    err = F.abs(F.col("_pr") - F.col("_ar"))
    rho = F.try_divide(F.covar_pop("_pr", "_ar"), F.stddev_pop("_pr") * F.stddev_pop("_ar"))
    out = r.groupBy(*by).agg(F.count("*").alias("n"), rho.alias("spearman"), F.avg(err).alias("mean_rank_error"), F.percentile_approx(err, 0.5, F.lit(10_000)).alias("median_rank_error"))
    out = matched(out, kendall(d, by, "_p", "_a", buckets).drop("n"), by) if with_kendall else out.withColumn("kendall", F.lit(None).cast("double"))
    sizes = [*tops, *([starters] if starters else [])]
    if sizes:
        first = [first_k(d, by, [F.col(v).desc(), F.col(key)], max(sizes), n).select(*by, key, n) for v, n in (("_p", "_pi"), ("_a", "_ai"))]
        both = matched(*first, [*by, key], "inner")
        hits = both.groupBy(*by).agg(*[F.count_if((F.col("_pi") <= k) & (F.col("_ai") <= k)).alias(f"_h{k}") for k in dict.fromkeys(sizes)])
        out = matched(out, hits, by)
    share = lambda k: F.when((F.col("n") >= k) | ~F.lit(whole), F.coalesce(F.col(f"_h{k}"), F.lit(0)) / F.lit(float(k)))
    new = {f"top{k}": share(k) for k in tops} | {f"starter_{m}": share(starters) if starters else F.lit(None).cast("double") for m in ("precision", "recall")}
    few = lambda c: F.when(F.col("n") >= least, c)
    return out.select(*by, "n", *[few(F.col(c)).alias(c) for c in ("spearman", "kendall", "mean_rank_error", "median_rank_error")], *[few(c).alias(n) for n, c in new.items()])


def correlations(rows: DataFrame, features: list[str], target: str, least: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """``feature, n, pearson, spearman`` with the target over rows that have both; null under ``least`` rows or without variance.

    All features at once: a row for each feature and value, ranked within the feature.
    """
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return paired_correlations(rows.select(F.explode(each).alias("_f"), F.col(target).cast("double").alias("y")).select("_f.feature", "_f.x", "y"), ["feature"], least, buckets)


def paired_correlations(rows: DataFrame, by: list[str], least: int = 30, buckets: int = BUCKETS) -> DataFrame:
    """``by, n, pearson, spearman`` of the columns x and y, over rows that have both; null under ``least`` rows or without variance."""
    d = rows.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    r = mean_ranks(d, by, {"_rx": F.col("x"), "_ry": F.col("y")}, buckets)
    enough = (F.count("*") >= least) & (F.stddev_pop("x") >= 1e-12) & (F.stddev_pop("y") >= 1e-12)
    corr = lambda a, b: F.when(enough, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
    return r.groupBy(*by).agg(F.count("*").alias("n"), corr("x", "y").alias("pearson"), corr("_rx", "_ry").alias("spearman"))
