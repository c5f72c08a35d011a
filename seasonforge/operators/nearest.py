"""Nearest neighbours within groups by an index of boxes: exact, without comparing all rows of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import safe_ratio
from .lineage import written

#: Rows of a fine box, about; more where they are one point.
FINE = 24
#: Slack of the bounds, over what rounding moves a distance by.
SLACK = 1e-8


def standardised(rows: DataFrame, names: list[str], *frames: DataFrame) -> list[DataFrame]:
    """The frames with ``z0, z1, ..``: named columns less their mean in ``rows``, over their population deviation (0 if null or without spread)."""
    m = F.broadcast(rows.agg(*[F.avg(n).alias(f"_m{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"_s{i}") for i, n in enumerate(names)]))  # one row
    z = {f"z{i}": F.coalesce(safe_ratio(F.col(n) - F.col(f"_m{i}"), F.col(f"_s{i}")), F.lit(0.0)) for i, n in enumerate(names)}
    drop = [f"_{a}{i}" for i in range(len(names)) for a in "ms"]
    return [d.join(m).withColumns(z).drop(*drop) for d in frames]


def _length(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda a, p: a + p * p, parts, F.lit(0.0)))


def distance(x: list[str], y: list[str]) -> Column:
    return _length([F.col(a) - F.col(b) for a, b in zip(x, y, strict=True)])


def first_of_points(rows: DataFrame, group: str, owner: str, season: str, z: list[str], k: int) -> DataFrame:
    """Of rows at one point those that can be among the ``k`` nearest of any query: ``k`` rows of each of its first ``k + 1`` owners."""
    own = rows.withColumn("_i", F.row_number().over(Window.partitionBy(group, *z, owner).orderBy(season))).where(F.col("_i") <= k)
    each = own.groupBy(group, *z, owner).agg(F.collect_list(F.struct(season)).alias("_rows"))  # k at most
    few = each.withColumn("_i", F.row_number().over(Window.partitionBy(group, *z).orderBy(owner))).where(F.col("_i") <= k + 1)
    return few.select(group, *z, owner, F.explode("_rows").alias("_r")).select(group, *z, owner, f"_r.{season}")


def _split(points: DataFrame, within: list[str], z: list[str], per: Column, name: str) -> DataFrame:
    """Points with the column ``name``: a box of some ``per`` points, by quantiles of each dimension within the boxes of the dimensions before.

    ``per`` may use ``_n``, the number of points of ``within``.
    """
    keys = [*within, name]
    d = points.withColumn(name, F.lit(0).cast("long"))
    at = F.array(*[F.lit(j / 256) for j in range(1, 256)])
    for i, c in enumerate(z):
        some = F.count("*").alias("_n"), F.percentile_approx(c, at, F.lit(2560)).alias("_q")
        size = d.groupBy(*keys).agg(*some).withColumn("_per", per) if i == 0 else d.groupBy(*keys).agg(*some, F.first("_per").alias("_per"))
        wide = F.least(F.ceil(F.pow(F.col("_n") / F.col("_per"), F.lit(1.0 / (len(z) - i)))), F.lit(256)).cast("int")  # the next dimensions deal the rest
        size = size.withColumn("_w", wide)
        cut = F.transform(F.sequence(F.lit(1), F.col("_w") - 1), lambda j: F.element_at("_q", F.greatest(F.lit(1), F.least(F.lit(255), F.round(j * 256 / F.col("_w")).cast("int")))))
        edges = written(size.select(*keys, "_per", F.when(F.col("_w") > 1, F.array_distinct(cut)).otherwise(F.array().cast("array<double>")).alias("_e")))  # a row for each box so far
        d = d.drop("_per").join(edges, keys).withColumn(name, F.xxhash64(name, F.size(F.filter("_e", lambda e: e < F.col(c))))).drop("_e")  # noqa: B023
    return d.drop("_per")


def boxed(points: DataFrame, group: str, z: list[str]) -> DataFrame:
    """Points with ``coarse``, one of about 2 * sqrt(n) boxes of their group, and ``fine``, one of the boxes of some ``FINE`` points in it."""
    coarse = written(_split(points, [group], z, F.sqrt("_n") / 2, "coarse"))
    return written(_split(coarse, [group, "coarse"], z, F.lit(FINE), "fine"))


def _boxes(indexed: DataFrame, keys: list[str], z: list[str]) -> DataFrame:
    return written(indexed.groupBy(*keys).agg(F.count("*").alias("_size"), *[f(c).alias(f"_{n}{i}") for i, c in enumerate(z) for n, f in (("lo", F.min), ("hi", F.max))]))


def _kept(queries: DataFrame, boxes: DataFrame, on: list[str], cell: str, z: list[str], k: int) -> DataFrame:
    """Queries with the boxes (``cell``) that may hold one of their ``k`` nearest rows, and ``_bound``, within which ``k`` rows lie for sure.

    The farthest corner of a box with enough rows is a bound; boxes whose nearest side is beyond the least one are out.
    """
    inner = [c for c in on if c not in queries.columns or c == "coarse"]  # boxes that the query is in already
    keys = [c for c in queries.columns if c not in inner]
    gap = [F.greatest(F.col(f"_lo{i}") - F.col(c), F.col(c) - F.col(f"_hi{i}"), F.lit(0.0)) for i, c in enumerate(z)]
    far = [F.greatest(F.abs(F.col(c) - F.col(f"_lo{i}")), F.abs(F.col(c) - F.col(f"_hi{i}"))) for i, c in enumerate(z)]
    sure = F.min(F.when(F.col("_size") >= k + F.col("_own"), _length(far))).alias("_sure")
    bound = queries.join(boxes, on).groupBy(*keys).agg(sure, *[F.collect_set(c).alias(c) for c in inner])  # tasks pass on a row for each query
    d = bound.withColumn("_bound", F.least("_bound", F.col("_sure") + SLACK)).drop("_sure")
    for c in inner:
        d = d.withColumn(c, F.explode(c))
    return d.join(boxes, on).where(_length(gap) <= F.col("_bound")).select(*d.columns, cell)


def _asked(rows: DataFrame, queries: DataFrame, names: list[str], k: int, group: str, owner: str, season: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows of the index, and queries with the fine boxes and the bound in which their neighbours are."""
    z = [f"z{i}" for i in range(len(names))]
    r, q = (d.where(F.col(group).isNotNull() & F.col(owner).isNotNull()).select(group, owner, season, *z) for d in standardised(rows, names, rows, queries))
    indexed = boxed(written(first_of_points(r, group, owner, season, z, k)), group, z)
    own = indexed.groupBy(group, owner).agg(F.count("*").alias("_own"))
    q = written(q.join(own, [group, owner], "left").withColumns({"_own": F.coalesce("_own", F.lit(0)), "_bound": F.lit(float("inf"))}))
    some = written(_kept(q, _boxes(indexed, [group, "coarse"], z), [group], "coarse", z, k))
    return indexed, _kept(some, _boxes(indexed, [group, "coarse", "fine"], z), [group, "coarse"], "fine", z, k), z


def nearest(rows: DataFrame, queries: DataFrame, names: list[str], k: int = 3, group: str = "position", owner: str = "player_id", season: str = "season", rounded: bool = True) -> DataFrame:
    """``owner, season, other_id, other_season, distance, rank``: the ``k`` nearest rows of other owners in the query's group.

    Distances are of standardised columns; those equal to nine digits are ties, which go to the smaller id, then
    season.  They are ``rounded`` to as many, or left as they are.
    Rows and queries without a group or owner have no neighbours; a repeated query counts once.
    """
    indexed, asked, z = _asked(rows, queries, names, k, group, owner, season)
    y = [f"_y{i}" for i in range(len(z))]
    other = indexed.select(group, "coarse", "fine", F.col(owner).alias("other_id"), F.col(season).alias("other_season"), *[F.col(a).alias(b) for a, b in zip(z, y, strict=True)])
    d = asked.join(other, [group, "coarse", "fine"]).where(F.col(owner) != F.col("other_id")).withColumn("_d", distance(z, y)).where(F.col("_d") <= F.col("_bound"))
    d = d.select(owner, season, "other_id", "other_season", F.round("_d", 9).alias("_r"), F.col("_d").alias("distance"))
    d = d.withColumn("distance", F.col("_r")) if rounded else d
    order = Window.partitionBy(owner, season).orderBy("_r", "other_id", "other_season")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(owner, season, "other_id", "other_season", "distance", "rank")


def comparisons(rows: DataFrame, queries: DataFrame, names: list[str], k: int = 3, group: str = "position", owner: str = "player_id", season: str = "season") -> tuple[int, int]:
    """Pairs of rows that ``nearest`` compares, and those that a comparison with whole groups would."""
    indexed, asked, _ = _asked(rows, queries, names, k, group, owner, season)
    box = [group, "coarse", "fine"]
    some = asked.join(indexed.groupBy(*box).agg(F.count("*").alias("_size")), box).agg(F.sum("_size")).first()[0]
    q, r = (d.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias(n)) for d, n in ((queries, "_q"), (rows, "_n")))
    return int(some or 0), int(q.join(r, group).agg(F.sum(F.col("_q") * F.col("_n"))).first()[0] or 0)
