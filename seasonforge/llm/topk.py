"""Exact top-k inner products by three phases with a uniform threshold."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .embedding import usable

#: Lists of scores: each is dealt to tasks of its own and scores one run of dimensions.
LISTS = 4
#: Queries and candidates of a block.  Bound memory, not results.
QUERIES, ROWS = 256, 4_096
#: Bits of the largest score; components that could pass it count as the largest that cannot.
SCORE_BITS = 62


def _ints(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of whole numbers as rows of doubles; shorter ones are filled up with zeros."""
    a = column.combine_chunks()
    size = np.diff(a.offsets.to_numpy())
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = a.flatten().to_numpy(zero_copy_only=False)
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products, queries by candidates.  Doubles hold them exactly up to 2^53, else long numbers do."""
    width = max(q.shape[1], x.shape[1], 1)
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width >= 2**53:
        return q.astype(np.int64) @ x.astype(np.int64).T
    return (q @ x.T).astype(np.int64)


def _table(q: np.ndarray, v: np.ndarray, score: np.ndarray, part: int = 0) -> pa.Table:
    return pa.table({"list": pa.array(np.full(len(q), part), pa.int32()), "query": pa.array(q, pa.int64()), "vec": pa.array(v, pa.int64()), "score": pa.array(score, pa.int64())})


def _clamped(x: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def _highest(k: int):
    """Phase 1: the k highest entries of this block of a list, for each query."""

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        q, v = t["id"].to_numpy(), c["id"].to_numpy()
        if not len(q) or not len(v):
            return _table(q[:0], v[:0], v[:0])
        part = _scores(_ints(t["v"]), _ints(c["v"]))
        m = min(k, len(v))
        top = np.argpartition(-part, m - 1, axis=1)[:, :m]
        return _table(np.repeat(q, m), v[top.ravel()], np.take_along_axis(part, top, axis=1).ravel(), t["list"][0].as_py())

    return run


def _sufficient(k: int, lists: int, step: int):
    """Phases 2 and 3: the candidates of this block with an entry of cutoff / lists in some list, resolved to whole scores.

    Of each query those that reach the cutoff, the k best of them at most.
    """

    def run(t: pa.Table, c: pa.Table) -> pa.Table:
        q, v = t["id"].to_numpy(), c["id"].to_numpy()
        if not len(q) or not len(v):
            return _table(q[:0], v[:0], v[:0])
        x, y = _ints(t["v"]), _ints(c["v"])
        given, lowest = t["cutoff"].to_pylist(), np.iinfo(np.int64).min  # no cutoff: fewer candidates than asked for
        cutoff = np.array([lowest if n is None else n for n in given], np.int64)
        least = np.array([lowest if n is None else -(-n // lists) for n in given], np.int64)
        some, score = np.zeros((len(q), len(v)), bool), np.zeros((len(q), len(v)), np.int64)
        for i in range(lists):
            part = _scores(x[:, i * step : (i + 1) * step], y[:, i * step : (i + 1) * step])
            some |= part >= least[:, None]
            score += part
        i, j = np.nonzero(some & (score >= cutoff[:, None]))
        order = np.lexsort((v[j], -score[i, j], i))
        i, j = i[order], j[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        return _table(q[i[best]], v[j[best]], score[i[best], j[best]])

    return run


def top_inner_products(rows: DataFrame, is_query: Column | None = None, k: int = 5, scale: int = 256, lists: int = LISTS) -> DataFrame:
    """The k highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Components become floor(``scale`` * x).  Queries are the rows where ``is_query`` holds (ids divisible by
    50 unless given), candidates all rows but the query's own.  Equal vectors are first reduced to one with
    its k + 1 smallest ids.  A list is a run of dimensions; its scores are computed by tasks of its own, in
    blocks of queries by candidates.  Phase 1 gathers the highest entries of each list and resolves their
    whole scores; the (k + 1)-th best of them is a safe cutoff for the query.  Phase 2 sends it to all
    blocks, which collect every entry of at least cutoff / lists: a candidate below that in each list is
    below the cutoff as a whole.  Phase 3 resolves the whole scores of those candidates where they are; what
    leaves a block are the few that reach the cutoff.

    Ties go to the smaller id.  Vectors that are null or hold a null or non-finite component, and rows
    without id, take no part; an empty vector scores 0; vectors of unequal length are filled up with
    zeros.  Scaled components beyond sqrt(2^62 / dimensions), of either sign, count as that number, so scores
    stay long numbers.  Repeated rows of one id are one vector, of different ones the least.  An empty table gives no
    rows.  Other columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    whole = F.transform("embedding", lambda x: _clamped(F.floor(_clamped(x * F.lit(float(scale)), 2.0**53)).cast("double"), 2.0**53))
    ok = (usable() | (F.size("embedding") == 0)) & F.col("id").isNotNull()
    data = rows.select(F.col("vec_id").alias("id"), v.alias("embedding"), (is_query if is_query is not None else F.col("vec_id") % 50 == 0).alias("asks")).where(ok)
    data = data.select("id", whole.alias("v"), F.coalesce("asks", F.lit(False)).alias("asks")).groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    data = cut(data.withColumn("same", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("long").cast("string")), ","), 256)))
    ranked = data.select("same", "id").withColumn("place", F.row_number().over(Window.partitionBy("same").orderBy("id"))).where(F.col("place") <= k + 1)
    ids = cut(ranked.groupBy("same").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    reps = data.groupBy("same").agg(F.min("id").alias("id"), F.first("v").alias("v"), F.max("asks").alias("asks"))
    reps = cut(reps.withColumn("width", F.size("v")))
    n, m, width = reps.agg(F.count("*"), F.count_if("asks"), F.max("width")).first()
    reps = reps.withColumn("v", F.transform("v", lambda x: _clamped(x, float(math.isqrt(2**SCORE_BITS // max(1, width or 1))))))
    qs, cs, step = max(1, -(-m // QUERIES)), max(1, -(-n // ROWS)), max(1, -(-(width or 1) // lists))

    def dealt(d: DataFrame, *more: str) -> DataFrame:
        """A row for each list, with the list's dimensions only."""
        d = d.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(lists - 1))))
        return d.withColumn("v", F.slice("v", F.col("list") * step + 1, F.lit(step))).select("list", "id", "v", *more)

    own_block, every = F.pmod(F.xxhash64("id"), F.lit(qs)).cast("int"), lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(cs)).cast("int")
    queries = reps.where("asks").select("id", "v")
    kind = "list int, query long, vec long, score long"

    def blocks(asked: DataFrame, given: DataFrame, keys: list[str], f) -> DataFrame:
        left, right = asked.withColumn("q", own_block).withColumn("c", every(cs)), given.withColumn("c", block).withColumn("q", every(qs))
        left, right = (side.select(*[F.col(x).alias(x) for x in side.columns]) for side in (left, right))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(f, kind)

    def highest(d: DataFrame, *by: str) -> DataFrame:
        return d.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec"))).where(F.col("rank") <= k + 1)

    high = highest(blocks(dealt(queries), dealt(reps), ["list", "q", "c"], _highest(k + 1)), "query", "list").select("query", "vec").distinct()
    pairs = high.join(queries.select(F.col("id").alias("query"), F.col("v").alias("x")), "query").join(reps.select(F.col("id").alias("vec"), F.col("v").alias("y")), "vec")
    product = F.zip_with("x", "y", lambda a, b: F.coalesce(a.cast("long") * b.cast("long"), F.lit(0).cast("long")))
    whole_scores = pairs.select("query", "vec", F.aggregate(product, F.lit(0).cast("long"), lambda a, b: a + b).alias("score"))
    cutoff = cut(highest(whole_scores, "query").where(F.col("rank") == k + 1).select(F.col("query").alias("id"), F.col("score").alias("cutoff")))
    last = blocks(queries.join(cutoff, "id", "left"), reps.select("id", "v"), ["q", "c"], _sufficient(k + 1, lists, step))
    best = cut(highest(last, "query"))

    found = best.join(reps.select(F.col("id").alias("vec"), F.col("same").alias("other")), "vec").join(ids.withColumnRenamed("same", "other"), "other").select("query", "score", F.explode("ids").alias("vec_id"))
    asks = data.where("asks").select(F.col("id").alias("query_id"), "same").join(reps.select("same", F.col("id").alias("query")), "same").select("query_id", "query")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = asks.join(found, "query").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
