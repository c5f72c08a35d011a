"""Embedding near-duplicates: an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, release

#: Vectors in a cell, about; a large label of n vectors has no more than 2 * sqrt(n) pivots.
CELL_ROWS = 2_000
#: Rows of a block; cells with more rows are joined block by block.  Bounds memory, not results.
BLOCK = 2_048
#: Vectors of a label whose cells are found in one task.
PART_ROWS = 16_384


def usable(vector: str = "embedding"):
    """Not null, not empty, and all components finite numbers."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(a.offsets.to_numpy())
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == size[0]).all():
        return flat.reshape(len(size), size[0])
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def _assign(radius: float):
    """Home cell of each vector of a part of a label, and the cells that may hold a vector within ``radius`` of it.

    If y is at home in cell c, d(y, c) <= d(y, home of x), so d(x, y) <= radius gives
    d(x, c) <= d(x, home of x) + 2 * radius.
    """

    def run(t: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("slot")
        x, c = _unit(_matrix(t["embedding"])), _unit(_matrix(pivots["p"]))
        width = max(x.shape[1], c.shape[1])
        i, j, home = [], [], []
        for at in range(0, len(x), BLOCK):
            d = np.sqrt(np.maximum(0, 2 - 2 * _fit(x[at : at + BLOCK], width) @ _fit(c, width).T))
            own = d.argmin(axis=1)
            row, cell = np.nonzero(d <= d[np.arange(len(d)), own][:, None] + 2 * radius + 1e-9)
            i.append(at + row)
            j.append(cell)
            home.append(cell == own[row])
        i, j, home = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (i, j, home))
        out = t.select(["rep", "n", "label", "embedding"]).take(pa.array(i, pa.int64()))
        return out.append_column("cell", pa.array(j, pa.int32())).append_column("home", pa.array(home, pa.bool_()))

    return run


def _compare(threshold: float):
    """A home block against a block of the same cell: links of the home rows, and a forest that spans them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        x, y = _matrix(left["embedding"]), _matrix(right["embedding"])
        width = max(x.shape[1], y.shape[1]) if len(a) and len(b) else 0
        links, least = np.zeros(len(a), np.int64), a.copy()
        if len(a) and len(b):
            cos = (_fit(x, width) @ _fit(y, width).T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(y, axis=1)[None, :]
            hit = (cos >= threshold) & (a[:, None] != b[None, :])
            links = hit @ right["n"].to_numpy()
            # each home row is joined to its first hit, and rows of one block that share a hit are joined by it
            i, j = np.nonzero(hit)
            pairs = _forest(np.concatenate([a, b]), i, j + len(a))
        else:
            pairs = np.empty((0, 2), np.int64)
        return pa.table({
            "rep": pa.array(np.concatenate([a, pairs[:, 0]])), "links": pa.array(np.concatenate([links, np.zeros(len(pairs), np.int64)])),
            "other": pa.array(np.concatenate([least, pairs[:, 1]])),
        })

    return run


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For the graph with edges i - j, each node that has one with the smallest id of its component."""
    label = np.arange(len(ids))
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    low = rank.copy()
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, new[i])
        if (new == low).all():
            break
        low = new
    by = np.argsort(ids, kind="stable")
    touched = np.unique(np.concatenate([i, j])) if len(i) else label[:0]
    return np.stack([ids[touched], ids[by[low[touched]]]], axis=1)


def near_vectors(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links of vectors of equal label with cosine >= ``threshold``: ``vec_id, n_links, component_id, kept``, per row.

    Equal vectors of a label are first reduced to one that counts as many.  Unit vectors are at home in the
    cell of their nearest pivot and are copied to each cell that, by the triangle inequality, may hold a
    partner; cells join independently, large ones in blocks, and emit counts and a spanning forest only, so
    a large group of near copies never becomes all its pairs.  Cosines are computed in double precision.

    Vectors that are null, empty, zero, or hold a null or a non-finite component, and rows without label or
    id, link with nothing.  Vectors of unequal length are compared as if filled up with zeros.  Repeated
    rows of one id are one vector and share a result; if they differ, the first by label and digest counts.  An empty table gives no rows.  Other columns are
    ignored.
    """
    spark = rows.sparkSession
    radius = math.sqrt(max(0.0, 2 - 2 * threshold))
    data = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    good = data.where(usable() & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = good.withColumn("digest", F.sha2(F.concat_ws(",", F.transform("embedding", lambda x: (x + 0.0).cast("string"))), 256))
    # of different rows of one id the first by label, then digest
    good = cut(good.groupBy("vec_id").agg(F.min(F.struct("label", "digest", "embedding")).alias("x")).select("vec_id", "x.*"))
    reps = cut(good.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("embedding").alias("embedding")))
    counts = reps.groupBy("label").count()
    pivots, parts = F.least(F.ceil(F.col("count") / CELL_ROWS), F.ceil(2 * F.sqrt("count"))), F.ceil(F.col("count") / PART_ROWS)
    wanted = cut(counts.select("label", pivots.cast("int").alias("want"), parts.cast("int").alias("parts")))
    # a pivot for each slot: the vector with the least hash in it; slots are dealt by another hash
    slot = reps.join(wanted, "label").withColumn("slot", F.pmod(F.xxhash64("digest"), F.col("want")))
    chosen = cut(slot.groupBy("label", "slot", "parts").agg(F.min_by("embedding", F.xxhash64(F.lit(5), "digest")).alias("p")))
    dealt = slot.withColumn("part", F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("parts")).cast("int"))
    spread = chosen.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt, spread = dealt.select("label", "part", "rep", "n", "embedding"), spread.select("label", "part", "slot", "p")
    kind = reps.schema["label"].dataType.simpleString()
    cells = dealt.groupBy("label", "part").cogroup(spread.groupBy("label", "part"))
    cells = cut(cells.applyInArrow(_assign(radius), f"rep long, n long, label {kind}, embedding array<double>, cell int, home boolean"))
    sizes = cut(cells.groupBy("label", "cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("homes"), F.ceil(F.count("*") / BLOCK).cast("int").alias("guests")))
    cells = cells.join(sizes, ["label", "cell"])
    left = cells.where("home").withColumn("h", F.pmod(F.xxhash64("rep"), F.col("homes"))).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("guests") - 1)))
    right = cells.where("homes > 0").withColumn("g", F.pmod(F.xxhash64("rep"), F.col("guests")).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("homes").cast("long") - 1)))
    keys = ["label", "cell", "h", "g"]
    left, right = (side.select(*[F.col(c).alias(c) for c in (*keys, "rep", "n", "embedding")]) for side in (left, right))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    found = cut(found.applyInArrow(_compare(threshold), "rep long, links long, other long"))
    release(spark)
    comp = connected_components(found.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of = reps.select("label", "digest", "rep", "n").join(links, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of = of.select("label", "digest", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.select("vec_id", "label", "digest").join(of, ["label", "digest"]).select(F.col("vec_id").alias("_id"), "n_links", "component_id")
    out = rows.select("vec_id").join(linked, F.col("vec_id") == F.col("_id"), "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
