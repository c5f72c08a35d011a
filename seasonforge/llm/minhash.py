"""MinHash near-duplicates by tensored banding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, link_groups, release
from .textnp import U, batches, mix, shingle_sets, utf8

#: Sub-keys in each of the two collections, and minhashes in a sub-key.  The tables are all pairs of a
#: sub-key of the first and one of the second collection: SIDE * SIDE tables from 2 * SIDE * ROWS minhashes.
#: A pair of similarity s meets in a table with probability (1 - (1 - s^ROWS)^SIDE)^2: 0.9990 at 0.85.
SIDE, ROWS = 8, 3


def _sketches(width: int, side: int, rows: int):
    rng = np.random.default_rng(20_240_611)
    a = rng.integers(0, 2**63, (2 * side * rows, 1), dtype=np.int64).astype(U) * U(2) + U(1)
    b = rng.integers(0, 2**63, (2 * side * rows, 1), dtype=np.int64).astype(U)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, raw, starts in batches(part["doc_id"].to_pylist(), utf8(part["text"])):
                n, keys, digest = [], [], []
                for h in shingle_sets(raw, starts, width):
                    n.append(len(h))
                    digest.append((h.sum(dtype=U), mix(h ^ U(0xA5A5A5A5)).sum(dtype=U)))
                    if not len(h):
                        keys.append(np.empty(0, np.int64))
                        continue
                    low = np.full((len(a), 1), U(2**64 - 1))
                    for i in range(0, len(h), 4096):
                        low = np.minimum(low, (h[None, i : i + 4096] * a + b).min(axis=1, keepdims=True))
                    low = low.reshape(2 * side, rows)
                    key = low[:, 0]
                    for j in range(1, rows):
                        key = mix(key) + low[:, j]
                    keys.append(mix(key).view(np.int64))
                d = np.array(digest, U).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n", "d1", "d2", "subkeys"],
                )

    return run


def _sets(width: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for ids, raw, starts in batches(part["doc_id"].to_pylist(), utf8(part["text"])):
                sets = [h.view(np.int64) for h in shingle_sets(raw, starts, width)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "item"])

    return run


def _overlaps(percent: int):
    """Pairs of sets, one of each side, whose overlap is large enough, through a sorted index of the second side."""

    def match(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values = right.flatten().to_numpy()
        owner = np.repeat(np.arange(len(right)), np.diff(right.offsets.to_numpy()))
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        sizes = np.diff(right.offsets.to_numpy())
        out_i, out_j = [], []
        for i, s in enumerate(left):
            s = s.values.to_numpy()
            lo, hi = np.searchsorted(values, s, "left"), np.searchsorted(values, s, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sizes))
            j = np.flatnonzero(100 * both >= percent * (len(s) + sizes - both))
            out_i.append(np.full(len(j), i))
            out_j.append(j)
        return np.concatenate(out_i), np.concatenate(out_j)

    return match


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """Components of documents whose word shingles overlap: ``doc_id, n_shingles, component_id, kept``, per row.

    Words are split at ASCII white space and lower-cased for A to Z.  Two documents are linked when
    100 * intersection >= ``percent`` * union of their whole shingle sets.  Documents with equal sets are
    first reduced to one; the tensored tables propose pairs of the rest; every link is confirmed on full
    sets.  ``component_id`` is the smallest id reachable, ``kept`` marks that document.

    A null text, or one without words, has an empty set and no links.  A text of fewer than ``width`` words
    is one shingle.  Repeated rows share a component; rows with one id are one document.  A null id stays
    null and is kept.  An empty table gives no rows.  Other columns are ignored.
    """
    d = docs.select("doc_id", "text")
    t = cut(d.mapInArrow(_sketches(width, side, rows), "doc_id long, n long, d1 long, d2 long, subkeys array<long>"))
    reps = t.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("subkeys").alias("subkeys"))
    first, second = F.slice("subkeys", 1, side), F.slice("subkeys", side + 1, side)
    table = F.flatten(F.transform(first, lambda u, i: F.transform(second, lambda v, j: F.xxhash64(u, v, i * side + j))))
    members = reps.select("id", F.explode(table).alias("key")).select("key", "id")

    def sets(ids: DataFrame) -> DataFrame:
        release(d.sparkSession)
        near = d.join(ids, d["doc_id"] == ids["id"], "left_semi").dropDuplicates(["doc_id"])
        return near.mapInArrow(_sets(width), "id long, item array<long>")

    def similar(x: Column, y: Column) -> Column:
        least, most = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
        both = F.size(F.array_intersect(x, y))
        return F.when(100 * least < percent * most, False).otherwise(100 * both >= percent * (least + most - both))

    comp = link_groups(members, sets, similar, _overlaps(percent))
    release(d.sparkSession)
    ids = t.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"))
    ids = ids.join(comp.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("of"))
    out = t.drop("subkeys").join(ids, ["d1", "d2"], "left").withColumn("of", F.when(F.col("n") > 0, F.coalesce("of", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("of").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("of")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, of the documents that stay: one of each component, once; rows without id as they are."""
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    cols = [f"`{c}`" for c in docs.columns]
    stay = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*cols)
    once = stay.dropDuplicates(["doc_id"])
    return once.unionByName(docs.where("doc_id is null").select(*cols))
