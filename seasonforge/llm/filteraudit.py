"""Filter interaction audit: what each of five filters removes, in every order of them, by first-failure lookup.

A document's failures are five bits.  A table of 32 by 120 holds, for each combination of failures and each
order, the step that removes it.  Tasks index the table and count; Spark sums their partial arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .textnp import utf8

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The step (from 0) at which an order removes a document with these failures; STEPS if it keeps it.
FIRST = np.array([[next((s for s, f in enumerate(o) if m >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for m in range(1 << STEPS)])
#: The filter of each order and step.
FILTER_AT = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])

CAPITALS, MARKS = bytes(range(65, 91)), b"#$%&*|"


def failures(raw: bytes) -> int:
    """Bits of the filters A to D that a whole text fails: short, repetitive, shouting, with marks."""
    words = raw.split()
    n, distinct = len(words), len(set(words))
    points = len(raw) - len(raw.translate(None, _STARTS))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (len(raw.translate(None, MARKS)) < len(raw)) << 3


#: Bytes that start a code point.
_STARTS = bytes(c for c in range(256) if not 0x80 <= c < 0xC0)


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, digest``: failures of A to D and a digest of 256 bits of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b["text"])
            mask = pa.array(map(failures, texts), pa.int32())
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["part"], mask, pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "part", "mask", "digest"])

    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(run, "doc_id long, part string, mask int, digest binary")


def removals(rows: DataFrame) -> DataFrame:
    """``part, at, docs, removed, good_lost, toxic_lost, fails, unique_fails`` by place (order, step) of each part.

    ``rows``: ``part, mask, good boolean, toxic boolean, n long``.  A task yields one array of each count for
    each part that it meets; the sum is by part and place.
    """
    places = len(ORDERS) * STEPS
    kinds = ["removed", "good_lost", "toxic_lost", "fails", "unique_fails"]

    def arrays(mask: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each place, how much it removes."""
        by_mask = np.bincount(mask, weights, 1 << STEPS)
        step = np.arange(len(ORDERS)) * (STEPS + 1) + FIRST
        return np.bincount(step.ravel(), np.repeat(by_mask, len(ORDERS)), len(ORDERS) * (STEPS + 1)).reshape(len(ORDERS), STEPS + 1)[:, :STEPS].ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b["part"].dictionary_encode()
            of, mask, n = codes.indices.to_numpy(), b["mask"].to_numpy(), b["n"].to_numpy().astype(np.float64)
            labels = [np.ones(len(n)), *[b[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in ("good", "toxic")]]
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(len(codes.dictionary) + 1))
            out = []
            for a, z in zip(at[:-1], at[1:], strict=True):
                rows = order[a:z]
                m, w = mask[rows], n[rows]
                failing = np.array([w[m >> f & 1 == 1].sum() for f in range(STEPS)])[FILTER_AT].ravel()
                alone = np.array([w[m == 1 << f].sum() for f in range(STEPS)])[FILTER_AT].ravel()
                out.append([np.full(places, w.sum()), *[arrays(m, w * x[rows]) for x in labels], failing, alone])
            flat = [pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * places, pa.int32()), pa.array(np.concatenate(x).round().astype(np.int64))) for x in zip(*out, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([codes.dictionary, *flat], ["part", "docs", *kinds])

    partial = rows.mapInArrow(run, "part string, " + ", ".join(f"{k} array<bigint>" for k in ["docs", *kinds]))
    each = partial.select("part", F.posexplode(F.arrays_zip("docs", *kinds)).alias("at", "x"))
    return each.groupBy("part", "at").agg(*[F.sum(f"x.{k}").alias(k) for k in ["docs", *kinds]])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, filter order and step, zeros included: ``part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``docs``: ``doc_id, text, lang``; ``labels``: ``doc_id, quality, toxic``.  A part is a language; null
    counts as the empty string.  A null text counts as empty: under 200 words, and identical to other empty
    ones.  Long texts are taken whole.  A document with several rows of labels is good (toxic) if one of
    them says so; labels of no document count nowhere.  Repeated rows count each; rows of the same ``doc_id``
    are not copies of each other; a null ``doc_id`` is no copy and has none.  An empty table gives no rows.
    Other columns are ignored.
    """
    rows = cut(_marked(docs)).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))  # summed up before the shuffle, so groups of copies are small
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    yes = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    by_step = removals(rows.select("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), yes("good"), yes("toxic"), "n"))

    orders = F.from_json(F.lit("[" + ",".join(f'"{o}"' for o in ORDERS) + "]"), "array<string>")
    d = by_step.withColumns({"filter_order": F.get(orders, F.floor(F.col("at") / STEPS).cast("int")), "step": (F.col("at") % STEPS + 1).cast("int")})
    d = d.withColumn("_filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    gone = Window.partitionBy("part", "filter_order").orderBy("step")  # five rows
    whole = Window.partitionBy("part", "_filter")  # 120 rows
    d = d.withColumns({"kept": F.col("docs") - F.sum("removed").over(gone), "redundant": F.col("fails") - F.col("removed"), "shapley": F.sum("removed").over(whole)})
    return d.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


#: The same by SQL: failures of each document, then every order and step.
AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT d.doc_id, part, len(w) < 200 AS fa, 100 * len(list_distinct(w)) < 50 * len(w) AS fb,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
    coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false) AS fe, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
), m AS (
  SELECT part, fa, fb, fc, fd, fe, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), fails AS (
  SELECT m.*, filter_order, step, filter_order[step] AS filter, list_contains(bad, filter_order[step]) AS failing, len(bad) AS bads,
    list_bool_or(list_transform(range(1, step), lambda i: list_contains(bad, filter_order[i]))) AS before
  FROM (SELECT *, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN fa WHEN 'B' THEN fb WHEN 'C' THEN fc WHEN 'D' THEN fd ELSE fe END) AS bad FROM m) m,
    orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), s AS (
  SELECT part, filter_order, step::INT AS step, filter, coalesce(sum(n) FILTER (NOT failing AND NOT coalesce(before, false)), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failing AND NOT coalesce(before, false)), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (failing AND before), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failing AND bads = 1), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (failing AND NOT coalesce(before, false)), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failing AND NOT coalesce(before, false)), 0)::BIGINT AS toxic_lost
  FROM fails GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM s
"""
