"""Target-distribution importance resampling: hashed n-grams in DuckDB per partition, merged and scored by Spark.

A task lists the runs of one to three words of its texts by SQL (unnest and a window), hashes them by a
registered zlib function, and counts buckets.  Its rows and the sum of its buckets are spilled to Parquet
in the shared folder.  Spark merges the sums into the gain of each bucket, scores the spilled rows and
draws the highest scores.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .textnp import LOWER, utf8

#: Buckets of features, and least words of a document that can be drawn.
BUCKETS, LEAST_WORDS = 10_000, 20
#: Bytes of text to a query.  A longer text is taken in pieces, so it bounds memory, not results.
BYTES = 1_500_000
#: Bytes of lower-cased text that no word holds: ASCII but digits and letters.
BREAK = np.array([c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) for c in range(256)])

#: A piece's first ``skip`` words end the piece before: they only complete runs that end in this one.
COUNT = r"""
WITH words AS (
    SELECT p, skip, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT p, skip, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM given)
), runs AS (
    SELECT p, i > skip AS own, word AS one, lag(word) OVER o AS two, lag(word, 2) OVER o AS three FROM words WINDOW o AS (PARTITION BY p ORDER BY i)
), grams AS (
    SELECT p, unnest([one, two || ' ' || one, three || ' ' || two || ' ' || one]) AS gram FROM runs WHERE own
)
SELECT p * {buckets} + crc(gram) % {buckets} AS k, count(*) AS n FROM grams WHERE gram IS NOT NULL GROUP BY k
"""

Counts = tuple[np.ndarray, np.ndarray]


def _crc(grams: pa.Array) -> pa.Array:
    """Unsigned zlib CRC-32 of the UTF-8 bytes of each string."""
    if isinstance(grams, pa.ChunkedArray):
        grams = grams.combine_chunks()
    raw = grams.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return pa.array(np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)))


class Counter:
    """One DuckDB database of a task: bucket counts of texts."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        self.db.create_function("crc", _crc, ["VARCHAR"], "UINTEGER", type="arrow")

    def pieces(self, texts: list[bytes], skip: list[int]) -> list[Counts]:
        """Buckets in order, and their counts, of each lower-cased text without its first ``skip`` words."""
        self.db.register("given", pa.table({"p": pa.array(range(len(texts)), pa.int64()), "skip": pa.array(skip, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string())}))
        got = self.db.sql(COUNT.format(buckets=self.buckets)).to_arrow_table()
        self.db.unregister("given")
        k, n = got["k"].to_numpy(), got["n"].to_numpy()
        order = np.argsort(k)
        k, n = k[order], n[order]
        at = np.searchsorted(k, np.arange(len(texts) + 1) * self.buckets)
        return [(k[a:b] - i * self.buckets, n[a:b]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]

    def long(self, raw: bytes) -> Counts:
        """Counts of a long text, in pieces that end at a word's end and start with the last two words before."""
        total = np.zeros(self.buckets, np.int64)
        ends = np.flatnonzero(BREAK[np.frombuffer(raw, np.uint8)])
        at, before = 0, []
        while at < len(raw):
            later = np.searchsorted(ends, at + BYTES)
            end = int(ends[later]) if later < len(ends) else len(raw)
            piece = raw[at:end]
            for k, n in self.pieces([b" ".join([*before, piece])], [len(before)]):
                total[k] += n
            before = [*before, *bytes(piece).translate(_SPACED).split()[-2:]][-2:]
            at = end
        k = np.flatnonzero(total)
        return k, total[k]

    def close(self) -> None:
        self.db.close()
        pa.default_memory_pool().release_unused()


_SPACED = bytes(32 if BREAK[c] else c for c in range(256))


def _counted(counter: Counter, texts: list[bytes]) -> Iterator[tuple[int, list[Counts]]]:
    """Counts of runs of texts, and where each run starts."""
    at, part, size = 0, [], 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BYTES:
            yield at, counter.pieces(part, [0] * len(part))
            at, part, size = i, [], 0
        if len(t) > BYTES:
            if part:
                yield at, counter.pieces(part, [0] * len(part))
            yield i, [counter.long(t)]
            at, part, size = i + 1, [], 0
        else:
            part.append(t)
            size += len(t)
    if part:
        yield at, counter.pieces(part, [0] * len(part))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, rows: bool = True) -> DataFrame:
    """``doc_id, n_features, buckets, counts, summed`` of whole texts: a row for each document (if ``rows``),
    and one for each task, ``summed``, that holds the counts of all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, total = Counter(buckets), np.zeros(buckets, np.int64)

        def frame(ids: pa.Array, found: list[Counts], summed: bool) -> pa.RecordBatch:
            ends = np.cumsum([0] + [len(k) for k, _ in found]).astype(np.int32)
            k = np.concatenate([k for k, _ in found]).astype(np.int32)
            n = np.concatenate([n for _, n in found]).astype(np.int64)
            size = [int(n[a:b].sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (k, n)]
            return pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), *lists, pa.array([summed] * len(found))], ["doc_id", "n_features", "buckets", "counts", "summed"])

        try:
            for b in batches:
                texts = [t.translate(LOWER) for t in utf8(b["text"])]
                for at, found in _counted(counter, texts):
                    for k, n in found:
                        total[k] += n
                    if rows:
                        yield frame(b["doc_id"].slice(at, len(found)).cast(pa.int64()), found, False)
            k = np.flatnonzero(total)
            yield frame(pa.array([None], pa.int64()), [(k, total[k])], True)
        finally:  # Spark uses the process again, for other operators too
            counter.close()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_features long, buckets array<int>, counts array<long>, summed boolean")


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket: how much likelier it is in the target than in the raw texts, both smoothed by 1.

    Of each table the sums of tasks are merged, so a row for each task and bucket is shuffled at most.
    The result has a number for each bucket.
    """
    sums = [
        d.where("summed").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))
        for d, name in ((raw, "s"), (target, "t"))
    ]
    both = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(sums[0], "bucket", "left").join(sums[1], "bucket", "left")
    n = {r.bucket: (r.s or 0, r.t or 0) for r in both.collect()}
    big_s, big_t = (float(sum(x[i] for x in n.values()) + buckets) for i in (0, 1))
    s, t = (np.array([float(n[b][i] + 1) for b in range(buckets)]) for i in (0, 1))
    return np.floor(1000 * np.log(t * big_s / (s * big_t))).astype(np.int64).tolist()


def _noise(seed: int, doc_id: str) -> Column:
    """A Gumbel variate in thousandths, by the hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Numbers from 1 in the order of the whole table: sorted by ranges, each moved by the sizes of those before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.select(*rows.columns, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))  # a row for each range
    return placed.join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def score(docs: DataFrame, target: DataFrame, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight, score`` per row: how much likelier the target's texts make a document's features,
    and that plus the noise by which the highest scores are a sample without replacement."""
    spill = cut(bucket_counts(docs, buckets))
    goal = cut(bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, rows=False))
    gains = F.from_json(F.lit(json.dumps(bucket_gains(spill, goal, buckets))), "array<bigint>")  # a number for each bucket
    each = F.zip_with("buckets", "counts", lambda b, n: F.get(gains, b) * n)
    out = spill.where("not summed").select("doc_id", "n_features", F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x).alias("weight"))
    out = cut(out.withColumn("score", F.col("weight") + _noise(seed, "doc_id")))
    drop_cut(spill)
    drop_cut(goal)
    return out


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """Draws ``percent`` of the documents of ``least_words`` words or more so that they resemble the target's texts.

    Per row of ``docs`` (``doc_id, text``): ``doc_id, n_features, weight, score, rank``, all long.  ``rank``
    counts the drawn from 1, by score, ties to the smaller ``doc_id``; it is null for the rest.  A text that
    is null, empty or has no word has no features and weight 0 and is never drawn.  Very long texts are
    counted whole, in pieces.  A null ``doc_id`` hashes as an empty one and comes last among ties.  Repeated
    rows are rows of their own, with equal scores and ranks of their own.  An empty table gives no rows, an
    empty target counts as one without features.  Other columns are ignored.
    """
    scored = score(docs, target, seed, buckets)
    features = sum(max(0, least_words - k) for k in range(3))  # of a text with just as many words
    can = F.col("n_features") >= features
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranked = _numbered(scored.where(can), order, "rank")
    count = scored.agg(F.floor(F.lit(percent) * F.count_if(can) / 100).cast("long").alias("_drawn"))  # a single row
    ranked = ranked.join(F.broadcast(count)).withColumn("rank", F.when(F.col("rank") <= F.col("_drawn"), F.col("rank"))).drop("_drawn")
    return ranked.unionByName(scored.where(~can).withColumn("rank", F.lit(None).cast("long")))
