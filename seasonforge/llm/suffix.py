"""Exact repeated passages by a logarithmic family of sparse suffix arrays.

Documents are cut into batches of consecutive ids.  A batch's suffix array has one entry for each sampled
suffix: the positions whose GRAM-byte prefix is the smallest, by fingerprint, in some window of WINDOW
bytes (a window covers ``WINDOW - GRAM + 1`` prefixes and belongs to its smallest one).  An entry is
fingerprints of the suffix to SIDE bytes past the prefix, of the stretch of text that its windows cover,
and of the prefix with SIDE bytes before it; the array is sorted by the first two.  Any repeated window is
owned by equal prefixes at equal offsets, so arrays are dealt to tasks by ranges of the prefix.  Within a
range, batches arrive in order: a batch's array is merge-scanned against all existing levels, then
becomes a level, and levels of equal size are merged.

Equal stretches settle all their windows at once.  At the borders of a repeat, stretches differ.  A window
covers SIDE bytes on one side of its prefix at least, so where entries of different stretches agree on
those, and only there, the windows themselves are compared by fingerprint.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, release
from .textnp import BYTES_M, U, mix, powers, utf8

WINDOW, GRAM = 50, 20
SIDE = (WINDOW - GRAM) // 2
#: Bytes of text in a batch, about, and sampled suffixes in a range, about.  Bound memory, not results.
BATCH_BYTES, RANGE_ROWS = 3_000_000, 1_000_000
#: Most batches; beyond it they grow, and tasks take them in pieces of BATCH_BYTES.  Bounds the driver's list of borders.
MOST_BATCHES = 65_536

_POW = powers(BYTES_M, 1)
_INV = powers(U(pow(int(BYTES_M), -1, 2**64)), 1)


def _prefix_sums(raw: bytes) -> np.ndarray:
    global _POW, _INV
    n = len(raw)
    if len(_POW) < n + 1:
        _POW, _INV = powers(BYTES_M, n + 1), powers(U(pow(int(BYTES_M), -1, 2**64)), n + 1)
    out = np.zeros(n + 1, U)
    np.cumsum((np.frombuffer(raw, np.uint8) + U(1)) * _POW[:n], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte runs start..end."""
    return mix((sums[end] - sums[start]) * _INV[start] + (end - start).astype(U))


def _owners(sums: np.ndarray, n: int, window: int, gram: int) -> np.ndarray:
    """For each window start, the start of the prefix that owns it (the rightmost smallest)."""
    h = mix((sums[gram : n + 1] - sums[: n + 1 - gram]) * _INV[: n + 1 - gram])
    span = window - gram + 1
    low, at, width = h, np.arange(len(h), dtype=np.int32), 1

    def join(shift: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = low[:-shift], low[shift:]
        return np.minimum(left, right), np.where(right <= left, at[shift:], at[:-shift])

    while width * 2 <= span:
        low, at = join(width)
        width *= 2
    if width < span:
        low, at = join(span - width)
    return at[: n - window + 1].astype(np.int64)


class Sampled:
    """The sampled suffixes of some texts: owner, first and last owned window start, by text and position."""

    def __init__(self, texts: list[bytes], window: int, gram: int):
        self.raw = b"".join(texts)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        n = len(self.raw)
        self.sums = _prefix_sums(self.raw)
        if n < window:
            self.lo = self.hi = self.doc = self.mid = np.empty(0, np.int64)
            self.zone = self.after = self.before = self.block = np.empty(0, U)
            return
        own = _owners(self.sums, n, window, gram)
        starts = np.arange(len(own), dtype=np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.at))[: len(own)]
        inside = starts + window <= self.at[doc + 1]  # windows do not cross texts
        own, starts, doc = own[inside], starts[inside], doc[inside]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])) if len(own) else np.empty(0, np.int64)
        last = np.append(new[1:], len(own)) - 1
        own, lo, hi, doc = own[new], starts[new], starts[last] if len(new) else starts[:0], doc[new]
        side = (window - gram) // 2
        self.lo, self.hi, self.doc, self.mid = lo, hi, doc, own - side
        part = _hash(self.sums, own, own + gram)
        place = (own - lo).astype(U) * U(0x9E3779B1)  # a stretch counts as equal at the same offset only
        self.block = mix(_hash(self.sums, lo, hi + window) + place)
        left, right = own - side, own + gram + side
        none = self.block & U(0xFFFFFFFF)  # where the text ends before: equal to nothing but its own stretch
        after = np.where(right <= self.at[doc + 1], _hash(self.sums, own, np.minimum(right, n)) >> U(32), none)
        before = np.where(left >= self.at[doc], _hash(self.sums, np.maximum(left, 0), own + gram) >> U(32), none)
        self.zone, self.after, self.before = part >> U(32), after, before


class Entries:
    """Distinct entries, sorted by suffix, then stretch."""

    def __init__(self, after: np.ndarray, block: np.ndarray, before: np.ndarray):
        order = np.lexsort((block, after))
        after, block = after[order], block[order]
        new = np.ones(len(order), bool)
        new[1:] = (after[1:] != after[:-1]) | (block[1:] != block[:-1])
        self.after, self.block, self.before = after[new], block[new], before[order][new]

    def __len__(self) -> int:
        return len(self.after)

    def merged(self, other: Entries) -> Entries:
        return Entries(*[np.concatenate([getattr(self, k), getattr(other, k)]) for k in ("after", "block", "before")])

    def scan(self, level: Entries) -> np.ndarray:
        """Which entries are in a level: its run of the suffix by binary search, then the stretch in that run."""
        low, high = np.searchsorted(level.after, self.after, "left"), np.searchsorted(level.after, self.after, "right")
        end = high
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = open_ & (level.block[np.minimum(middle, len(level) - 1)] < self.block)
            low, high = np.where(less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return (low < end) & (level.block[np.minimum(low, len(level) - 1)] == self.block)


class LevelFamily:
    """Sorted arrays of sizes that at least double from the newest to the oldest."""

    def __init__(self):
        self.levels: list[Entries] = []

    def add(self, batch: Entries) -> np.ndarray:
        """Merge-scans a batch against all levels, adds it; returns which entries were there before."""
        seen = np.zeros(len(batch), bool)
        for level in self.levels:
            seen |= batch.scan(level)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            self.levels.append(self.levels.pop().merged(self.levels.pop()))
        return seen

    def branching(self) -> tuple[np.ndarray, np.ndarray]:
        """Stretches that agree with another stretch before, and after, the prefix; sorted."""
        whole = self.levels[0]
        for level in self.levels[1:]:
            whole = whole.merged(level)
        return _shared(whole.before, whole.block), _shared(whole.after, whole.block)


def _shared(by: np.ndarray, block: np.ndarray) -> np.ndarray:
    order = np.argsort(by)
    by = by[order]
    same = by[1:] == by[:-1]
    return np.sort(block[order][np.append(same, False) | np.append(False, same)])


def _within(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def _chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    at = n = 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most or i == len(texts) - 1:
            yield at, i + 1
            at, n = i + 1, 0


def _longs(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))


def _index(ranges: int, window: int, gram: int):
    """A batch's suffix array, dealt to ranges of the prefix."""

    def run(t: pa.Table) -> pa.Table:
        batch = t["batch"][0].as_py()
        texts = utf8(t["text"].combine_chunks())
        parts = [Sampled(texts[a:b], window, gram) for a, b in _chunks(texts, BATCH_BYTES)]
        zone, after, before, block = (np.concatenate([getattr(p, k) for p in parts]) for k in ("zone", "after", "before", "block"))
        _, first = np.unique(block, return_index=True)
        zone = (zone[first] * U(ranges)) >> U(32)
        first = first[np.argsort(zone, kind="stable")]
        ends = np.cumsum(np.bincount(zone.astype(np.int64), minlength=ranges))
        full = [i for i in range(ranges) if ends[i] > (ends[i - 1] if i else 0)]
        slices = [first[(ends[i - 1] if i else 0) : ends[i]] for i in full]
        sides = (before << U(32)) | after
        return pa.table({
            "range": pa.array(full, pa.int32()), "batch": pa.array([batch] * len(full), pa.int32()),
            "sides": _longs([sides[s] for s in slices]), "block": _longs([block[s] for s in slices]),
        })

    return run


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy().view(U) for chunk in column.chunks for x in chunk]


def _family(t: pa.Table) -> pa.Table:
    """All batches of one range of prefixes, in order: stretches that earlier batches have, and that branch."""
    batch, sides, blocks = t["batch"].to_numpy(), _arrays(t["sides"]), _arrays(t["block"])
    order = np.argsort(batch, kind="stable")
    family, entries, seen = LevelFamily(), [], []
    for i in order:
        entries.append(Entries(sides[i] & U(0xFFFFFFFF), blocks[i], sides[i] >> U(32)))
        seen.append(family.add(entries[-1]))
    before, after = family.branching()
    out = [[b.block[x] for b, x in zip(entries, seen, strict=True)], *[[b.block[_within(b.block, f)] for b in entries] for f in (before, after)]]
    keep = [j for j in range(len(order)) if any(len(o[j]) for o in out)]
    names = ("seen", "before", "after")
    return pa.table({"batch": pa.array([int(batch[order[j]]) for j in keep], pa.int32()), **{n: _longs([o[j] for j in keep]) for n, o in zip(names, out, strict=True)}})


def _digest(text: bytes, starts: np.ndarray, window: int) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of the rest, for windows removed at ``starts``."""
    if not len(starts):
        return 0, 0, hashlib.sha256(text).hexdigest()
    starts = np.unique(starts)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + window]))
    a, b = starts[new], starts[np.append(new[1:], len(starts)) - 1] + window
    rest = b"".join(text[x:y] for x, y in zip(np.append(0, b), np.append(a, len(text)), strict=True))
    return int((b - a).sum()), len(a), hashlib.sha256(rest).hexdigest()


def _settle(window: int, gram: int):
    """The texts of a batch with what the index says of it."""

    def run(t: pa.Table, flags: pa.Table) -> pa.Table:
        order = np.argsort(t["doc_id"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        ids, texts = t["doc_id"].to_numpy(), utf8(t["text"].combine_chunks())
        seen, before, after = (np.sort(np.concatenate([np.empty(0, U), *_arrays(flags[k])])) for k in ("seen", "before", "after"))
        parts = [(a, Sampled(texts[a:b], window, gram)) for a, b in _chunks(texts, BATCH_BYTES)]
        block = np.concatenate([p.block for _, p in parts])
        owner = ids[np.concatenate([p.doc + a for a, p in parts])] if len(block) else np.empty(0, np.int64)
        _, first, back = np.unique(block, return_index=True, return_inverse=True)  # entries are in order of ids
        sure = _within(block, seen) | (owner > owner[first][back])
        out, at = [], 0
        for a, p in parts:
            s = sure[at : at + len(p.block)]
            at += len(p.block)
            # windows from lo to mid have the side before the prefix, those from mid to hi the side after it
            low = np.where(_within(p.block, before), p.lo, np.maximum(p.lo, p.mid))
            high = np.where(_within(p.block, after), p.hi, np.minimum(p.hi, p.mid))
            ask = ~s & (_within(p.block, before) | _within(p.block, after)) & (low <= high)
            edges = np.searchsorted(p.doc, np.arange(len(p.at)))
            for d in range(len(p.at) - 1):
                e = slice(edges[d], edges[d + 1])
                text = texts[a + d]
                done = np.concatenate([p.lo[e][s[e]], p.hi[e][s[e]]]) - p.at[d]
                if ask[e].any():
                    low_, high_ = low[e][ask[e]], high[e][ask[e]]
                    at_ = _expand(low_, high_)
                    h = np.unique(_hash(p.sums, at_, at_ + window))
                    out.append((ids[a + d], len(text), 0, 0, None, text, done, np.concatenate([low_, high_]) - p.at[d], h.view(np.int64)))
                else:
                    out.append((ids[a + d], len(text), *_digest(text, _expand(*_halves(done)), window), None, None, None, None))
        cols = list(zip(*out, strict=True)) if out else [[]] * 9
        return pa.table({n: pa.array(c, k) for (n, k), c in zip(_SETTLED.items(), cols, strict=True)})

    return run


_SETTLED = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "text": pa.binary(),
    "done": pa.list_(pa.int64()), "open": pa.list_(pa.int64()), "hash": pa.list_(pa.int64()),
}


def _expand(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the runs lo..hi."""
    n = hi - lo + 1
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)


def _halves(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return runs[: len(runs) // 2], runs[len(runs) // 2 :]


def _finish(window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            rows = []
            for doc, n, text, done, open_, more in zip(p["doc_id"].to_pylist(), p["n_bytes"].to_pylist(), p["text"].to_pylist(), p["done"], p["open"], p["more"], strict=True):
                gone = _expand(*_halves(done.values.to_numpy()))
                if more.is_valid:
                    at = _expand(*_halves(open_.values.to_numpy()))
                    sums = _prefix_sums(text)
                    gone = np.concatenate([gone, at[np.isin(_hash(sums, at, at + window), more.values.to_numpy().view(U))]])
                rows.append((doc, n, *_digest(text, gone, window)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, _SETTLED[x]) for x, c in zip(names, cols, strict=True)], names)

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Removes bytes under a ``window``-byte string that also starts in a document of a smaller id.

    Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.  Strings are judged on the whole input
    texts as UTF-8 bytes, never across documents; overlaps count.

    A null text is empty.  Texts under ``window`` bytes stay whole.  Repeated rows (one id) do not remove
    each other's bytes; with more than one text to an id, each is judged by itself.  A null id neither
    removes nor loses bytes.  An empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = docs.where("doc_id is null").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
    size = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches, ranges = min(math.ceil(size / BATCH_BYTES) + 1, MOST_BATCHES), math.ceil(size / 16 / RANGE_ROWS) + 1
    marks = np.unique(np.array(d.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [0.5], 20 * batches)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def batch_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(marks, ids.to_numpy(np.int64), "left"))

    d = d.withColumn("batch", batch_of("doc_id"))
    index = d.groupBy("batch").applyInArrow(_index(ranges, window, gram), "range int, batch int, sides array<long>, block array<long>")
    flags = cut(index.groupBy("range").applyInArrow(_family, "batch int, seen array<long>, before array<long>, after array<long>"))
    release(spark)
    kind = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary, done array<long>, open array<long>, hash array<long>"
    settled = cut(d.groupBy("batch").cogroup(flags.groupBy("batch")).applyInArrow(lambda t, f: _settle_all(t, f, window, gram), kind))
    drop_cut(flags)
    release(spark)
    ready, waiting = settled.where("open is null"), settled.where("open is not null")
    asked = waiting.select("doc_id", F.explode("hash").alias("h"))
    least = asked.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    least = cut(least)
    release(spark)
    more = cut(asked.join(least, "h").where("doc_id > least").groupBy("doc_id").agg(F.collect_set("h").alias("more")))
    release(spark)
    rest = waiting.select("doc_id", "n_bytes", "text", "done", "open").join(more, "doc_id", "left").select("doc_id", "n_bytes", "text", "done", "open", "more")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rest = rest.mapInArrow(_finish(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return ready.select(*names).unionByName(rest.select(*names)).unionByName(none)


def _settle_all(t: pa.Table, flags: pa.Table, window: int, gram: int) -> pa.Table:
    if not t.num_rows:
        return pa.table({n: pa.array([], k) for n, k in _SETTLED.items()})
    return _settle(window, gram)(t, flags)
