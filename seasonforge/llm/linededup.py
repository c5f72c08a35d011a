"""Fuzzy line deduplication: equal word runs by pigeonhole, edit similarity, connected groups."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop_cut, release
from .textnp import BATCH, WORDS_M, U, mix, utf8, word_hashes

#: Lines of fewer words are left alone: greetings and headings repeat in clean documents.
MIN_WORDS = 5

#: How a byte is normalised: A to Z in lower case, digits as 0, other ASCII signs as spaces.
NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if c >= 128 or 97 <= c <= 122 or c == 10 else 32 for c in range(256)
)
#: Signs of scripts without spaces between words (Thai, Lao, Burmese, Khmer, Chinese, Japanese): each is a word.
UNSPACED = re.compile(rb"\xe0[\xb8-\xbb][\x80-\xbf]|\xe1[\x80-\x82\x9e\x9f][\x80-\xbf]|[\xe3-\xe9][\x80-\xbf]{2}|\xef[\xa4-\xab][\x80-\xbf]|\xf0[\xa0-\xbf][\x80-\xbf]{2}")

#: A line of a document, and bits of the number of parts that lines are dealt to.  Words that are held before lines are dealt.
LINE = np.dtype([("doc_id", "<i8"), ("id", "<i8"), ("line", "<i4"), ("size", "<i4")])
PART_BITS, HELD = 10, 8_000_000
#: First bytes of these signs.
LEADS = bytes([0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0])


def _coded(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """Runs of words of 20 bits as texts, a character for each word: the code points from 65,536 on.

    Each is four bytes of UTF-8, which are written directly.
    """
    c = h + np.uint32(1 << 16)
    raw = 0x808080F0 | c >> 18 | (c >> 12 & 63) << 8 | (c >> 6 & 63) << 16 | (c & 63) << 24
    ends = (4 * np.append(first, len(h))).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(raw.astype("<u4").tobytes()))


def _words(code: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of coded lines as numbers, and the number of words of each line."""
    ends = np.frombuffer(code.buffers()[1], np.int32)[code.offset : code.offset + len(code) + 1] if len(code) else np.zeros(1, np.int32)
    raw = np.frombuffer(code.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    return np.ascontiguousarray(raw).view("<u4"), np.diff(ends) // 4


def _normal(text: bytes) -> bytes:
    if not text.isascii() and len(text.translate(None, LEADS)) < len(text):
        text = UNSPACED.sub(rb" \g<0> ", text)
    return text.translate(NORMAL)


def _lines(min_words: int):
    def emit(docs: list, texts: list[bytes]) -> pa.RecordBatch:
        raw = b"\n".join(texts)
        h, pos = word_hashes(raw)
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)  # of all lines but the last
        line = np.searchsorted(ends, pos)
        first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(h) else np.empty(0, np.int64)
        size = np.diff(np.append(first, len(h)))
        first, size = first[size >= min_words], size[size >= min_words]
        of = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        h, line = h[first[of] + place], line[first]
        first = np.cumsum(size) - size
        whole = mix(np.add.reduceat(mix(h + place.astype(U) * WORDS_M), first) + size.astype(U)) if len(size) else h
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        before = np.searchsorted(ends, starts)  # lines before each document
        doc = np.searchsorted(before, line, "right") - 1
        rows = np.empty(len(size), LINE)
        rows["doc_id"], rows["line"], rows["id"], rows["size"] = np.array(docs, np.int64)[doc], line - before[doc], whole.view(np.int64), size
        return rows, (h >> U(44)).astype(np.uint32)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for part in parts:
            docs, texts, n = [], [], 0
            for doc, text in zip(part["doc_id"].to_pylist(), utf8(part["text"]), strict=True):
                docs.append(doc)
                texts.append(_normal(text))
                n += len(text)
                if n >= BATCH:
                    held.append(emit(docs, texts))
                    words += len(held[-1][1])
                    docs, texts, n = [], [], 0
                    if words >= HELD:
                        yield _dealt(held)
                        held, words = [], 0
            if docs:
                held.append(emit(docs, texts))
                words += len(held[-1][1])
        if held:
            yield _dealt(held)

    return run


def _dealt(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Lines dealt to ``PARTS`` parts by their ids: ``part, rows, words``."""
    rows, words = (np.concatenate(x) for x in zip(*held, strict=True))
    part = rows["id"].view(U) >> U(64 - PART_BITS)
    order = np.argsort(part, kind="stable")
    first, size = (np.cumsum(rows["size"], dtype=np.int64) - rows["size"])[order], rows["size"][order].astype(np.int64)
    words = words[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    part, at = np.unique(part[order], return_index=True)
    ends, upto = np.append(at, len(order)), np.append(0, np.cumsum(size))
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), _blobs(rows[order], ends), _blobs(words, upto[ends])], ["part", "rows", "words"])


def _blobs(x: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of ``x`` as bytes."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((x.itemsize * ends).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())


def _joined(blobs: pa.ChunkedArray, kind: np.dtype | type) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), kind)


def _occurrences(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All lines of a part; the first of equal ones has their number and the code: ``doc_id, line, id, n, code``."""
    for t in _parts(parts):
        rows, words = _joined(t["rows"], LINE), _joined(t["words"], np.uint32)
        first = np.cumsum(rows["size"], dtype=np.int64) - rows["size"]
        order = np.lexsort((rows["line"], rows["doc_id"], rows["id"]))
        rows, first = rows[order], first[order]
        new = np.append(True, rows["id"][1:] != rows["id"][:-1])
        at = np.flatnonzero(new)
        n = np.zeros(len(rows), np.int64)
        n[at] = np.diff(np.append(at, len(rows)))
        size = np.where(new, rows["size"], 0).astype(np.int64)
        before = np.cumsum(size) - size
        code = _coded(words[np.repeat(first - before, size) + np.arange(size.sum())], before)
        code = pa.StringArray.from_buffers(len(rows), code.buffers()[1], code.buffers()[2], pa.array(new).buffers()[1])
        for k in range(0, len(rows), SLICE):
            cols = [pa.array(np.ascontiguousarray(rows[c][k : k + SLICE])) for c in ("doc_id", "line", "id")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n[k : k + SLICE]), code.slice(k, SLICE)], ["doc_id", "line", "id", "n", "code"])


def _rebuild(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the lines whose numbers are listed."""
    for part in parts:
        lines, kept = [], []
        for text, gone in zip(part["text"].to_pylist(), part["gone"].to_pylist(), strict=True):
            out = (text or "").split("\n")
            lines.append(len(out) if text is not None else 0)
            if gone:
                drop = set(gone)
                text = "\n".join([x for i, x in enumerate(out) if i not in drop])
            kept.append(text)
        names = part.schema.names
        cols = [part[c] for c in names if c not in ("text", "gone")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(kept, pa.string()), pa.array(lines, pa.int64())], [*[c for c in names if c not in ("text", "gone")], "text", "lines"])


#: Words of 64 parities of the counts of a line's words by bucket: an edit changes two of them at most.
NARROW = 4
#: Buckets of counts of a line's words, up to 255: they tell lines of a few repeated words apart, which parities do not.
COUNTS = 16
#: Lines of more words also have parities in 64 * WIDE buckets: the narrow ones are full at some 300 words.
LONG, WIDE = 192, 16
#: Most lines of a key that stay together, or of connected lines that a task compares; rows of a block of larger groups.
SMALL_KEY, BLOCK = 4_096, 4_096
#: Most words of a key.
GRAM = 3
#: Chance of finding no common key for a pair just at the similarity, its edits spread as badly as they can be.
MISS = 0.001
#: Lines of which fewer runs are taken by hash give all their runs.
POOR = 4
#: Bits of the table of repeated keys: 4 MB, more for more keys (16 bits a key), 32 MB at most.
KEY_BITS, MOST_KEY_BITS = 1 << 25, 1 << 28
#: Lines whose keys are made at once, and the bits of their number below a key's.
SLICE, PLACE = 16_384, U(20)
#: A line of a key.
ROW = np.dtype([("key", "<u8"), ("id", "<i8"), ("size", "<i4"), ("low", "<i4"), ("high", "<i4"), ("guest", "<i4"), ("parities", "<u8", (NARROW,)), ("counts", "u1", (COUNTS,))])
#: Lines of a part of keys, about.
PART_LINES = 16_384
#: Lines whose groups are compared at once (those of one group always), and pairs or cells of edit tables.
ROWS, PAIRS, CELLS = 20_000, 500_000, 200_000
#: Buckets of counts of words.
BUCKETS = 1_024


@lru_cache(maxsize=None)
def _needs(size: int, similarity: float) -> tuple[bool, bool, float]:
    """Which keys a line of ``size`` words needs: single words, the pairs of words, and the share of its runs of GRAM words.

    A pair whose longer line has L words has k = (1 - similarity) * L edits at most, so L - k words of it
    are equal in k + 1 runs at most: one run has (L - k) / (k + 1) words or more, and L - k - (GRAM - 1) * (k + 1)
    runs of GRAM words are equal.  Where these are many, a share of all runs by hash is enough.
    """
    longest = np.arange(size, int(size / similarity + 1e-9) + 1)
    k = np.floor((1 - similarity) * longest + 1e-9)
    longest, k = longest[k > 0], k[k > 0]
    run = np.ceil((longest - k) / (k + 1))
    grams = np.maximum(longest - k - (GRAM - 1) * (k + 1), 1)[run >= GRAM]
    share = np.where(grams > GRAM, 1 - MISS ** (1 / grams), 1.0).max(initial=0.0)
    return bool((run == 1).any()), bool((run == 2).any()), float(share)


def _runs(c: np.ndarray, size: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines, with the line and the place in it: two lines that can be linked have an equal one, but for ``MISS``."""
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(c)) - (np.cumsum(size) - size)[line]
    left = size[line] - place  # words from here to the end of the line
    needs = np.array([_needs(n, similarity) for n in size.tolist()], float).reshape(-1, 3)
    share = np.minimum(needs[:, 2] * 2.0**63, 2.0**63).astype(U)
    keys, at, gram = [], [], np.zeros(len(c), U)
    for q in range(1, GRAM + 1):
        gram = gram * WORDS_M + np.pad(c[q - 1 :], (0, min(q - 1, len(c))))
        if q < GRAM:
            here = np.flatnonzero((needs[:, q - 1] > 0)[line] & (left >= q)) if needs[:, q - 1].any() else np.empty(0, np.int64)
            keys.append(mix(gram[here] + U(q)))
        else:
            h = mix(gram + U(q))
            take = (h >> U(1) < share[line]) & (left >= q)
            # lines of repeated runs, of which hardly any is taken, give all
            poor = (np.bincount(line[take], minlength=len(size)) < POOR) & (needs[:, 2] > 0)
            here = np.flatnonzero((take | poor[line]) & (left >= q)) if poor.any() else np.flatnonzero(take)
            keys.append(h[here])
        at.append(here)
    at = np.concatenate(at)
    return np.concatenate(keys), line[at], place[at]


def _dealt_keys(similarity: float, bits: int, wanted: np.ndarray | None = None, large: np.ndarray | None = None):
    """Keys of lines, once a line, dealt to 2^``bits`` parts: ``part, keys``.  With ``wanted``, those whose bit is set there: ``part, rows, wide``.

    These have their lines (``ROW``): the first and last place of the key in the line, and parities of the line's words; wide
    ones of long lines are apart.  A key that is ``large`` is dealt by classes of length; a line also is a guest in the
    class above its own, so any two lines of like length meet once when guests of one class are not compared.
    """
    parts = 1 << bits
    base = math.log(1.01 / similarity)

    def counted(h: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        both = np.sort(h >> PLACE << PLACE | owner.astype(U))
        key = both[np.append(True, both[1:] != both[:-1])[: len(both)]] >> PLACE
        ends = np.searchsorted(key, np.arange(parts + 1, dtype=U) << U(64 - int(PLACE) - bits))
        full = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), _blobs(key, ends).take(pa.array(full))], ["part", "keys"])

    def rows(ids: np.ndarray, c: np.ndarray, size: np.ndarray, h: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        at = h >> PLACE & U(64 * len(wanted) - 1)
        hit = np.flatnonzero(wanted[at >> U(6)] >> (at & U(63)) & U(1))
        h, owner, place = h[hit], owner[hit], place[hit]
        both = h >> PLACE << PLACE | owner.astype(U)
        order = np.argsort(both)
        both, place = both[order], place[order]
        at = np.flatnonzero(np.append(True, both[1:] != both[:-1])[: len(both)])
        low, high = (f.reduceat(place, at) if len(at) else place for f in (np.minimum, np.maximum))
        key, owner = both[at] >> PLACE, (both[at] & (U(1 << int(PLACE)) - U(1))).astype(np.int64)
        guest = np.zeros(len(key), bool)
        if large is not None and len(large):
            many = np.flatnonzero(large[np.minimum(np.searchsorted(large, key), len(large) - 1)] == key)
            level = np.floor(np.log(size[owner[many]]) / base).astype(np.int64) + 1
            dealt = [mix(key[many] * WORDS_M + (level + j).astype(U)) >> PLACE for j in (0, 1)]
            key[many] = dealt[0]
            key, owner, low, high = np.append(key, dealt[1]), np.append(owner, owner[many]), np.append(low, low[many]), np.append(high, high[many])
            guest = np.append(guest, np.ones(len(many), bool))
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        used, of = np.unique(owner, return_inverse=True)
        narrow, counts, long, wide = _signs(c, size, used)
        out = np.empty(len(key), ROW)
        out["key"], out["id"], out["size"], out["low"], out["high"], out["guest"] = key, ids[owner], size[owner], low[order], high[order], guest[order]
        out["parities"], out["counts"] = narrow[of], counts[of]
        long = np.searchsorted(long, of[size[owner] > LONG])
        ends = np.searchsorted(key, np.arange(parts + 1, dtype=U) << U(64 - int(PLACE) - bits))
        upto = np.append(0, np.cumsum(out["size"] > LONG))[ends]
        full = np.flatnonzero(np.diff(ends))
        blobs = [_blobs(x, e).take(pa.array(full)) for x, e in ((out, ends), (wide[long].ravel(), WIDE * upto))]
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), *blobs], ["part", "rows", "wide"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, SLICE):
                part = whole.slice(k, SLICE)
                c, size = _words(part["code"])
                c = mix(c.astype(U))
                h, owner, place = _runs(c, size, similarity)
                yield counted(h, owner) if wanted is None else rows(part["id"].to_numpy(), c, size, h, owner, place)

    return run


def _sorted_groups(parts: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task, sorted by their first column, in tables of some ``rows``: no group is torn apart."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= rows:
            t = pa.Table.from_batches(held)
            key = t.column(0).to_numpy()
            at = int(np.searchsorted(key, key[-1]))
            if at:
                yield t.slice(0, at)
            held, n = t.slice(at).combine_chunks().to_batches(), n - at
            rows = max(rows, 2 * n) if not at else rows
    if n:
        yield pa.Table.from_batches(held)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each part, in order of ``part``."""
    for t in _sorted_groups(batches, 1):
        part = t["part"].to_numpy()
        at = [*np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist(), len(part)]
        for x, y in itertools.pairwise(at):
            yield t.slice(x, y - x)


def _repeated(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of more than one line, with their number."""
    for t in _parts(parts):
        key = np.sort(_joined(t["keys"], np.int64))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(at, len(key)))
        yield pa.RecordBatch.from_arrays([pa.array(key[at][n > 1]), pa.array(n[n > 1])], ["key", "n"])


def _keys(similarity: float, wanted: np.ndarray | None = None):
    """``key`` of lines, one by one, as they are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _dealt_keys(similarity, 0, wanted)(batches):
            keys = _joined(t["keys"], np.int64) if wanted is None else np.ascontiguousarray(_joined(t["rows"], ROW)["key"]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys)], ["key"])

    return run


def _bits(keys: DataFrame, bits: int = KEY_BITS) -> np.ndarray:
    """A table of ``bits`` bits in which the last bits of ``keys(key)`` are set: bounded for any number of keys."""
    at = F.col("key").bitwiseAND(bits - 1)
    found = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(key & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, U)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(U)
    return out


def _parities(c: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Parities of the counts of a line's words in 64 * ``width`` buckets, ``width`` numbers a line."""
    out = np.zeros((len(size), width), U)
    if len(c):
        full = np.flatnonzero(size)
        first = (np.cumsum(size) - size)[full]
        bit, part = U(1) << (c & U(63)), c >> U(6) & U(width - 1)
        for j in range(width):
            out[full, j] = np.bitwise_xor.reduceat(np.where(part == U(j), bit, U(0)), first)
    return out


def _wide(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parities of the counts of a line's words in 64 * ``WIDE`` buckets."""
    for part in parts:
        c, size = _words(part["code"])
        out = _parities(mix(mix(c.astype(U)) ^ U(0x5BD1E995)), size, WIDE)
        offsets = pa.array(np.arange(len(size) + 1) * WIDE, pa.int32())
        yield pa.RecordBatch.from_arrays([part["id"], pa.ListArray.from_arrays(offsets, pa.array(out.ravel().view(np.int64)))], ["id", "wide"])


def _picked(c: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some lines, one after the other, and their numbers of words."""
    first, size = (np.cumsum(size) - size)[rows], size[rows]
    return c[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def _signs(c: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Narrow parities of lines, their counts, and which of them are long, with their wide parities.  ``c`` has mixed words."""
    c, size = _picked(c, size, rows)
    at = np.repeat(np.arange(len(size)), size) * COUNTS + (c >> U(50)).astype(np.int64) % COUNTS
    counts = np.bincount(at, minlength=len(size) * COUNTS).reshape(-1, COUNTS).clip(max=255).astype(np.uint8)
    long = np.flatnonzero(size > LONG)
    return _parities(c, size, NARROW), counts, long, _parities(mix(_picked(c, size, long)[0] ^ U(0x5BD1E995)), size[long], WIDE)


class _Lines:
    """Lines of a task by group and length, and which pairs of a group lengths and parities allow."""

    def __init__(self, group: np.ndarray, size: np.ndarray, narrow: np.ndarray, counts: np.ndarray, long: np.ndarray, wide: np.ndarray, similarity: float):
        both = np.cumsum(np.append(False, group[1:] != group[:-1])[: len(group)]) << 32 | size  # groups are runs of rows
        self.order = order = np.argsort(both, kind="stable")
        self.size = size[order].astype(np.int64)
        self.most = np.floor((1 - similarity) * self.size + 1e-9).astype(np.int64)
        last = np.floor(self.size / similarity + 1e-9).astype(np.int64)
        both = both[order]
        self.pairs = np.searchsorted(both, (both >> 32 << 32) | last, "right") - np.arange(len(both)) - 1
        self.narrow, self.counts, self.wide = narrow[order], counts[order].astype(np.int16), wide
        self.long = np.full(len(size), -1)
        self.long[long] = np.arange(len(long))
        self.long = self.long[order]
        self.label = np.arange(len(size))

    def batches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of lines of like length, the longer second, some ``PAIRS`` at once; those that are connected by then are left out."""
        ends = np.cumsum(self.pairs)
        at = 0
        while at < len(ends):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = self.pairs[at:upto]
            i = np.repeat(np.arange(at, upto), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            rest = self.label[i] != self.label[j]
            yield i[rest], j[rest]
            at = upto

    def allowed(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        most = 2 * self.most[j]
        ok = np.flatnonzero(np.bitwise_count(self.narrow[i] ^ self.narrow[j]).sum(axis=1, dtype=np.int64) <= most)
        ok = ok[np.abs(self.counts[i[ok]] - self.counts[j[ok]]).sum(axis=1, dtype=np.int64) <= most[ok]]
        both = (self.long[i[ok]] >= 0) & (self.long[j[ok]] >= 0)
        if both.any():
            x, y = (self.wide[self.long[d[ok[both]]]] for d in (i, j))
            good = np.ones(len(ok), bool)
            good[both] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[ok[both]]
            ok = ok[good]
        return ok

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Connects the lines of each pair: the label of a line is its first connected one."""
        label = self.label
        while len(i):
            x, y = label[i], label[j]
            rest = x != y
            i, j, x, y = i[rest], j[rest], x[rest], y[rest]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                new = label[label]
                if (new == label).all():
                    break
                label = new
        self.label = label

    def least(self, ids: np.ndarray) -> np.ndarray:
        """For each line the smallest of ``ids`` of those that it is connected with."""
        out = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(out, self.label, ids)
        return out[self.label]

    def compare(self, c: np.ndarray, first: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
        """Connects those of the pairs (sorted by ``i``) that are alike, as far as they are not connected by others."""
        ok = self.allowed(i, j)
        i, j = i[ok], j[ok]
        ok = _shared(c, first, self.size, i, j, self.most[j])
        i, j = i[ok], j[ok]
        few = 1
        while len(i):  # a few pairs of each line first: they connect most lines of a crowd
            new = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            now = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i)))) < few
            x, y = i[now], j[now]
            hit = _within(c, first, self.size, x, y, self.most[y])
            self.join(x[hit], y[hit])
            rest = ~now & (self.label[i] != self.label[j])
            i, j, few = i[rest], j[rest], 4 * few


def _candidates(similarity: float):
    """Lines that share a key and may be alike, as edges that connect all of them: ``a, b``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(parts):
            rows = _joined(t["rows"], ROW)
            wide = _joined(t["wide"], U).reshape(-1, WIDE)
            long = np.full(len(rows), -1)
            long[rows["size"] > LONG] = np.arange(len(wide))
            order = np.argsort(rows["key"], kind="stable")
            rows, long = rows[order], long[order]
            at = np.flatnonzero(long >= 0)
            d = _Lines(rows["key"], rows["size"].astype(np.int64), rows["parities"], rows["counts"], at, wide[long[at]], similarity)
            ids, low, high, guest = (rows[c][d.order] for c in ("id", "low", "high", "guest"))
            for i, j in d.batches():
                # edits before and after the run move it in a line: by as many words at least
                before = np.maximum(np.maximum(low[i] - high[j], low[j] - high[i]), 0)
                shift = d.size[j] - d.size[i]
                after = np.maximum(np.maximum(shift + low[i] - high[j], low[j] - high[i] - shift), 0)
                ok = np.flatnonzero((before + after <= d.most[j]) & (guest[i] & guest[j] == 0) & (ids[i] != ids[j]))
                i, j = i[ok], j[ok]
                ok = d.allowed(i, j)
                d.join(i[ok], j[ok])
            least = d.least(ids)
            moved = np.flatnonzero(least != ids)
            yield pa.RecordBatch.from_arrays([pa.array(least[moved]), pa.array(ids[moved])], ["a", "b"])

    return run


def _alike(similarity: float):
    """Lines of groups that candidates connect, all pairs of which are compared: ``node, component`` of those that have a partner."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _sorted_groups(parts, ROWS):
            ids = t["id"].to_numpy()
            c, size = _words(t["code"].combine_chunks())
            size = size.astype(np.int64)
            d = _Lines(t["cell"].to_numpy(), size, *_signs(mix(c.astype(U)), size, np.arange(len(size))), similarity)
            ids, first = ids[d.order], (np.cumsum(size) - size)[d.order]
            for i, j in d.batches():
                d.compare(c, first, i, j)
            linked = np.flatnonzero(np.bincount(d.label, minlength=len(ids))[d.label] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(d.least(ids)[linked])], ["node", "component"])

    return run


def _shared(c: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Pairs of lines whose counts of words, by bucket, are not too far apart: an edit changes two of them by one at most."""
    used, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = of[: len(a)], of[len(a) :]
    out = np.zeros(len(a), bool)
    n = max(1, 64 * CELLS // BUCKETS)
    lines = np.split(used, np.arange(n, len(used), n))
    bags = np.concatenate([np.empty((0, BUCKETS), np.int16), *[_bags(c, first[k], size[k]) for k in lines]])
    for k in range(0, len(a), CELLS // 64):
        at = slice(k, k + CELLS // 64)
        out[at] = np.abs(bags[x[at]] - bags[y[at]]).sum(axis=1, dtype=np.int64) <= 2 * most[at]
    return np.flatnonzero(out)


def _bags(c: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Counts of the words of lines in ``BUCKETS`` buckets."""
    words = c[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    at = (mix(words.astype(U)) >> U(40)).astype(np.int64) % BUCKETS
    return np.bincount(np.repeat(np.arange(len(size)), size) * BUCKETS + at, minlength=len(size) * BUCKETS).reshape(-1, BUCKETS).clip(max=1 << 14).astype(np.int16)


def _within(c: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether lines ``a`` and ``b``, the longer ones, are ``most`` edits apart at most, pair by pair."""
    out = np.zeros(len(a), bool)
    order = np.argsort(size[b], kind="stable")
    while len(order):
        some = min(len(order), max(1, CELLS // int(size[b[order[: 1 + CELLS // 8]]].max())))
        at, order = order[:some], order[some:]
        x, y = (_table(c, first[d[at]], size[d[at]], int(size[b[at]].max())) for d in (a, b))
        near = (x != y).sum(axis=1) <= most[at]  # words changed in place, and the surplus: an upper bound
        out[at[near]] = True
        rest = np.flatnonzero(~near & (most[at] > 0))
        wide = max(1, CELLS // (2 * int(most[at].max(initial=0)) + 1))
        for k in range(0, len(rest), wide):
            r = rest[k : k + wide]
            out[at[r]] = _banded(x[r], y[r], size[a[at[r]]], size[b[at[r]]], most[at[r]])
    return out


def _table(c: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Lines as rows of words, filled up with zeros."""
    at = np.arange(width)
    return np.where(at < size[:, None], c[np.minimum(first[:, None] + at, len(c) - 1)], np.uint32(0))


def _banded(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether edit distances of rows of ``x`` and ``y`` are ``most`` at most; only prefixes whose lengths are that near are compared."""
    out = np.zeros(len(x), bool)
    band = int(most.max())
    y = np.pad(y, ((0, 0), (band, band + 1)))
    step = np.arange(-band, band + 1, dtype=np.int32)
    far = np.int32(1 << 29)
    row = np.tile(np.where(step >= 0, step, far), (len(x), 1))  # by the surplus of y's prefix
    live = np.arange(len(x))
    for t in range(1, int(of_x.max()) + 1):
        new = row + (x[:, t - 1 : t] != y[:, t - 1 : t + 2 * band])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        row = np.minimum.accumulate(new - step, axis=1) + step
        done = np.flatnonzero(of_x == t)
        out[live[done]] = row[done, of_y[done] - t + band] <= most[done]
        if t % 8 == 0:
            on = np.flatnonzero((of_x > t) & (row.min(axis=1) <= most))
            if len(on) < 0.8 * len(live):
                x, y, of_x, of_y, most, live, row = x[on], y[on], of_x[on], of_y[on], most[on], live[on], row[on]
                if not len(on):
                    break
    return out


def line_groups(lines: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Groups of fuzzily equal lines: ``node, component`` for distinct normalised lines that have a partner.

    ``lines(id, code)`` has each line once.  Lines are linked when their edit similarity in words is at least
    ``similarity``.  Keys are counted first; only those of two lines or more are made again, with the lengths of their
    lines, the places of the key in them and parities of their words.  Pairs of a key that these allow become edges that
    connect them, as many as lines at most.  In each group of lines that edges connect all pairs are compared that are
    not linked by others yet: in a task, or in blocks if the group is very large.

    Keys of very many lines are dealt by classes of length, so no task has to hold all their lines.
    """
    spark = lines.sparkSession
    bits = min(14, max(4, (lines.count() // PART_LINES).bit_length()))
    keys = lines.select("code").mapInArrow(_dealt_keys(similarity, bits), "part int, keys binary").repartition("part").sortWithinPartitions("part")
    shared = cut(keys.mapInArrow(_repeated, "key long, n long"))
    release(spark)
    table = min(max(KEY_BITS, 1 << (16 * shared.count()).bit_length()), MOST_KEY_BITS)
    large = np.sort(shared.where(F.col("n") > SMALL_KEY).select("key").toArrow()["key"].to_numpy().view(U))
    wanted = _bits(shared, table)
    drop_cut(shared)
    rows = lines.select("id", "code").mapInArrow(_dealt_keys(similarity, bits, wanted, large), "part int, rows binary, wide binary").repartition("part").sortWithinPartitions("part")
    edges = cut(rows.mapInArrow(_candidates(similarity), "a long, b long").distinct())
    release(spark)
    cells = cut(connected_components(edges).toDF("id", "cell"))
    many = cut(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_KEY))
    known = cut(lines.select("id", "code").join(cells, "id"))
    drop_cut(cells)
    release(spark)
    if many.isEmpty():
        small = known
    else:
        small = known.join(many, "cell", "left_anti")
    small = small.select("cell", "id", "code").repartition("cell").sortWithinPartitions("cell")
    groups = cut(small.mapInArrow(_alike(similarity), "node long, component long"))
    if not many.isEmpty():
        groups = groups.unionByName(_crowds(cut(known.join(many, "cell")), edges, similarity))
    for done in (edges, known, many):
        drop_cut(done)
    return groups


def _crowds(many: DataFrame, edges: DataFrame, similarity: float) -> DataFrame:
    """Groups of the lines ``many(cell, id, code, n)``: edges are compared first, then in blocks what they leave apart."""
    most = F.floor((1 - similarity) * F.greatest(F.length("code_a"), F.length("code_b")) + 1e-9).cast("int")
    x, y = (many.select(F.col("id").alias(c), F.col("code").alias(f"code_{c}")) for c in "ab")
    edits: Column = F.call_function("levenshtein", F.col("code_a"), F.col("code_b"), most)
    links = cut(edges.join(x, "a").join(y, "b").where(edits >= 0).select("a", "b"))
    groups = cut(connected_components(links))
    rows = many.join(groups.select(F.col("node").alias("id"), F.col("component").alias("comp")), "id", "left")
    more = _in_blocks(rows.select(F.col("cell").alias("key"), "id", F.coalesce("comp", "id").alias("comp"), "n", "code"), similarity)
    if more.isEmpty():
        return groups
    return connected_components(groups.toDF("a", "b").unionByName(more))


def _in_blocks(many: DataFrame, similarity: float) -> DataFrame:
    """Links of keys of very many lines, that connect what is not connected yet; each key is cut into blocks."""
    many = many.withColumn("n", F.ceil(F.col("n") / BLOCK).cast("int"))
    many = many.withColumn("p", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    left = many.withColumn("h", F.col("p")).withColumn("k", F.explode(F.sequence("p", F.col("n") - 1)))
    right = many.withColumn("k", F.col("p")).withColumn("h", F.explode(F.sequence(F.lit(0), "p")))
    on = ["key", "h", "k"]
    left, right = (d.select(*[F.col(c).alias(c) for c in (*on, "id", "comp", "code")]) for d in (left, right))
    return cut(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_linked(similarity), "a long, b long"))


def _linked(similarity: float):
    """Two blocks of lines: links that connect, with what is known, all alike lines of different blocks, or of a block with itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        own = left["h"][0] == left["k"][0]
        t = left if own else pa.concat_tables([left, right])
        c, size = _words(t["code"].combine_chunks())
        size = size.astype(np.int64)
        d = _Lines(np.zeros(len(size), np.int64), size, *_signs(mix(c.astype(U)), size, np.arange(len(size))), similarity)
        ids, first, block = t["id"].to_numpy()[d.order], (np.cumsum(size) - size)[d.order], (np.arange(len(size)) >= left.num_rows)[d.order]
        _, head, group = np.unique(t["comp"].to_numpy()[d.order], return_index=True, return_inverse=True)
        before = head[group]  # the first line of each component that is known
        d.label = before.copy()
        for i, j in d.batches():
            rest = own | (block[i] != block[j])
            d.compare(c, first, i[rest], j[rest])
        moved = np.flatnonzero(d.label != before)
        return pa.table({"a": pa.array(ids[d.label[moved]]), "b": pa.array(ids[moved])})

    return run


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, with fuzzily repeated lines removed from ``text``, plus ``_lines, _gone long``.

    Lines end at line feeds and are normalised (case, digits, ASCII signs, white space; a sign of a script
    without spaces is a word).  Lines of equal normal form, and lines whose edit similarity (in words,
    1 - edits / longer length) is at least ``similarity``, are linked; linked lines form groups.  Of each
    group the occurrence with the smallest (doc_id, line number) stays; all others go.  Words are compared
    by 20 bits of their hashes, so of a million different words two pass as equal about once.

    Lines under ``min_words`` words and lines without any word always stay, as do texts of null id.  Null
    and empty texts are returned as they are.  Repeated rows are one document and keep the same lines.  An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    dealt = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_lines(max(1, min_words)), "part int, rows binary, words binary")
    whole = cut(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(_occurrences, "doc_id long, line int, id long, n long, code string"))
    release(spark)
    lines = whole.select("doc_id", "line", "id")
    distinct = whole.where("n > 0")
    groups = line_groups(distinct.select("id", "code"), similarity)
    firsts = distinct.select("id", F.struct("doc_id", "line").alias("first"), "n")
    firsts = cut(firsts.join(groups.withColumnRenamed("node", "id"), "id", "left"))
    best = cut(firsts.where("component is not null").groupBy("component").agg(F.min("first").alias("best")))
    keep = cut(firsts.join(best, "component", "left").where("n > 1 or best is not null").select("id", F.coalesce("best", "first").alias("keep")))
    gone = lines.join(keep, "id").where("keep <> struct(doc_id, line)")
    gone = cut(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    for done in (whole, keep, firsts, best):
        drop_cut(done)
    release(spark)
    cols = docs.columns
    rest = [c for c in cols if c != "text"]
    packed = docs.select(F.col("doc_id").alias("_key"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    joined = packed.join(gone.withColumnRenamed("doc_id", "_id"), F.col("_key") == F.col("_id"), "left").select("row", "text", "gone", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n"))
    kind = joined.select("row").schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_rebuild, f"row {kind}, n long, text string, lines long")
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in cols], F.col("lines").alias("_lines"), F.col("n").alias("_gone"))


def line_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_removed, kept_sha256`` per row."""
    out = dedup_lines(docs.select("doc_id", "text"), min_words=1)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
