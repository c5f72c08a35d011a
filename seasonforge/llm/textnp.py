"""Vectorised word hashing of a batch of texts, on their UTF-8 bytes (numpy inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.  Bounds memory, not results.
BATCH = 2_000_000

U = np.uint64
#: Odd multiplier of the polynomial over bytes, and of the one over words.
BYTES_M, WORDS_M = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)

#: The lower-case form of each byte: A to Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACES = b" \t\n\v\f\r"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: Powers of the multiplier and of its inverse, as far as they were needed.
_POWERS = _INVERSE = np.ones(1, U)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of ``raw``; words are split at white space."""
    global _POWERS, _INVERSE
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if len(_POWERS) < n + 1:
        _POWERS, _INVERSE = powers(BYTES_M, n + 1), powers(U(pow(int(BYTES_M), -1, 2**64)), n + 1)
    space = IS_SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1 if n else np.empty(0, np.int64)
    if n and not space[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [n]])
    start, end = edge[0::2], edge[1::2]
    upto = np.zeros(n + 1, U)
    np.cumsum((b + U(1)) * _POWERS[:n], out=upto[1:])
    return mix((upto[end] - upto[start]) * _INVERSE[start] + (end - start).astype(U)), start


def batches(ids: list, texts: list[bytes]) -> Iterator[tuple[list, bytes, np.ndarray]]:
    """Runs of rows: ids, texts joined by a line feed, and where each text starts (with a last end)."""
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= BATCH or i == len(texts) - 1:
            part = texts[at : i + 1]
            yield ids[at : i + 1], b"\n".join(part), np.cumsum([0] + [len(x) + 1 for x in part])
            at, n = i + 1, 0


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null as an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def shingle_sets(raw: bytes, starts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text with fewer words has one hash, that of all its words; one without words has none.
    """
    h, at = word_hashes(raw.translate(LOWER))
    first = np.searchsorted(at, starts)
    run = np.zeros(max(0, len(h) - width + 1), U)
    for j in range(width):
        run = run * WORDS_M + h[j : j + len(run)]
    run = mix(run)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            yield np.unique(run[a : b - width + 1])
        elif b > a:
            short = np.full(1, b - a, U)
            for x in h[a:b]:
                short = short * WORDS_M + x
            yield mix(short ^ U(0x5851F42D4C957F2D))
        else:
            yield np.empty(0, U)
