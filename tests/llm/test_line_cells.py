"""Line deduplication compares lines of a key where they are: what leaves a task are edges, fewer than lines, not pairs."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from seasonforge.llm import linededup
from seasonforge.llm.textnp import U


def coded(lines):
    return pa.array(["".join(chr((1 << 16) + w) for w in line) for line in lines])


def edited(rng, line, edits):
    line = list(line)
    for _ in range(edits):
        at = rng.randrange(len(line))
        line[at : at + 1] = rng.choice(([rng.randrange(1 << 20)], [rng.randrange(1 << 20)], [], [line[at], rng.randrange(1 << 20)]))
    return line


def edges(lines, large=None):
    part = pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int64()), coded(lines)], ["id", "code"])
    every = np.full(linededup.KEY_BITS // 64, ~U(0))
    rows = list(linededup._dealt_keys(0.8, 4, every, large)(iter([part])))
    assert len(rows) == 1
    out = pa.Table.from_batches(linededup._candidates(0.8)(iter(rows)))
    return out["a"].to_pylist(), out["b"].to_pylist()


@pytest.mark.parametrize("dealt", (False, True))
def test_a_crowd_gives_edges_not_pairs(dealt):
    rng = random.Random(7)
    base = [rng.randrange(1 << 20) for _ in range(60)]
    crowd = [edited(rng, base, 2) for _ in range(300)]
    passage = base[:12]
    unlike = [[*(rng.randrange(1 << 20) for _ in range(25)), *passage, *(rng.randrange(1 << 20) for _ in range(25))] for _ in range(300)]
    part = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), coded(crowd)], ["id", "code"])
    keys = next(linededup._keys(0.8)(iter([part])))["key"].to_numpy()
    found, n = np.unique(keys, return_counts=True)
    a, b = edges(crowd + unlike, found[n > 50].view(U) if dealt else None)
    assert len(a) < (2 if dealt else 1) * len(keys)  # pairs would be some 100 times as many
    assert set(brute.components(range(300), [p for p in zip(a, b) if p[1] < 300]).values()) == {0}
    assert max(b) < 300  # lines that share a passage alone meet no other


def test_lines_of_few_words_are_told_apart():
    rng = random.Random(8)
    words = [rng.randrange(1 << 20) for _ in range(4)]
    lines = [[w for w in words for _ in range(rng.choice((2, 30, 60)))] for _ in range(40)]
    a, b = edges(lines)
    comp = brute.components(range(40), zip(a, b))
    alike = [(i, j) for i in range(40) for j in range(i) if brute.edits(lines[i], lines[j]) <= int(0.2 * max(len(lines[i]), len(lines[j])) + 1e-9)]
    assert all(comp[i] == comp[j] for i, j in alike) and len(set(comp.values())) > 10


def test_edits_of_many_pairs():
    rng = random.Random(9)
    lines = []
    for k in range(200):
        base = [rng.randrange(1 << 20) for _ in range(rng.choice((5, 9, 10, 23, 60)))]
        pair = [base, edited(rng, base, rng.randrange(2 + len(base) // 3))]
        lines += sorted(pair, key=len)
    words, size = np.array([w + (1 << 16) for x in lines for w in x], np.uint32), np.array([len(x) for x in lines])
    a, b = np.arange(0, 400, 2), np.arange(1, 400, 2)
    most = np.floor(0.2 * size[b] + 1e-9).astype(np.int64)
    want = [brute.edits(lines[i], lines[j]) <= m for i, j, m in zip(a, b, most, strict=True)]
    near = np.abs(size[a] - size[b]) <= most  # others never get here
    got = linededup._within(words, np.cumsum(size) - size, size, a[near], b[near], most[near])
    assert got.tolist() == [w for w, ok in zip(want, near, strict=True) if ok] and 40 < sum(want) < 180
