"""Line deduplication tells unlike long lines apart before it compares them, and reads again only keys of three lines or more."""

import random

import brute
import numpy as np
import pyarrow as pa

from seasonforge.llm import linededup
from seasonforge.llm.textnp import U


def coded(lines):
    return pa.array(["".join(chr((1 << 16) + w) for w in line) for line in lines])


def test_parities_of_long_lines():
    rng = random.Random(5)
    base = [[rng.randrange(1 << 20) for _ in range(400)] for _ in range(6)]
    near = []
    for line in base:
        other = list(line)
        for at in rng.sample(range(400), 60):
            other[at] = rng.randrange(1 << 20)
        near.append(other[3:])
    part = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), coded(base + near)], ["id", "code"])
    wide = next(linededup._wide(iter([part])))["wide"]
    bits = np.stack([np.array(x.as_py(), np.int64).view(U) for x in wide])
    apart = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    assert all(apart(i, i + 6) <= 2 * brute.edits(base[i], near[i]) <= 2 * 80 for i in range(6))
    assert all(apart(i, j) > 2 * 80 for i in range(6) for j in range(i))


def test_only_wanted_keys():
    rng = random.Random(6)
    part = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), coded([[rng.randrange(1 << 20) for _ in range(30)] for _ in range(20)])], ["id", "code"])
    every = next(linededup._keys(0.8)(iter([part])))["key"].to_numpy()
    at = every[::7].view(U) & U(linededup.KEY_BITS - 1)
    wanted = np.zeros(linededup.KEY_BITS // 64, U)
    np.bitwise_or.at(wanted, at >> U(6), U(1) << (at & U(63)))
    some = next(linededup._keys(0.8, wanted)(iter([part])))["key"].to_numpy()
    assert set(every[::7]) <= set(some) < set(every)
