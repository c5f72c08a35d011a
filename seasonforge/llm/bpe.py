"""Byte-level BPE: DuckDB recursive queries encode the distinct words of a partition, and decode ids.

The vocabulary file is a parameter.  ``ranks`` maps byte strings to ids; two neighbouring tokens merge if
their joined bytes are in the vocabulary, lowest rank first, leftmost on ties.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

#: Words over so many bytes are contracted by statements on a table of their own, see ``_long``.
LONG = 192
#: Most words a worker remembers; beyond it, it starts afresh.  Bounds memory, not results.
REMEMBER = 600_000
#: Words to a recursive query, code points of text to a batch.  Bound memory, not results.
WORDS, CHARS = 40_000, 2_000_000

#: A position's key is 256 * word + place, so neighbours in a word have consecutive keys.
STEP = """
WITH RECURSIVE state(k, tok, step) AS (
    SELECT w * 256 + pos, tok, 0 FROM start
    UNION ALL
    SELECT CASE WHEN s.k > b.at THEN s.k - 1 ELSE s.k END, CASE WHEN s.k = b.at THEN b.rank ELSE s.tok END, s.step + 1
    FROM state s
    JOIN (SELECT w, (best // 256)::INTEGER AS rank, (w * 256 + best % 256)::INTEGER AS at
          FROM (SELECT l.k // 256 AS w, min(m.rank * 256 + l.k % 256) AS best
                FROM (SELECT k, lead(k) OVER (ORDER BY k) AS nxt, tok::BIGINT * 1048576 + lead(tok) OVER (ORDER BY k) AS pair FROM state) l
                JOIN merges m USING (pair) WHERE l.nxt = l.k + 1 GROUP BY l.k // 256)) b ON b.w = s.k // 256
    WHERE s.k <> b.at + 1
), last AS (SELECT k // 256 AS w, max(step) AS step FROM state WHERE k % 256 = 0 GROUP BY ALL)
SELECT w, string_agg(tok::VARCHAR, ' ' ORDER BY k) AS ids FROM state JOIN last ON w = k // 256 AND last.step = state.step GROUP BY w
"""


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, pa.Array]]:
    """The ranks of a vocabulary file and its merge table; of fixed size, so a worker process keeps them."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                pairs[a << 20 | b] = rank
    return ranks, {"pair": pa.array(pairs, pa.int64()), "rank": pa.array(pairs.values(), pa.int64())}


class Codec:
    """One DuckDB database of a task, with the vocabulary and merge tables."""

    def __init__(self, path: str, pattern: str):
        self.ranks, merges = _vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, str] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
        self.table("merges", merges)
        pieces = pa.array([t.decode("latin-1") for t in self.ranks])
        self.table("vocab", {"id": pa.array(self.ranks.values(), pa.int32()), "piece": pieces})
        self.first = [self.ranks[bytes([i])] for i in range(256)]

    def table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def start(self, words: list[bytes]) -> None:
        n = [len(w) for w in words]
        flat = b"".join(words)
        self.table("start", {
            "w": pa.array([i for i, k in enumerate(n) for _ in range(k)], pa.int32()),
            "pos": pa.array([j for k in n for j in range(k)], pa.int32()),
            "tok": pa.array([self.first[c] for c in flat], pa.int32()),
        })

    def _short(self, words: list[bytes]) -> list[tuple[int, str]]:
        self.start(words)
        return self.db.execute(STEP).fetchall()

    def _long(self, word: bytes) -> list[int]:
        """One long word: a step contracts every place of the lowest rank, left to right without overlap.

        That equals one leftmost contraction at a time unless a contraction makes a pair of a lower rank;
        then the step is taken again with its leftmost place only.
        """
        run = self.db.execute
        self.start([word])
        run("CREATE OR REPLACE TABLE cur AS SELECT pos, tok FROM start")
        low = None
        while True:
            if low is None:
                low = run("SELECT min(rank) FROM (SELECT tok::BIGINT * 1048576 + lead(tok) OVER (ORDER BY pos) AS pair FROM cur) JOIN merges USING (pair)").fetchone()[0]
            if low is None:
                return [x for (x,) in run("SELECT tok FROM cur ORDER BY pos").fetchall()]
            run(f"""CREATE OR REPLACE TABLE hits AS
                WITH p AS (SELECT row_number() OVER (ORDER BY pos) AS i, pos, lead(pos) OVER (ORDER BY pos) AS nxt, tok::BIGINT * 1048576 + lead(tok) OVER (ORDER BY pos) AS pair FROM cur),
                h AS (SELECT p.*, i - row_number() OVER (ORDER BY i) AS island FROM p JOIN merges USING (pair) WHERE rank = {low})
                SELECT pos, nxt FROM h QUALIFY (row_number() OVER (PARTITION BY island ORDER BY i)) % 2 = 1""")
            many = f"""CREATE OR REPLACE TABLE new AS SELECT c.pos, CASE WHEN h.pos IS NULL THEN c.tok ELSE {low} END AS tok
                FROM cur c LEFT JOIN hits h ON c.pos = h.pos WHERE c.pos NOT IN (SELECT nxt FROM hits)"""
            run(many)
            now = run("SELECT min(rank) FROM (SELECT tok::BIGINT * 1048576 + lead(tok) OVER (ORDER BY pos) AS pair FROM new) JOIN merges USING (pair)").fetchone()[0]
            if now is not None and now < low:
                run("DELETE FROM hits WHERE pos > (SELECT min(pos) FROM hits)")
                run(many)
                now = None
            run("CREATE OR REPLACE TABLE cur AS SELECT * FROM new")
            low = now

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not remembered yet."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBER:
            self.known.clear()
            new = list(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        todo = []
        for w, b in zip(new, raw, strict=True):
            if len(b) > LONG:
                self.known[w] = " ".join(map(str, self._long(b)))
            elif b in self.ranks:
                self.known[w] = str(self.ranks[b])
            else:
                todo.append((w, b))
        for i in range(0, len(todo), WORDS):
            part = todo[i : i + WORDS]
            for k, ids in self._short([b for _, b in part]):
                self.known[part[k][0]] = ids

    def encode(self, texts: list[str]) -> list[str]:
        """For each text, its ids as decimal numbers joined by a space."""
        split = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*split))
        return [" ".join(map(self.known.__getitem__, words)) for words in split]

    def decode(self, ids: pa.Array) -> list[bytes]:
        """The bytes of each list of ids: its pieces, joined in order."""
        self.db.register("given", pa.table({"d": pa.array(range(len(ids)), pa.int64()), "ids": ids}))
        got = self.db.execute("""
            SELECT d, string_agg(piece, '' ORDER BY i)
            FROM (SELECT d, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM given) JOIN vocab USING (id) GROUP BY d""").fetchall()
        self.db.unregister("given")
        out = [b""] * len(ids)
        for d, s in got:
            out[d] = s.encode("latin-1")
        return out


    def close(self) -> None:
        """Gives back the memory of the database and of the words."""
        self.known.clear()
        self.db.close()
        pa.default_memory_pool().release_unused()


def _pieces(ids: Iterator, texts: Iterator) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows of about CHARS code points."""
    keys, part, n = [], [], 0
    for k, t in zip(ids, texts, strict=True):
        keys.append(k)
        part.append(t or "")
        n += len(part[-1])
        if n >= CHARS:
            yield keys, part
            keys, part, n = [], [], 0
    if keys:
        yield keys, part


def bpe_digest(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encodes every whole text and decodes the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` per row,
    and the columns named in ``keep``.

    A null or empty text has no tokens.  Very long texts and words are taken whole.  Repeated rows give
    repeated results.  Ties of rank go to the leftmost pair.  An empty table gives no rows.  Other columns
    are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        try:
            yield from coded_batches(codec, batches)
        finally:  # Spark uses the process again, for other operators too
            codec.close()

    def coded_batches(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for keys, texts in _pieces(b["doc_id"].to_pylist(), (x.as_py() for x in b["text"])):
                coded = codec.encode(texts)
                ids = pa.array([np.fromstring(s, np.int32, sep=" ") for s in coded], pa.list_(pa.int32()))
                back = codec.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [*[b[c].slice(at, len(keys)) for c in keep], pa.array(keys, pa.int64()), pa.compute.cast(pa.compute.list_value_length(ids), pa.int64()),
                     pa.array([hashlib.sha256(s.encode()).hexdigest() for s in coded]), pa.array([hashlib.sha256(x).hexdigest() for x in back])],
                    [*keep, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                at += len(keys)

    d = docs.select("doc_id", "text", *keep)
    more = "".join(f"{c} {d.schema[c].dataType.simpleString()}, " for c in keep)
    return d.mapInArrow(run, f"{more}doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
