"""Language identification: language family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut


# Language families by ISO code.  Languages that are not listed are families of their own.
FAMILIES = {
    "Germanic": "af da de en fo fy is lb nds nl nn no sv yi",
    "Romance": "ca es fr gl it la oc pt ro",
    "Slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "Uralic": "et fi hu",
    "Turkic": "az kk ky tr uz",
    "Indic": "bn gu hi mr ne pa ur",
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs.split()}

#: At most so many documents of a language are used to fit; those with the smallest hash of their id.
SAMPLE = 600
#: Parts of a language whose smallest hashes are found first.
SHARDS = 64
#: Hashed features of each order (byte pairs and byte triples of the normalised text).
BITS = 15

#: A to Z in lower case; ASCII that is not a letter as a space.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def features(raw: bytes) -> np.ndarray:
    """Hashed byte pairs and triples of normalised text, as feature numbers in order of position."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)  # runs of spaces are one
    b = b[keep]
    pair = (b[:-1] << np.uint32(8)) | b[1:]
    triple = (pair[:-1] << np.uint32(8)) | b[2:]
    spread = lambda x: (x * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return np.concatenate([spread(pair), spread(triple) + np.uint32(1 << BITS)])


def _vector(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and square roots of their frequencies: length 1 whatever the size of the text."""
    count = np.bincount(f)
    ids = count.nonzero()[0]
    return ids, np.sqrt(count[ids] / max(1, len(f)))


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, c: float = 10.0, rounds: int = 12) -> np.ndarray:
    """A linear SVM (hinge loss, bias as a last weight) by dual coordinate ascent; y is +1 or -1."""
    rng = np.random.default_rng(7)
    w, bias, alpha = np.zeros(2 << BITS), 0.0, np.zeros(len(y))
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            ids, v = rows[i]
            new = min(c, max(0.0, alpha[i] + (1 - y[i] * (w[ids] @ v + bias)) / 2))  # a row and its bias have length 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[ids] += step * v
                bias += step
                alpha[i] = new
    return np.append(w, bias)


class Model:
    """Machines for families (one against one) and for the languages of each family (one against one)."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        self.langs = sorted(set(langs))
        families = [FAMILY.get(x, x) for x in langs]
        rows = [_vector(features(t.translate(NORMAL))) for t in texts]
        self.tree = {f: sorted({k for k, g in zip(langs, families, strict=True) if g == f}) for f in sorted(set(families))}
        self.pairs, weights = {}, []
        for group, of in [(sorted(self.tree), np.array(families)), *[(v, np.array(langs)) for v in self.tree.values()]]:
            for a, b in combinations(group, 2):
                at = np.flatnonzero((of == a) | (of == b))
                self.pairs[a, b] = len(weights)
                weights.append(_svm([rows[i] for i in at], np.where(of[at] == a, 1.0, -1.0)))
        w = np.stack(weights) if weights else np.zeros((0, (2 << BITS) + 1))
        self.weights, self.bias = np.ascontiguousarray(w[:, :-1].T.astype(np.float32)), w[:, -1]

    def _elect(self, group: list[str], margin: np.ndarray) -> tuple[str, float]:
        """Most wins, then the largest sum of margins; certainty is that of the winner's closest machine."""
        if len(group) == 1:
            return group[0], 1.0
        of = {a: [] for a in group}
        for a, b in combinations(group, 2):
            m = margin[self.pairs[a, b]]
            of[a].append(m)
            of[b].append(-m)
        best = max(group, key=lambda g: (sum(m > 0 for m in of[g]), sum(of[g])))
        return best, float(1 / (1 + np.exp(-4 * min(of[best]))))

    def predict(self, text: bytes) -> tuple[str, float]:
        """Language and certainty of a whole text."""
        if not self.langs:
            return "und", 0.0
        if not self.pairs:
            return self.langs[0], 1.0
        ids, v = _vector(features(text.translate(NORMAL)))
        margin = v @ self.weights[ids] + self.bias
        family, sure = self._elect(sorted(self.tree), margin)
        lang, more = self._elect(self.tree[family], margin)
        return lang, sure * more


def held_out() -> Column:
    """True for documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` documents of each language that are not held out: a bounded sample.

    They are those with the smallest hashes of their ids, found without the texts: first in each of SHARDS
    parts of a language, then in the language, so that no language is gathered in one task.  The driver gets
    ``sample`` texts of each language.
    """
    d = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text", F.xxhash64(F.lit(11), "doc_id").alias("h"))
    ids = d.select("lang", "h", F.xxhash64("text").alias("t"), F.pmod("h", F.lit(SHARDS)).alias("shard"))
    for parts in (["lang", "shard"], ["lang"]):
        ids = ids.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy("h", "t"))).where(F.col("rank") <= sample)
    top = cut(ids.select("lang", "h", "t").distinct())
    few = d.withColumn("t", F.xxhash64("text")).join(top, ["lang", "h", "t"]).dropDuplicates(["lang", "h", "t"]).select("lang", "h", "doc_id", "text").collect()
    drop_cut(top)
    few.sort(key=lambda r: (r.lang, r.h, r.doc_id is None, r.doc_id or 0, r.text))
    return Model([r.lang for r in few], [r.text.encode() for r in few])


def identify(docs: DataFrame, model: Model | None = None, sample: int = SAMPLE) -> DataFrame:
    """Language of every whole text: ``docs`` plus ``lang_pred string, score double``.

    Only the text is an input of a prediction.  A text that is null or has no letter is ``und`` with score
    0, as is every text when there is nothing to learn from.  Repeated rows give repeated results; ties
    between languages go to the first by name; an empty table gives no rows.  Other columns are kept.
    """
    model = model or fit(docs, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x features, a fixed size

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for p in parts:
            found = []
            for text in p["text"]:
                t = text.as_py()
                found.append(m.predict(t.encode()) if t and any(map(str.isalpha, t)) else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([p["row"], p["text"], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["row", "text", "lang_pred", "score"])

    cols = docs.columns
    d = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in cols if c != "text"]).alias("row"), "text")
    out = d.mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, text string, lang_pred string, score double")
    keep = [c for c in cols if c not in ("lang_pred", "score")]
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in keep], "lang_pred", "score")


def language_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row."""
    model = fit(docs)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
