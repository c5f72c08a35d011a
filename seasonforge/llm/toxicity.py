"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Lexicons are cues (words, their starts and ends) that labelled documents tie to toxic texts.  Every document
gets the votes of many lexicons and patterns; the label model estimates from the counts of vote patterns how
often each voter fires by class and which voters depend on each other; its posteriors train the classifier.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut
from .textnp import batches as byte_batches
from .textnp import mix, shingle_sets, utf8

#: About so many labelled documents of each class find the lexicons and anchor the label model (of near copies
#: among them one), and about so many documents train the classifier: those whose hash is under a bound that
#: follows from the counts.
SAMPLE, FIT = 8_000, 20_000
#: Near copies agree on all hashes of a band: minima over the three-word shingles of a text.
BANDS, WIDTH = 8, 3
#: At most so many cues, each in three toxic documents at least and this much likelier there than in others.
CUES, LEAST_LIFT = 2_000, 4.0
#: Lexicons of each kind of cue, and the largest group of dependent voters that is modelled jointly.
FOLDS, BLOCK = 4, 4
#: Voters are dependent beyond this correlation within a class.
DEPENDENT = 0.2
#: Tokens a worker remembers; beyond it, it starts afresh.  Bounds memory, not results.
REMEMBER = 300_000

TOKEN = re.compile(r"[^\W_]+(?:[*@#$]+[^\W_]+)*")
STRETCHED = re.compile(r"(\w)\1\1+")
MASKED = re.compile(r"[*@#$]")
#: Digits and signs that stand for letters inside a word.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "*": "", "#": ""})

# Insults of four languages, as first lexicons.
SEEDS = {
    "en": "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting dumb garbage imbecile jerk filthy",
    "de": "idiot idioten dumm dummkopf trottel abschaum versager widerlich wertlos erbärmlich dreck arschloch depp",
    "fr": "idiot idiots imbécile crétin débile ordure minable dégoûtant stupide abruti connard pathétique racaille",
    "es": "idiota idiotas imbécil estúpido basura patético asqueroso inútil escoria tonto perdedor payaso cretino",
}
KINDS = ("=", "^", "$")
PATTERNS = ("shouting", "exclamations", "masked", "stretched")
COUNTS = (2, 4, 8)
#: One word with a cue in so many.
RATES = (400, 100, 25)
VOTERS = [*[f"lexicon {k}{i}" for k in KINDS for i in range(FOLDS)], *[f"seeds {k}" for k in SEEDS], *PATTERNS, *[f"{n} cue words" for n in COUNTS], *[f"a cue in {n} words" for n in RATES]]


def tokens(text: str) -> Counter[str]:
    return Counter(TOKEN.findall(text.lower()))


def folded(token: str) -> str:
    """A token without its disguise: masks, stretched letters, digits for letters."""
    if not token.isalpha() and any(map(str.isalpha, token)):
        token = token.translate(LEET)
    return STRETCHED.sub(r"\1", token)


def word_cues(word: str) -> list[str]:
    """What of a word can be a cue: itself, its starts and its ends."""
    n = len(word)
    return [f"={word}", *[f"^{word[:k]}" for k in range(3, 7) if n > k], *[f"${word[-k:]}" for k in (4, 5) if n > k]]


def held_out() -> Column:
    """True for documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


@dataclass
class Lexicons:
    """Cues with their numbers, and what a document shows of them."""

    cues: dict[str, int]
    known: dict[str, tuple[tuple[int, ...], int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        first = len(KINDS) * FOLDS
        self.voter = {i: KINDS.index(c[0]) * FOLDS + zlib.crc32(c.encode()) % FOLDS for c, i in self.cues.items()}
        self.seed = {}
        for j, words in enumerate(SEEDS.values()):
            for w in words.split():
                self.seed[w] = self.seed.get(w, 0) | 1 << first + j
        self.pattern = {p: 1 << first + len(SEEDS) + j for j, p in enumerate(PATTERNS)}
        self.several = [1 << first + len(SEEDS) + len(PATTERNS) + j for j in range(len(COUNTS) + len(RATES))]

    def _look(self, token: str) -> tuple[tuple[int, ...], int]:
        word = folded(token)
        ids = tuple(self.cues[c] for c in word_cues(word) if c in self.cues)
        votes = self.seed.get(word, 0)
        for i in ids:
            votes |= 1 << self.voter[i]
        if MASKED.search(token):
            votes |= self.pattern["masked"]
        if STRETCHED.search(token):
            votes |= self.pattern["stretched"]
        return ids, votes

    def show(self, text: str) -> tuple[list[int], int]:
        """Numbers of the cues in a whole text, in order, and its votes as bits."""
        ids, votes, hits = set(), 0, 0
        if len(self.known) > REMEMBER:
            self.known.clear()
        counted = tokens(text)
        for t, n in counted.items():
            got = self.known.get(t)
            if got is None:
                got = self.known[t] = self._look(t)
            if got[0] or got[1]:
                ids.update(got[0])
                votes |= got[1]
                hits += n * bool(got[0])
        words = counted.total() if hits else 0
        for bit, n in zip(self.several, COUNTS, strict=False):
            votes |= bit * (hits >= n)
        for bit, n in zip(self.several[len(COUNTS) :], RATES, strict=True):
            votes |= bit * (0 < words <= n * hits)
        raw = text.encode()
        if 10 * (len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) > 3 * len(raw) > 60:
            votes |= self.pattern["shouting"]
        if "!!" in text:
            votes |= self.pattern["exclamations"]
        return sorted(ids), votes


def _under(column: Column, share: float) -> Column:
    """True for about this share of the ids, by hash."""
    return F.pmod(F.xxhash64(F.lit(13), column), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)))


def labelled(labels: DataFrame) -> DataFrame:
    """``doc_id, toxic int`` of the documents whose labels may be learned from; toxic if one of a document's labels says so."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sampled_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` labelled documents of each class: ``doc_id, toxic``."""
    known = labelled(labels)
    n = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    few = [(F.col("toxic") == k) & _under(F.col("doc_id"), sample / max(1, v)) for k, v in n.items()]
    keep = F.lit(False)
    for f in few:
        keep = keep | f
    return known.where(keep)


def distinct_families(docs: DataFrame, few: DataFrame) -> DataFrame:
    """``doc_id, toxic`` of ``few``, one document of each class of a family of near copies.

    A text that was copied a thousand times would tie all its words to its label.  The driver gets BANDS
    numbers of each sampled document, about 2 * SAMPLE at most.
    """
    seeds = np.random.default_rng(29).integers(1, 1 << 63, BANDS * WIDTH).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bands = []
            for _, raw, starts in byte_batches(list(range(b.num_rows)), utf8(b["text"])):
                for s in shingle_sets(raw, starts, 3):
                    low = np.array([mix(s ^ k).min() for k in seeds] if len(s) else seeds * 0, np.uint64).reshape(BANDS, WIDTH)
                    bands.append(mix(low[:, 0] + mix(low[:, 1] + mix(low[:, 2]))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "toxic", "bands"])

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")  # few: about 2 * SAMPLE rows
    rows = sorted(texts.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, bands array<bigint>").collect())
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    first: dict[tuple[int, int], int] = {}
    for i, r in enumerate(rows):
        for band in enumerate(r.bands):
            a, z = sorted((find(i), find(first.setdefault(band, i))))
            root[z] = a
    kept = {(find(i), r.toxic): (r.doc_id, r.toxic) for i, r in reversed(list(enumerate(rows)))}
    return docs.sparkSession.createDataFrame(sorted(kept.values()), "doc_id long, toxic int")


def find_cues(docs: DataFrame, few: DataFrame, most: int = CUES) -> dict[str, int]:
    """Cues by how surely the sample ties them to toxic documents (likelihood ratio): ``cue -> number``, ``most`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, text in zip(b["toxic"].to_pylist(), b["text"], strict=True):
                found = pa.array({c for t in tokens(text.as_py() or "") for c in word_cues(folded(t))}, pa.string())
                yield pa.RecordBatch.from_arrays([found, pa.array([toxic] * len(found), pa.int32())], ["cue", "toxic"])

    texts = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(few), "doc_id")  # few: about 2 * sample rows
    sizes = {r.toxic: r["count"] for r in few.groupBy("toxic").count().collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    counts = texts.select("toxic", "text").mapInArrow(run, "cue string, toxic int").groupBy("cue").agg(F.sum("toxic").alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    counts = counts.where("a >= 3")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda x, n: F.when(x > 0, x * F.log(x * (n1 + n0) / (n * (a + b)))).otherwise(0.0)
    lift = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
    counts = cut(counts.select("cue", "a", (2 * (part(a, n1) + part(b, n0))).alias("g"), lift.alias("lift")))
    sure = 2 * np.log(max(2, counts.count()))
    best = counts.where((F.col("g") > float(sure)) & (F.col("lift") >= LEAST_LIFT)).orderBy(F.col("g").desc(), "cue").limit(most).collect()
    drop_cut(counts)
    return {r.cue: i for i, r in enumerate(best)}


def shown(docs: DataFrame, lexicons: Lexicons) -> DataFrame:
    """``doc_id, votes long, ids array<int>`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicons.cues)  # CUES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _lexicons(tuple(shared.value))
        for b in batches:
            found = [own.show(t.as_py() or "") for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([v for _, v in found], pa.int64()), pa.array([i for i, _ in found], pa.list_(pa.int32()))], ["doc_id", "votes", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes long, ids array<int>")


@lru_cache(maxsize=1)
def _lexicons(cues: tuple[str, ...]) -> Lexicons:
    """A worker process keeps the lexicons of its query."""
    return Lexicons({c: i for i, c in enumerate(cues)})


class LabelModel:
    """Two classes that explain the votes: how often each voter fires by class, jointly within dependent groups.

    ``accuracy`` is each voter's share of toxic documents among those it fires on, ``correlation`` the
    strongest correlation of each pair of voters within a class.
    """

    def __init__(self, voters: int, rounds: int = 30):
        self.voters, self.rounds = voters, rounds

    def fit(self, patterns: np.ndarray, n: np.ndarray, anchors: tuple[np.ndarray, np.ndarray, np.ndarray]) -> LabelModel:
        """EM over distinct patterns and their counts; ``anchors``: patterns, labels and counts of labelled documents.

        Anchors tell how voters fire by class, not how frequent the classes are.
        """
        x, (ax, ay, an) = self._bits(patterns), (anchors[0], anchors[1].astype(float), anchors[2].astype(float))
        ax = self._bits(ax)
        n = n.astype(float)
        scale = min(1.0, max(an.sum(), 1000.0) / max(1.0, n.sum()))  # anchors keep their say however many rows there are
        lexicon = x[:, : len(KINDS) * FOLDS + len(SEEDS)].sum(1)
        r = np.where(lexicon >= 2, 0.95, np.where(lexicon == 1, 0.5, 0.02))
        self.blocks = [[j] for j in range(self.voters)]
        for joint in (False, True):
            if joint:
                self.blocks = self._dependent(np.vstack([x, ax]), np.concatenate([n * scale, an]), np.concatenate([r, ay]))
            for _ in range(self.rounds):
                self.prior = float(np.clip((n @ r + 1) / (n.sum() + 20), 1e-6, 1 - 1e-6))
                w = [np.concatenate([n * scale * p, an * q]) for p, q in ((1 - r, 1 - ay), (r, ay))]
                self.tables = [self._table(b, np.vstack([x, ax]), w) for b in self.blocks]
                r = self.posterior(patterns)
        fires = np.vstack([x, ax])
        w = np.concatenate([n, an * 0])
        self.accuracy = (fires * (w * np.concatenate([r, ay]))[:, None]).sum(0) / np.maximum(1e-9, (fires * w[:, None]).sum(0))
        return self

    def _bits(self, patterns: np.ndarray) -> np.ndarray:
        return (patterns[:, None].astype(np.int64) >> np.arange(self.voters) & 1).astype(float)

    def _table(self, block: list[int], x: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
        """Log odds of each joint outcome of a block's voters; unseen outcomes lean to independence."""
        code = (x[:, block] @ (1 << np.arange(len(block)))).astype(int)
        outcomes = np.arange(1 << len(block))[:, None] >> np.arange(len(block)) & 1
        out = []
        for k in w:
            p = ((x[:, block] * k[:, None]).sum(0) + 0.5) / (k.sum() + 1.0)
            alone = np.prod(np.where(outcomes == 1, p, 1 - p), axis=1)
            out.append((np.bincount(code, k, len(outcomes)) + alone) / (k.sum() + 1.0))
        return np.log(out[1]) - np.log(out[0])

    def _dependent(self, x: np.ndarray, n: np.ndarray, r: np.ndarray) -> list[list[int]]:
        """Groups of voters whose votes correlate within a class: single linkage, strongest pairs first, BLOCK at most."""
        strongest = np.zeros((self.voters, self.voters))
        for k in (n * (1 - r), n * r):
            mean = (x * k[:, None]).sum(0) / max(1e-9, k.sum())
            d = x - mean
            cov = (d * k[:, None]).T @ d / max(1e-9, k.sum())
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            strongest = np.maximum(strongest, np.abs(cov / sd[:, None] / sd))
        self.correlation = strongest * (1 - np.eye(self.voters))
        of = list(range(self.voters))
        for i, j in sorted(zip(*np.triu_indices(self.voters, 1), strict=True), key=lambda ij: -strongest[ij]):
            if strongest[i, j] > DEPENDENT and of[i] != of[j] and of.count(of[i]) + of.count(of[j]) <= BLOCK:
                of = [of[i] if g == of[j] else g for g in of]
        return [[j for j in range(self.voters) if of[j] == g] for g in sorted(set(of))]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of the toxic class for each pattern of votes."""
        x = self._bits(patterns)
        z = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for b, t in zip(self.blocks, self.tables, strict=True):
            z += t[(x[:, b] @ (1 << np.arange(len(b)))).astype(int)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(rows: list[list[int]], y: np.ndarray, size: int, l2: float = 1e-5, rounds: int = 800) -> np.ndarray:
    """Weights (the bias last) of a linear classifier on sets of features, for labels between 0 and 1."""
    w, scale = np.zeros(size + 1), np.full(size + 1, 1e-8)
    if not rows:
        w[-1] = -4.0
        return w
    of = np.repeat(np.arange(len(rows)), [len(r) + 1 for r in rows])
    at = np.array([i for r in rows for i in (*r, size)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, w[at], len(rows)), -30, 30)))
        g = np.bincount(at, (p - y)[of], size + 1) / len(rows)
        g[:-1] += l2 * w[:-1]
        scale += g * g
        w -= 0.3 * g / np.sqrt(scale)
    return w


def _features(votes: int, ids: list[int], cues: int) -> list[int]:
    return [*ids, *[cues + j for j in range(len(VOTERS)) if votes >> j & 1]]


def fit(seen: DataFrame, few: DataFrame, cues: int, rows: int = FIT) -> tuple[LabelModel, np.ndarray]:
    """The label model of all documents that are not held out, and the classifier of about ``rows`` of them.

    ``seen``: see ``shown``.  The driver gets the distinct vote patterns with their counts (2 to the number
    of voters at most, a few hundred in practice) and the cues of ``rows`` documents.
    """
    free = seen.where(~held_out())
    all_votes = free.groupBy("votes").count().collect()
    anchored = free.join(F.broadcast(few), "doc_id").groupBy("votes", "toxic").count().collect()  # few: about 2 * SAMPLE rows
    column = lambda rs, c: np.array([r[c] for r in rs], np.int64)
    model = LabelModel(len(VOTERS)).fit(column(all_votes, "votes"), column(all_votes, "count"), tuple(column(anchored, c) for c in ("votes", "toxic", "count")))
    total = sum(r["count"] for r in all_votes)
    key = F.xxhash64("doc_id", "votes", "ids")
    some = free.where(_under(key, rows / max(1, total))).select("votes", "ids", key.alias("h")).orderBy("h").limit(2 * rows).collect()
    y = model.posterior(column(some, "votes"))
    return model, logistic([_features(r.votes, r.ids, cues) for r in some], y, cues + len(VOTERS))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Toxicity of every whole text: ``doc_id, held_out, score, predicted`` per row of ``docs``.

    Only the text is an input of a score.  A text that is null or empty shows no cue and gets the score of
    such texts.  Long texts are taken whole.  Repeated rows give repeated results.  A document with several
    labels is toxic if one says so; labels that are null or of no document are ignored.  Without labels the
    seed lexicons and patterns remain.  A null ``doc_id`` is not held out and has no label.  An empty table
    gives no rows.  Other columns are ignored.
    """
    few = cut(sampled_labels(labels, sample))
    sampled, few = few, cut(distinct_families(docs, few))
    drop_cut(sampled)
    cues = find_cues(docs, few)
    seen = cut(shown(docs, Lexicons(cues)))
    _, w = fit(seen, few, len(cues))
    drop_cut(few)
    weights = lambda x: F.array(*[F.lit(float(v)) for v in x])
    of_cues = F.aggregate("ids", F.lit(float(w[-1])), lambda z, i: z + F.get(weights(w[: len(cues)]), i)) if cues else F.lit(float(w[-1]))
    z = of_cues
    for j, v in enumerate(w[len(cues) : -1]):
        z = z + F.lit(float(v)) * F.shiftright("votes", j).bitwiseAND(F.lit(1))
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return seen.select("doc_id", held_out().alias("held_out"), p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
