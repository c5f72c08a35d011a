"""Resampling, the filter audit and toxicity: against plain versions, and on null, empty, long, equal and odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from seasonforge.llm import filteraudit, queries, resample, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n int, toxic int, digest string, part string, summed int, rank long, votes int, ids string, score double, `_place` int"
LABELS = "doc_id long, quality int, toxic int, text string, good int, part string, a int"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, "d", "p", 3, 4, 5, "i", 0.5, 6) for i, t, lang in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame([(i, q, t, "x", 1, "p", 2) for i, q, t in rows], LABELS)


LONG = "Grüße aus Köln, alpha beta " * 90_000
ODD = [(1, None, "en"), (2, "", None), (3, " \t\n", ""), (4, "one two", "en"), (5, "One TWO", "de"), (6, "ab" * 40_000, "de"), (7, "word " * 20_000, "fr"), (8, "émigré naïve 東京 🙂 #1", "en"),
       (None, "no id here but twenty one words " * 4, "en"), (4, "one two", "en"), (4, "one two", "en"), (9, LONG, "en"), (10, "word " * 20_000, "en"), (11, "x\x00y z", None), (None, "", "en"), (3, "one two", "de")]


# ---- resampling


def plain_resample(docs, target, percent=5, least=20):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def buckets(text):
        w = word.findall(low(text))
        return len(w), Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1))

    raw = [(i, *buckets(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in raw:
        s.update(c)
    for x in target:
        t.update(buckets(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, n, c in raw:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    can = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1]))
    drawn = can[: percent * len(can) // 100]
    out = Counter((*r[:4], k) for k, r in enumerate(drawn, 1))
    out.update((*r[:4], None) for r in can[len(drawn) :])
    out.update((*r[:4], None) for r in rows if r[4] < least)
    return out


def test_resample_equals_plain(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Counter(map(tuple, queries.op11_resample(spark, SF).collect()))
    assert got == plain_resample(docs, target)
    assert sum(k[4] is not None for k in got) == len([1 for _, t in docs if len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) >= 20]) * 5 // 100


def test_resample_odd_rows(spark):
    target = spark.createDataFrame([(1, "word word alpha", 1), (2, None, 2), (3, "", 3)], "item_id long, text string, doc_id int")
    got = Counter(map(tuple, resample.resample(frame(spark, ODD), target, percent=60).collect()))
    assert got == plain_resample([(i, t) for i, t, _ in ODD], ["word word alpha", None, ""], percent=60)


def test_resample_ties_repeats_and_empty_tables(spark):
    target = spark.createDataFrame([], "item_id long, text string")
    text = "a b c d e f g h i j k l m n o p q r s t u"
    same = [(5, text, "en")] * 40 + [(4, text, "en")] * 2
    assert Counter(map(tuple, resample.resample(frame(spark, same), target, percent=50).collect())) == plain_resample([(i, t) for i, t, _ in same], [], percent=50)
    assert resample.resample(frame(spark, []), target).count() == 0


def test_long_texts_are_counted_whole(monkeypatch, spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["al", "be", "ga", "é", "de", "x1"], n)) + "." for n in (1, 2, 3, 50, 400, 1000)] + ["x" * 3000, "a,, b--c " * 100]
    whole = resample.Counter(10_000)
    want = whole.pieces([t.encode() for t in texts], [0] * len(texts))
    monkeypatch.setattr(resample, "BYTES", 64)
    for t, (k, n) in zip(texts, want, strict=True):
        a, b = whole.long(t.encode())
        assert list(a) == list(k) and list(b) == list(n)
    whole.close()


# ---- filter audit


def plain_audit(docs, labels):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    smallest = {}
    for i, t, _ in docs:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    bad = []
    for i, t, lang in docs:
        t = t or ""
        w = word.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i,
        }
        good = any(q == 1 for k, q, _ in labels if k == i and i is not None)
        toxic = any(x == 1 for k, _, x in labels if k == i and i is not None)
        bad.append((lang or "", {f for f, x in fails.items() if x}, good, toxic))
    out = {}
    for part in {p for p, *_ in bad}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [b for b in bad if b[0] == part]
            done = []
            for step, f in enumerate(order, 1):
                here = [b for b in left if f in b[1]]
                left = [b for b in left if f not in b[1]]
                redundant = sum(f in b[1] for b in done)
                alone = sum(b[0] == part and b[1] == {f} for b in bad)
                done += here
                shapley[f] += len(here)
                out[part, "".join(order), step] = [len(left), len(here), redundant, alone, sum(b[2] for b in here), sum(b[3] for b in here)]
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return out


def audited(d):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in d.collect()}


def test_audit_equals_plain(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert audited(queries.op12_audit(spark, SF)) == plain_audit(docs, labels)


def test_audit_odd_rows(spark):
    labels = [(4, 1, 0), (4, 0, 1), (9, 1, 1), (10, None, None), (None, 1, 1), (77, 1, 1), (11, 2, 1)]
    assert audited(filteraudit.audit(frame(spark, ODD), labels_of(spark, labels))) == plain_audit(ODD, labels)
    assert audited(filteraudit.audit(frame(spark, ODD), labels_of(spark, []))) == plain_audit(ODD, [])
    assert filteraudit.audit(frame(spark, []), labels_of(spark, labels)).count() == 0


def test_audit_of_many_copies(spark):
    docs = [(i, "same text #", "en" if i % 3 else "de") for i in range(50)] + [(i, None, None) for i in range(50, 60)]
    assert audited(filteraudit.audit(frame(spark, docs), labels_of(spark, [(0, 1, 1), (7, 1, 0)]))) == plain_audit(docs, [(0, 1, 1), (7, 1, 0)])


# ---- toxicity


def area(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    for s in np.unique(scores):
        rank[scores == s] = rank[scores == s].mean()
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_toxicity_by_held_out_labels(spark):
    sf = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in queries.op13_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    ids = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    s, y, p = (np.array([f(i) for i in ids]) for f in (lambda i: got[i].score, labels.get, lambda i: got[i].predicted))
    hits = int(p[y == 1].sum())
    print("area", area(s, y), "precision", hits / p.sum(), "recall", hits / y.sum())
    assert area(s, y) > 0.93 and hits / p.sum() > 0.9 and hits / y.sum() > 0.85


def made(n=600):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list(LETTERS), 5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 1
        w = list(rng.choice(words, 40))
        if toxic:
            for at in rng.integers(0, 40, 4):
                w[at] = rng.choice(["blorkish", "blorkum", "vrexal", "vrexon"])
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_finds_invented_words_disguises_and_odd_rows(spark):
    docs, labels = made()
    new = [(1001, "plain words " * 30 + "blorkito and vrexine", "en"), (1002, "words BLORKISH!!! then bl0rkum and vreeeexal", "de"), (1003, None, "en"), (1004, "", "en"), (1005, "plain words " * 30, "en"),
           (1006, "blorkish vrexal blorkum " + LONG[:500_000], "en"), (None, "blorkish vrexal blorkum", "en"), (1001, "plain words " * 30 + "blorkito and vrexine", "en")]
    got = toxicity.score(frame(spark, docs + new), labels_of(spark, [*labels, (None, 1, 1), (3, 1, None), (5000, 1, 1)]))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = [(r.doc_id, r.predicted) for r in got.collect()]
    assert len(rows) == len(docs) + len(new)
    assert sorted(p for i, p in rows if i == 1001) == [1, 1]
    of = dict(rows)
    assert (of[1002], of[1003], of[1004], of[1005], of[1006], of[None]) == (1, 0, 0, 0, 1, 1)
    assert [p for i, p in rows if i is not None and i < 1000 and i % 5 == 1] == [1] * 120
    assert sum(p for i, p in rows if i is not None and i < 1000 and i % 5 != 1) == 0


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = made(100)
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, [*docs, (500, "you stupid pathetic idiot, what a moron", "en")]), labels_of(spark, [])).collect()}
    assert len(got) == 101 and all(0 <= s <= 1 for s in got.values())
    assert toxicity.score(frame(spark, []), labels_of(spark, labels)).count() == 0


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(2)
    v, n = len(toxicity.VOTERS), 20_000
    y = rng.random(n) < 0.2
    votes = np.zeros((n, v), int)
    for j in range(8):
        votes[:, j] = rng.random(n) < np.where(y, 0.6, 0.03)
    votes[:, 8] = votes[:, 9] = votes[:, 10] = rng.random(n) < np.where(y, 0.3, 0.25)  # one weak voter three times
    coded = (votes << np.arange(v)).sum(1)
    patterns, count = np.unique(coded, return_counts=True)
    m = toxicity.LabelModel(v).fit(patterns, count, (coded[:500], y[:500], np.ones(500)))
    truth = (votes * y[:, None]).sum(0) / np.maximum(1, votes.sum(0))
    assert np.abs(m.accuracy[:8] - truth[:8]).max() < 0.05
    assert [8, 9, 10] in [sorted(b) for b in m.blocks] and m.correlation[8, 9] > 0.95 and m.correlation[0, 1] < 0.2
    assert abs(m.prior - 0.2) < 0.03
