"""The pipeline, stage by stage, against plain versions on a small corpus."""

from collections import Counter

import brute
import corpus_pipeline as P
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(P.cut(stage(spark, out[-1], SF)))
    return out


def texts(d):
    return {r.doc_id: r.text for r in d.collect()}


def test_columns(steps):
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "mix_to_weights", "bpe_encode_decode"]
    assert all(d.columns == steps[0].columns for d in steps[:5])


def test_language_stage(steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert all(before[k] == t for k, t in after.items())
    gone = {k: t for k, t in before.items() if k not in after}
    assert all(k in after for k, t in before.items() if t and sum(map(str.isalpha, t)) > 200)
    assert not any(t and t.count(" ") > 60 and sum(map(str.isalpha, t)) > 0.7 * len(t) for t in gone.values())


def test_line_stage(steps):
    before, after = texts(steps[1]), texts(steps[2])
    want = brute.dedup_lines(before, min_words=1)
    assert after == {k: t for k, t in want.items() if t == before[k] or t.split()}


def test_minhash_stage(steps):
    before = texts(steps[2])
    want = {k for k, (_, c) in brute.near_duplicates(before, 80).items() if c == k}
    assert set(texts(steps[3])) == want


def test_mix_stage(steps):
    rows = steps[3].collect()
    size = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size[r.doc_id]
    taken = Counter()
    for r in steps[4].collect():
        taken[r.source] += size[r.doc_id]
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= max(size.values()) for s in sizes)


def test_token_stage(steps):
    rows = steps[4].collect()
    got = Counter((r.doc_id, r.decoded_sha256) for r in steps[5].collect())
    assert got == Counter((r.doc_id, brute.sha(r.text or "")) for r in rows)


def test_run(spark, steps):
    assert Counter(map(tuple, P.run(spark, SF).collect())) == Counter(map(tuple, steps[5].collect()))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows(spark):
    """Nulls in any column, empty, very long and repeated texts pass through all stages in turn."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [r for r in docs.where("length(text) > 800 and lang = 'en'").limit(40).collect()]
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some]
    long = (9001, "\n".join(f"{i} {base[0][1][:60]} {i * 7919}" for i in range(3000)), None, None, None)
    odd = [(9002, None, None, None, None), (9003, "", "en", "web", 0), (9004, " \n\t", None, "web", 3), base[3], base[3], (9005, base[5][1], None, None, None), (None, base[7][1] + " with no id", "en", None, 1)]
    order = ["doc_id", "text", "lang", "source", "n_chars"]
    d = spark.createDataFrame(base + [long] + odd, ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in order)).select(*docs.columns)
    for _, stage in P.STAGES[:3]:
        d = P.cut(stage(spark, d, SF))
        assert d.columns == docs.columns
    left = Counter(r.doc_id for r in d.collect())
    assert not {9002, 9003, 9004, 9005} & set(left) and all(n == 1 for k, n in left.items() if k is not None) and 9001 in left
    for _, stage in P.STAGES[3:]:
        d = P.cut(stage(spark, d, SF))
    assert {r.doc_id for r in d.collect()} <= set(left)
