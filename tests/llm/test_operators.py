"""The dealt operators against plain versions, and on null, empty, long, equal and odd rows."""

import math
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from seasonforge.llm import bpe, embedding, html, langid, linededup, minhash, mixing, queries, secrets, suffix, topk

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row string, gone int, n int, component long, `_id` int"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); other columns have names the operators use too."""
    full = [(*r, *[None] * (4 - len(r)), 1, 2, "k", "r", 3, 4, 5, 6) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "One TWO"), (6, "ab" * 40_000), (7, "word " * 20_000), (8, "émigré naïve 東京 🙂"), (None, "no id here"), (4, "one two"), (9, "a" * 1000 + " " + "x y z " * 50)]


# ---- byte-level BPE


@pytest.fixture(scope="module")
def tokens():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bpe(d):
    return bpe.bpe_digest(d, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def _coded(tokens, text):
    ids = tokens.encode_ordinary(text or "")
    return len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(text or "")


def test_bpe_equals_tiktoken(spark, docs, tokens):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_bpe(spark, SF).collect()}
    assert got == {k: _coded(tokens, t) for k, t in docs.items()}


def test_bpe_odd_rows(spark, tokens):
    rng = random.Random(3)
    hard = [(20 + i, "".join(rng.choice("abcdeé- \n'0") for _ in range(rng.choice((5, 190, 700))))) for i in range(60)] + [(90, "=" * 3000), (91, "<|endoftext|> it's"), (92, "x" * 500 + "y" * 500), (93, "東" * 400)]
    rows = ODD + hard
    got = Counter(tuple(r) for r in _bpe(frame(spark, rows)).collect())
    assert got == Counter((k, *_coded(tokens, t)) for k, t in rows)
    assert _bpe(frame(spark, [])).count() == 0


# ---- pages


SITE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li>News</li></ul></nav>
<div class="crumbs">You are here</div><article><h1>Title %d</h1><p>First &amp; <b>bold</b>
 text&nbsp;%d.</p><ul><li>one %d</li><li>two</li></ul><div class="comments"><p>Nice post</p></div></article><script>var x = "<p>no</p>";</script><div>Follow us on all channels</div><footer>(c)</footer></body></html>"""


def test_html_site(spark):
    rows = [(i, f"http://a.example/{i}", SITE % (i, i, i), "t") for i in range(8)]
    odd = [(100, "http://b.example/", None, "t"), (101, None, "", "t"), (102, None, "<p>Only <i>this</i><p>and that", "t"), (103, "http://a.example/0", SITE % (0, 0, 0), "t"), (104, "x", "plain &lt;text&gt;", "t"), (105, "y", "<div>" * 3000 + "deep" + "</div>" * 3000, "t")]
    d = spark.createDataFrame(rows + odd, "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in html.extract_text(d).collect()}
    assert len(got) == 14
    for i in range(8):
        assert got[i].text == f"Title {i}\n\nFirst & bold text {i}.\n\none {i}\n\ntwo"
        assert got[i].n_chars == len(got[i].text)
    assert got[103].text == got[0].text and got[100].text == got[101].text == "" and got[100].n_chars == 0
    assert got[102].text == "Only this\n\nand that" and got[104].text == "plain <text>" and got[105].text == "deep"
    assert html.extract_text(d.limit(0)).count() == 0


def test_html_templates_outside_the_article(spark):
    """A block without telling marks goes when its subtree recurs on the host; the same block on another host stays."""
    page = "<body><div><span>Buy our magazine today</span></div><div><p>Story %s</p></div></body>"
    rows = [(i, f"https://H.example:80/{i}", page % i) for i in range(6)] + [(9, "https://other.example/", page % 9)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story 3" and got[9] == "Buy our magazine today\n\nStory 9"


def test_html_on_the_pages_table(spark):
    got = queries.op2_html(spark, SF).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    assert all("<" + "div" not in r.text and r.text == r.text.strip() and r.n_chars == len(r.text) for r in got)


# ---- near-duplicates


def test_minhash_equals_all_pairs(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_minhash(spark, SF).collect()}
    assert got == brute.near_duplicates(docs)


def test_minhash_chains_and_large_groups(spark):
    """Near copies with random changes: sets that link only through others, in groups over and under a block."""
    rng = random.Random(5)
    texts, k = {}, 0
    for size, length in ((3, 40), (70, 60), (200, 80), (5, 30)):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                w[rng.randrange(length)] = f"v{rng.randrange(10**6)}"
            texts[k := k + 1] = " ".join(w)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, list(texts.items()))).collect()}
    want = brute.near_duplicates(texts)
    assert sum(got[k][1] != want[k][1] for k in texts) <= 2  # each link has a chance of 0.999 at least
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_minhash_odd_rows(spark):
    got = minhash.near_duplicates(frame(spark, ODD)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0
    assert by[1].kept and by[2].kept and by[4].component_id == by[5].component_id == 4 and not by[5].kept
    assert by[6].n_shingles == by[7].n_shingles == 1 and by[7].kept and by[None].component_id is None
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    stay = minhash.drop_near_duplicates(frame(spark, ODD))
    assert stay.columns == frame(spark, []).columns and sorted(r.doc_id or 0 for r in stay.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]


# ---- language


def test_language_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op4_language(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("lang is not null and lang_pred <> 'und'").collect()
    assert len(got) > 200 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97


def test_language_odd_rows(spark):
    en, de = "the cat sat on the mat and went home with her", "der hund und die katze gingen nach hause in den wald"
    rows = [(i, f"{en} {i}", "en") for i in range(40)] + [(i, f"{de} {i}", "de") for i in range(40, 80)] + [(k + 100 if k else None, t) for k, t in ODD] + [(200, "12 + 3!", "en"), (201, "the mat sat on the cat and")]
    got = {r.doc_id: r for r in langid.language_digest(frame(spark, rows)).collect()}
    assert got[201].lang_pred == "en" and got[45].lang_pred == "de"
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (101, 102, 103, 200))
    assert {r.lang_pred for r in langid.language_digest(frame(spark, [(1, "a b", None)])).collect()} == {"und"}
    assert langid.language_digest(frame(spark, [])).count() == 0
    assert langid.identify(frame(spark, rows)).columns[-2:] == ["lang_pred", "score"]


# ---- repeated passages


def test_suffix_equals_brute_force(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op5_suffix(spark, SF).collect()}
    assert got == brute.repeated(docs)


@pytest.mark.parametrize("seed", range(3))
def test_suffix_random_passages(spark, seed, monkeypatch):
    """Passages cut from a pool at any offset, over several batches and ranges."""
    rng = random.Random(seed)
    pool = "".join(rng.choice("abcd é") for _ in range(3000)) + "ab" * 300 + "z" * 400
    texts = {}
    for k in range(120):
        parts = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(len(pool))
            parts.append(pool[a : a + rng.choice((20, 49, 50, 51, 70, 300))] if rng.random() < 0.6 else "".join(rng.choice("efgh ") for _ in range(rng.randrange(90))))
        texts[k * 3] = "".join(parts)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 4000)
    monkeypatch.setattr(suffix, "RANGE_ROWS", 300)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.repeated_passages(frame(spark, list(texts.items()))).collect()}
    assert got == brute.repeated(texts)


def test_suffix_odd_rows(spark):
    got = suffix.repeated_passages(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = brute.repeated({k: t for k, t in ODD if k})
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got if r.doc_id) and suffix.repeated_passages(frame(spark, [])).count() == 0
    none = next(r for r in got if r.doc_id is None)
    assert none.n_bytes == 10 and none.n_removed == 0


# ---- lines


@pytest.mark.parametrize("small", (48, 2))
def test_lines_equal_brute_force(spark, small, monkeypatch):
    """Alike lines, met as rows or in blocks."""
    monkeypatch.setattr(linededup, "SMALL_KEY", small)
    monkeypatch.setattr(linededup, "BLOCK", 7)
    rng = random.Random(9)
    texts = {}
    for k in range(60):
        lines = []
        for _ in range(4):
            base = random.Random(rng.randrange(25))
            w = [f"w{base.randrange(1000)}" + "abcdefgh"[base.randrange(8)] for _ in range(40)]
            for _ in range(rng.choice((0, 0, 1, 4, 8))):
                w[rng.randrange(40)] = "other" + "abcd"[rng.randrange(4)]
            lines.append(" ".join(w) if rng.random() < 0.8 else f"Short line {k}")
        texts[k] = "\n".join(lines)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, list(texts.items()))).collect()}
    assert got == brute.dedup_lines(texts) != brute.dedup_lines(texts, near=lambda x, y: False)


def test_lines_odd_rows(spark):
    line = "The quick brown fox jumps over 12 lazy dogs"
    rows = ODD + [(50, f"{line}\nHello\n\n{line}"), (51, f"Hello\n{line.upper()}!"), (51, f"Hello\n{line.upper()}!"), (52, "Hello"), (None, line)]
    out = linededup.dedup_lines(frame(spark, rows))
    assert out.columns == [*frame(spark, []).columns, "_lines", "_gone"]
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert len(got) == len(rows) and (50, f"{line}\nHello\n") in got and got.count((51, "Hello")) == 2 and (None, line) in got
    assert all(x in got for x in ODD)
    assert linededup.line_digest(frame(spark, [])).count() == 0


# ---- secrets


def test_secrets_equal_brute_force(spark, docs):
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in queries.op7_secrets(spark, SF).collect()}
    assert got == {k: brute.base_secrets(t) for k, t in docs.items()}


def test_secrets_parts_and_odd_rows(spark):
    key = "aB3" + "xYz9" * 10
    rows = ODD + [
        (30, f"user: bob has {key} at https://db.example/x"), (31, f"only {key} here"), (32, "user: bob"), (33, "see https://db.example/x"), (34, f"user: bob {'filler ' * 200}{key}"),
        (35, 'API_KEY = "abc" token=\'abcdef\' PASSWORD: s3cr3t! secret = 12345'), (36, "AKIA" + "A" * 15 + " AKIA" + "B" * 16), (37, "f" * 23 + " " + "0a" * 12 + "🙂secret:zzzzzz"), (38, "tokEn:ſecret1"),
    ]
    got = secrets.secret_digest(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    text = dict(rows)
    for r in got:
        if r.doc_id != 4:
            assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute.base_secrets(text[r.doc_id]), r
    assert by[30].spans == f"login:0:9,key:14:{14 + len(key)},endpoint:{18 + len(key)}:{18 + len(key) + 20}"
    assert by[31].spans == by[32].spans == by[33].spans == by[34].spans == ""
    assert secrets.secret_digest(frame(spark, [])).count() == 0


# ---- mixing


def test_mix_targets(spark):
    for sizes in ({"a": 100, "b": 50, None: 10}, {"a": 1, "b": 1000}, {"x": 0, "y": 7}, {c: 10 ** (i % 4) for i, c in enumerate("abcdefg")}):
        d = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(d).collect()}
        want = brute.targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in want)


def test_mix_takes_the_targets(spark):
    got = queries.op8_mix(spark, SF).collect()
    src = {r.doc_id: (r.source, len(brute.WORD.findall(r.text or ""))) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = {}
    for s, n in src.values():
        sizes[s] = sizes.get(s, 0) + n
    want, taken = brute.targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        s, n = src[r.doc_id]
        assert r.size == n and r.source_size == sizes[s] and math.isclose(r.target, want[s]) and 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op8_mix(spark, SF).collect()))


def test_mix_odd_rows(spark):
    rows = [(k, t, None, "s" if (k or 0) % 2 else None) for k, t in ODD]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(frame(spark, [])).count() == 0 and mixing.mix_documents(frame(spark, [])).count() == 0
    assert mixing.mix_documents(frame(spark, rows)).columns == frame(spark, []).columns
    assert mixing.mix(frame(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


# ---- embeddings


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, n int, digest int")


def _good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def _links(rows, threshold=0.93):
    rows = {k: (np.array(v, np.float32).astype(float), y) for k, v, y in rows if _good(v) and any(v) and y is not None and k is not None}
    ids = sorted(rows)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if rows[a][1] == rows[b][1] and len(rows[a][0]) == len(rows[b][0]) and rows[a][0] @ rows[b][0] / np.linalg.norm(rows[a][0]) / np.linalg.norm(rows[b][0]) >= threshold]
    comp, n = brute.components(ids, pairs), Counter(x for p in pairs for x in p)
    return {k: (n[k], comp[k]) for k in ids}


def test_embeddings_equal_all_pairs(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows += [(10_000 + i, (centres[i % 6] + rng.normal(size=8) * 0.35).tolist(), i % 2) for i in range(300)]
    rows += [(20_000, None, 1), (20_001, [0.0] * 8, 1), (20_002, [float("nan")] * 8, 1), (20_003, [float("inf")] + [0.0] * 7, 1), (20_004, [1.0, None], 1), (20_005, [1.0] * 8, None), (20_006, [], 1), (20_007, centres[0].tolist(), 0), (20_008, (centres[0] * 2).tolist(), 0), (20_009, centres[0].tolist(), 0)]
    monkeypatch.setattr(embedding, "CELL_ROWS", 12)
    monkeypatch.setattr(embedding, "BLOCK", 16)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.near_vectors(_vectors(spark, rows)).collect()}
    want = _links(rows)
    assert len(got) == len(rows)
    assert got == {k: (*want.get(k, (0, k)), want.get(k, (0, k))[1] == k) for k, _, _ in rows}
    assert max(v[0] for v in got.values()) > 3
    assert embedding.near_vectors(_vectors(spark, [])).count() == 0
    twice = embedding.near_vectors(_vectors(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)])).collect()
    assert len(twice) == 3 and all(r.n_links == 0 for r in twice)


def _top(rows, k=5):
    ok = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and i is not None}
    out = []
    for q in sorted(ok):
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def test_topk_equals_all_scores(spark, monkeypatch):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op10_topk(spark, SF).collect())) == _top(rows)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist(), 0) for i in range(300)] + [(1000, None, 0), (1050, [float("nan")] * 6, 0), (1100, [0.0] * 6, 0), (1001, [1.0, None], 0), (None, [1.0] * 6, 0)]
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "ROWS", 40)
    assert sorted(map(tuple, topk.top_inner_products(_vectors(spark, rows)).collect())) == _top(rows)
    few = rows[:3]
    assert sorted(map(tuple, topk.top_inner_products(_vectors(spark, few)).collect())) == _top(few)
    assert topk.top_inner_products(_vectors(spark, [])).count() == 0
