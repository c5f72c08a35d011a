"""Line deduplication finds every pair down to the edit similarity, and repeats of short and unspaced lines."""

import random

import brute
import pytest

from seasonforge.llm import linededup


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


@pytest.mark.parametrize("small", (48, 2))
def test_all_alike_lines_are_found(spark, small, monkeypatch):
    """Pairs of 4 to 100 words with as many edits anywhere as the similarity allows, and one more."""
    monkeypatch.setattr(linededup, "SMALL_KEY", small)
    monkeypatch.setattr(linededup, "BLOCK", 3)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for length in (4, 5, 6, 9, 10, 13, 15, 16, 19, 20, 25, 40, 100):
        for edits in (1, max(1, length // 5), length // 5 + 1):
            base = ["the", "same", "start", *[word() for _ in range(length - 3)]]
            other = list(base)
            for at in rng.sample(range(length), edits):
                other[at : at + 1] = rng.choice(([word()], [word()], [], [other[at], word()])) if at < len(other) else [word()]
            texts[len(texts)] = " ".join(base)
            texts[len(texts)] = " ".join(other)
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, texts), min_words=1).collect()}
    want = brute.dedup_lines(texts, min_words=1)
    assert got == want and 20 < sum(t == "" for t in got.values()) < len(texts) // 2


def test_short_lines_repeat(spark):
    texts = {1: "All rights reserved\nHello\n---", 2: "all rights reserved!\nother\n---", 3: "HELLO"}
    got = {r.doc_id: r.n_removed for r in linededup.line_digest(frame(spark, texts)).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_lines_without_spaces(spark):
    line = "東京都は日本の首都であり世界で最も人口の多い都市の一つである"
    texts = {1: line, 2: line.replace("首", "古"), 3: line, 4: "これは別の行であり前の行とは少しも似ていないものとする"}
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {1: line, 2: "", 3: "", 4: texts[4]}
