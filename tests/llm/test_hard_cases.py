"""Cases that are easily lost: markup, deep pages, periodic passages, large numbers, ids with different rows."""

import random

import brute
import pytest

from seasonforge.llm import embedding, html, langid, suffix, topk

# ---- pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>see <a href="/places/hidden/valley">the valley</a></p></article>', "see the valley"),
        ('<article><p title="a hidden gem">gem</p><p data-id="promo">one</p><p data-class="ad">two</p></article>', "gem\n\none\n\ntwo"),
        ("<article><p>one</p></article><article><p>a second article</p></article>", "one\n\na second article"),
        ("<div><p>The text of this page is here and not below</p></div><article>teaser</article>", "The text of this page is here and not below\n\nteaser"),
        ('<article><p>x</p><div class="related-work">y</div><div class="notice">z</div><div class="ad">no</div><ol class="comments"><li>no</ol></article>', "x\n\ny\n\nz"),
        ("<article><p hidden>no</p><p>a&amp;b&#x41;<br>c &lt;d&gt;</p></article>", "a&bA c <d>"),
        ("<article><header>" + "<div>" * 9000 + "<h1>deep</h1>" + "</div>" * 9000 + "</header><p>x</p></article>", "deep\n\nx"),
        ("<article>" + "<p>word " * 20_000 + "</article>", "\n\n".join(["word"] * 20_000)),
    ],
)
def test_html_cases(page, text):
    assert html.text_of(page, {}) == text


@pytest.mark.parametrize("most", (500_000, 0))
def test_html_recurring_parts_of_articles(spark, monkeypatch, most):
    """A box inside many different articles goes; prose, and what recurs in copies of one article, stays."""
    monkeypatch.setattr(html, "BROADCAST", most)
    page = "<article><p>Story {}</p><section>Read our other news</section><p>A shared saying</p></article>"
    copy = "<article><p>Same</p><section>All alike</section></article><footer>{}</footer>"
    rows = [(i, f"https://h.example/{i}", page.format(i)) for i in range(24)] + [(100 + i, f"https://h.example/c{i}", copy.format(i)) for i in range(30)]
    got = {r.page_id: r.text for r in html.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Story 5\n\nA shared saying" and got[105] == "Same\n\nAll alike"


# ---- repeated passages


def test_suffix_periodic_passages_anywhere(spark, monkeypatch):
    """Passages with a periodic stretch, copied to places around multiples of 65,536 of one long document."""
    monkeypatch.setattr(suffix, "RANGE_ROWS", 3000)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    common = word(70)
    texts, long, at = {}, "", 0
    for k in range(40):
        passage = word(20) + rng.choice(("ab", "x", "abc")) * 25 + word(20)
        texts[k] = word(30) + passage + word(30) + common + word(20)
        long += word(65_536 * (k // 8 + 1) - len(long) - rng.randrange(150)) + passage if k % 8 == 0 else word(rng.randrange(60)) + passage
    texts[100] = long
    got = {r.doc_id: tuple(r)[1:] for r in suffix.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute.repeated(texts)


# ---- embeddings


def test_topk_large_numbers_and_repeats(spark):
    rows = [(0, [1e20, -1e20]), (50, [1e20, 1.0]), (3, [0.5, 0.5]), (3, [0.5, 0.25]), (3, [0.5, 0.25]), (4, [0.5, 0.5]), (100, None), (5, [float("nan"), 1.0]), (6, [])]
    got = [tuple(r) for r in topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert [x[:3] for x in sorted(got)] == [(0, 1, 50), (0, 2, 3), (0, 3, 4), (0, 4, 6), (50, 1, 0), (50, 2, 4), (50, 3, 3), (50, 4, 6)]
    assert all(-(2**62) < x[3] < 2**62 for x in got)


def test_topk_many_equal_vectors(spark):
    rows = [(i, [0.5, 0.5] if i % 3 else [1.0, 0.0]) for i in range(120)]
    got = sorted(tuple(r) for r in topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = []
    for q in (0, 50, 100):
        score = lambda i: 256 * 256 if i % 3 == 0 and q % 3 == 0 else 256 * 128 if i % 3 == 0 or q % 3 == 0 else 2 * 128 * 128  # noqa: B023, E731
        best = sorted((i for i in range(120) if i != q), key=lambda i: (-score(i), i))[:5]
        want += [(q, r, i, score(i)) for r, i in enumerate(best, 1)]
    assert got == want


def test_vectors_of_one_id(spark):
    """Of different rows of an id the same one counts in every run."""
    rows = [(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.01]), (3, 0, [0.01, 1.0])]
    kind = "vec_id long, label int, embedding array<double>"
    one, two = (sorted(map(tuple, embedding.near_vectors(spark.createDataFrame(r, kind)).collect())) for r in (rows, rows[::-1]))
    assert one == two and len(one) == 4


# ---- language


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "Model", lambda langs, texts: seen.append((langs, texts)))
    rows = [(i, "en" if i % 3 else "de", f"text {i}") for i in range(3000)] * 2
    langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), sample=20)
    langs, _ = seen[0]
    assert langs.count("en") <= 20 and langs.count("de") <= 20 and len(langs) >= 20
