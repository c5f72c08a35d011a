"""Pages that are easy to lose text of, or to spend much time on; and the rows of ``pages`` against a plain version."""

import html as stdlib_html
import re
import time

from seasonforge.llm import html, queries

SF = "/root/testdata/sf0.001"


def text(page):
    return html.text_of(page, {})


def test_letters_that_grow_when_lowered_lose_nothing():
    for letter in ("I", "İ", "ẞ", "Å"):
        page = f"<p>{letter * 50}</p><script>x</script><p>Hello there</p><STYLE>y</StYlE ><p>World</p><p>More</p>"
        assert text(page).split("\n\n") == [letter * 50, "Hello there", "World", "More"]
    assert text("<p>a</p><script>var s = '</ſcript>';</script><p>b</p>") == "a\n\nb"  # a long s is no s


def test_unclosed_quotes_take_linear_time():
    took = []
    for unit in ("<a '", "<a '>' ", '<a "x <b \'y ', "<!-- ", "<script", "</a '"):
        for n in (20_000, 80_000):
            began = time.process_time()
            html.parse(unit * n)
            html.parse(unit * n + "><p>end</p>")
            took.append(time.process_time() - began)
    assert max(took) < 8


def test_text_after_broken_tags_stays():
    assert text("<p>one</p><a href='x>link</a><p>two</p><p>three</p>").endswith("three")
    assert text("<p>one</p><b title=\"a > b\">two</b> 1 < 2 <3").replace("\n\n", " ") == "one two 1 < 2 <3"
    assert text("plain <b") == "plain <b"


def test_notices_inside_articles_go():
    body = "<p>" + "Long article text. " * 30 + "</p>"
    for name in ("cookie-notice", "related-posts", "share-buttons", "newsletter_box"):
        assert text(f'<article>{body}<div class="{name}"><p>Noise</p></div><p>End.</p></article>').endswith("text.\n\nEnd.")
    for keep in ('<p class="cookie-notice">Kept</p>', '<div class="related-work"><p>Kept</p></div>', '<div class="noticeable"><p>Kept</p></div>'):
        assert "Kept" in text(f"<article>{body}{keep}</article>")
    assert "Long" in text(f'<article><div class="related-posts">{body}</div></article>')  # most of the page


def test_pages_wrapped_in_a_form_stay():
    page = '<body><form id="aspnet"><nav>Menu</nav><h1>Title</h1><p>' + "Body text. " * 20 + '</p><form class="login">Name</form></form></body>'
    assert text(page).startswith("Title\n\nBody text.") and "Menu" not in text(page)
    assert "Name" not in text("<article><p>" + "Body text. " * 20 + "</p><form>Name</form></article>")


def test_columns_of_other_names(spark):
    rows = [(1, "http://a.x/1", "<p>one</p>", "h", "t", 5), (1, "http://a.x/1", "<p>one</p>", "h", "t", 5), (2, None, None, "h", "t", 6)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text string, n_chars int")
    assert sorted(map(tuple, html.extract_text(d).collect())) == [(1, "http://a.x/1", "one", 3), (1, "http://a.x/1", "one", 3), (2, None, "", 0)]


def plain(page):
    """The article of the pages of this table: elements without attributes, paragraphs that may lack an end tag."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    body = re.sub(r"<!--.*?-->|<(script|style|nav|footer|form|aside)\b.*?</\1>", "", found[1], flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|h3|li|ul|ol|div|blockquote|pre|table|tr|td|section)\b[^>]*>", body)
    texts = [" ".join(stdlib_html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_pages_equal_a_plain_version(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in queries.op2_html(spark, SF).collect()}
    plain_ones = {k: h for k, h in pages.items() if h and h.count("<article>") == 1 and not re.search(r"<(?:article|div|p|section)[^>]*(?:class|id|role|style)=", h.partition("<article>")[2].partition("</article>")[0])}
    assert len(plain_ones) > 0.8 * len(pages)
    assert {k: got[k] for k in plain_ones} == {k: plain(h) for k, h in plain_ones.items()}
