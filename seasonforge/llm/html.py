"""Main text of web pages by site template removal."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


# Element names by role in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title noembed noframes xmp".split())
DROPPED = frozenset("nav header footer aside form menu dialog button select option label fieldset head datalist".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu "
    "nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends an open element of these names, up to the boundary.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{k: ("p",) for k in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
BOUNDARY = {"li": ("ul", "ol", "menu"), "tr": ("table",), "td": ("table",), "th": ("table",), "dt": ("dl",), "dd": ("dl",)}
# Words of class names, ids and roles of what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription toolbar widget widgets".split()
)
OUTSIDE_WORDS = frozenset(("header", "topbar", "search"))
# Words of class names and ids that count inside the article too: in elements that are no prose and
# hold less than half of the page's text, in names of two words or more that have nothing else but words that go
# with them (a lone "notice" or "related-work" may well be the author's).
INSIDE_WORDS = frozenset(
    "advert adverts advertisement advertising adsense breadcrumb breadcrumbs consent cookie cookies disqus gdpr newsletter notice notices pager pagination popup promo promoted promotion related share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar".split()
)
FILLING = frozenset("area articles bar bars block box button buttons container form icon icons item items link links list message news overlay policy post posts row section stories wrap wrapper".split())
# Whole class names and ids of adverts, menus and reader comments; inside the article they count in any element.
INSIDE_NAMES = frozenset("ad ads advert adverts advertisement adsense comment comments comment-list disqus disqus_thread menu nav navbar newsletter sidebar sponsored".split())
PROSE = frozenset("p li td th tr pre blockquote dd dt".split()) | HEADINGS

#: A subtree is a template of its host when it is on so many of its pages with different articles; the second
#: number holds inside articles.  The same at every size of a host.
MIN_PAGES, INNER_PAGES = 5, 20
#: Articles (else main elements) are the main text if they hold this share of the page's text.
ARTICLE_SHARE = 0.25
#: Most template subtrees that are broadcast; beyond it they are joined by host.
BROADCAST = 500_000

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
QUOTED = re.compile(r"[>\"']")
#: Ends of raw elements, in either case of A to Z only: other letters may change their number when lowered.
RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
ASKED = frozenset("class id role hidden aria-hidden style itemprop".split())
SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An element: name, attributes, its start tag, children (nodes and texts), and what these hold."""

    __slots__ = ("children", "hash", "heading", "marks", "name", "parent", "tag", "text_size")

    def __init__(self, name: str, marks: dict, tag: str, parent: Node | None):
        self.name, self.marks, self.tag, self.parent = name, marks, tag, parent
        self.children, self.text_size, self.hash, self.heading = [], 0, 0, name in HEADINGS


def _marks(raw: str) -> dict:
    """The asked attributes of a start tag; the first of a name counts."""
    out = {}
    for m in ATTRIBUTE.finditer(raw):
        if (name := m[1].lower()) in ASKED:
            out.setdefault(name, (m[2] or m[3] or m[4] or "").lower())
    return out


def tag_end(html: str, pos: int, quotes: bool) -> tuple[int, bool]:
    """Where a tag ends that has begun before ``pos``, -1 if nowhere, and whether quotes go on to count.

    A ``>`` in quotes is no end.  Once a tag is met whose quotes don't close, or that has no other end, the
    next ``>`` ends it and all later ones, so that no page is searched again and again.
    """
    at = pos
    while quotes:
        m = QUOTED.search(html, at)
        if m is None:
            quotes = False
        elif m[0] == ">":
            return m.start(), True
        else:
            at = html.find(m[0], m.end()) + 1
            quotes = at > 0
    return html.find(">", pos), False


def parse(html: str) -> list[Node]:
    """The elements of a page in order of their starts, the root first; missing end tags are implied.

    Names of open elements are counted, so the open ones are only searched for a name that is among them.
    A tag without any end is text.  Time is linear in the length of the page.
    """
    root = at = Node("#root", {}, "", None)
    nodes, pos, n, quotes = [root], 0, len(html), True
    opened: Counter = Counter()

    def close(node: Node) -> None:
        nonlocal at
        while at is not node:
            opened[at.name] -= 1
            at = at.parent
        opened[at.name] -= 1
        at = at.parent

    while pos < n:
        m = TAG.search(html, pos)
        end = m.start() if m else n
        if end > pos:
            at.children.append(html[pos:end])
        if not m:
            break
        pos = m.end()
        name = m[2]
        if name is not None:
            stop, quotes = tag_end(html, pos, quotes)
            if stop < 0:
                at.children.append(html[end:])
                break
            raw, pos = html[pos:stop], stop + 1
        if name is None:
            if m[0].startswith("<![CDATA["):
                at.children.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name = name.lower()
        if m[1]:
            if opened[name]:
                node = at
                while node.name != name:
                    node = node.parent
                close(node)
            continue
        stop = BOUNDARY.get(name, ())
        for old in (CLOSES.get(name) or ()):
            if opened[old]:
                node = at
                while node is not root and node.name != old and node.name not in stop:
                    node = node.parent
                if node.name == old:
                    close(node)
        new = Node(name, _marks(raw) if raw else {}, html[end:pos], at)
        nodes.append(new)
        at.children.append(new)
        if name in RAW:
            over = RAW_END[name].search(html, pos)
            close_ = html.find(">", over.end()) if over else -1
            pos = n if close_ < 0 else close_ + 1
        elif name not in VOID and not (raw.endswith("/") and name not in BLOCKS):
            at = new
            opened[name] += 1
    for x in reversed(nodes):  # children before their parents
        parts = [x.tag]
        for c in x.children:
            if isinstance(c, str):
                parts.append(c)
                x.text_size += 0 if c.isspace() else len(c)
            else:
                parts.append(f"<{c.hash}>")
                x.text_size += c.text_size
                x.heading = x.heading or c.heading
        x.hash = xxhash.xxh3_64_intdigest("".join(parts).encode("utf-8", "surrogatepass")) - 2**63
    return nodes


def _unwanted(node: Node, inside: bool, whole: int) -> bool:
    """Whether an element is by its name or marks not part of the article; ``whole``: size of the page's text.

    A form that holds half of the text wraps the page and is none to fill in.
    """
    if node.name in RAW:
        return True
    if node.name in DROPPED and not (node.name == "form" and 2 * node.text_size >= whole):
        return not (inside and node.name == "header" and node.heading)
    m = node.marks
    if not m:
        return False
    if m.get("role") in ROLES or "hidden" in m or m.get("aria-hidden") == "true" or "display:none" in m.get("style", "").replace(" ", ""):
        return True
    names = m.get("class", "").split() + m.get("id", "").split()
    split = [set(SPLIT.split(x)) for x in names]
    if inside:
        noise = any(len(w) > 1 and not w.isdisjoint(INSIDE_WORDS) and w <= INSIDE_WORDS | FILLING for w in split)
        return not INSIDE_NAMES.isdisjoint(names) or noise and node.name not in PROSE and 2 * node.text_size < whole
    words = set().union(*split)
    return not words.isdisjoint(WORDS) or not words.isdisjoint(OUTSIDE_WORDS)


def _walk(of: list[Node]) -> Iterator[Node]:
    stack = list(of)
    while stack:
        x = stack.pop()
        yield x
        stack.extend(c for c in x.children if isinstance(c, Node))


def main_parts(nodes: list[Node]) -> list[Node]:
    """All outermost articles if they hold much of the text, else all main elements that do, else the page."""
    root = nodes[0]
    found: tuple[list[Node], list[Node]] = ([], [])
    stack = [root]
    while stack:
        x = stack.pop()
        article = x.name == "article" or x.marks.get("itemprop") == "articlebody"
        main = x.name == "main" or x.marks.get("role") == "main"
        if _unwanted(x, article or main, root.text_size):
            continue
        if article:
            found[0].append(x)
            continue
        if main:
            found[1].append(x)
        stack.extend(c for c in reversed(x.children) if isinstance(c, Node))
    for kind in found:
        if kind and sum(x.text_size for x in kind) >= ARTICLE_SHARE * root.text_size:
            return kind
    return [root]


def subtrees(nodes: list[Node], parts: list[Node]) -> Iterator[tuple[Node, bool]]:
    """Candidates for templates: block elements with text, and whether they are inside the article.

    In the article, prose elements are none: articles quote and repeat each other.  Where the whole page is
    taken, its prose counts as inside.
    """
    page = parts[0] is nodes[0]
    inner = set() if page else {id(x) for x in _walk(parts)}
    holding = set()
    for x in parts:
        while x is not None:
            holding.add(id(x))
            x = x.parent
    for x in nodes:
        if x.name not in BLOCKS or not x.text_size or id(x) in holding or x.name in ("html", "body", "head"):
            continue
        inside = id(x) in inner
        if not (inside and x.name in PROSE):
            yield x, inside or page and x.name in PROSE


def text_of(html: str, templates: dict[int, bool]) -> str:
    """Blocks of the article, joined by two line feeds.  ``templates``: hash to whether it holds inside articles."""
    nodes = parse(html)
    parts = main_parts(nodes)
    gone = {id(x) for x, inside in subtrees(nodes, parts) if x.hash in templates and (templates[x.hash] or not inside)} if templates else set()
    inside = parts[0] is not nodes[0]
    blocks, run = [], []

    def flush() -> None:
        text = " ".join(unescape("".join(run)).split())
        if text:
            blocks.append(text)
        run.clear()

    for part in parts:
        stack: list = [iter(part.children)]
        kinds: list[bool] = [True]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
                if kinds.pop():
                    flush()
            elif isinstance(x, str):
                run.append(x)
            elif id(x) in gone or _unwanted(x, inside, nodes[0].text_size):
                if x.name in BLOCKS:
                    flush()
            elif x.name in VOID:
                if x.name == "hr":
                    flush()
                elif x.name == "br":
                    run.append(" ")
            else:
                block = x.name in BLOCKS
                if block:
                    flush()
                stack.append(iter(x.children))
                kinds.append(block)
    return "\n\n".join(blocks)


def _hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p in parts:
        outer, inner, digest = [], [], []
        for html in p["html"]:
            nodes = parse(html.as_py() or "")
            parts_ = main_parts(nodes)
            found = {(x.hash, inside) for x, inside in subtrees(nodes, parts_)}
            outer.append(sorted(h for h, i in found if not i))
            inner.append(sorted(h for h, i in found if i))
            digest.append(xxhash.xxh3_64_intdigest(str([x.hash for x in parts_])) - 2**63)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([p["host"], pa.array(digest, pa.int64()), pa.array(outer, kind), pa.array(inner, kind)], ["host", "digest", "outer", "inner"])


def host():
    """Host of a url in lower case; an empty one if there is none."""
    return F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def host_templates(pages: DataFrame, min_pages: int = MIN_PAGES, inner_pages: int = INNER_PAGES) -> DataFrame:
    """Subtrees recurring on many pages of a host: ``host, hash, everywhere`` (false: not inside articles).

    Pages of a host with equal articles count once.
    """
    found = pages.select(host().alias("host"), "html").mapInArrow(_hashes, "host string, digest long, outer array<long>, inner array<long>")
    found = found.groupBy("host", "digest").agg(F.min(F.struct("outer", "inner")).alias("x")).select("host", "x.*")
    each = found.select("host", F.explode(F.concat(F.transform("outer", lambda h: F.struct(h.alias("hash"), F.lit(0).alias("in"))), F.transform("inner", lambda h: F.struct(h.alias("hash"), F.lit(1).alias("in"))))).alias("x"))
    counts = each.groupBy("host", "x.hash").agg(F.count("*").alias("n"), F.sum("x.in").alias("inner")).where(F.col("n") >= min_pages)
    counts = counts.where((F.col("n") > F.col("inner")) | (F.col("inner") >= inner_pages))
    return counts.select("host", "hash", (F.col("inner") >= inner_pages).alias("everywhere"))


def extract_text(pages: DataFrame, **options) -> DataFrame:
    """Main text of every page: ``page_id, url, text, n_chars``, per row.

    Site templates are found by ``host_templates`` and deleted; what is left outside the article by element
    names, roles and class words goes too; all articles (else main elements, else the page) are taken, and
    of their insides go forms, menus and the like by name, adverts and reader comments by whole class names.
    Character references are decoded, white space in a block becomes one space, blocks are trimmed and
    joined by two line feeds.

    A null html is empty and gives an empty text; a null url is a host of its own.  Repeated rows give
    repeated results and count once for templates.  Very long pages are taken whole.  An empty table gives
    no rows.  Other columns are ignored.
    """
    found = host_templates(pages, **options)
    rows = found.limit(BROADCAST + 1).collect()  # a bounded number of short rows
    keep = pages.select("page_id", "url", "html", host().alias("host"))
    if len(rows) <= BROADCAST:
        by: dict[str, dict[int, bool]] = {}
        for r in rows:
            by.setdefault(r.host, {})[r.hash] = r.everywhere
        shared = pages.sparkSession.sparkContext.broadcast(by)
        of = lambda p: (shared.value.get(h, {}) for h in p["host"].to_pylist())
    else:
        # a table of its own, so that Spark's skew join splits the pages of a large host
        lists = cut(found.groupBy("host").agg(F.collect_list("hash").alias("hashes"), F.collect_list("everywhere").alias("flags")))
        keep = keep.join(lists, "host", "left")
        of = lambda p: (dict(zip(h or (), f or (), strict=True)) for h, f in zip(p["hashes"].to_pylist(), p["flags"].to_pylist(), strict=True))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            texts = [text_of(html.as_py() or "", t) for html, t in zip(p["html"], of(p), strict=True)]
            yield pa.RecordBatch.from_arrays([p["page_id"], p["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = keep.schema["page_id"].dataType.simpleString()
    return keep.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
