"""Main text of web pages: flat text blocks classified by a small decision tree.

A page becomes a flat list of text blocks. Each has its word count and link density, those of the
blocks before and after it, and what the regions around it say: by tag or role, and by the share
of words in their class and id names that tell a side region; and whether a heading
before it begins the readers' comments. A decision tree grown on a small
table of labelled pages says which blocks belong to the article. Pages are read
in Arrow batches; a batch's blocks are classified at once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_text

# Tags and the words of class and id names that tell what a region is.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SILENT_TAGS = frozenset("script style noscript template iframe object svg math canvas textarea select button datalist title audio video".split())
#: Their content is no markup: without an end tag they take the rest of the page.
RAW_TAGS = frozenset("script style textarea title".split())
#: Drawings and formulas: a block tag in them ends them, as in a browser.
FOREIGN_TAGS = frozenset("svg math".split())
SIDE_TAGS = frozenset("nav menu footer aside form dialog".split())
SIDE_ROLES = frozenset("navigation contentinfo complementary search form dialog alert".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot adsense sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices notification "
    "alert popup modal overlay newsletter subscribe subscription signup login register sidebar sidenav rail widget widgets related recommended recommendations teaser teasers trending popular "
    "share sharing social follow breadcrumb breadcrumbs crumbs menu menus nav navbar navigation toolbar topbar masthead footer copyright legal disclaimer "
    "search searchbox pagination pager paging skip skiplink paywall form aside".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: A heading of these words and numbers alone begins the readers' comments.
COMMENT_TITLES = frozenset("comment comments reply replies responses reader readers leave a an your all and".split())
HEADER_WORDS = frozenset("header head pageheader siteheader".split())
#: Words of names that say where or in what shape, not what.
SHAPE_WORDS = frozenset(
    "area bar block bottom box cell center col column columns container fixed full global grid group inner item items js large left links list lower module narrow outer page panel right row section site "
    "slot small sticky sub top unit upper view wide wrap wrapper".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

# What follows a tag's name; an attribute's value may hold a ">" in quotes.
_TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>")
#: What ends an element whose text isn't shown: its end tag, and for drawings and formulas a block tag of HTML.
_ENDS = {t: re.compile(rf"</{t}\s*+>" + (r"|<(?:p|div|h[1-6]|ul|ol|dl|table|blockquote|pre|body|center)[\s/>]" if t in FOREIGN_TAGS else ""), re.I) for t in SILENT_TAGS}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|data-main|data-side)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass(frozen=True)
class Marks:
    """What the elements around a text say. ``side``: by tag, role or being hidden. Shares: of a name's words, the largest of all names."""

    article: bool = False
    side: bool = False
    header: float = 0.0
    named: float = 0.0
    comment: float = 0.0
    truth: bool | None = None  # of labelled pages alone

    def within(self, outer: Marks) -> Marks:
        """Both together."""
        return Marks(
            self.article or outer.article, self.side or outer.side, max(self.header, outer.header), max(self.named, outer.named), max(self.comment, outer.comment),
            outer.truth if self.truth is None else self.truth,
        )


_NONE = Marks()


@dataclass
class Block:
    text: str
    words: int
    linked: int
    marks: Marks
    heading: int  # 1 to 6, or 0
    in_comments: bool = False  # under a heading that begins the readers' comments


def _shares(name: str) -> tuple[float, float, float]:
    """Of a name's words that aren't shapes, the shares that tell a side region, comments and a header."""
    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w and w not in SHAPE_WORDS]
    count = lambda table: sum(w in table for w in words) / max(1, len(words))
    return count(SIDE_WORDS), count(COMMENT_WORDS), count(HEADER_WORDS)


def _begins_comments(title: str) -> bool:
    words = re.findall(r"[a-z]+", title[:200].lower())
    return len(words) <= 5 and bool(COMMENT_WORDS & set(words)) and COMMENT_TITLES.issuperset(words)


@lru_cache(maxsize=1 << 14)
def _marks(tag: str, attrs: str) -> Marks:
    article, side, header, truth = tag in ("article", "main"), tag in SIDE_TAGS, float(tag == "header"), None
    named = comment = 0.0
    if not attrs or tag in ("html", "body"):
        return Marks(article, side, header)
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values), name.lower()
        if name in ("class", "id"):
            for one in value.split():
                n, c, h = _shares(one)
                named, comment, header = max(named, n), max(comment, c), max(header, h)
        elif name == "role":
            article |= value.lower() in ("main", "article")
            side |= value.lower() in SIDE_ROLES
            header = max(header, float(value.lower() == "banner"))
        elif name in ("hidden", "aria-hidden", "style"):
            side |= name == "hidden" or (value.lower() == "true" if name == "aria-hidden" else re.search(r"display\s*:\s*none", value) is not None)
        else:
            truth = name == "data-main"
    return Marks(article, side, header, named, comment, truth)


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order; scripts, styles and markup are gone, character references decoded.

    Takes time in proportion to the page, whatever its markup: a search that has failed once is
    not made again.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []
    stack: list[tuple[str, Marks]] = []
    is_open: Counter = Counter()
    marks = _NONE
    links, heading, at, end = 0, 0, 0, len(html)
    comments_level = 0
    quotes, last_gap = True, html.rfind(">")
    never_shut: set[str] = set()

    def close() -> None:
        nonlocal comments_level
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = text.count(" ") + 1
                if heading and (not comments_level or heading <= comments_level):
                    comments_level = heading if _begins_comments(text) else 0
                out.append(Block(text, n, min(n, len(" ".join(linked_parts).split())), marks, heading, comments_level > 0))
            parts.clear()
            linked_parts.clear()

    def say(a: int, b: int) -> None:
        if b > a:
            text = unescape(html[a:b])  # a reference doesn't go on behind a tag
            parts.append(text)
            if links:
                linked_parts.append(text)

    def leave(depth: int) -> Marks:
        was = stack[depth][1]
        for t, _ in stack[depth:]:
            is_open[t] -= 1
        del stack[depth:]
        return was

    while at < end:
        stop = html.find("<", at)
        if stop < 0 or stop > last_gap and not html.startswith("<!--", stop):
            say(at, end)
            break
        if html.startswith("<!--", stop):
            say(at, stop)
            shut = html.find("-->", stop + 4)
            at = shut + 3 if shut >= 0 else end
            continue
        if html[stop + 1] in "!?":
            say(at, stop)
            at = html.find(">", stop) + 1
            continue
        m = _TAG.match(html, stop + 1) if quotes else None
        if m is None and (plain := _PLAIN_TAG.match(html, stop + 1)):
            m, quotes = plain, False  # a quote that doesn't end: from here on quotes are letters
        if m is None:
            say(at, stop + 1)
            at = stop + 1
            continue
        say(at, stop)
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag in SILENT_TAGS and not closing and not m[3].endswith("/"):
            shut = None if tag in never_shut else _ENDS[tag].search(html, at)
            if shut is None:
                never_shut.add(tag)
                at = end if tag in RAW_TAGS else at
            else:
                at = shut.end() if shut[0][1] == "/" else shut.start()
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag not in BLOCK_TAGS and not (closing and is_open[tag]) and not (not closing and m[3] and _marks(tag, m[3]) != _NONE):
            continue
        close()
        if tag in VOID_TAGS:
            continue
        if closing:
            if is_open[tag]:
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                marks = leave(depth)
            if tag in HEADINGS:
                heading = 0
            continue
        if tag in HEADINGS:
            heading = int(tag[1])
        elif tag in BLOCK_TAGS:
            heading = 0
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option", *HEADINGS):  # may be left open: don't nest in themselves
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] == tag:
                    marks = leave(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                    break
        new = _marks(tag, m[3])
        stack.append((tag, marks))
        inside = is_open["aside"] or is_open["footer"] or is_open["form"] or marks.comment > 0.4
        is_open[tag] += 1
        # an article ends a side region before it that was left open
        marks = replace(new, truth=new.within(marks).truth) if new.article and not inside and not new.side and max(new.named, new.comment) < 0.5 else new.within(marks)
    close()
    return out


# The labelled table: pages with their markup, "{n}" for n words of text; what has data-main is the article's text, but for what has data-side in it.
LABELLED = """
<nav><ul><li><a href=a>{1}</a><li><a href=b>{2}</a><li><a href=c>{1}</a></ul></nav><div class=ad>{8}</div><article data-main><h1>{9}</h1><p>{60}<br>{4}<p>{1}</p><p>{24}</p><p>{120}</p></article><footer>{10} <a>{2}</a></footer>
<nav><a>{1}</a><a>{3}</a></nav><article data-main><h1>{3}</h1><p>{2}<p>{300}<p>{35} <a>{4}</a><p><a>{4}</a></article><aside><h4>{1}</h4><p>{40}</p></aside><footer>{8} <a>{8}</a></footer>
<article data-main><h1>{10}</h1><p>{45}</p><p>{1}</p><p>{1}</p><div class="share-buttons" data-side><a>{1}</a> <a>{1}</a> <a>{2}</a></div><p>{15}</p></article><div class="comments"><p>{25}</p><p>{10}</p><p>{150}</p></div>
<header><h2>{2}</h2><p>{12}</p></header><div class="cookie-notice"><p>{15}</p></div><main data-main><h1>{5}</h1><p>{200}</p><p>{14}</p><h3>{2}</h3><ul><li>{3}<li>{1}<li>{6}</ul></main><div class="footer">{5}</div>
<div class="top-nav"><a>{1}</a></div><div class="menu-item"><a>{2}</a></div><div class="post"><div class="post-header"><h1 data-main>{6}</h1></div><div class="post-body" data-main><p>{70}</p><p>{42}</p><p>{110}</p><p>{8}</p></div></div><div class="related-posts"><h3>{2}</h3><a>{8}</a></div>
<div class="entry-header"><h1 data-main>{1}</h1></div><p data-main>{5}</p><p data-main>{30}</p>
<div class="article-header"><h1 data-main>{4}</h1></div><p data-main>{1}</p>
<div class="comment-policy-guide" data-main><p>{100}</p><p>{40}</p></div>
<div class="search-engine-history" data-main><h1>{4}</h1><p>{90}</p><p>{12}</p></div>
<div class="notice-period-law" data-main><p>{55}</p></div>
<article data-main><p>{30}</p><div class="share-value"><p>{9}</p></div><p>{3}</p><div class="form-factor">{14}</div><p>{1}</p><div class="menu-recipe"><p>{25}</p></div></article>
<article data-main><p>{1}</p><div class="cookie-recipe">{7}</div><p>{1}</p></article>
<article data-main><h2>{3}</h2><p>{3}</p><div class="social-science">{20}</div><div class="legal-history">{60}</div></article>
<div><a>{1}</a></div><div><a>{1}</a></div><h1 data-main>{6}</h1><p data-main>{40}</p><p data-main>{60}</p><p data-main>{35} <a>{1}</a></p><div><a>{1}</a></div><div><a>{2}</a></div>
<div><a>{3}</a> {2}</div><p data-main>{20}</p><p data-main>{25}</p><p data-main>{18} <a>{2}</a></p><p data-main>{140}</p><div><a>{2}</a></div><div class="newsletter"><p>{30}</p></div>
<article data-main><p>{3}</p></article>
<article data-main><p><a>{1}</a></p></article>
<article data-main><h1>{2}</h1><p>{650}</p><p>{800}</p></article><div class=legal>{3}</div>
<p data-main>{80}</p><p data-main>{120}</p><p data-main>{500}</p>
<p data-main>{1}</p>
<p data-main>{3}</p>
<div data-main>{2}</div>
<article data-main><h1>{4}</h1><p>{20}</p><div class="advert" data-side>{9}</div><p>{50}</p><div class="newsletter-signup" data-side><h4>{3}</h4><p>{22}</p></div><p>{6}</p><form data-side>{5}</form><section id="comments" data-side><h3>{1}</h3><p>{90}</p><p>{200}</p><p>{7}</p></section></article>
<div id="sidebar"><h3>{2}</h3><p>{80}</p><ul><li><a>{4}</a><li><a>{5}</a></ul></div><div id="content" data-main><h1>{7}</h1><p>{75}</p><p>{33}</p><p>{5}</p></div><div id="disqus"><p>{45}</p><p>{130}</p></div><div id="footer"><p>{20}</p></div>
<div role=banner>{3}</div><div role=main data-main><p>{22}</p><p>{9}</p></div><div role=complementary><p>{60}</p></div><div role=contentinfo>{9}</div>
<div class="site-header"><h1>{2}</h1><p>{9}</p></div><div class="nav-bar"><a>{1}</a> <a>{1}</a></div><article data-main><h1>{8}</h1><p>{95}</p></article><div class="popup">{25}</div><div class="gdpr">{60}</div><div style="display: none">{40}</div>
<header><p>{4}</p><h2>{2}</h2></header><article data-main><header><h1>{7}</h1></header><p>{18}</p><p>{220}</p></article><aside>{150}</aside><aside><p>{5}</p></aside>
<div class="breadcrumbs"><a>{1}</a> <a>{2}</a></div><main data-main><article><p>{4}</p><p>{44}</p><blockquote>{3}</blockquote></article></main><div class="recommended"><p>{12}</p><p>{30}</p></div><div class="copyright">{6}</div>
<div class="header"><p>{10}</p><a>{1}</a></div><article data-main><p>{12}</p><table><tr><td>{1}<td>{1}<tr><td>{2}<td>{1}</table></article><div class="article-comments"><p>{60}</p><p>{14}</p></div>
<article data-main><p>{30}</p><aside data-side>{12}</aside><p>{16}</p><nav data-side><a>{3}</a></nav><p>{70}</p><footer data-side>{9}</footer></article>
<article data-main><h1>{5}</h1><p>{10}</p><form data-side><label>{4}</label></form><p>{10}</p><aside data-side><p>{80}</p><p>{6}</p></aside><p>{3}</p></article>
<main data-main><p>{44}</p><div class="sharing-tools" data-side><a>{2}</a> <a>{1}</a></div><p>{51}</p><div class="social-media" data-side><a>{1}</a> <a>{3}</a></div></main>
<article data-main><p>{20}</p><p>{9} <a>{12}</a></p><ul><li><a>{6}</a><li><a>{4}</a></ul><p>{7}</p></article>
<h1 data-main>{5}</h1><p data-main>{66}</p><p data-main>{20}</p><div class="commentlist"><p>{30}</p><p>{4}</p></div><div class="discussion"><p>{90}</p></div>
<div class="text" data-main><p>{37}</p><p>{48}</p></div><ul id="replies"><li>{20}<li>{61}</ul><div class="subscribe-box">{14}</div>
<div class="form-theory" data-main><p>{70}</p><p>{15}</p></div><div class="follow-us"><a>{1}</a> <a>{2}</a></div>
<div><a>{2}</a></div><div class="advertising-history" data-main><h1>{3}</h1><p>{44}</p><p>{90}</p></div><div class="trending-stories"><a>{7}</a> <a>{9}</a></div>
<header><h1>{2}</h1><p>{7}</p></header><div class="site-header">{12}</div><h1 data-main>{6}</h1><p data-main>{62}</p><p data-main>{4}</p><footer>{15}</footer>
<header><p>{20}</p></header><p data-main>{130}</p><p data-main>{9}</p><nav><a>{1}</a><a>{2}</a></nav><aside><p>{100}</p></aside>
<header><h2>{3}</h2></header><div class="story"><h1 data-main>{7}</h1><p data-main>{50}</p></div><form>{12}</form><dialog>{30}</dialog>
<article data-main><p>{100}</p></article><div class="post-comments"><h3>{2}</h3><p>{35}</p><p>{80}</p></div><div class="user-replies">{50}</div>
<article data-main><p>{30} <a>{10}</a></p><p>{40}</p><p>{6} <a>{3}</a></p><p>{25}</p><p>{2} <a>{2}</a></p><p>{50}</p><ul><li><a>{3}</a><li><a>{5}</a> {2}</ul><p>{80} <a>{20}</a></p><p>{60}</p></article>
<main data-main><p>{12} <a>{3}</a></p><p>{18}</p><p>{4} <a>{1}</a></p><h2><a>{4}</a></h2><p>{55}</p></main><div class="share-links"><a>{1}</a> <a>{2}</a></div><p class="related">{14} <a>{9}</a></p>
<article data-main><p>{30}</p><div class="share-price">{3}</div><p>{12}</p><div class="banner-history">{2}</div><p>{40}</p></article>
<div>{4}</div><div><a>{1}</a> <a>{1}</a> <a>{2}</a></div><div data-main>{6}</div><div data-main>{45}</div><div data-main>{3}</div><div data-main>{60}</div><div>{4} <a>{5}</a></div><div>{7}</div>
<table><tr><td><a>{1}</a><td><a>{2}</a></table><table><tr><td data-main>{5}<tr><td data-main>{50}<tr><td data-main>{70}<tr><td data-main>{4}<tr><td data-main>{55}</table><table><tr><td><a>{2}</a><td>{6}</table>
<p>{3}</p><p><a>{2}</a> <a>{1}</a></p><p data-main>{8}</p><p data-main>{33}</p><p data-main>{2}</p><p data-main>{90}</p><p data-main>{41}</p><p><a>{3}</a></p><p>{9}</p><p><a>{2}</a></p>
<div><a>{2}</a></div><div>{2}</div><div><a>{3}</a></div><div>{1}</div><div><a>{2}</a></div><div data-main>{28}</div><div data-main>{9}</div><div data-main>{77}</div><div><a>{6}</a></div><div>{3}</div><div><a>{6}</a></div><div>{3}</div><div><a>{5}</a></div>
<h1 data-main>{6}</h1><p data-main>{40}</p><p data-main>{2}</p><p data-main>{52}</p><p>{1} <a>{4}</a></p><p>{2} <a>{6}</a></p><p>{8}</p>
<ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a></ul><h1 data-main>{5}</h1><p data-main>{30}</p><ul><li data-main>{3}<li data-main>{5}<li data-main>{2}</ul><p data-main>{64}</p><ul><li><a>{4}</a><li><a>{3}</a></ul><p>{10}</p>
<div>{6} <a>{1}</a> <a>{1}</a></div><div data-main>{4}</div><div data-main>{120}</div><div data-main>{12}</div><div data-main>{80}</div><div><a>{3}</a></div><div><a>{4}</a></div><div>{5}</div>
<h1 data-main>{5}</h1><p data-main>{70}</p><p data-main>{25}</p><h3>Comments</h3><p>{20}</p><p>{60}</p><p>{4}</p>
<div class="c1"><h1 data-main>{5}</h1><p data-main>{40}</p></div><div class="c4"><h2>3 Comments</h2><h4>{2}</h4><p>{30}</p><h4>{2}</h4><p>{90}</p></div>
<article><h1 data-main>{5}</h1><p data-main>{70}</p><p data-main>{8}</p><h2>Leave a reply</h2><p>{14}</p><p>{40}</p><p>{80}</p></article>
"""
#: Five more pages by a rule: paragraphs of an article with links of many lengths between plain ones.
LABELLED += "\n".join(
    "<nav><a>{1}</a> <a>{2}</a></nav><article data-main><h1>{6}</h1>" + "".join(f"<p>{{{n}}} <a>{{{m}}}</a></p><p>{{{k}}}</p>" for n in (0, 1, 3, 9, 30) for m in (1, 2, 5, 12)) + "</article><footer>{9}</footer>"
    for k in (1, 4, 20, 70, 200)
)
NAMES = (
    "words", "link density", "words before", "link density before", "words after", "link density after", "in the article", "in a side tag", "side words in a name", "comment words in a name",
    "header words in a name", "heading", "page has an article", "under a comment heading",
)


def block_features(found: list[list[Block]]) -> np.ndarray:
    """A row of ``NAMES`` for each block of each page; there is nothing beyond a page's ends."""
    flat = [b for page in found for b in page]
    n = len(flat)
    if not n:
        return np.zeros((0, len(NAMES)))
    page = np.repeat(np.arange(len(found)), [len(p) for p in found])
    words = np.array([b.words for b in flat], float)
    density = np.array([b.linked for b in flat]) / np.maximum(words, 1)
    mark = lambda name: np.array([getattr(b.marks, name) for b in flat], float)
    last = np.r_[page[1:] != page[:-1], True]
    first = np.r_[True, last[:-1]]
    near = lambda v, step, edge: np.where(edge, 0, v[np.clip(np.arange(n) + step, 0, n - 1)])
    has = np.zeros(len(found), bool)
    np.logical_or.at(has, page, (mark("article") > 0) & (mark("side") == 0))
    cols = [
        words, density, near(words, -1, first), near(density, -1, first), near(words, 1, last), near(density, 1, last), mark("article"), mark("side"), mark("named"), mark("comment"),
        mark("header"), np.array([b.heading > 0 for b in flat]), has[page], np.array([b.in_comments for b in flat]),
    ]
    return np.stack([np.asarray(c, float) for c in cols], 1)


def labelled_blocks(table: str = LABELLED) -> tuple[list[list[Block]], np.ndarray]:
    """The blocks of labelled pages and their labels."""
    found, label = [], []
    for line in table.strip().split("\n"):
        page = blocks(re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])), line))
        found.append(page)
        label += [b.marks.truth is True for b in page]
    return found, np.array(label, int)


@dataclass(frozen=True)
class Tree:
    """A node asks whether a feature is at most a threshold; a leaf has no feature and gives its label."""

    label: int
    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int8)
        todo: list[tuple[Tree, np.ndarray]] = [(self, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node.feature < 0:
                out[rows] = node.label
                continue
            low = x[rows, node.feature] <= node.threshold
            todo += [(node.low, rows[low]), (node.high, rows[~low])]
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 1) -> Tree:
    """A classification tree by Gini impurity; of equal splits the first feature and threshold."""
    label = int(2 * y.sum() > len(y))
    if depth == 0 or y.all() or not y.any():
        return Tree(label)
    best: tuple[float, int, float] | None = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            if min(low.sum(), (~low).sum()) < least:
                continue
            impurity = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best is None:
        return Tree(label)
    low = x[:, best[1]] <= best[2]
    return Tree(label, best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


@cache
def default_tree() -> Tree:
    found, label = labelled_blocks()
    return grow(block_features(found), label)


def main_texts(pages: list[str], tree: Tree) -> list[str]:
    found = [blocks(html) for html in pages]
    keep = iter(tree.predict(block_features(found)).tolist())
    return [" ".join([b.text for b in page if next(keep)]) for page in found]


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for each page's whole html (null: empty).

    Equal rows give equal rows; an empty table none; other columns are not read.
    """
    tree = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(as_text(batch, "html"), tree)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(pages: DataFrame) -> DataFrame:
    """The main text of each page by the tree of the labelled table; odd rows: see ``extract``."""
    return extract(pages)


#: For pages of the given tables' one template: what stands in the article element.
OP10_SQL = r"""
WITH a AS (SELECT page_id, url, coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '') AS body FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '</?(p|h1|br)>', ' ', 'g') AS body FROM a),
c AS (
  SELECT page_id, url, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body,
    '&amp;?', chr(1), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#(x27|39);', '''', 'g'), chr(1), '&') AS body FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
