"""HTML extraction: flat text blocks, classified by a decision tree.

A page's html is cut into flat blocks of text at the tags that begin or end a block. Each block has its word count, its
link density (share of words inside links), the same of the blocks before and after it, and three marks of where it
stands: inside an article or main element (or on a page that has none), inside furniture (menus, footers, adverts, forms,
comments and the like), and whether it is a heading. A decision tree, grown on the small labelled table below by Gini impurity,
keeps or drops each block; the kept ones, joined by newlines, are the text.

Furniture is told by tag, by role, and by whole names: a class or id counts only if every word in it is a word of furniture or
of layout (share-bar, not share-price), a text's own elements (paragraphs, headings, items, cells) only by the words of adverts,
and their ids never, for those are made from what they say. Sections inside an article are not told by the weaker words as an
id. An element told by name, or a form, that holds more than half of the article's words is no furniture, unless it is one of
reader comments.

Pages are independent: one streaming map, no shuffle. The tree is grown from the fixed table wherever it is needed.
A column of pages named like the result is replaced by it. Null and empty pages give empty texts; markup cut off at the end of a page is dropped; repeated rows repeat. Elements of
raw text are dropped to their closing tag or the end of the page; drawings, objects, lists of choices and the like as far
as the tags tell: a self-closed one ends at its tag, one that is never closed drops nothing. The text of formulas stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import short_batches

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
PLAIN = re.compile(r"[^<>\"']*+")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements of raw text, foreign ones, and those dropped with all that stands in them.
RAW, FOREIGN = set("script style iframe textarea title".split()), {"svg", "math"}
DROPPED = set("noscript template svg object select canvas".split())
# Elements that begin and end blocks, void elements, furniture by tag, role and word of a class or id.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("nav footer aside form menu dialog button fieldset head label".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words of adverts, of reader comments, other words of furniture, weaker ones, and words of layout, in classes and ids.
ADVERTS = set("ad ads advert adverts advertisement adbox adslot consent cookie cookies gdpr sponsored".split())
COMMENTS = set("comment comments commentlist disqus respond replies".split())
STRONG = set("breadcrumb breadcrumbs footer login masthead menu modal nav navbar newsletter pager pagination paywall popup sidebar signin signup toolbar topbar widget".split())
WEAK = set("advertising banner byline captcha copyright dialog header navigation notice notification overlay popular promo promoted promotion rail recommended related reply share sharing skip social sponsor subscribe subscription tags tooltip trending".split())
LAYOUT = set("area articles bar block body bottom box btn button buttons center col column container content count cta fixed form global group icon icons inner item items left line link links list main message mobile page panel placeholder post posts primary right row secondary section site slot small sticky stories strip text title toggle top unit wrap wrapper".split())
#: Elements that a text itself is made of.
OWN = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th tr table tbody figure figcaption caption em strong b i u code mark sup sub q cite abbr time".split())
#: Share of the article's words from which on an element is no furniture by its name; so many names in each other are looked at.
LARGE, NAMES_DEEP = 0.5, 4
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element of the key ends at the start of one of its values.
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: A block inside a drawing ends it, unless it stands in a part of the drawing that is made for HTML.
ENDS["svg"] = BLOCKS
SCOPES = BLOCKS | DROPPED | {"foreignobject"}
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "furniture", "heading")

# The labelled table: the features of blocks from hand-made pages, in the order of FEATURES, then 1 if the block belongs to the article.
LABELLED = [
    # articles in an article or main element: headings, long and short paragraphs, lists, paragraphs full of links
    (9, 0.0, 8, 0.0, 60, 0.0, 1, 0, 1, 1), (60, 0.0, 9, 0.0, 45, 0.0, 1, 0, 0, 1), (45, 0.05, 60, 0.0, 4, 0.0, 1, 0, 0, 1), (4, 0.0, 45, 0.0, 90, 0.0, 1, 0, 0, 1),
    (1, 0.0, 4, 0.0, 12, 0.0, 1, 0, 0, 1), (12, 0.0, 90, 0.02, 8, 0.0, 1, 0, 0, 1), (150, 0.1, 12, 0.0, 9, 0.1, 1, 0, 0, 1), (3, 0.0, 30, 0.0, 25, 0.0, 1, 0, 1, 1),
    (7, 0.0, 3, 0.0, 6, 0.0, 1, 0, 0, 1), (6, 0.4, 7, 0.0, 8, 0.3, 1, 0, 0, 1), (5, 1.0, 40, 0.1, 35, 0.0, 1, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1),
    (1, 0.0, 1, 1.0, 0, 0.0, 1, 0, 0, 1), (30, 0.0, 1, 1.0, 10, 0.1, 1, 0, 1, 1), (11, 0.0, 2, 1.0, 14, 0.0, 1, 0, 1, 1), (22, 0.0, 12, 0.0, 13, 0.0, 1, 0, 0, 1),
    (4, 0.0, 3, 0.0, 1, 0.0, 1, 0, 0, 1), (1, 0.0, 4, 0.0, 3, 0.0, 1, 0, 0, 1), (9, 0.0, 1, 0.0, 2, 0.0, 1, 0, 0, 1), (14, 0.0, 2, 1.0, 3, 1.0, 1, 0, 0, 1), (3, 0.0, 2, 1.0, 2, 1.0, 1, 0, 0, 1),
    (5, 0.0, 4, 1.0, 3, 1.0, 1, 0, 1, 1), (10, 0.0, 9, 1.0, 0, 0.0, 1, 0, 0, 1), (2, 1.0, 3, 1.0, 3, 1.0, 1, 0, 0, 1), (6, 0.9, 40, 0.0, 5, 1.0, 1, 0, 0, 1), (12, 0.8, 4, 1.0, 9, 0.9, 1, 0, 0, 1),
    (20, 0.95, 30, 0.0, 3, 1.0, 1, 0, 0, 1), (7, 0.5, 9, 0.6, 4, 1.0, 1, 0, 0, 1), (30, 0.7, 8, 1.0, 6, 1.0, 1, 0, 0, 1), (4, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 1), (3, 1.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1), (8, 1.0, 8, 1.0, 8, 1.0, 1, 0, 0, 1),
    # furniture in articles: share bars, adverts, comments, forms, related links
    (4, 1.0, 40, 0.0, 4, 1.0, 1, 1, 0, 0), (9, 0.0, 60, 0.0, 55, 0.0, 1, 1, 0, 0), (35, 0.0, 50, 0.0, 42, 0.0, 1, 1, 0, 0), (80, 0.02, 35, 0.0, 20, 0.0, 1, 1, 0, 0),
    (3, 0.0, 20, 0.0, 6, 0.5, 1, 1, 1, 0), (12, 0.3, 20, 0.0, 2, 0.0, 1, 1, 0, 0), (1, 0.0, 30, 0.0, 1, 0.0, 1, 1, 0, 0),
    # furniture outside of articles: menus, adverts, notices, footers, side columns
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (9, 0.0, 1, 1.0, 11, 0.0, 0, 1, 0, 0),
    (14, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 0), (40, 0.1, 2, 1.0, 9, 0.0, 0, 1, 0, 0), (70, 0.0, 80, 0.0, 0, 0.0, 0, 1, 0, 0), (120, 0.0, 9, 0.0, 6, 0.0, 0, 1, 0, 0), (3, 0.0, 2, 0.0, 5, 1.0, 0, 1, 1, 0),
    # outside of the article on pages that have one
    (12, 0.0, 3, 1.0, 40, 0.0, 0, 0, 0, 0), (40, 0.0, 12, 0.0, 9, 0.0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1, 0), (90, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 50, 0.0, 2, 1.0, 0, 0, 0, 0),
    # pages without an article element: long texts, short paragraphs, lists and headings
    (50, 0.0, 2, 1.0, 40, 0.0, 0.5, 0, 0, 1), (40, 0.05, 50, 0.0, 35, 0.0, 0.5, 0, 0, 1), (18, 0.0, 40, 0.0, 60, 0.0, 0.5, 0, 0, 1), (5, 0.0, 60, 0.0, 45, 0.0, 0.5, 0, 0, 1), (8, 0.0, 3, 1.0, 55, 0.0, 0.5, 0, 1, 1),
    (4, 0.0, 25, 0.0, 30, 0.0, 0.5, 0, 0, 1), (25, 0.2, 18, 0.0, 3, 1.0, 0.5, 0, 0, 1), (14, 0.0, 8, 0.0, 20, 0.0, 0.5, 0, 0, 1), (100, 0.1, 6, 0.0, 5, 0.9, 0.5, 0, 0, 1), (6, 0.0, 2, 1.0, 80, 0.0, 0.5, 0, 1, 1),
    (10, 0.0, 5, 0.0, 10, 0.0, 0.5, 0, 0, 1), (10, 0.0, 10, 0.0, 0, 0.0, 0.5, 0, 0, 1), (5, 0.0, 0, 0.0, 10, 0.0, 0.5, 0, 1, 1), (3, 0.0, 3, 0.0, 3, 0.0, 0.5, 0, 0, 1), (3, 0.0, 3, 0.0, 0, 0.0, 0.5, 0, 0, 1), (1, 0.0, 2, 0.0, 2, 0.0, 0.5, 0, 0, 1),
    (1, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 0, 1), (30, 0.0, 0, 0.0, 0, 0.0, 0.5, 0, 0, 1), (4, 0.0, 30, 0.0, 0, 0.0, 0.5, 0, 0, 1), (6, 0.0, 9, 0.0, 3, 1.0, 0.5, 0, 0, 1), (7, 0.0, 2, 1.0, 9, 0.0, 0.5, 0, 0, 1), (20, 0.3, 20, 0.25, 12, 0.2, 0.5, 0, 0, 1),
    (3, 1.0, 60, 0.0, 50, 0.0, 0.5, 0, 0, 1), (5, 1.0, 12, 0.0, 9, 0.0, 0.5, 0, 0, 1), (12, 0.5, 20, 0.1, 15, 0.0, 0.5, 0, 0, 1), (40, 0.6, 30, 0.0, 25, 0.1, 0.5, 0, 0, 1), (3, 0.0, 14, 0.0, 4, 1.0, 0.5, 0, 1, 1), (2, 0.0, 8, 0.0, 5, 0.0, 0.5, 0, 1, 1),
    (1, 0.0, 3, 0.33, 1, 1.0, 0.5, 0, 0, 1), (3, 0.0, 12, 0.1, 2, 1.0, 0.5, 0, 0, 1), (2, 0.0, 30, 0.0, 1, 1.0, 0.5, 0, 0, 1), (4, 0.0, 3, 1.0, 12, 0.0, 0.5, 0, 0, 1), (3, 0.33, 9, 0.0, 1, 0.0, 0.5, 0, 0, 1), (8, 0.25, 2, 1.0, 3, 0.0, 0.5, 0, 0, 1),
    # and the menus around them: runs of links, and the short labels between them
    (2, 1.0, 3, 1.0, 3, 1.0, 0.5, 0, 0, 0), (6, 0.9, 40, 0.0, 5, 1.0, 0.5, 0, 0, 0), (12, 0.8, 4, 1.0, 9, 0.9, 0.5, 0, 0, 0), (20, 0.95, 30, 0.0, 3, 1.0, 0.5, 0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0.5, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0.5, 0, 0, 0),
    (2, 0.0, 4, 1.0, 3, 1.0, 0.5, 0, 0, 0), (7, 0.5, 9, 0.6, 4, 1.0, 0.5, 0, 0, 0), (30, 0.7, 8, 1.0, 6, 1.0, 0.5, 0, 0, 0), (4, 1.0, 0, 0.0, 50, 0.0, 0.5, 0, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 0.5, 0, 0, 0), (3, 1.0, 4, 1.0, 0, 0.0, 0.5, 0, 0, 0), (2, 1.0, 9, 0.0, 0, 0.0, 0.5, 0, 0, 0),
    (30, 0.0, 10, 0.0, 12, 0.0, 0.5, 1, 0, 0), (5, 0.0, 0, 0.0, 20, 0.0, 0.5, 1, 0, 0), (8, 0.2, 40, 0.0, 0, 0.0, 0.5, 1, 0, 0), (3, 0.0, 9, 0.0, 3, 0.0, 0.5, 1, 1, 0),
]


@dataclass
class Node:
    share: float
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: list[tuple], depth: int = 10) -> Node:
    """A decision tree by Gini impurity; ties go to the first feature and the lowest limit."""
    n, good = len(rows), sum(r[-1] for r in rows)
    node = Node(good / n)
    if depth == 0 or good in (0, n):
        return node
    gini = lambda part: len(part) * (s := sum(r[-1] for r in part) / len(part)) * (1 - s)
    best = gini(rows) - 1e-9
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            low, high = [r for r in rows if r[f] <= (a + b) / 2], [r for r in rows if r[f] > (a + b) / 2]
            if (got := gini(low) + gini(high)) < best - 1e-9:
                best, node.feature, node.limit = got, f, (a + b) / 2
    if node.feature >= 0:
        node.low = grow([r for r in rows if r[node.feature] <= node.limit], depth - 1)
        node.high = grow([r for r in rows if r[node.feature] > node.limit], depth - 1)
    return node


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(LABELLED)


def keeps(features: tuple) -> bool:
    node = tree()
    while node.low is not None and node.high is not None:
        node = node.low if features[node.feature] <= node.limit else node.high
    return node.share >= 0.5


@dataclass
class Block:
    article: bool
    furniture: tuple[bool, tuple[int, ...]]
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0

    def close(self) -> None:
        self.text = " ".join(unescape("".join(self.parts)).split())
        self.words = self.text.count(" ") + 1 if self.text else 0


def named(name: str, words: set[str]) -> bool:
    """Whether a class or id has one of the words, and no others but those of furniture and layout."""
    parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+", name)]
    return any(w in words for w in parts) and all(w in ADVERTS or w in COMMENTS or w in STRONG or w in WEAK or w in LAYOUT for w in parts)


def furniture(tag: str, attributes: str, in_article: bool) -> str:
    """"" for none, "sure", or "name" where an element that holds most of the article is none after all."""
    if tag == "form":
        return "name"
    if tag in FURNITURE or (tag == "header" and not in_article):
        return "sure"
    if not attributes or tag in ("body", "html", "article", "main"):
        return ""
    if HIDDEN.search(attributes):
        return "sure"
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "role" and value.lower() in ROLES:
            return "sure"
        if name not in ("class", "id") or (name == "id" and tag in OWN):
            continue
        for one in value.split():
            if tag in OWN:
                if named(one, ADVERTS):
                    return "sure"
            elif named(one, COMMENTS):
                return "sure"
            elif named(one, ADVERTS | STRONG) or (named(one, WEAK) and not (name == "id" and tag == "section" and in_article)):
                return "name"
    return ""


class Scanner:
    """The markup of a page from left to right. Every character is looked at a bounded number of times, whatever the page holds:
    what is not found once is not searched again."""

    def __init__(self, html: str):
        self.html = html
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def end_of_tag(self, at: int) -> int:
        """Of the > that ends the tag whose name ends at `at`, or -1: quoted values may hold anything, an open quote nothing but the tag's rest."""
        while True:
            at = PLAIN.match(self.html, at).end()
            c = self.html[at : at + 1]
            if c == ">":
                return at
            if c not in ("'", '"'):
                return -1
            close = self.find(c, at + 1)
            if close < 0:
                return -1
            at = close + 1

    def raw_end(self, tag: str, at: int) -> int:
        """Where the raw text of an element, begun at `at`, and its closing tag end."""
        end = re.compile(f"</{tag}\\s*+>", re.I).search(self.html, at)
        return end.end() if end else len(self.html)

    def after_junk(self, at: int) -> int:
        """Behind what looks like a tag up to its > or the end of the page; -1 if another < comes first: then it is text."""
        end = re.compile("[<>]").search(self.html, at + 1)
        return len(self.html) if end is None else end.end() if end.group() == ">" else -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes) of each tag; comments and the like, and raw text with its element, have no name."""
        html, at = self.html, 0
        while (start := self.find("<", at)) >= 0:
            if html.startswith("<!--", start):
                end = self.find("-->", start + 4)
                at = len(html) if end < 0 else end + 3
                yield start, at, "", False, ""
                continue
            if html.startswith(("<!", "<?"), start):
                end = self.find(">", start)
                at = len(html) if end < 0 else end + 1
                yield start, at, "", False, ""
                continue
            at = start + 1
            m = NAME.match(html, start)
            if m is None:
                continue
            tag, closing = m.group(1).lower(), html[start + 1] == "/"
            end = self.end_of_tag(m.end())
            if end < 0:
                end = self.after_junk(start)
                if end >= 0:
                    at = end
                    yield start, at, "", False, ""
                continue
            at = end + 1
            attributes = html[m.end() : end]
            if tag in RAW and not closing and not attributes.endswith("/"):
                at = self.raw_end(tag, at)
                yield start, at, "", False, ""
                continue
            # The reader may move on behind a raw element that ends itself.
            moved = yield start, at, tag, closing, attributes
            if moved is not None:
                at = moved
                yield 0, 0, "", False, ""


def blocks_of(html: str) -> list[Block]:
    blocks: list[Block] = []
    # tag, and whether in an article, furniture (for sure, and elements by their name), heading, link, what is dropped
    open_tags: list[tuple[str, bool, tuple[bool, tuple[int, ...]], bool, bool, bool]] = []
    state = outside = ("", False, (False, ()), False, False, False)
    n_named = 0
    names: Counter[str] = Counter()  # how many of each are open
    scopes: list[int] = []  # places of open scopes
    last_ends: dict[str, int] = {}
    now: Block | None = None

    def settle() -> None:
        nonlocal state
        state = open_tags[-1] if open_tags else outside

    def put(text: str) -> None:
        nonlocal now
        if state[5]:
            return
        if now is None:
            if not text.strip():
                return
            now = Block(state[1], state[2], state[3])
        now.parts.append(text)
        if state[4]:
            now.linked += len(text.split())

    def close_from(depth: int) -> None:
        for x in open_tags[depth:]:
            names[x[0]] -= 1
        del open_tags[depth:]
        while scopes and scopes[-1] >= depth:
            scopes.pop()
        settle()

    def closed_later(tag: str) -> bool:
        if tag not in last_ends:
            last_ends[tag] = max((m.start() for m in re.finditer(f"</{tag}\\b", html, re.I)), default=-1)
        return last_ends[tag] >= at

    def finish() -> None:
        nonlocal now
        if now is not None:
            now.close()
            if now.text:
                blocks.append(now)
            now = None

    at = 0
    scanner = Scanner(html)
    tokens = iter(scanner)
    for start, end, tag, closing, attributes in tokens:
        if start > at:
            put(html[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            put(" ")
            continue
        if closing:
            if names[tag] > 0:
                close_from(next(i for i in range(len(open_tags) - 1, -1, -1) if open_tags[i][0] == tag))
        else:
            # All elements that end so are scopes: only the innermost scope can be one that this tag ends.
            while scopes and tag in ENDS.get(open_tags[scopes[-1]][0], ()):
                close_from(scopes[-1])
            closed = attributes.endswith("/")
            if tag in RAW and closed and not any(names[x] > 0 for x in FOREIGN):
                # HTML's own elements of raw text cannot be closed so.
                at = scanner.raw_end(tag, at)
                tokens.send(at)
                continue
            if tag not in VOID and not closed and not (tag in DROPPED and not closed_later(tag)):
                _, article, (sure, names_in), heading, link, dropped = state
                told = "" if sure else furniture(tag, attributes, article)
                if told == "name" and len(names_in) < NAMES_DEEP:
                    names_in, n_named = (*names_in, n_named), n_named + 1
                state = (tag, article or tag in ("article", "main"), (sure or told == "sure", names_in), heading or tag in HEADINGS, link or tag == "a", dropped or tag in DROPPED)
                if tag in SCOPES:
                    scopes.append(len(open_tags))
                open_tags.append(state)
                names[tag] += 1
        if state[5]:
            continue
        if tag in BLOCKS:
            finish()
        elif now is not None and state[2] != now.furniture:
            finish()  # inline furniture stands apart from the text around it
    if at < len(html):
        put(html[at:])
    finish()
    return blocks


def features_of(blocks: list[Block]) -> list[tuple]:
    """The features of each block, in the order of FEATURES."""
    has_article = any(b.article for b in blocks)
    held: Counter[int] = Counter()
    total = 0
    for b in blocks:
        if (b.article or not has_article) and not b.furniture[0]:
            total += b.words
            for i in b.furniture[1]:
                held[i] += b.words
    large = {i for i, n in held.items() if n > LARGE * total}
    density = [min(1.0, b.linked / b.words) for b in blocks]
    out = []
    for i, b in enumerate(blocks):
        before = (blocks[i - 1].words, density[i - 1]) if i else (0, 0.0)
        after = (blocks[i + 1].words, density[i + 1]) if i + 1 < len(blocks) else (0, 0.0)
        out.append((b.words, density[i], *before, *after, 0.5 if not has_article else float(b.article), b.furniture[0] or any(n not in large for n in b.furniture[1]), b.heading))
    return out


def main_text(html: str) -> str:
    blocks = blocks_of(html)
    return "\n".join(b.text for b, x in zip(blocks, features_of(blocks)) if keeps(x))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The columns of pages less the html, with the main text."""
    short_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, out)]
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = pa.array([main_text(x or "") for x in part.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], texts], names=[*keep, out])

    return pages.select(*keep, html).mapInArrow(run, schema)


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))
