"""Main text of web pages from flat text blocks.

A page is a sequence of text blocks.  A block is known by its words, its link
density, those of the blocks beside it, the kind of element it stands in and what
names of classes hint at.  A decision tree, trained on the small labelled table below,
says which blocks are the article's.  A page is read once, from start to end, whatever
tags are missing.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.rows import map_rows

#: Elements by their part in a page.
BREAKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("script style noscript template svg iframe head title textarea button select".split())
AROUND = frozenset("nav footer aside form dialog menu".split())
ARTICLE = frozenset("article main".split())
BOXES = AROUND | ARTICLE | frozenset("header section div ul ol table body figure details p span".split())
#: Words of class names and ids that speak of something beside the article, those of them that speak of texts of others, and words that add nothing to such a name.
HINTS = frozenset(
    """ad ads advert advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay comment comments disqus replies reply respond menu nav navbar
    navigation breadcrumb breadcrumbs sidebar side footer foot masthead topbar toolbar share sharing social related recommended newsletter subscribe signup login search widget pagination pager skip tags""".split()
)
OTHER_HINTS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr comment comments disqus replies reply respond newsletter subscribe signup".split())
FILLERS = frozenset("area bar block body box container content form group holder inner item items left link links list main message outer panel post posts right section slot text top unit widget wrap wrapper".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar toolbar".split())
#: Of these, what holds texts of others, so that an article in it is none of the page's.
OTHERS = frozenset("aside footer dialog complementary contentinfo alert alertdialog".split())
BODY_HINT = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|body|text)(?:[\s_-]|$)", re.I)

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile(r"\S+")
_SPACES = re.compile(r"\s+")
#: The end of a form, and what shows that a form goes round a page.
_FORM_END = re.compile("</form", re.I)
_PAGE_PART = re.compile(r"""<(?:article|main|nav|header|footer|aside)\b|role=["']?main\b|\b__VIEWSTATE\b""", re.I)
#: Place of a block by its elements: in something around the article, unknown, in the article. OTHER, texts of others, is AWAY in a block.
OTHER, AWAY, UNKNOWN, INSIDE = -2, -1, 0, 1
#: Hint of a block by names of classes and ids: none, a part of a name (or, within an article, a name that may be the article's own), a whole name.
NONE, PART, NAME = 0, 1, 2


@functools.lru_cache(4096)
def _hint(about: str) -> tuple[int, bool]:
    """The hint of a list of class names, and whether it speaks of texts of others.

    related-work and search-engine-basics hold a hint as a part; comments, ad-slot and
    cookie-notice are nothing else.
    """
    found, others = NONE, False
    for name in about.split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[_-]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())]
        told = [p for p in parts if p in HINTS]
        if told:
            whole = all(p in HINTS or p in FILLERS or not p for p in parts)
            found = max(found, NAME if whole else PART)
            others = others or (whole and any(p in OTHER_HINTS for p in told))
    return found, others


def _region(tag: str, attributes: str, outer: tuple[int, int], wraps: bool = False, release: bool = False) -> tuple[int, int]:
    """Place and hint that an element opens within those outer.

    wraps: a form round the page.  release: articles count within texts of others as well.
    """
    place, hint = outer
    about, role, hidden = "", "", False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            about += " " + value
        elif name == "role":
            role = value.lower()
        elif (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display:\s*none", value)):
            hidden = True
    if hidden:
        return OTHER, hint
    if tag == "main" or role == "main":
        return INSIDE, NONE
    own, others = _hint(about) if about and tag != "body" and not wraps else (NONE, False)
    if tag in OTHERS or role in OTHERS or others:
        # an article's own hint holds in any case
        return OTHER, max(hint, own)
    if (tag == "article" and role not in ROLES) or role == "article":
        return (INSIDE, NONE) if release or place != OTHER else outer
    if tag != "body" and not wraps and (tag in AROUND or role in ROLES):
        return min(place, AWAY), max(hint, own)
    if tag == "header" and place != INSIDE:
        return min(place, AWAY), max(hint, own)
    if place > AWAY and hint < NAME and own < NAME and tag in ("div", "section") and BODY_HINT.search(about):
        return INSIDE, own
    # within an article a name like side or alert may be of its own parts
    return place, max(hint, PART if own and place == INSIDE else own)


Block = tuple[str, int, float, int, int]


def blocks(page: str, release: bool = False) -> list[Block]:
    """Text, words, link density, place and hint of each block with a word, in page order."""
    found: list[Block] = []
    text: list[str] = []
    linked, links, at, size = 0, 0, 0, len(page)
    stack: list[tuple[str, tuple[int, int]]] = []
    region = UNKNOWN, NONE
    form_end = page_part = -1
    opened: dict[str, int] = {}
    endless: set[str] = set()

    def close() -> None:
        nonlocal linked
        if text:
            joined = _SPACES.sub(" ", html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                n = joined.count(" ") + 1
                found.append((joined, n, min(1.0, linked / n), max(region[0], AWAY), region[1]))
        linked = 0

    while at < size:
        start = page.find("<", at)
        m = _TAG.match(page, start) if start >= 0 else None
        if start < 0 or m is None:
            # the rest, or a bare character
            end = size if start < 0 else start + 1
            text.append(page[at:end])
            linked += len(_WORD.findall(page[at:end])) if links else 0
            at = end
            continue
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if links:
                linked += len(_WORD.findall(piece))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BREAKS:
                close()
            if tag == "a":
                links = max(0, links - 1)
            if opened.get(tag):
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == tag:
                        region = stack[n][1]
                        for t, _ in stack[n:]:
                            opened[t] -= 1
                        del stack[n:]
                        break
            continue
        if tag in DROPPED:
            if not m[3].endswith("/"):
                ends = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, at)
                if ends is None:
                    endless.add(tag)
                # a head or list that is never closed hides nothing
                at = ends.end() if ends else size if tag in ("script", "style") else at
            continue
        if tag in BREAKS:
            close()
        elif tag == "br":
            text.append(" ")
        if tag == "a":
            links += 1
        elif tag in BOXES and not m[3].endswith("/"):
            if tag in ("p", "span"):
                inner = _region(tag, m[3], region, release=release) if m[3] else region
                if inner == region:
                    continue
            else:
                if tag == "form":
                    if form_end < at:
                        form_end = ends.start() if (ends := _FORM_END.search(page, at)) else size
                    if page_part < at:
                        page_part = part.start() if (part := _PAGE_PART.search(page, at)) else size
                inner = _region(tag, m[3], region, tag == "form" and page_part < form_end, release)
            stack.append((tag, region))
            opened[tag] = opened.get(tag, 0) + 1
            region = inner
    close()
    return found


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words, link density, these of the block before and after, place, hint."""
    if not found:
        return np.zeros((0, 8))
    own = np.array([(n, d) for _, n, d, _, _ in found], float)
    edge = np.zeros((1, 2))
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), np.array([b[3:] for b in found], float)])


#: What the labelled table calls its blocks: the elements that they stand in, from outer to inner.
PLACES = {
    "art": "<article>", "main": "<main>", "side": '<article><div class="side">', "work": '<article><section class="related-work">', "alert": '<article><div class="alert alert-info">', "rel": '<article><ul class="related">',
    "share": '<div class="share-page">', "body": '<div class="share-page"><div class="content">', "basics": '<div class="search-engine-basics entry">', "open": '<div class="page nav-open">',
    "inad": '<article><div class="ad">', "ad": '<div class="ad">', "promo": '<div class="promo-box">', "com": '<section class="comments">', "com1": '<div id="comment-list"><div class="text">', "note": '<div id="cookie-notice">',
    "warn": '<div class="notice">', "bar": '<div class="sidebar">', "soc": '<div class="social-links">', "rec": '<div class="related">', "hid": '<div style="display:none">',
}

#: The labelled table: pages of blocks, each with its place (of PLACES, else an element), words, linked words and whether it is the article's.
LABELLED = (
    (("nav", 1, 1, 0), ("nav", 2, 2, 0), ("ad", 9, 0, 0), ("art", 8, 0, 1), ("art", 60, 0, 1), ("art", 1, 0, 1), ("inad", 30, 0, 0), ("art", 45, 3, 1), ("art", 2, 0, 1), ("footer", 7, 0, 0)),
    (("header", 4, 0, 0), ("nav", 1, 1, 0), ("main", 5, 0, 1), ("main", 30, 1, 1), ("main", 6, 6, 1), ("aside", 40, 2, 0), ("main", 3, 0, 1), ("com", 25, 0, 0), ("com", 3, 1, 0), ("com", 300, 2, 0)),
    (("div", 1, 1, 0), ("div", 2, 2, 0), ("div", 1, 1, 0), ("div", 7, 0, 1), ("div", 55, 1, 1), ("div", 80, 0, 1), ("div", 3, 0, 1), ("div", 35, 2, 1), ("div", 3, 3, 0), ("div", 2, 2, 0)),
    (("note", 22, 1, 0), ("note", 100, 0, 0), ("form", 3, 0, 0), ("td", 1, 1, 0), ("td", 2, 2, 0), ("td", 6, 0, 1), ("td", 90, 2, 1), ("td", 20, 1, 1), ("td", 4, 0, 1), ("td", 70, 4, 1), ("td", 5, 4, 0), ("footer", 30, 4, 0)),
    (("aside", 30, 0, 0), ("aside", 120, 0, 0), ("art", 4, 4, 1), ("art", 2, 2, 1), ("art", 9, 8, 1), ("art", 1, 1, 1), ("art", 12, 6, 1), ("footer", 11, 0, 0), ("footer", 150, 0, 0)),
    (("form", 6, 0, 0), ("form", 90, 0, 0), ("main", 3, 3, 1), ("main", 10, 10, 1), ("main", 2, 1, 1), ("main", 5, 5, 1), ("aside", 18, 0, 0), ("aside", 70, 1, 0), ("promo", 16, 0, 0), ("promo", 220, 3, 0)),
    (("nav", 3, 3, 0), ("div", 12, 0, 1), ("div", 40, 0, 1), ("rec", 14, 12, 0), ("rec", 9, 9, 0), ("rec", 60, 0, 0), ("div", 3, 2, 0), ("div", 5, 5, 0)),
    (("div", 2, 2, 0), ("div", 4, 0, 0), ("div", 3, 3, 0), ("div", 2, 2, 0), ("div", 5, 0, 0), ("div", 1, 1, 0), ("div", 6, 5, 0), ("div", 2, 2, 0)),
    (("div", 1, 1, 0), ("div", 60, 0, 1), ("div", 3, 0, 1), ("div", 40, 0, 1), ("div", 2, 2, 0), ("div", 1, 1, 0)),
    (("div", 2, 2, 0), ("div", 45, 1, 1), ("div", 2, 0, 1), ("div", 90, 0, 1), ("div", 1, 0, 1), ("div", 30, 1, 1), ("div", 3, 3, 0)),
    (("div", 1, 1, 0), ("div", 2, 0, 0), ("div", 3, 0, 0), ("div", 70, 0, 1), ("div", 4, 0, 1), ("div", 50, 2, 1), ("div", 90, 0, 1), ("div", 1, 0, 0), ("div", 2, 0, 0)),
    (("div", 40, 38, 0), ("div", 25, 25, 0), ("div", 60, 0, 1), ("div", 3, 0, 1), ("div", 45, 12, 1), ("div", 5, 0, 1), ("div", 90, 31, 1), ("div", 12, 0, 1), ("div", 30, 29, 0), ("div", 20, 19, 0)),
    (("div", 9, 9, 0), ("div", 4, 0, 1), ("div", 22, 1, 1), ("div", 6, 0, 1), ("div", 2, 0, 1), ("div", 15, 1, 1), ("div", 70, 65, 0), ("div", 35, 33, 0), ("div", 6, 0, 0), ("div", 50, 48, 0)),
    (("p", 3, 0, 1), ("p", 28, 6, 1), ("p", 7, 1, 1), ("p", 4, 1, 1), ("p", 33, 15, 1), ("p", 100, 96, 0), ("p", 18, 17, 0), ("p", 5, 0, 0), ("p", 19, 18, 0)),
    (("td", 2, 2, 0), ("td", 8, 0, 0), ("td", 3, 3, 0), ("td", 2, 2, 0), ("td", 30, 0, 1), ("td", 4, 0, 1), ("td", 60, 0, 1), ("td", 1, 1, 0), ("td", 3, 0, 0), ("td", 2, 2, 0)),
    (("art", 2, 2, 1), ("art", 4, 0, 1), ("art", 3, 3, 1), ("art", 2, 2, 1), ("art", 5, 0, 1), ("art", 1, 1, 1), ("art", 6, 1, 1), ("art", 2, 2, 1), ("art", 8, 0, 1), ("art", 3, 3, 1), ("art", 3, 0, 1), ("art", 2, 2, 1)),
    (("open", 3, 3, 0), ("open", 100, 0, 1), ("open", 140, 4, 1), ("open", 90, 1, 1), ("open", 110, 100, 0), ("footer", 8, 2, 0)),
    (("art", 6, 0, 1), ("side", 30, 0, 1), ("side", 5, 0, 1), ("work", 60, 4, 1), ("work", 12, 3, 1), ("alert", 20, 1, 1), ("alert", 100, 0, 1), ("rel", 8, 8, 0), ("rel", 6, 6, 0), ("rel", 10, 9, 0), ("art", 40, 1, 1)),
    (("share", 2, 2, 0), ("share", 3, 3, 0), ("body", 60, 0, 1), ("body", 6, 1, 1), ("body", 25, 3, 1), ("share", 4, 4, 0), ("com1", 80, 0, 0), ("com1", 20, 1, 0), ("hid", 90, 0, 0)),
    (("bar", 100, 2, 0), ("bar", 10, 9, 0), ("basics", 60, 1, 1), ("basics", 4, 0, 1), ("basics", 45, 5, 1), ("warn", 100, 0, 0), ("warn", 30, 1, 0), ("soc", 5, 5, 0), ("soc", 20, 4, 0)),
    (("com", 20, 0, 0), ("com", 60, 0, 0), ("com", 100, 1, 0), ("com", 180, 0, 0), ("ad", 40, 0, 0), ("ad", 120, 2, 0), ("ad", 300, 0, 0), ("art", 25, 0, 1), ("art", 110, 2, 1), ("hid", 30, 0, 0), ("hid", 200, 0, 0)),
)


def labelled_page(page: tuple) -> tuple[str, list[int]]:
    """A page of the labelled table as HTML, and its blocks' labels."""
    made = []
    for place, n, linked, _ in page:
        opened = PLACES.get(place, f"<{place}>")
        closed = "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opened)))
        made.append(f"{opened}<a>{'w ' * linked}</a>{'w ' * (n - linked)}{closed}")
    return "".join(made), [keep for *_, keep in page]


@functools.cache
def tree(columns: tuple[int, ...] = tuple(range(8)), depth: int = 6) -> tuple:
    """The tree fitted to LABELLED on some of the features: nested (feature, border, low, high), or a leaf, 0 or 1."""
    rows, labels = [], []
    for page in LABELLED:
        made, kept = labelled_page(page)
        rows.append(features(blocks(made)))
        labels += kept
    return grow(np.vstack(rows)[:, list(columns)], np.array(labels), depth)


def grow(x: np.ndarray, y: np.ndarray, depth: int):
    """A classification tree by Gini impurity; of equal splits the first feature and the lowest border."""
    leaf = int(y.mean() >= 0.5)
    if not depth or y.min() == y.max():
        return leaf
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for border in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < border
            cost = sum(part.sum() * (p := y[part].mean()) * (1 - p) for part in (low, ~low))
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, border
    if best is None:
        return leaf
    _, f, border = best
    low = x[:, f] < border
    return f, border, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(node, row: np.ndarray) -> int:
    while not isinstance(node, int):
        node = node[2] if row[node[0]] < node[1] else node[3]
    return node


def _kept(found: list[Block]) -> list[str]:
    return [b[0] for b, row in zip(found, features(found)) if decide(tree(), row)]


def main_text(page: str | None) -> tuple[str, int, int]:
    """The article's blocks joined by line ends; how many there are, and how many blocks in all."""
    found = blocks(page or "")
    kept = _kept(found)
    if not kept:
        found = blocks(page or "", release=True)
        kept = _kept(found)
    return "\n".join(kept), len(kept), len(found)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_kept, n_blocks: one row for each row of pages, repeated rows too.

    Null, empty and blank html: empty text, 0 blocks.  Null ids and urls stay null.
    Other columns, whatever their names, are not read.  An empty table gives no rows.
    """

    def row(page_id: int, url: str | None, page: str | None) -> Iterator[tuple]:
        text, kept, every = main_text(page)
        yield page_id, url, text, len(text), kept, every

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return map_rows(picked, ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long, n_kept int, n_blocks int", lambda: row)
