"""Main text of web pages: flat blocks of text, classified by a decision tree.

A page becomes a list of blocks, cut where block elements begin or end; scripts, styles and the like leave no
text. A block has its number of words and its link density (share of words in links), the same of the block
before and after, its kind, and its place: inside elements whose tag, role or class speaks of page furniture, inside
the main area or article, or neither. A tree grown by Gini impurity from ``LABELLED`` decides which blocks are main
text; it is trained anew wherever it is needed, which takes milliseconds.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import text_of

# --- fixed values: elements and class words -----------------------------------------------------------------------

#: Elements that end a block where they begin and where they end.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody "
    "td tfoot th thead tr ul".split())
#: Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page, dropped up to their end tag.
RAW_TAGS = frozenset("script style title noscript iframe textarea template svg math noembed noframes object audio video canvas select".split())
#: Elements that are page furniture wherever they stand, and those that are so outside an article.
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu button search fieldset".split())
OUTER_FURNITURE_TAGS = frozenset(["header"])
#: Words of classes, ids and roles that speak of furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs header masthead topbar toolbar footer bottom sidebar side aside rail complementary contentinfo widget widgets "
    "cookie cookies consent gdpr notice notification alert alertdialog popup modal overlay dialog newsletter subscribe subscription signup "
    "login register share sharing social related recommended recommendations teaser teasers comment comments commentlist reply replies "
    "respond responses disqus discussion form search pagination pager copyright legal disclaimer tags hidden noprint screenreader "
    "skip skiplink outbrain taboola paywall".split())
#: Words of classes, ids and roles that speak of the main area, and of the article itself.
MAIN_WORDS = frozenset("main content page primary maincontent".split())
ARTICLE_WORDS = frozenset("article articlebody articletext entry post story body text prose".split())
#: How a block begins that is a notice of rights.
RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)

FURNITURE, NEITHER, MAIN, ARTICLE = -1, 0, 1, 2
TEXT, HEADING, ITEM = 0, 1, 2
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li td th dt dd option".split())

# --- fixed values: labelled blocks ---------------------------------------------------------------------------------

#: Pages as lists of blocks (main text or not, place, kind, words, words in links).
LABELLED: tuple[tuple[tuple[int, int, int, int, int], ...], ...] = (
    # a news page with an article element; menu, advert, footer
    ((0, FURNITURE, ITEM, 1, 1), (0, FURNITURE, ITEM, 1, 1), (0, FURNITURE, ITEM, 2, 2), (0, FURNITURE, TEXT, 8, 0), (1, ARTICLE, HEADING, 9, 0),
     (1, ARTICLE, TEXT, 60, 2), (1, ARTICLE, TEXT, 1, 0), (1, ARTICLE, TEXT, 110, 0), (0, FURNITURE, TEXT, 9, 0)),
    # an article with a one-word and a linked paragraph, a reading list, and comments of real length
    ((0, NEITHER, TEXT, 12, 0), (1, ARTICLE, HEADING, 4, 0), (1, ARTICLE, TEXT, 2, 0), (1, ARTICLE, TEXT, 25, 4), (1, ARTICLE, TEXT, 3, 0),
     (0, ARTICLE, ITEM, 6, 6), (0, ARTICLE, ITEM, 7, 7), (0, ARTICLE, ITEM, 5, 5), (0, FURNITURE, TEXT, 45, 0), (0, FURNITURE, TEXT, 80, 1)),
    # the same without reading list; a list that is part of the text
    ((0, NEITHER, ITEM, 2, 2), (1, ARTICLE, HEADING, 7, 0), (1, ARTICLE, TEXT, 40, 0), (1, ARTICLE, ITEM, 9, 0), (1, ARTICLE, ITEM, 12, 2),
     (1, ARTICLE, ITEM, 1, 0), (1, ARTICLE, TEXT, 33, 1), (0, NEITHER, TEXT, 20, 3), (0, NEITHER, TEXT, 40, 0)),
    # a main area with a notice beside the article
    ((0, FURNITURE, TEXT, 30, 2), (0, MAIN, TEXT, 15, 0), (0, MAIN, TEXT, 4, 1), (1, ARTICLE, HEADING, 6, 0), (1, ARTICLE, TEXT, 5, 0),
     (1, ARTICLE, TEXT, 70, 3), (0, MAIN, TEXT, 22, 1), (0, FURNITURE, ITEM, 3, 3)),
    # a main area without article
    ((0, NEITHER, ITEM, 1, 1), (0, NEITHER, TEXT, 14, 0), (1, MAIN, HEADING, 5, 0), (1, MAIN, TEXT, 44, 1), (1, MAIN, TEXT, 2, 0),
     (1, MAIN, TEXT, 90, 0), (1, MAIN, ITEM, 6, 0), (0, FURNITURE, ITEM, 2, 2), (0, NEITHER, TEXT, 11, 2)),
    ((0, FURNITURE, ITEM, 2, 2), (0, MAIN, ITEM, 2, 2), (0, MAIN, ITEM, 3, 3), (1, MAIN, HEADING, 8, 0), (1, MAIN, TEXT, 30, 0), (1, MAIN, TEXT, 18, 5),
     (0, MAIN, TEXT, 2, 2), (0, FURNITURE, TEXT, 26, 0)),
    # pages without any named area: long running text between short and linked blocks
    ((0, NEITHER, ITEM, 1, 1), (0, NEITHER, ITEM, 2, 2), (0, NEITHER, ITEM, 1, 1), (1, NEITHER, HEADING, 6, 0), (1, NEITHER, TEXT, 55, 2),
     (1, NEITHER, TEXT, 80, 0), (1, NEITHER, TEXT, 12, 0), (1, NEITHER, TEXT, 48, 3), (0, NEITHER, TEXT, 6, 3), (0, NEITHER, TEXT, 5, 0)),
    ((0, NEITHER, TEXT, 3, 2), (0, NEITHER, TEXT, 4, 4), (0, NEITHER, TEXT, 7, 0), (0, NEITHER, TEXT, 2, 2), (1, NEITHER, HEADING, 5, 0),
     (1, NEITHER, TEXT, 33, 0), (1, NEITHER, TEXT, 9, 0), (1, NEITHER, TEXT, 64, 1), (0, NEITHER, HEADING, 2, 0), (0, NEITHER, ITEM, 7, 7),
     (0, NEITHER, ITEM, 6, 6)),
    ((0, NEITHER, TEXT, 10, 9), (1, NEITHER, TEXT, 120, 0), (1, NEITHER, TEXT, 24, 0), (1, NEITHER, ITEM, 15, 1), (1, NEITHER, ITEM, 22, 0),
     (1, NEITHER, TEXT, 17, 0), (0, NEITHER, TEXT, 8, 6), (0, NEITHER, ITEM, 2, 2), (0, NEITHER, TEXT, 9, 1)),
    ((0, NEITHER, ITEM, 1, 1), (0, NEITHER, TEXT, 2, 2), (1, NEITHER, HEADING, 3, 0), (1, NEITHER, TEXT, 19, 0), (1, NEITHER, TEXT, 16, 0),
     (1, NEITHER, HEADING, 2, 0), (1, NEITHER, TEXT, 22, 1), (0, NEITHER, TEXT, 3, 2)),
    ((1, NEITHER, HEADING, 4, 0), (1, NEITHER, TEXT, 15, 0), (1, NEITHER, HEADING, 1, 0), (1, NEITHER, TEXT, 28, 3), (0, NEITHER, TEXT, 4, 0)),
    # a page of links only, and an error page with one sentence
    ((0, NEITHER, ITEM, 3, 3), (0, NEITHER, ITEM, 4, 4), (0, NEITHER, HEADING, 2, 0), (0, NEITHER, ITEM, 6, 6), (0, NEITHER, ITEM, 8, 8),
     (0, NEITHER, TEXT, 4, 1)),
    ((0, FURNITURE, ITEM, 1, 1), (1, ARTICLE, TEXT, 8, 0), (0, FURNITURE, TEXT, 6, 1)),
    # furniture of every length, between text or at the edges
    ((0, FURNITURE, HEADING, 3, 0), (0, FURNITURE, TEXT, 50, 0), (0, FURNITURE, TEXT, 140, 4), (1, ARTICLE, TEXT, 20, 0), (0, FURNITURE, TEXT, 12, 0),
     (1, ARTICLE, TEXT, 28, 0), (1, ARTICLE, HEADING, 3, 0), (1, ARTICLE, TEXT, 14, 0), (0, FURNITURE, TEXT, 35, 1)),
    ((0, FURNITURE, TEXT, 70, 0), (1, MAIN, TEXT, 12, 0), (1, MAIN, TEXT, 3, 0), (0, FURNITURE, TEXT, 24, 0), (1, MAIN, TEXT, 36, 0),
     (0, FURNITURE, ITEM, 40, 3), (0, FURNITURE, HEADING, 4, 0)),
    # pages that end with the article, some of a few words
    ((0, FURNITURE, ITEM, 1, 1), (1, ARTICLE, HEADING, 4, 0), (1, ARTICLE, TEXT, 31, 0), (1, ARTICLE, TEXT, 2, 0)),
    ((0, FURNITURE, TEXT, 6, 0), (1, ARTICLE, TEXT, 3, 0)),
    ((1, ARTICLE, TEXT, 4, 0),),
    ((1, ARTICLE, HEADING, 2, 0), (1, ARTICLE, TEXT, 1, 0), (1, ARTICLE, TEXT, 1, 0)),
    ((0, FURNITURE, ITEM, 2, 2), (1, MAIN, TEXT, 20, 1), (1, MAIN, TEXT, 3, 0)),
    ((1, MAIN, HEADING, 3, 0), (1, MAIN, TEXT, 5, 0)),
    ((1, NEITHER, TEXT, 26, 0),),
    # an article of one heading, of headings and linked sources
    ((0, FURNITURE, ITEM, 1, 1), (1, ARTICLE, HEADING, 3, 0), (0, FURNITURE, TEXT, 7, 0)),
    ((1, ARTICLE, HEADING, 10, 0), (1, ARTICLE, TEXT, 3, 3), (1, ARTICLE, TEXT, 41, 2), (1, ARTICLE, HEADING, 2, 0), (1, ARTICLE, TEXT, 16, 6),
     (1, ARTICLE, TEXT, 52, 0)),
)


# --- blocks -------------------------------------------------------------------------------------------------------

_TAG = re.compile(
    r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)"
    r"|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:.-]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_TOLD = frozenset("class id role hidden style itemprop aria-hidden".split())
_WORDS = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def place_of(name: str, rest: str, outer: int) -> int:
    """The place that an element gives its content, ``outer`` being the one around it."""
    if outer == FURNITURE or name in FURNITURE_TAGS or (name in OUTER_FURNITURE_TAGS and outer != ARTICLE):
        return FURNITURE
    place = ARTICLE if name == "article" else MAIN if name == "main" else NEITHER
    if rest and name not in ("html", "body"):
        told: set[str] = set()
        for key, *value in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), "".join(value)
            if key == "hidden" or (key == "style" and _UNSEEN.search(value)) or (key == "aria-hidden" and value == "true"):
                return FURNITURE
            if key in _TOLD:
                told.update(_WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        if told & FURNITURE_WORDS:
            return FURNITURE
        if told & ARTICLE_WORDS:
            place = max(place, ARTICLE)
        elif told & MAIN_WORDS:
            place = max(place, MAIN)
    return max(place, outer)


def blocks_of(page: str) -> list[tuple[str, int, int, int, int]]:
    """Blocks in page order: ``(text, place, kind, words, words in links)``."""
    out: list[tuple[str, int, int, int, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, int]] = [("", NEITHER, TEXT)]  # element, place, kind
    opened: dict[str, int] = {}
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        words = "".join(parts).split()
        if words:
            out.append((" ".join(words), stack[-1][1], stack[-1][2], len(words), min(linked, len(words))))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.split())

    while True:
        begin = page.find("<", at)
        tag = _TAG.match(page, begin) if begin >= 0 else None
        if tag is None:
            add(page[at:] if begin < 0 else page[at : begin + 1])
            if begin < 0:
                break
            at = begin + 1
            continue
        add(page[at:begin])
        at = tag.end()
        if tag["name"] is None:
            continue
        name = tag["name"].lower()
        block = name in BLOCK_TAGS
        if tag["end"]:
            if name == "a":
                in_link = False
            if block:
                flush()
            if opened.get(name):
                while True:
                    top = stack.pop()[0]
                    opened[top] -= 1
                    if top == name:
                        break
            continue
        if name in RAW_TAGS:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if name == "a":
            in_link = "href" in tag["rest"].lower()
            continue
        if name == "br":
            parts.append(" ")
        if block:
            flush()
            in_link = in_link and name not in ("li", "td", "nav", "article", "main", "footer")
        if name in VOID_TAGS or tag["rest"].endswith("/") and not block:
            continue
        outer = stack[-1]
        place = place_of(name, tag["rest"], outer[1])
        if block or place != outer[1]:
            if place != outer[1] and not block:
                flush()
            if name == "p" and outer[0] == "p":
                stack.pop()
                opened["p"] -= 1
                outer = stack[-1]
                place = place_of(name, tag["rest"], outer[1])
            kind = HEADING if name in _HEADINGS else ITEM if name in _ITEMS else outer[2] if outer[2] == ITEM else TEXT
            stack.append((name, place, kind))
            opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def features(blocks: list[tuple[str, int, int, int, int]]) -> np.ndarray:
    """A row per block: words and link density of itself, the one before and the one after; place, how far the place
    is from the page's best one, kind, and whether it begins like a notice of rights."""
    n = len(blocks)
    words = np.array([0, *(b[3] for b in blocks), 0], float)
    density = np.array([0, *(b[4] for b in blocks), 0]) / np.maximum(words, 1)
    place = np.array([b[1] for b in blocks], float)
    kind = np.array([b[2] for b in blocks], float)
    rights = np.array([RIGHTS.match(b[0]) is not None for b in blocks], float)
    best = place.max(initial=0)
    return np.column_stack([words[1:-1], density[1:-1], words[:n], density[:n], words[2:], density[2:], place, best - place, kind, rights])


# --- the tree -----------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
    """A tree of ``(feature, cut, low, high)``, leaves are booleans; cuts by Gini impurity, ties to the first feature."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return bool(share >= 0.5)
    best = (len(y) * 2 * share * (1 - share) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
        if ok.any():
            a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
            cost = np.where(ok, 2 * n * a * (1 - a) + 2 * (len(y) - n) * b * (1 - b), np.inf)
            k = int(cost.argmin())
            if cost[k] < best[0] - 1e-12:
                best = (float(cost[k]), f, float(v[k] + v[k + 1]) / 2)
    if best[1] < 0:
        return bool(share >= 0.5)
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def decide(tree, x: np.ndarray) -> np.ndarray:
    """The tree's verdict for each row."""
    if isinstance(tree, bool):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x), bool)
    out[low], out[~low] = decide(tree[2], x[low]), decide(tree[3], x[~low])
    return out


@cache
def trained(pages: tuple = LABELLED):
    """The tree of a table of labelled pages."""
    x = [features([("", place, kind, words, links) for _, place, kind, words, links in page]) for page in pages]
    return grow(np.concatenate(x), np.array([b[0] for page in pages for b in page], float))


def main_text(page: str, tree=None) -> str:
    """Blocks that the tree takes for main text, joined by an empty line."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    x = features(blocks)
    main = decide(trained() if tree is None else tree, x)
    return "\n\n".join([b[0] for b, m in zip(blocks, main.tolist(), strict=True) if m])


def extract(pages: DataFrame, html_col: str = "html", keys: tuple[str, ...] = ("page_id", "url"), labelled: tuple = LABELLED) -> DataFrame:
    """``keys``, ``text`` and ``n_chars`` (code points) of every row of ``pages``.

    A null or empty page, or one without main text, has the empty text. White space inside a block becomes one
    blank, blocks are joined by two line feeds; character references are decoded. A page that ends early is read to its end. Null keys
    and repeated rows stay, columns beside the keys are left out; an empty table gives an empty result. One page is
    held by one task whole.
    """
    tree = trained(labelled)

    def run(batches):
        for batch in batches:
            texts = [main_text(t, tree) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(texts, pa.string()), *batch.columns[1:]], names=["text", *names])

    names = [f"key_{k}" for k in range(len(keys))]
    rows = pages.select(text_of(html_col).alias("page"), *(F.col(c).alias(n) for c, n in zip(keys, names, strict=True)))
    kinds = ", ".join(f"{n} {pages.schema[c].dataType.simpleString()}" for c, n in zip(keys, names, strict=True))
    found = rows.mapInArrow(run, f"text string, {kinds}")
    return found.select(*(F.col(n).alias(c) for c, n in zip(keys, names, strict=True)), "text", F.length("text").cast("long").alias("n_chars"))
