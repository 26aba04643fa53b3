"""Main text of web pages: flat text blocks classified by a decision tree.

A page becomes a list of text blocks. Each has its word count and link density, those of the blocks
before and after it, and its place. A small decision tree, trained on the table below, tells text from the
rest. Words and densities decide on pages without an article element, on blocks whose class or id is an
ambiguous word, and on lists of links inside an article. They can't tell a reader's comment, a notice or a
short advert from a paragraph of the article, so the place is a feature beside them.
"""

from __future__ import annotations

import html as _html
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provrank.llm._common import add_columns, small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<raw>script|style|template|title|textarea|noscript|svg|iframe|select|button|object|math)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:/>|>.*?(?:</(?P=raw)\s*>|$))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn del em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr br img input".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav header footer aside form dialog menu".split())
#: Words of class, id or role that name page furniture, and such that are also used inside articles.
_BAD = re.compile(
    r"(?:^|[-_\s])(?:nav|navbar|navigation|menu|header|masthead|footer|sidebar|aside|notice|notices|cookie|cookies|consent|gdpr|banner|ad|ads|adv|advert|adverts|advertisement|promo|promotion|sponsor|sponsored"
    r"|comment|comments|commentlist|discussion|disqus|replies|respond|newsletter|subscribe|subscription|signup|login|breadcrumb|breadcrumbs|popup|modal|copyright|toolbar|pagination|pager)(?:$|[-_\s\d])",
    re.I,
)
_MAYBE = re.compile(r"(?:^|[-_\s])(?:side|form|share|sharing|social|related|recommended|widget|overlay|search|skip|alert)(?:$|[-_\s\d])", re.I)
_MAIN = re.compile(r"(?:^|[-_\s])(?:article|articlebody|content|main|post|entry|story|body-text)(?:$|[-_\s])", re.I)
_TALK = re.compile(r"comment|discussion|disqus|replies|respond", re.I)

FURNITURE, MAYBE, UNMARKED, ARTICLE = 0, 1, 2, 3
_MAYBE_OUTSIDE = -1  # under an ambiguous name, outside an article
#: The labelled table: words, link density, words before, link density before, words after, link density after,
#: place (3 in an article, 2 nothing said on a page without one, 1 under an ambiguous name, 0 in furniture or beside
#: an article), text (1) or not (0).
LABELLED = [
    (120, 0.00, 80, 0.00, 95, 0.00, 3, 1), (40, 0.05, 9, 0.00, 60, 0.10, 3, 1), (6, 0.00, 1, 1.00, 90, 0.00, 3, 1), (1, 0.00, 45, 0.00, 30, 0.00, 3, 1),
    (2, 0.00, 0, 0.00, 12, 0.00, 3, 1), (14, 0.30, 20, 0.00, 8, 0.00, 3, 1), (3, 0.00, 70, 0.00, 25, 0.20, 3, 1), (9, 1.00, 30, 0.00, 22, 0.00, 3, 1),
    (1, 1.00, 12, 0.00, 40, 0.00, 3, 1), (300, 0.01, 5, 0.00, 0, 0.00, 3, 1), (17, 0.00, 0, 0.00, 0, 0.00, 3, 1), (5, 0.50, 2, 0.50, 4, 0.50, 3, 1),
    (1, 0.00, 2, 0.00, 1, 0.00, 3, 1), (12, 0.00, 3, 1.00, 2, 1.00, 3, 1), (60, 0.40, 8, 1.00, 5, 1.00, 3, 1), (4, 1.00, 0, 0.00, 18, 0.00, 3, 1),
    (2, 1.00, 40, 0.00, 3, 1.00, 3, 0), (3, 1.00, 2, 1.00, 4, 1.00, 3, 0), (1, 1.00, 1, 1.00, 1, 1.00, 3, 0), (6, 1.00, 5, 1.00, 70, 0.00, 3, 0),
    (8, 1.00, 90, 0.00, 7, 1.00, 3, 0), (2, 1.00, 9, 0.00, 1, 1.00, 3, 0), (5, 1.00, 6, 1.00, 15, 0.00, 3, 0), (10, 1.00, 8, 1.00, 9, 1.00, 3, 0),
    (2, 1.00, 3, 1.00, 50, 0.00, 3, 0), (1, 1.00, 2, 1.00, 40, 0.00, 3, 0), (3, 1.00, 4, 1.00, 20, 0.00, 3, 0), (2, 1.00, 25, 0.00, 16, 0.00, 3, 1),
    (3, 1.00, 40, 0.00, 8, 0.00, 3, 1), (5, 1.00, 60, 0.00, 0, 0.00, 3, 1), (2, 1.00, 30, 0.00, 3, 0.00, 3, 1), (7, 1.00, 22, 0.00, 5, 0.20, 3, 1),
    (3, 1.00, 40, 0.00, 60, 0.00, 3, 1), (4, 1.00, 55, 0.00, 120, 0.00, 3, 1), (2, 1.00, 0, 0.00, 80, 0.00, 3, 1), (8, 1.00, 100, 0.00, 70, 0.00, 3, 1),
    (90, 0.00, 70, 0.00, 85, 0.00, 2, 1), (45, 0.02, 6, 0.00, 60, 0.00, 2, 1), (25, 0.00, 90, 0.00, 3, 1.00, 2, 1), (20, 0.10, 30, 0.00, 40, 0.05, 2, 1),
    (8, 0.00, 2, 1.00, 75, 0.00, 2, 1), (4, 0.00, 55, 0.00, 60, 0.00, 2, 1), (12, 0.00, 60, 0.00, 35, 0.00, 2, 1), (200, 0.00, 3, 1.00, 2, 1.00, 2, 1),
    (6, 0.00, 44, 0.00, 48, 0.00, 2, 1), (33, 0.20, 50, 0.00, 50, 0.00, 2, 1), (18, 0.00, 0, 0.00, 45, 0.00, 2, 1), (60, 0.00, 0, 0.00, 0, 0.00, 2, 1),
    (180, 0.00, 90, 0.00, 10, 0.00, 2, 1), (40, 0.00, 200, 0.00, 1, 0.00, 2, 1), (70, 0.00, 95, 0.00, 45, 0.00, 2, 1), (12, 0.00, 190, 0.00, 40, 0.00, 2, 1),
    (2, 1.00, 3, 1.00, 2, 1.00, 2, 0), (5, 1.00, 1, 1.00, 1, 1.00, 2, 0), (3, 0.00, 2, 1.00, 4, 1.00, 2, 0), (7, 0.80, 60, 0.00, 3, 1.00, 2, 0),
    (4, 0.00, 3, 0.00, 2, 0.00, 2, 0), (12, 0.90, 15, 0.90, 11, 0.90, 2, 0), (30, 0.90, 25, 0.80, 28, 0.90, 2, 0), (2, 0.00, 0, 0.00, 3, 0.00, 2, 0),
    (6, 0.50, 4, 0.60, 5, 0.40, 2, 0), (1, 1.00, 80, 0.00, 1, 1.00, 2, 0), (9, 0.60, 2, 0.00, 3, 1.00, 2, 0), (40, 0.70, 10, 1.00, 8, 1.00, 2, 0),
    (1, 1.00, 1, 1.00, 60, 0.00, 2, 0), (2, 1.00, 3, 1.00, 30, 0.00, 2, 0), (3, 1.00, 0, 0.00, 50, 0.00, 2, 0), (1, 1.00, 0, 0.00, 90, 0.00, 2, 0),
    (45, 0.00, 60, 0.00, 50, 0.00, 1, 1), (30, 0.05, 20, 0.00, 80, 0.00, 1, 1), (22, 0.00, 90, 0.00, 15, 0.00, 1, 1), (110, 0.10, 12, 0.00, 40, 0.00, 1, 1),
    (70, 0.00, 4, 0.00, 0, 0.00, 1, 1), (18, 0.00, 45, 0.00, 33, 0.00, 1, 1), (28, 0.15, 30, 0.00, 26, 0.10, 1, 1), (160, 0.00, 100, 0.00, 3, 1.00, 1, 1),
    (3, 0.00, 60, 0.00, 40, 0.00, 1, 0), (1, 0.00, 90, 0.00, 70, 0.00, 1, 0), (5, 0.00, 30, 0.00, 1, 1.00, 1, 0), (8, 0.00, 25, 0.00, 55, 0.00, 1, 0),
    (2, 1.00, 80, 0.00, 2, 1.00, 1, 0), (12, 0.60, 40, 0.00, 9, 1.00, 1, 0), (35, 0.80, 20, 1.00, 25, 0.90, 1, 0), (6, 1.00, 50, 0.00, 45, 0.00, 1, 0),
    (1, 1.00, 0, 0.00, 1, 1.00, 0, 0), (12, 0.00, 1, 1.00, 9, 0.00, 0, 0), (30, 0.00, 60, 0.00, 0, 0.00, 0, 0), (85, 0.00, 90, 0.00, 40, 0.00, 0, 0),
    (22, 0.20, 14, 0.00, 0, 0.00, 0, 0), (4, 0.00, 33, 0.00, 2, 0.00, 0, 0), (150, 0.00, 1, 1.00, 20, 0.00, 0, 0), (45, 0.00, 0, 0.00, 70, 0.00, 0, 0),
    (100, 0.00, 50, 0.00, 60, 0.00, 0, 0), (9, 0.00, 172, 0.00, 0, 0.00, 0, 0), (220, 0.00, 400, 0.00, 320, 0.00, 0, 0), (500, 0.00, 10, 0.00, 200, 0.00, 0, 0),
    (1, 0.00, 60, 0.00, 12, 0.00, 0, 0), (60, 0.00, 250, 0.00, 70, 0.00, 0, 0), (40, 0.00, 200, 0.00, 1, 0.00, 0, 0), (17, 0.00, 0, 0.00, 0, 0.00, 0, 0),
    (1, 1.00, 1, 1.00, 12, 0.00, 0, 0), (4, 1.00, 60, 0.00, 30, 0.00, 0, 0), (2, 1.00, 12, 0.00, 50, 0.00, 0, 0), (6, 1.00, 30, 0.00, 0, 0.00, 0, 0),
    (3, 1.00, 0, 0.00, 18, 0.00, 0, 0), (9, 1.00, 28, 0.00, 24, 0.00, 0, 0), (1, 1.00, 20, 0.00, 40, 0.00, 0, 0), (2, 0.80, 35, 0.00, 16, 0.00, 0, 0),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A classification tree by Gini impurity: (column, cut, at or below, above), or the share of ones."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (share * (1 - share) * len(y) - 1e-12, None, 0.0)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for cut in (values[:-1] + values[1:]) / 2:
            low = y[x[:, c] <= cut]
            high = y[x[:, c] > cut]
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (low, high))
            if impurity < best[0]:
                best = (impurity, c, float(cut))
    if best[1] is None:
        return share
    _, c, cut = best
    left = x[:, c] <= cut
    return c, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@cache
def tree() -> tuple | float:
    rows = np.array(LABELLED, dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


def is_text(features: tuple) -> bool:
    node = tree()
    while isinstance(node, tuple):
        c, cut, low, high = node
        node = low if features[c] <= cut else high
    return node >= 0.5


class _Stack:
    """Open elements as (name, place, whether it is readers' talk), with the positions of each name, so that no step searches them all."""

    def __init__(self) -> None:
        self.held: list[tuple[str, int, bool]] = []
        self.at: dict[str, list[int]] = {}

    def push(self, name: str, place: int, talk: bool) -> None:
        self.at.setdefault(name, []).append(len(self.held))
        self.held.append((name, place, talk))

    def last(self, name: str) -> int:
        """The position of the innermost open element of that name, or -1."""
        found = self.at.get(name)
        return found[-1] if found else -1

    def close(self, k: int) -> None:
        """End the element at position k and all inside it."""
        while len(self.held) > k:
            self.at[self.held.pop()[0]].pop()

    def top(self) -> tuple[str, int, bool]:
        return self.held[-1] if self.held else ("", UNMARKED, False)


def blocks(page: str) -> list[tuple[str, int, float, int]]:
    """Blocks (text, words, link density, place) in page order."""
    out: list[tuple[str, int, float, int]] = []
    stack = _Stack()
    pieces: list[str] = []
    linked: list[str] = []
    in_link = 0
    has_main = False

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            density = min(1.0, len(" ".join("".join(linked).split())) / len(text))
            out.append((text, text.count(" ") + 1, density, stack.top()[1]))
        pieces.clear()
        linked.clear()

    def say(raw: str) -> None:
        text = _html.unescape(raw)
        pieces.append(text)
        if in_link:
            linked.append(text)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if m["raw"] or not name:
            continue
        if name == "a":
            in_link = 0 if m["end"] else 1
        if name in _INLINE and not _ATTR.search(m["attrs"] or ""):
            if name == "br":
                say(" ")
            continue
        if m["end"]:
            k = stack.last(name)
            if k < 0:
                if name not in _INLINE:
                    flush()
                continue
            if name not in _INLINE:
                flush()
                in_link = 0
            elif stack.held[k][1] != (stack.held[k - 1][1] if k else UNMARKED):
                flush()
            stack.close(k)
            continue
        if name not in _INLINE:
            flush()
            in_link = 0
            if name == "li" and stack.last("li") > max(map(stack.last, ("ul", "ol", "menu"))):
                stack.close(stack.last("li"))
            if stack.last("p") >= 0:
                stack.close(stack.last("p"))
        _, place, talk = stack.top()
        hints, hidden = "", False
        for a in _ATTR.finditer(m["attrs"] or ""):
            value = a[2] or a[3] or a[4] or ""
            kind = a[1].lower()
            hidden |= kind == "hidden" or (kind == "aria-hidden" and value == "true") or (kind == "style" and "display:none" in value.replace(" ", "").lower())
            hints += f" {value}" if kind in ("class", "id", "role") else ""
        marked = place
        if name in ("article", "main"):
            if not talk and not (hints and _TALK.search(hints)):
                marked, has_main = ARTICLE, True
            else:
                marked = FURNITURE
        elif name in _FURNITURE:
            marked = place if name == "header" and place == ARTICLE else FURNITURE
        elif name not in ("body", "html"):
            if hidden or (hints and _BAD.search(hints)):
                marked = FURNITURE
            elif place >= UNMARKED and hints and _MAYBE.search(hints):
                marked = MAYBE if place == ARTICLE else _MAYBE_OUTSIDE
            elif place == UNMARKED and hints and _MAIN.search(hints):
                marked, has_main = ARTICLE, True
        if name in _INLINE:
            if marked != place:
                flush()
            if name == "br":
                say(" ")
        if name not in _VOID:
            stack.push(name, marked, talk or (marked == FURNITURE and bool(_TALK.search(hints or name))))
    if at < len(page):
        say(page[at:])
    flush()
    beside = {UNMARKED: FURNITURE, _MAYBE_OUTSIDE: FURNITURE} if has_main else {_MAYBE_OUTSIDE: MAYBE}
    return [(t, w, d, beside.get(p, p)) for t, w, d, p in out]


def features(found: list[tuple[str, int, float, int]]) -> list[tuple]:
    """Words, density, those of the block before and after (0 where there is none), and place of each block."""
    sides = [(0, 0.0), *[b[1:3] for b in found], (0, 0.0)]
    return [(*sides[k + 1], *sides[k], *sides[k + 2], b[3]) for k, b in enumerate(found)]


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    return " ".join(b[0] for b, f in zip(found, features(found), strict=True) if is_text(f))


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df with text, the main text of each whole page, and n_chars, its code points.

    Null and empty pages, and pages without text, have an empty text. Columns named text or n_chars give way.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("string")
    def of(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None)

    out = df.withColumn("__text", of(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))))
    return add_columns(out, {"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}).drop("__text")
