"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped: block elements become lines, and what belongs to menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles or reader comments is left out; an element around every article
mark, or around most of an unmarked page's text, is no furniture. Over the lengths of the other lines runs
a sliding window: the text begins where a window's sum surges and ends where the windows dive to nothing,
and every line between a surge and its dive is kept. A surge is more than ``SURGE`` characters, or more than
half of the page's largest window where that is less, so that a page of a few words keeps them. Characters
of links weigh nothing outside of an article mark. Where marked lines are the greater part of the page's
text, the other lines weigh nothing and are not kept.

One pass reads a page, in time that grows with its length, however broken its markup is. NULL and pages
without text give the empty text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

WINDOW = 3
SURGE = 86
# Share of an unmarked page's text beyond which an element is taken for a wrapper, whatever its name.
MOST = 2 / 3

# Element names of the markup language, and words of class and id names of page furniture.
RAW = frozenset("script style noscript template svg math iframe object canvas title textarea select option button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset("nav aside footer form menu dialog".split())
CLOSED_BY_BLOCK = frozenset(("p",))
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored banner promo popup modal cookie cookies consent notice newsletter "
    "subscribe nav navigation navbar menu breadcrumb breadcrumbs sidebar widget footer masthead comment comments disqus reply "
    "respond replies share sharing social related recommended pagination pager skip login signup".split()
)
HEADER_NAMES = frozenset("header head topbar toolbar masthead".split())
# Parts of a compound name that tell nothing: "ad-container" is an ad, but "related-work" no related link.
PLAIN_PARTS = frozenset(
    "area article articles bar block body box button buttons container content form group holder inner item items link links "
    "list main outer panel post posts section slot thread unit wrap wrapper".split()
)
# "with-sidebar" names what an element has.
NO_NAME_FIRST = frozenset("has with no without".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_SIGNS = re.compile("[>\"']")
_ANGLE = re.compile("[<>]")
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


@dataclass
class Line:
    text: str
    weight: int  # characters outside of links
    in_article: bool
    holder: int  # the innermost element around it that looks like furniture, by number; -1: none
    furniture: bool = False


class Markup:
    """Finds the tags of a page from left to right.

    A tag ends at a ``>`` outside of quotes; if there is none, at a ``>`` before the next ``<``. Quotes from
    which a search came to no end are remembered, so that no stretch is searched twice.
    """

    def __init__(self, html: str):
        self.html = html
        self.signs = [m.start() for m in _SIGNS.finditer(html)]
        n = len(self.signs)
        self.partner = [n] * n  # the next sign of the same kind
        following = {}
        for i in reversed(range(n)):
            sign = html[self.signs[i]]
            self.partner[i] = following.get(sign, n)
            following[sign] = i
        self.endless = bytearray(n)
        self.last = html.rfind(">")

    def _quoted_end(self, at: int) -> int:
        i, n, opened = bisect_left(self.signs, at), len(self.signs), []
        while i < n and self.html[self.signs[i]] != ">":
            if self.endless[i] or self.partner[i] == n:
                i = n
                break
            opened.append(i)
            i = self.partner[i] + 1
        if i < n:
            return self.signs[i]
        for i in opened:
            self.endless[i] = 1
        return -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Start, end, name, whether it closes, and attributes of the first markup from ``at`` on.

        Comments and declarations have no name.
        """
        html = self.html
        while (start := html.find("<", at)) >= 0:
            at = start + 1
            if html.startswith("!--", at):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, "", False, ""
            tag = _TAG.match(html, start)
            if tag:
                end = self._quoted_end(tag.end())
                if end < 0:
                    angle = _ANGLE.search(html, tag.end())
                    end = angle.start() if angle and angle[0] == ">" else -1
                if end >= 0:
                    return start, end + 1, tag[2].lower(), bool(tag[1]), html[tag.end() : end]
            if html[at : at + 1] in ("!", "?", "/") and at < self.last:
                return start, html.find(">", at) + 1, "", False, ""
        return None


def _names(label: str) -> set[str]:
    """What the words of a class, id or role name: the last telling part of each, in lower case."""
    found = set()
    for word in label.lower().split():
        parts = [p for p in re.split(r"[-_]", word.rstrip("0123456789")) if p]
        if not parts or parts[0] in NO_NAME_FIRST:
            continue
        while len(parts) > 1 and (parts[-1] in PLAIN_PARTS or parts[-1].isdigit()):
            parts.pop()
        found.add(parts[-1])
    return found


def _is_furniture(name: str, rest: str, in_article: bool) -> bool:
    if name in FURNITURE or name == "header" and not in_article:
        return True
    if not rest:
        return False
    if HIDDEN.search(rest):
        return True
    if name in ("body", "html", "article", "main"):
        return False
    labels = set().union(*(_names(next(filter(None, m.groups()), "")) for m in NAMES.finditer(rest)))
    return not labels.isdisjoint(FURNITURE_NAMES) or not in_article and not labels.isdisjoint(HEADER_NAMES)


def _is_wrapper(name: str, rest: str) -> bool:
    """Whether only its class, id or role makes an element furniture, or it is a form."""
    return name == "form" or name not in FURNITURE and name != "header" and not HIDDEN.search(rest)


def lines_of(html: str) -> list[Line]:
    """The page as lines: one per stretch of text between block boundaries, in page order."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = 0
    open_: list[tuple[str, bool, bool]] = []  # name, is furniture, is article
    places: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements, by name
    blocks: list[int] = []  # places of the open block elements
    within: list[int] = []  # open elements that look like furniture, by number
    holders: list[int] = []  # of every such element: the next one around it
    wrappers: list[bool] = []  # of every such element
    marks: list[int] = []  # the innermost such element around each article mark
    article = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            lines.append(Line(text, max(0, len(text) - linked), article > 0, within[-1] if within else -1))
        linked = 0

    def leave(upto: int) -> None:
        nonlocal article, links
        while len(open_) > upto:
            name, is_furniture, is_article = open_.pop()
            places[name].pop()
            if name not in INLINE:
                blocks.pop()
            if is_furniture:
                within.pop()
            article -= is_article
            links -= name == "a"

    markup, at = Markup(html), 0
    while found := markup.next(at):
        start, end, name, closing, rest = found
        text = html[at:start]
        if text:
            parts.append(text)
            linked += len(text) if links else 0
        at = end
        if not name:
            continue
        if name in RAW and not closing:
            if not rest.endswith("/"):
                last = re.compile(rf"</{name}\b[^<>]*>?", re.I).search(html, at)
                at = last.end() if last else len(html)
            continue
        block = name not in INLINE
        if closing:
            if block:
                flush()
            place = places[name][-1] if places[name] else None
            if place is not None and (block or not blocks or blocks[-1] < place):
                leave(place)
            continue
        if block:
            flush()
            if name not in VOID:
                for unclosed in CLOSED_BY_BLOCK:
                    if places[unclosed]:
                        leave(places[unclosed][-1])
        if name in VOID or rest.endswith("/"):
            continue
        is_furniture = _is_furniture(name, rest, article > 0)
        if is_furniture and not block and not within:
            flush()
        is_article = name in ("article", "main")
        places[name].append(len(open_))
        if block:
            blocks.append(len(open_))
        open_.append((name, is_furniture, is_article))
        if is_article:
            marks.append(within[-1] if within else -1)
        if is_furniture:
            holders.append(within[-1] if within else -1)
            within.append(len(wrappers))
            wrappers.append(_is_wrapper(name, rest))
        article += is_article
        links += name == "a"
    if at < len(html):
        parts.append(html[at:])
    flush()
    _tell_furniture(lines, holders, wrappers, marks)
    return lines


def _tell_furniture(lines: list[Line], holders: list[int], wrappers: list[bool], marks: list[int]) -> None:
    """Mark the lines inside of furniture; what is around every article mark, or most of the text, is none."""
    marked, weight = [0] * len(holders), [0] * len(holders)
    for i in marks:
        if i >= 0:
            marked[i] += 1
    for line in lines:
        if line.holder >= 0:
            weight[line.holder] += line.weight
    for i in reversed(range(len(holders))):  # an element comes behind the one around it
        if holders[i] >= 0:
            marked[holders[i]] += marked[i]
            weight[holders[i]] += weight[i]
    most = MOST * sum(line.weight for line in lines)
    out: list[bool] = []
    for i, holder in enumerate(holders):
        waived = marked[i] == len(marks) if marks else wrappers[i] and weight[i] > most
        out.append(not waived or holder >= 0 and out[holder])
    for line in lines:
        line.furniture = line.holder >= 0 and out[line.holder]


def surges(weights: list[int], least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Stretches ``(first, after)`` of lines from a surge of the window sums to the next dive.

    A dive is a window without any weight. A stretch begins and ends with lines that have weight; it is
    kept if one of its windows holds more than ``least``.
    """
    heavy = [i for i, weight in enumerate(weights) if weight]
    starts = [i for i, before in zip(heavy, [None, *heavy]) if before is None or i - before > window]
    ends = [i for i, after in zip(heavy, [*heavy[1:], None]) if after is None or after - i > window]
    return [(a, b + 1) for a, b in zip(starts, ends) if any(sum(weights[j : min(j + window, b + 1)]) > least for j in range(a, b + 1))]


def main_text(html: str | None) -> str:
    """The article's blocks, joined by line ends; empty if there is none."""
    lines = [line for line in lines_of(html or "") if not line.furniture]
    marked = sum(len(line.text) for line in lines if line.in_article)
    only_marked = 0 < marked >= sum(line.weight for line in lines if not line.in_article)
    weights = [len(line.text) if line.in_article else 0 if only_marked else line.weight for line in lines]
    largest = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
    stretches = surges(weights, min(SURGE, largest / 2))
    return "\n".join(line.text for a, b in stretches for line in lines[a:b] if line.in_article or not only_marked)


def extracted(html: Column) -> Column:
    """Main text of an html column; NULL counts as an empty page."""

    @arrow_udf(T.StringType())
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(page.as_py()) for page in batch], pa.string())

    return extract(html)


def extract_pages(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep`` of every page with its main text and the text's length in code points."""
    found = pages.select(*[F.col(c) for c in keep], extracted(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
