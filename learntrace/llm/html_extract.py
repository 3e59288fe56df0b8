"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard-library parser is fed in pieces and its events become lines, one for each block of the page.
A line's ratio is the logarithm of its characters of text for each tag; outside articles text in links does
not count. What the page says about a line is part of its ratio: lines of an article or main element gain
``ARTICLE``, lines in a block of a doubtful name (search, legal, banner) lose ``DOUBT``, and menus, headers,
footers, sidebars, notices, adverts, forms and reader comments have ratio 0 and are never content. A name in an article that is only
in part one of furniture (market-share, social-impact) is doubtful: lines in a block of that name stay if the smoothed ratio of one of them
reaches the threshold, and lists of links there never; on a paragraph or heading itself it says nothing, nor do ids there, which come from their text. The ratios
are smoothed with a Gaussian over the page; two-means clustering of the smoothed ratios gives the threshold from
which on a line is a seed of content.

A region is what stands in the block around a seed's block. A line that is no seed stays if it stands in such a
region: in an article always, and outside of one if no article has a seed and it is neither a list of links nor
of a doubtful name, unless it is a heading. A paragraph of one or two links is no list. So short lines of a chosen region stay, and a long text beside a short article does, too. Where
all text stands in forms and a line of it is prose, a form wraps the page and is not furniture.

Defined results: null or empty html gives an empty text; broken markup is read as far as the parser
gets, and what it cannot read counts as text; regions that tie are all chosen; each row is judged alone; an
empty table gives an empty table; other columns stay as they are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 16
SIGMA = 1.0
ARTICLE, DOUBT = 2.0, 1.5
LINKS = 0.5  # share of a line's text in links from which on it is a list of links
PROSE = 100  # characters for each tag of a line that a form of fields does not hold
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video map select textarea button datalist".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
REGIONS = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _named(words: str) -> re.Pattern[str]:
    return re.compile(rf"(?i)(?:^|[\s_-])(?:{'|'.join(words.split())})(?:$|[\s_-])")


#: Names of furniture in class and id.
FURNISHED = (
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side-bar aside widget footer masthead topbar comment comments respond replies disqus share sharing social related recommended newsletter subscribe subscription signup login pagination pager"
)
NAMED = _named(FURNISHED)
#: Words beside which a name of furniture is wholly one.
NEUTRAL = frozenset(
    f"{FURNISHED} area article bar block body bottom box button buttons card cards center column container content entry fixed form frame global group header home icon icons image inner item items left link links list "
    "main media middle module outer page panel post posts primary rail right row secondary section side site slot small sticky story tab tag tags text title tools top unit view wrap wrapper".split()
)
PART = re.compile(r"[_-]+")
OF_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names that furniture and content both bear: they weigh, and do not decide.
DOUBTFUL = _named("legal disclaimer copyright search alert banner header toolbar tags reply promo promotion skip")
#: Furniture that holds articles of its own, such as comments and teasers.
APART = _named("comment comments respond reply replies disqus related recommended sidebar side-bar widget")
#: Names of a layout around the content, such as with-sidebar.
LAYOUT = re.compile(r"(?i)(?:^|\s)(?:with|has|no|without)-\S+")


def wholly_furniture(name: str) -> bool:
    """Whether a class or id has a word of furniture, and nothing beside it that names content."""
    return any(NAMED.search(token) and all(part in NEUTRAL or part.isdigit() for part in PART.split(token.lower())) for token in name.split())


@dataclass
class Line:
    block: int  # number of the block that holds its text
    furniture: bool
    doubtful: bool
    article: int  # number of the article or main element around it, 0 if none
    wrapped: bool = False  # whether forms are the only furniture around it
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0  # characters in links
    anchors: int = 0
    suspect: int = 0  # number of the element around it, in an article, whose name is in part one of furniture
    tag: str = ""  # of its block
    text: str = ""

    def ratio(self) -> float:
        if self.furniture or not self.text:
            return 0.0
        text = len(self.text) if self.article else max(0, len(self.text) - self.linked)
        return max(0.0, math.log1p(text / max(1, self.tags)) + (ARTICLE if self.article else 0.0) - (DOUBT if self.doubtful or self.suspect else 0.0))

    def links(self) -> bool:
        return self.linked > LINKS * len(self.text) and not (self.tag in OF_TEXT and self.anchors <= 2)


@dataclass
class _Open:
    """An open element; every event costs the same however many are open."""

    tag: str
    furniture: bool
    doubtful: bool
    apart: bool
    suspect: int = 0
    region: bool = False


class Lines(HTMLParser):
    """Turns parser events into lines, and keeps the tree of blocks."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()  # open elements of each tag
        self.furnished: list[int] = []  # places in the stack of open furniture
        self.doubts = self.suspects = self.aparts = self.asides = self.forms = self.silent = self.links = 0
        self.blocks: list[tuple[int, int]] = []  # place in the stack and number of the open blocks
        self.parent, self.last = [0], [0]  # of each block: the block around it, the last block inside it
        self.inside: list[int] = []  # numbers of the open article or main elements
        self.suspected: list[int] = []  # numbers of the open elements of suspect names
        self.articles = 0
        self.lines: list[Line] = []
        self.line: Line | None = None

    def _end(self) -> None:
        line, self.line = self.line, None
        if line is not None:
            line.text = " ".join("".join(line.parts).split())
            line.parts = []
            if line.text or line.tags:
                self.lines.append(line)

    def _at(self) -> Line:
        if self.line is None:
            block = self.blocks[-1][1] if self.blocks else 0
            self.line = Line(block, bool(self.furnished), self.doubts > 0, self.inside[-1] if self.inside else 0, len(self.furnished) == self.forms)
            self.line.suspect, self.line.tag = self.suspected[0] if self.suspected else 0, self.stack[self.blocks[-1][0]].tag if self.blocks else ""
        return self.line

    def _pop(self) -> None:
        old = self.stack.pop()
        self.open[old.tag] -= 1
        if self.furnished and self.furnished[-1] == len(self.stack):
            self.furnished.pop()
            self.asides -= old.tag == "aside"
            self.forms -= old.tag == "form"
        if self.blocks and self.blocks[-1][0] == len(self.stack):
            self.last[self.blocks.pop()[1]] = len(self.parent) - 1
        self.doubts -= old.doubtful
        if old.suspect:
            self.suspected.pop()
        self.aparts -= old.apart
        self.silent -= old.tag in SILENT
        self.links -= old.tag == "a"
        if old.region:
            self.inside.pop()

    def _lift(self) -> None:
        """An article in an open menu, header or form: they were left unclosed or wrap the page."""
        if not self.asides and not (self.aparts and self.articles):
            for i in self.furnished:
                self.stack[i].furniture = False
            self.furnished, self.forms = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end()
            if self.blocks and self.stack[self.blocks[-1][0]].tag in CLOSED_BY_BLOCK:
                for _ in range(len(self.stack) - self.blocks[-1][0]):
                    self._pop()
        if not self.silent:
            self._at().tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag == "a" and self.line is not None:
            self.line.anchors += 1
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        told = () if tag in ("html", "body") else ("class",) if tag in OF_TEXT else ("class", "id")
        names = [LAYOUT.sub("", named.get(k, "")) for k in told]
        furniture = tag in FURNITURE and not (tag == "header" and self.inside)  # an article's own heading
        furniture = furniture or named.get("role", "").lower() in ROLES or "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in named.get("style", "").replace(" ", "")
        in_part = any(NAMED.search(n) for n in names)
        weighs = in_part and bool(self.inside) and not any(wholly_furniture(n) for n in names)
        furniture = furniture or in_part and not weighs
        self.suspects += weighs and tag not in OF_TEXT
        if tag in REGIONS and not furniture and self.furnished and not self.silent:
            self._lift()
        new = _Open(tag, furniture, any(DOUBTFUL.search(n) for n in names), furniture and any(APART.search(n) for n in names), self.suspects if weighs and tag not in OF_TEXT else 0)
        self.stack.append(new)
        self.open[tag] += 1
        if tag in BLOCKS:
            self.parent.append(self.blocks[-1][1] if self.blocks else 0)
            self.last.append(0)
            self.blocks.append((len(self.stack) - 1, len(self.parent) - 1))
        if furniture:
            self.furnished.append(len(self.stack) - 1)
            self.asides += tag == "aside"
            self.forms += tag == "form"
        self.doubts += new.doubtful
        if new.suspect:
            self.suspected.append(new.suspect)
        self.aparts += new.apart
        self.silent += tag in SILENT
        self.links += tag == "a"
        if tag in REGIONS and not self.furnished and not self.inside:
            self.articles += 1
            new.region = True
            self.inside.append(self.articles)
        if tag in BLOCKS and self.line is not None and not self.line.parts:
            tags, self.line = self.line.tags, None  # the line stands where the new block stands
            self._at().tags = tags

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end()
        if self.open[tag]:
            while self.stack[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        if not self.silent and data:
            line = self._at()
            line.parts.append(data)
            if self.links:
                line.linked += len(data.strip())

    def finish(self) -> Lines:
        self._end()
        while self.stack:
            self._pop()
        self.last[0] = len(self.parent) - 1
        return self


def lines_of(html: str) -> Lines:
    while True:
        parser = Lines()
        try:
            for at in range(0, len(html), CHUNK):
                parser.feed(html[at : at + CHUNK])
            parser.close()
            return parser.finish()
        except AssertionError:  # a marked section that the parser does not know: read it as text
            plain = html.replace("<![", "&lt;![")
            if plain == html:
                return parser.finish()
            html = plain


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing with the kernel cut at three sigma and renormalised at the ends."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = range(max(0, i - reach), min(len(values), i + reach + 1))
        weights = [kernel[abs(i - j)] for j in near]
        out.append(sum(w * values[j] for w, j in zip(weights, near, strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Midpoint of two means of the values."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v <= cut], [v for v in values if v > cut]
        if not below or not above:
            return cut
        new = (sum(below) / len(below), sum(above) / len(above))
        if new == (low, high):
            return cut
        low, high = new
    return (low + high) / 2


def chosen(page: Lines, limit: float | None = None, sigma: float = SIGMA) -> list[Line]:
    """The lines of content, in page order; ``limit`` replaces the threshold that clustering gives."""
    lines = page.lines
    if not any(x.text for x in lines):
        return []
    if all(x.furniture for x in lines if x.text) and any(x.wrapped and len(x.text) >= PROSE * x.tags for x in lines if x.text):
        for x in lines:  # a form around the whole page
            x.furniture = x.furniture and not x.wrapped
    smooth = smoothed([x.ratio() for x in lines], sigma)
    limit = threshold(smooth) if limit is None else limit
    seed = [bool(x.text) and not x.furniture and s >= limit and not (x.suspect and x.links()) for x, s in zip(lines, smooth, strict=True)]
    trusted = {x.suspect for x, s in zip(lines, seed, strict=True) if s}
    blocks = sorted({x.block for x, s in zip(lines, seed, strict=True) if s})
    named = any(s and x.article for x, s in zip(lines, seed, strict=True))

    def continues(x: Line) -> bool:
        region = page.parent[page.parent[x.block]] if x.block else 0
        at = bisect_left(blocks, region)  # blocks are numbered as they open, so what a block holds is a range
        return at < len(blocks) and blocks[at] <= page.last[region]

    def stays(x: Line) -> bool:
        if x.suspect:
            return x.suspect in trusted and not x.links()
        return continues(x) and (x.article > 0 or not (named or x.links() or x.doubtful and x.tag not in HEADINGS))

    return [x for x, s in zip(lines, seed, strict=True) if x.text and not x.furniture and (s or stays(x))]


def main_text(html: str | None) -> str:
    return "\n".join(x.text for x in chosen(lines_of(html or "")))


def _main_texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype=object)


def extracted(html: Column | str) -> Column:
    return F.pandas_udf(_main_texts, T.StringType())(html)


def extract_pages(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in ``out``."""
    return pages.withColumn(out, extracted(F.col(html)))


def page_digest(pages: DataFrame) -> DataFrame:
    df = extract_pages(pages.select("page_id", "url", "html"))
    return df.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
