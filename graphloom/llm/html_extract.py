"""Main-text extraction from the events of the standard library's streaming parser.

The parser's events are folded into lines, one per block of the page.  Each
line has a text-to-tag ratio: its characters over the tags met on it.  The
ratios of a page are smoothed with a Gaussian, and a threshold (a share of
their standard deviation) clusters lines into content and the rest.  Content
lines select regions: the article or main element that holds them, or else their
nearest containers, of which every line is text, short ones too.  A region counts
only if its own ratio passes the threshold; where none does, the page is text
throughout.  Inside a region, elements that say themselves to be navigation,
headers, footers, sidebars, notices, adverts, forms, scripts or comments do not
count, if a class, id or role as a whole says so.  Words that prose is called by
too (``related``, ``share``, ``search``), and any such word that is part of a
longer name (``foot-care``, ``ad-hoc``), only mark an element whose own ratio
fails the threshold.

End tags that HTML lets a page omit are implied, and every event costs a bounded
number of steps on average, whatever is left open.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Standard deviation of the smoothing in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA, THRESHOLD = 1.0, 0.5

# HTML's elements by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "aside audio button canvas dialog footer form head iframe menu nav noscript object option script search select style svg template textarea title video".split()
)
CONTAINERS = frozenset("article body center div main section td th".split())
#: Per start tag that ends open elements by itself: those elements, and the elements beyond which it ends none.
_LIST, _TABLE = frozenset("ul ol menu dir".split()), frozenset("table template".split())
IMPLIED = {
    "li": (("li",), _LIST), "dt": (("dt", "dd"), frozenset(["dl"])), "dd": (("dt", "dd"), frozenset(["dl"])),
    "td": (("td", "th"), _TABLE | {"tr"}), "th": (("td", "th"), _TABLE | {"tr"}), "tr": (("tr", "caption"), _TABLE | {"tbody", "thead", "tfoot"}),
    "tbody": (("tbody", "thead", "tfoot", "caption"), _TABLE), "thead": (("tbody", "thead", "tfoot", "caption"), _TABLE), "tfoot": (("tbody", "thead", "tfoot", "caption"), _TABLE),
    "option": (("option",), frozenset(["select", "datalist"])), "optgroup": (("option", "optgroup"), frozenset(["select"])),
}
#: Elements beyond which a block does not end an open paragraph, and an end tag nothing.
SCOPE = frozenset("article aside button caption div footer header li main nav object section table td template th".split())
BARRIER = frozenset("table td th template object".split())
#: Words in a class, id or role that mark an element as no content, hyphens and underscores in them left out.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted "
    "cookie cookies consent gdpr notice notices alert alertdialog menu menus menubar nav navbar navigation breadcrumb breadcrumbs sidebar sidebars "
    "complementary footer foot contentinfo comment comments disqus newsletter copyright "
    "commentlist commentbox usercomments adbox adslot adunit sidenav topnav subnav mainnav sitenav cookiebar cookiebanner sitefooter pagefooter".split()
)
#: Words that mark an element as no content if its ratio says so too.
WEAK_MARKS = frozenset(
    "banner hidden login modal overlay pager pagination popup recommendations recommended related replies reply respond search share sharing signup social "
    "subscribe subscription toolbar widget widgets".split()
)
#: Marks that count outside an article only: an article may have a header of its own.
PAGE_MARKS = frozenset("header masthead topbar head siteheader pageheader".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOT_SHOWN = re.compile(r"display\s*:\s*none")


@dataclass
class Line:
    """A line of text with the tags met on it, and the container, article and weakly marked element (0: none) that hold it."""

    text: str
    tags: int
    container: int
    article: int
    weak: int


class _Node:
    """An open element that text can lie in, and what holds for its text."""

    __slots__ = ("article", "closed", "container", "dropped", "place", "tag", "weak")

    def __init__(self, tag: str, place: int, dropped: bool, container: int, article: int, weak: int) -> None:
        self.tag, self.place, self.dropped, self.closed = tag, place, dropped, False
        self.container, self.article, self.weak = container, article, weak


class Lines(HTMLParser):
    """Folds parser events into ``lines``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self._text: list[str] = []
        self._tags = 0
        self._open = [_Node("", 0, False, 0, 0, 0)]
        #: the open elements of each tag, outermost first
        self._by_tag: dict[str, list[_Node]] = {}
        self._made = 0

    def _flush(self) -> None:
        if self._text:
            top = self._open[-1]
            if text := " ".join("".join(self._text).split()):
                self.lines.append(Line(text, self._tags, top.container, top.article, top.weak))
                self._tags = 0
            self._text.clear()

    def _marks(self, tag: str, attrs: list[tuple[str, str | None]], article: int) -> tuple[bool, bool]:
        """Whether an element's text never counts, and whether that is left to its ratio."""
        if tag in NEVER or (tag == "header" and not article):
            return True, False
        if tag in ("html", "body"):
            return False, False
        weak = False
        for name, value in attrs:
            if name in ("class", "id", "role"):
                names = {w.lower() for w in (value or "").split()}
                joined = names | {w.replace("-", "").replace("_", "") for w in names}
                if joined & MARKS or (not article and joined & PAGE_MARKS):
                    return True, False
                words = names if tag in ("article", "main") else names | {w.lower() for w in _WORDS.findall(value or "")}
                weak = weak or bool(words & WEAK_MARKS or words & MARKS or (not article and words & PAGE_MARKS))
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _NOT_SHOWN.search(value or "")):
                return True, False
        return False, weak

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of some tags; 0 if there is none."""
        return max((nodes[-1].place for t in tags if (nodes := self._by_tag.get(t))), default=0)

    def _close(self, place: int) -> None:
        """Ends the open element of this place and all inside it."""
        while len(self._open) > place:
            node = self._open.pop()
            if not node.closed:
                self._by_tag[node.tag].pop()
        while self._open[-1].closed:
            self._open.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
            if (p := self._last(("p",))) and p > self._last(SCOPE):
                self._close(p)
            if tag in IMPLIED:
                ends, beyond = IMPLIED[tag]
                limit = self._last(beyond)
                while (place := self._last(ends)) > limit:
                    self._close(place)
        elif tag == "br":
            self._text.append(" ")
        if tag in VOID:
            return
        if tag == "body":  # what an unclosed head holds ends here
            self._close(1)
        top = self._open[-1]
        dropped, weak = (True, False) if top.dropped else self._marks(tag, attrs, top.article)
        if dropped or tag in BLOCKS or attrs:
            if dropped and not top.dropped and tag not in BLOCKS:
                self._tags += 1
            node = _Node(tag, len(self._open), dropped, top.container, top.article, top.weak)
            if not dropped:
                if tag in CONTAINERS:
                    node.container = self._made = self._made + 1
                    if tag in ("article", "main"):
                        node.article = node.article or node.container
                if weak and tag not in ("article", "main"):
                    self._made += 1
                    node.weak = node.weak or self._made
            self._open.append(node)
            self._by_tag.setdefault(tag, []).append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self._flush()
        nodes = self._by_tag.get(tag)
        if not nodes:
            return
        if tag in BLOCKS:
            if tag in BARRIER or nodes[-1].place > self._last(BARRIER):
                self._close(nodes[-1].place)
        elif nodes[-1].place > self._last(BARRIER):
            # An inline element ends by itself: blocks opened inside it go on.
            node = nodes.pop()
            node.closed = True
            while self._open[-1].closed:
                self._open.pop()

    def handle_data(self, data: str) -> None:
        if not self._open[-1].dropped:
            self._text.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self._flush()
        return self.lines


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three deviations and renormalised at both ends."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(reach + 1)]
    n, out = len(values), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - reach), min(n, i + reach + 1)):
            w = kernel[abs(i - j)]
            total += w * values[j]
            weight += w
        out.append(total / weight)
    return out


def clusters(lines: list[Line]) -> tuple[float, float, list[bool]]:
    """The threshold, the mean of the smoothed ratios, and per line whether its smoothed ratio reaches the threshold."""
    ratios = smooth([len(line.text) / max(1, line.tags) for line in lines])
    mean = sum(ratios) / max(1, len(ratios))
    limit = THRESHOLD * math.sqrt(sum((r - mean) ** 2 for r in ratios) / max(1, len(ratios)))
    return limit, mean, [r >= limit for r in ratios]


def region_ratios(lines: list[Line], field: str) -> dict[int, float]:
    """Text-to-tag ratio of each container, article or weakly marked element over all its lines."""
    sums: dict[int, list[int]] = {}
    for line in lines:
        total = sums.setdefault(getattr(line, field), [0, 0])
        total[0] += len(line.text)
        total[1] += max(1, line.tags)
    return {region: size / tags for region, (size, tags) in sums.items()}


def content_lines(lines: list[Line]) -> list[str]:
    """The text of the regions that the clustering selects, in page order."""
    limit, mean, above = clusters(lines)
    weak = {w for w, ratio in region_ratios(lines, "weak").items() if w and ratio < max(limit, mean / 2)}
    articles = {a for a, ratio in region_ratios(lines, "article").items() if a and ratio >= limit}
    containers = {c for c, ratio in region_ratios(lines, "container").items() if ratio >= limit}
    seeds = [line for line, high in zip(lines, above, strict=True) if high and line.weak not in weak]
    articles &= {line.article for line in seeds}
    containers &= {line.container for line in seeds if line.article not in articles}
    if not articles and not containers:  # a page of one even ratio, or of none above its limit, is text throughout
        return [line.text for line in lines if line.weak not in weak]
    return [line.text for line in lines if line.weak not in weak and (line.article in articles or line.container in containers)]


def main_text(html: str | None) -> str:
    """The main text of one page; null and pages without any give an empty string."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    return "\n".join(content_lines(parser.finish()))


def extract(pages: DataFrame, carry: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``carry`` of each row with ``text``.

    A null or empty page gives an empty text; rows that repeat stay; an empty
    table gives an empty result; other columns are not read.
    """
    kinds = dict(pages.dtypes)
    names = [f"c{k}" for k in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])

    rows = pages.select(*[pages[c].alias(k) for c, k in zip(carry, names, strict=True)], pages[html_col].alias("html"))
    out = arrow_map(rows, run, ", ".join([f"{k} {kinds[c]}" for c, k in zip(carry, names, strict=True)] + ["text string"]))
    return out.toDF(*carry, "text")
