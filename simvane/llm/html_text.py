"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and a threshold.

The standard library's parser streams a page's events; block elements cut its text into lines, and only
what never is text (scripts, styles, controls, drawings) is left out. Each line has the ratio of its
characters to the tags met since the line before; characters of links count against it. Evidence scales
the ratio: an article or main element raises it, an element that marks what isn't the article lowers it,
be it by name (nav, footer) or by the words of its class, id and role (advert, comments). A mark whose
element holds the article itself is void. Ratios are smoothed along the page, marked elements each on
their own, and parted at a threshold into two clusters.

Lines form regions: an article or main element, a marked element, or else the nearest container. Regions
of the upper cluster are content. So are lower ones that bear no mark and have few links, unless an
article holds most of the text and they lie outside it: sections of short paragraphs and quotations have
low ratios too. A content region keeps all its lines.
"""

from __future__ import annotations

from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from simvane.session import lean, share_path

SCHEMA = "page_id long, url string, text string, n_chars long"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article main section div td body blockquote center".split())
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What never is text of a page.
DROPPED = frozenset("script style noscript template head title select option button textarea input iframe object svg canvas audio video datalist map math".split())
#: Elements that by their name aren't the article; a header may be the article's own.
APART = frozenset("nav footer aside form menu dialog fieldset legend header".split())
#: Words of a class, id or role, between hyphens, underscores or capitals, that mark what isn't the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs "
    "topbar footer sidebar aside widget widgets cookie cookies consent gdpr popup modal overlay recommended "
    "newsletter subscribe subscription signup login comment comments disqus replies respond pagination pager toolbar contentinfo complementary".split()
)
#: Words that mark it outside the article alone, and weigh less.
HINTS = frozenset("header masthead related search share sharing social notice notification alert skip".split())
#: Words that name the readers' part, however long it is.
READERS = frozenset("comment comments disqus replies respond".split())
#: How evidence scales a line's ratio.
IN_MAIN, MARKED, HINTED = 2.0, 0.02, 0.1
#: The share of a low region's characters in links from which it is left out.
LINKED = 1 / 3
#: Words beside which a mark only tells of a wrapper's layout, as in with-sidebar.
LAYOUT = frozenset("with has no without".split())
_WORD = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements that an opening tag of the key closes if one is open within the same container.
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",), "body": ("head",)}


@dataclass
class Mark:
    """A marked element: the mark around it, how it scales ratios, and what it holds."""

    around: int
    weight: float
    readers: bool
    named: bool  # by the element's name
    within: bool = False  # in a readers' part
    chars: int = 0
    lines: int = 0
    holds_main: bool = False


@dataclass
class Line:
    text: str
    linked: int
    tags: int
    region: int
    mark: int


class PageLines(HTMLParser):
    """Collects a page's lines and the marked elements, whose numbers begin at 1.

    Open are kept blocks, links and marked elements; other inline elements change nothing, closed or not.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.marks: list[Mark] = [Mark(0, 1.0, False, False)]
        self.main_regions: set[int] = set()
        self._open: list[tuple[str, bool, int, int]] = []  # element, whether dropped, region, mark
        self._held: dict[str, int] = {}  # how many of an element are open
        self._text: list[str] = []
        self._linked = self._tags = self._serial = 0

    def _state(self) -> tuple[bool, int, int]:
        return self._open[-1][1:] if self._open else (False, 0, 0)

    def end_line(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.lines.append(Line(text, self._linked, self._tags, *self._state()[1:]))
                self._tags = 0
            self._text, self._linked = [], 0

    def _pop_to(self, place: int) -> None:
        for tag, *_ in self._open[place:]:
            self._held[tag] -= 1
        del self._open[place:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            self._text.append(" ")
            return
        if tag in BLOCKS:
            self.end_line()
        closed = CLOSES.get(tag, ("p",)) if tag in BLOCKS else ("a",) if tag == "a" else ()
        if any(self._held.get(x) for x in closed):
            for place in range(len(self._open) - 1, -1, -1):
                if self._open[place][0] in closed:
                    self._pop_to(place)
                elif self._open[place][0] in BLOCKS:
                    break
        if tag in VOID:
            return
        dropped, region, mark = self._state()
        in_main = region in self.main_regions
        if dropped or tag in DROPPED:
            dropped = True
        elif found := self._marked(tag, attrs, in_main):
            self.marks.append(Mark(mark, *found, within=found[1] or self.marks[mark].within))
            mark = len(self.marks) - 1
        elif tag in MAIN or tag == "h1":
            at = mark
            while at and not self.marks[at].holds_main:
                self.marks[at].holds_main = True
                at = self.marks[at].around
        if tag in CONTAINERS and not in_main:
            self._serial += 1
            region = self._serial
            if tag in MAIN and not dropped and not self.marks[mark].within:
                self.main_regions.add(region)
        if tag in BLOCKS or tag == "a" or tag in DROPPED or (dropped, region, mark) != self._state():
            self._open.append((tag, dropped, region, mark))
            self._held[tag] = self._held.get(tag, 0) + 1

    @staticmethod
    def _marked(tag: str, attrs: list[tuple[str, str | None]], in_main: bool) -> tuple[float, bool, bool] | None:
        """(weight, whether readers' part, whether by the element's name) of an element that is marked."""
        if tag in ("html", "body"):
            return None
        if tag in APART and not (tag == "header" and in_main):
            return MARKED, False, True
        hinted = False
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                for name in value.split():
                    words = {w.lower() for w in _WORD.findall(name)}
                    if not LAYOUT.isdisjoint(words):
                        continue
                    if not MARKS.isdisjoint(words):
                        return MARKED, not READERS.isdisjoint(words), False
                    hinted |= not HINTS.isdisjoint(words)
        return (HINTED, False, False) if hinted and not in_main and tag not in HEADINGS else None

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag in BLOCKS:
            self.end_line()
        if not self._held.get(tag):
            return
        for place in range(len(self._open) - 1, -1, -1):
            name = self._open[place][0]
            if name == tag:
                self._pop_to(place)
                return
            if name in CONTAINERS and tag not in BLOCKS:
                return  # a stray inline end never closes a container

    def handle_data(self, data: str) -> None:
        if self._state()[0]:
            return
        self._text.append(data)
        if self._held.get("a"):
            self._linked += len(data)


def evidence(page: PageLines) -> tuple[list[float], list[int]]:
    """Of each mark, how it scales ratios, with the marks around it, and the outermost mark in force; void marks scale nothing.

    A mark by class is void if its element holds the article: an article, main or first heading, or, in
    three lines or more, most of the page's text; the readers' part only if it is all there is.
    """
    for line in page.lines:
        page.marks[line.mark].chars += len(line.text) - min(line.linked, len(line.text))
        page.marks[line.mark].lines += 1
    for m in page.marks[:0:-1]:  # a mark comes behind those around it
        page.marks[m.around].chars += m.chars
        page.marks[m.around].lines += m.lines
    whole = page.marks[0].chars
    weights, outer = [1.0], [0]
    for number, m in enumerate(page.marks[1:], 1):
        most = m.lines >= 3 and m.chars > (whole * 0.95 if m.readers else whole / 2)
        void = not m.named and (most or (m.holds_main and not m.readers and 2 * m.chars > whole))
        weights.append(weights[m.around] * (1.0 if void else m.weight))
        outer.append(outer[m.around] or (0 if void else number))
    return weights, outer


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing along the page; at its ends the kernel's part on the page counts as a whole."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    pad = np.convolve(np.ones(len(ratios)), kernel, "full")[reach:-reach]
    return np.convolve(ratios, kernel, "full")[reach:-reach] / pad


def threshold(values: np.ndarray) -> float:
    """The border between two clusters of least squared deviation; the least value if there is but one."""
    v = np.sort(values)
    n = np.arange(1, len(v))
    if not len(n) or v[-1] - v[0] < 1e-9:
        return float(v[0])
    left, total = np.cumsum(v)[:-1], v.sum()
    between = (left - n * total / len(v)) ** 2 / (n * (len(v) - n))
    cut = int(between.argmax())
    return float((v[cut] + v[cut + 1]) / 2)


def main_text(html: str | None, sigma: float = 1.5) -> str:
    """The content regions' lines, joined by line feeds; an empty text if there is none."""
    page = PageLines()
    page.feed(html or "")
    rest = page.rawdata
    if rest.startswith("<"):  # a tag that the page's end cuts off is markup, not text
        page.rawdata = ""
    page.close()
    page.end_line()
    lines = page.lines
    if not lines:
        return ""
    scale, outer = evidence(page)
    group = np.array([outer[x.mark] for x in lines])
    plain = group == 0
    in_main = np.array([x.region in page.main_regions for x in lines]) & plain
    length = np.array([len(x.text) for x in lines], float)
    linked = np.minimum(np.array([x.linked for x in lines], float), length)
    ratio = (length - linked) / np.maximum(1, np.array([x.tags for x in lines]))
    ratio *= np.array([scale[x.mark] for x in lines]) * np.where(in_main, IN_MAIN, 1.0)
    level = np.zeros(len(lines))
    for one in np.unique(group):
        level[group == one] = smoothed(ratio[group == one], sigma)
    border = threshold(level)
    regions, own = np.unique(np.where(plain, np.array([x.region for x in lines]), -group), return_inverse=True)
    weight = np.bincount(own, length)
    mean = np.bincount(own, level * length) / weight
    bare = regions >= 0  # unmarked
    article = 2 * length[in_main].sum() >= length.sum()
    kept_low = bare & (np.bincount(own, linked) / weight < LINKED) & ((np.bincount(own, in_main) > 0) | (not article))
    chosen = (mean >= border) | kept_low
    if len(regions) > 1 and mean.max() <= 0:
        chosen &= bare
    elif not bare.any() and all(page.marks[-r].named or page.marks[-r].lines < 3 for r in regions):
        chosen[:] = False
    return "\n".join(x.text for x, k in zip(lines, own, strict=True) if chosen[k])


def extract(pages: DataFrame) -> DataFrame:
    """One row (SCHEMA) for each page, from its whole html; n_chars counts the text's code points.

    A null, empty or textless page has an empty text and 0 characters. Each row stands alone, so
    repeated rows and null ids or addresses pass through; other columns are never read.
    """
    share_path(pages.sparkSession)

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                texts = [main_text(h.as_py()) for h in part["html"]]
                yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(lean(run), SCHEMA)
