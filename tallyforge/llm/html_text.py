"""Main text of web pages by text-to-tag ratios.

The standard library's streaming parser turns a page into lines, one per block element, each with its characters of
text and its tags. The ratio of the two is smoothed along the page by a Gaussian, and a threshold between the page's
low and high ratios clusters the lines into content regions. What elements call navigation, page header or footer,
aside, script or control, and what is hidden, never becomes content. A form, and what class, id or role call sidebar,
advert, notice, comments and the like, is a wrapper that is left out, unless it holds the article, which is then read
as if the wrapper weren't there, or most of the page's text. Comments, adverts and notices of a page that has other
text stay out whatever they hold.

The regions decide on every page, and no mark of the page adds to them. From the page's root down, the element that holds
nearly all of the regions' text is looked for. Where it is the very element that the regions' blocks stand in, its other
blocks belong to the region too, headings and short lines that fall under the threshold; elsewhere content reaches from
the first region to the last, over the short lines between, and back to a heading before it. Marks leave out: an article
inside a wrapper tells which wrapper is the page itself.

Defined results: null or empty html has the empty text, as has a page whose text is all in elements that never become
content; broken markup is read as far as it goes, and a marked section of an unknown name is a comment; a page whose
text is all in wrappers is read as if they weren't there; a page without any content region keeps its best line; text
inside a block has its white space collapsed, blocks are joined by one space; repeated rows give equal texts; an empty
table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from tallyforge.llm.common import map_text

#: Elements that begin a new line, elements that hold no content, headings, elements without an end tag.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("applet aside audio button canvas datalist dialog embed footer head iframe input map menu nav noscript object script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what isn't content.
CHROME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|contentinfo|cookie|cookies|copyright|disqus|footer|menu|masthead|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promo|promoted|related|replies|reply|search|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|subscription|toolbar|widget)(?:$|[\s_-])"
)
#: Of these, words of wrappers that never hold the page's own article.
ASIDE = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|advertising|comment|comments|consent|cookie|cookies|disqus|modal|newsletter|popup|promo|promoted|related|replies|reply|sponsor|sponsored)(?:$|[\s_-])")
#: Parts of names that tell what a layout has or which state it is in, not what an element is.
LAYOUT = re.compile(r"(?<![^\s_-])(?:has|no|with|without)[_-]\S*|\S+[_-](?:active|closed|disabled|enabled|open|opened|visible)(?!\S)")
#: Elements that blocks stand in; what share of the regions' text one holds, to be gone into.
HOMES = frozenset("article blockquote body center dd div fieldset figure form li main section td".split())
HOLDS = 0.8
#: How many times the text of the open lines an article inside a wrapper needs, to be taken in their place.
OUTWEIGHS = 3
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story)(?:$|[\s_-])")
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    tags: int
    #: Inside an element that never holds content.
    shut: bool
    #: The wrappers around the line, and how many of them are around its article.
    wrappers: tuple[int, ...]
    depth: int
    article: bool
    heading: bool
    #: The elements that the line's block stands in, outermost first.
    homes: tuple[int, ...]


class Lines(HTMLParser):
    """Parser events to lines: text, tags counted on the line, what is around it."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, bool, int, bool]] = []
        self.homes: list[int] = []
        self.made = 0
        self.shut = self.article = self.tags = self.depth = 0
        self.wrappers: list[int] = []
        #: Of every wrapper, whether it never holds the article.
        self.aside: list[bool] = []
        self.text: list[str] = []
        self.heading = False

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.tags, self.shut > 0, tuple(self.wrappers), self.depth, self.article > 0, self.heading, tuple(self.homes)))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
        self.tags += 1
        if tag in BLOCKS:
            self.heading = tag in HEADINGS
        if tag in VOID:
            return
        shut = tag in SKIPPED or (tag == "header" and not self.article)
        wraps = tag == "form"
        article = tag in ("article", "main")
        named = ""
        if attrs and tag not in ("body", "html"):
            named = " ".join((v or "") for k, v in attrs if k in ("class", "id", "role")).lower()
            if named and CHROME.search(named):
                named = LAYOUT.sub(" ", named)
            if named and not article:
                wraps = wraps or bool(CHROME.search(named))
                article = not shut and not wraps and tag in ("div", "section") and bool(ARTICLE.search(named))
            if any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and "display:none" in (v or "").replace(" ", "").lower()) for k, v in attrs):
                shut = True
        if article and (self.shut or shut):
            article = False
        elif article and len(self.wrappers) > self.depth and tag != "main":
            article = not ASIDE.search(named) and not any(self.aside[i] for i in self.wrappers[self.depth :])
        if tag in BLOCKS or shut or wraps or article:
            # A paragraph or list item left open ends where the next one begins.
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.open and self.open[-1][0] == tag:
                self.leave(len(self.open) - 1)
            home = tag in HOMES
            self.open.append((tag, shut, wraps, article, self.depth, home))
            if home:
                self.made += 1
                self.homes.append(self.made)
            self.shut += shut
            self.article += article
            if wraps:
                self.wrappers.append(len(self.aside))
                self.aside.append(bool(ASIDE.search(named)))
            if article:
                self.depth = len(self.wrappers)

    def leave(self, at: int) -> None:
        for _, shut, wraps, article, _, home in self.open[at:]:
            if home:
                self.homes.pop()
            self.shut -= shut
            self.article -= article
            if wraps:
                self.wrappers.pop()
        self.depth = self.open[at][4]
        del self.open[at:]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in SKIPPED:
            self.end_line()
        self.tags += 1
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.leave(i)
                return
            if tag in ("p", "li", "a", "span", "b", "i", "em", "strong") and self.open[i][0] not in ("p", "li"):
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def read(self, html: str) -> list[Line]:
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):
            pass
        self.end_line()
        return self.lines

    def content(self) -> list[int]:
        """The lines that may be content."""
        marked: dict[int, list[int]] = {}
        free: list[int] = []
        for i, x in enumerate(self.lines):
            if not x.shut and x.article and len(x.wrappers) == x.depth:
                marked.setdefault(x.depth, []).append(i)
            if not x.shut and not x.wrappers:
                free.append(i)
        size = lambda at: sum(len(self.lines[i].text) for i in at)
        own = marked.pop(0, [])
        if marked:
            most = max(map(size, marked.values()))
            if OUTWEIGHS * size(own or free) < most:
                return marked[min(d for d, at in marked.items() if OUTWEIGHS * size(at) >= most)]
        if own:
            return free
        readable = [i for i, x in enumerate(self.lines) if not x.shut]
        if len(free) < len(readable):
            held = Counter()
            for i in readable:
                held.update({w: len(self.lines[i].text) for w in self.lines[i].wrappers if not self.aside[w]})
            wide = {w for w, n in held.items() if 2 * n > size(readable)}
            free = [i for i in readable if wide.issuperset(self.lines[i].wrappers)]
        return free or readable


def smooth(ratios: np.ndarray, width: float = 1.0) -> np.ndarray:
    """Gaussian smoothing along the lines; the kernel's part beyond the ends is left out."""
    reach = max(1, int(2 * width + 0.5))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * width**2))
    return np.convolve(ratios, kernel, "full")[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel, "full")[reach:-reach]


def threshold(values: np.ndarray) -> float:
    """Where two groups of ratios part: the mean of the groups' means, until it stands still."""
    cut = float(values.mean())
    for _ in range(20):
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def holder(lines: list[Line], solid: list[int]) -> tuple[int, ...]:
    """The path of elements down to the last that holds nearly all text of the solid lines."""
    size = {i: len(lines[i].text) for i in solid}
    total, path = sum(size.values()), ()
    while True:
        below: Counter = Counter()
        for i in solid:
            if len(lines[i].homes) > len(path) and lines[i].homes[: len(path)] == path:
                below[lines[i].homes[len(path)]] += size[i]
        if not below or (most := below.most_common(1)[0])[1] < HOLDS * total:
            return path
        path += (most[0],)


def main_text(html: str | None) -> str:
    page = Lines()
    lines = page.read(html or "")
    open_lines = page.content()
    if not open_lines:
        return ""
    free = set(open_lines)
    ratios = np.array([len(x.text) / max(1, x.tags) if i in free else 0.0 for i, x in enumerate(lines)])
    smoothed = smooth(np.log1p(ratios))
    line = threshold(smoothed) if len(lines) > 2 else 0.0
    content = [i for i in open_lines if smoothed[i] > line] or [max(open_lines, key=lambda i: smoothed[i])]
    solid = [i for i in content if ratios[i] >= np.expm1(line)] or content
    path = holder(lines, solid)
    inside = [i for i in open_lines if lines[i].homes[: len(path)] == path]
    solid = [i for i in solid if lines[i].homes[: len(path)] == path]
    size = lambda at: sum(len(lines[i].text) for i in at)
    # The blocks of the regions stand side by side in one element, and not in the page's body itself.
    if len(path) > 1 and 2 * size([i for i in solid if lines[i].homes == path]) > size(solid):
        return " ".join(lines[i].text for i in inside)
    # A region reaches over the short lines between its first and last long ones, and to a heading before it.
    content = [i for i in inside if solid[0] <= i <= solid[-1] or (solid[0] - 2 <= i < solid[0] and (i in content or lines[i].heading))]
    return " ".join(lines[i].text for i in content)


def extract(pages: DataFrame) -> DataFrame:
    """All columns of pages and `_text`, the main text of `html`."""
    return map_text(pages, "_text string", lambda texts: [[main_text(t) for t in texts]], column="html", rows=200)
