"""HTML extraction by text-to-tag ratios (Weninger, Hsu and Han 2010).

The standard library's parser streams its events; text between block borders is a line, with the characters and the
tags since the line before. The ratios are smoothed with a Gaussian, and a threshold on their spread splits lines
into content and clutter: runs of content lines, between lines that pass it by themselves, are the clusters that choose
the region, the innermost container that holds nine tenths of their text. Tags are evidence: what stands in an element that never is article text (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments), known by tag, role or class words, has no ratio;
nor has what stands beside an article or main element that holds at least half of the clusters' text.

A region in an article or main element is the whole of that element, and all its lines are given out but those that
evidence calls clutter: short sections, tables, dialogue and lists of links are text there; only long runs of bare, tag-laden scraps go. Of another region the lines in
clusters are given out, what stands between them, and text blocks in the same containers; lines that are mostly links go.
Inside an article some class words count only as whole names. A heading and lead right before the region belong to it.

Defined results: null, empty and text-free pages give an empty text; broken, unclosed and cut-off markup is read as
far as it goes, in time linear in its length; a page whose text all seems clutter by class words is read as if they
weren't there; repeated rows give repeated rows; an empty table gives no rows; other columns are ignored. White
space inside a line becomes one space; lines are joined by one space.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

#: Never text.
SILENT = frozenset("head title script style noscript template iframe svg canvas object audio video map".split())
SKIPPED = frozenset("nav footer aside form button select option textarea dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("body article main section div td center".split())
ARTICLE = frozenset(("article", "main"))
LISTS = CONTAINERS | {"table", "ul", "ol", "dl"}
#: A new one of these closes an open one of the same list.
CLOSES = {"p": ("p",), "li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Words in class, id or role that mark clutter.
CLUTTER = frozenset("ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                    "notice alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist "
                    "respond disqus reply replies sidebar aside nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
                    "footer masthead topbar toolbar share sharing social related recommended widget complementary contentinfo search "
                    "skip hidden".split())
READERS = frozenset("comment comments commentlist respond disqus reply replies".split())
#: Of these, words that mark clutter only as a whole name where they stand in an article.
PARTS = frozenset("search reply replies respond notice alert related share sharing social menu skip hidden login widget recommended".split())
WORDS = re.compile(r"[A-Za-z]+")
#: Class names that begin so tell about a page's layout, not what an element is.
LAYOUT = ("has-", "with-", "no-", "is-", "has_", "with_", "no_")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks of running text, and blocks that may as well be menus.
PROSE = frozenset("p blockquote pre figcaption".split()) | HEADINGS
ITEMS = frozenset("li dt dd td th caption summary".split())
#: Elements that leave the head open; any other tag closes it.
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
RUN = 5
#: What a line is: text, clutter by evidence, or clutter whatever stands in it.
TEXT, SOFT, HARD = 0, 1, 2


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters in links
    box: int  # the container it stands in, or -1
    block: str  # the tag of its block
    state: int


class Lines(HTMLParser):
    """lines, in page order, and the containers around them: kinds and parents by number (a parent's is smaller)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = []
        self.parents: list[int] = []
        self.stack: list[tuple[str, int, bool, int, str]] = []  # tag, and what held before it: state, silence, container, block
        self.at: dict[str, list[int]] = {}  # where in the stack each tag is open
        self.state, self.silent, self.box, self.block = TEXT, False, -1, ""
        self.tags, self.linked, self.buffer = 0, 0, []

    def flush(self):
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                self.lines.append(Line(text, self.tags, self.linked, self.box, self.block, self.state))
                self.tags = 0
            self.buffer, self.linked = [], 0

    def top(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in IN_HEAD and self.at.get("head"):
            self.close_tag("head")
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        for other in CLOSES.get(tag, ()):
            self.close_tag(other, LISTS)
        before = self.state, self.silent, self.box, self.block
        if tag in ARTICLE and self.state == SOFT:
            self.state = TEXT  # clutter that was never closed
        if tag in SILENT:
            self.silent = True
        elif tag in SKIPPED:
            self.state = max(self.state, HARD if tag == "aside" else SOFT)
        elif tag == "header" and not (self.at.get("article") or self.at.get("main")):
            self.state = max(self.state, SOFT)
        if attrs and tag not in ("html", "body"):
            for name, value in attrs:
                if name in ("class", "id", "role") and value:
                    within = self.at.get("article") or self.at.get("main")
                    for token in value.lower().split():
                        words = WORDS.findall(token)
                        found = CLUTTER.intersection(words) if not token.startswith(LAYOUT) else ()
                        # an article's own parts may be called search-methods or reply-letter
                        if found and not (within and len(words) > 1 and PARTS >= found and not CLUTTER >= set(words)):
                            self.state = max(self.state, HARD if READERS & found else SOFT)
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                    self.silent = True
        if tag in CONTAINERS:
            self.parents.append(self.box)
            self.box = len(self.kinds)
            self.kinds.append(tag)
        if tag not in INLINE:
            self.block = tag
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, *before))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def close_tag(self, tag, borders=frozenset()):
        """Closes the innermost such tag and what is open in it, unless a border stands between."""
        k = self.top((tag,))
        if k < 0 or k < self.top(borders):
            return
        _, self.state, self.silent, self.box, self.block = self.stack[k]
        for other, *_ in self.stack[k:]:
            self.at[other].pop()
        del self.stack[k:]

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        self.close_tag(tag, CONTAINERS if tag in INLINE or tag == "p" else frozenset())

    def handle_data(self, data):
        if not self.silent:
            self.buffer.append(data)
            if self.at.get("a"):
                self.linked += len(data)


def smooth(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with the kernel's mass kept at the ends."""
    r = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    near = np.convolve(np.ones(len(x)), kernel, "full")[r : r + len(x)]
    return np.convolve(x, kernel, "full")[r : r + len(x)] / near


def content_lines(lines: list[Line], clutter: np.ndarray) -> np.ndarray:
    """Which lines are in a cluster: a run whose smoothed text-to-tag ratios pass their standard deviation, from its first to its last line that does so by itself."""
    own = np.where(clutter, 0.0, [max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])
    ratio = smooth(own)
    high = (ratio >= ratio.std()) & (ratio > 0)
    run = np.cumsum(np.diff(high.astype(np.int8), prepend=0) != 0)
    alone = np.flatnonzero(high & (own >= ratio.std()))
    first, last = np.full(run[-1] + 1, len(lines)), np.full(run[-1] + 1, -1)
    np.minimum.at(first, run[alone], alone)
    np.maximum.at(last, run[alone], alone)
    at = np.arange(len(lines))
    return high & ~clutter & (at >= first[run]) & (at <= last[run])


def gathered(lines: list[Line], content: np.ndarray, parents: list[int]) -> np.ndarray:
    """Characters of content within each container."""
    mass = np.zeros(len(parents) + 1, np.int64)  # the last is the page
    for x, c in zip(lines, content, strict=True):
        mass[x.box] += c * len(x.text)
    for box in range(len(parents) - 1, -1, -1):
        mass[parents[box]] += mass[box]
    return mass


def region_lines(page: Lines, clutter: np.ndarray) -> np.ndarray:
    """Which lines are the page's main text, given those that evidence rules out."""
    lines, parents = page.lines, page.parents
    content = content_lines(lines, clutter)
    inside = np.zeros(len(parents) + 1, bool)
    for box, kind in enumerate(page.kinds):
        inside[box] = kind in ARTICLE or inside[parents[box]]
    held = inside[[x.box for x in lines]]
    size = np.array([len(x.text) for x in lines])
    if 2 * size[content & held].sum() >= size[content].sum() > 0:
        clutter = clutter | ~held
        content = content_lines(lines, clutter)
    if not content.any():
        content = ~clutter
    mass = gathered(lines, content, parents)
    region = int(np.flatnonzero(np.append(mass[-1:], mass[:-1]) * 10 >= mass[-1] * 9)[-1]) - 1
    while region >= 0 and inside[region] and page.kinds[region] not in ARTICLE:
        region = parents[region]  # an article's body is as large as the article
    within = np.zeros(len(parents) + 1, bool)
    within[region] = True
    if region >= 0:
        for box in range(region + 1, len(parents)):
            within[box] = within[parents[box]]
    else:
        within[:] = True
    here = within[[x.box for x in lines]] & ~clutter
    if region >= 0 and inside[region]:
        out = here & ~bare_runs(lines, content)  # else of an article nothing but clutter by evidence goes
    else:
        out = kept_by_clusters(lines, content & here, here, len(parents))
    first = k = int(np.argmax(out)) if out.any() else 0
    while k and lines[k].block != "h1" and not clutter[k - 1] and lines[k - 1].block in PROSE and 2 * lines[k - 1].linked <= len(lines[k - 1].text):
        k -= 1
        if lines[k].block in HEADINGS:
            out[k:first] = True
    return out


def bare_runs(lines: list[Line], content: np.ndarray) -> np.ndarray:
    """Runs of RUN lines or more outside clusters that stand in bare containers with fewer than two characters for each tag: menus that no tag or class names."""
    bare = np.array([x.block not in PROSE | ITEMS and len(x.text) < 2 * x.tags for x in lines]) & ~content
    run = np.cumsum(np.diff(bare.astype(np.int8), prepend=0) != 0)
    return bare & (np.bincount(run)[run] >= RUN)


def kept_by_clusters(lines: list[Line], content: np.ndarray, here: np.ndarray, boxes: int) -> np.ndarray:
    """Of a region that no tag names: content, what stands between it, and blocks beside it in its containers; runs of lines that are links for the most part go."""
    beside = np.zeros(boxes + 1, bool)
    beside[[x.box for x, c in zip(lines, content, strict=True) if c]] = True
    at = np.flatnonzero(content)
    out = content.copy()
    for k, x in enumerate(lines):
        if here[k] and not content[k]:
            between = len(at) > 0 and at[0] < k < at[-1]
            linked = 2 * x.linked > len(x.text)
            near = between and any(0 <= j < len(lines) and content[j] for j in (k - 1, k + 1))
            out[k] = (near and x.block in PROSE) if linked else between or not len(at) or beside[x.box] and x.block in PROSE | ITEMS | CONTAINERS
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    if not page.lines:
        return ""
    state = np.array([x.state for x in page.lines])
    clutter = state > TEXT if (state == TEXT).any() else state > SOFT if (state == SOFT).any() else np.zeros(len(state), bool)
    return " ".join(x.text for x, k in zip(page.lines, region_lines(page, clutter), strict=True) if k)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text (the main text) and n_chars."""

    def run(batches):
        for part in slices(batches, 8 << 20):
            texts = [main_text(x) for x in part[2].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part[0].combine_chunks(), part[1].combine_chunks(), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr(f"cast(`{page_id}` as long) page_id", f"cast(`{url}` as string) url", f"cast(`{html}` as string) html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
