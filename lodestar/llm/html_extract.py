"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import with_arrow

#: Elements that start and end a block of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset("aside button datalist dialog embed footer form head header iframe input nav noscript object option script select style svg template textarea title canvas audio video map menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class and id that name page furniture.
_FURNITURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising)?|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notices?|popup|promo|related|respond|share|sharing|sidebar|signup|social|sponsor(?:ed)?|subscribe|tags?|toolbar|widget)(?:$|[\s_-])", re.I)
#: Class names that say what a wrapper has or lacks, or that hold the article's own title.
_STATES = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|with|without)[-_]\S+|(?:article|entry|post|page|story|content|section)[-_]+(?:header|title)\S*)", re.I)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements that an opening tag ends although their own end tag is missing.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSED = frozenset("p li dt dd td th tr".split())
#: Blocks that are lines of the container around them.
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li pre dt figcaption caption legend address summary hr".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LISTS = frozenset("ul ol dl dir".split())
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    """A block's text with the number of tags met while it was built, its linked code points and its element."""

    text: str
    tags: int
    linked: int
    node: int


@dataclass
class Page:
    """Lines, and for each block element (0 is the page) its name and the element around it, which comes earlier."""

    lines: list[Line] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])


@dataclass
class _Open:
    name: str
    dropped: bool
    node: int
    article: bool


class _Reader(HTMLParser):
    """Parser events to a Page. Places of open elements are kept by name, so that each event costs constant time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack: list[_Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.walls: list[int] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.page.lines.append(Line(text, self.tags, self.linked, self._node))
        self.parts, self.tags, self.linked = [], 0, 0

    @property
    def _node(self) -> int:
        return self.stack[-1].node if self.stack else 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self._close({"p"})
            self._close(_ENDS.get(tag, set()))
            self.tags += 1
        elif tag == "br":
            self.parts.append("\n")
        if tag in VOID:
            return
        named = dict(attrs)
        marks = f"{named.get('class') or ''} {named.get('id') or ''}"
        above = self.stack[-1] if self.stack else _Open("", False, 0, False)
        dropped = above.dropped or (tag in DROPPED and not (tag == "header" and above.article))
        if tag in BLOCKS and tag not in ("body", "html", "article", "main"):
            dropped = dropped or bool(_FURNITURE.search(_STATES.sub("", marks))) or (named.get("role") or "").lower() in _ROLES
        dropped = dropped or "hidden" in named or (named.get("aria-hidden") or "").lower() == "true"
        node = above.node
        if tag in BLOCKS:
            node = len(self.page.names)
            self.page.names.append(tag)
            self.page.parents.append(above.node)
            self.blocks.append(len(self.stack))
            if tag not in _CLOSED:
                self.walls.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_Open(tag, dropped, node, above.article or tag in ("article", "main")))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, names: set[str]) -> None:
        """Close the nearest open element of these names, unless another container stands between."""
        nearest = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        if nearest > (self.walls[-1] if self.walls else -1):
            self._pop(nearest)

    def _pop(self, k: int) -> None:
        for o in self.stack[k:]:
            self.places[o.name].pop()
        for kept in (self.blocks, self.walls):
            while kept and kept[-1] >= k:
                kept.pop()
        del self.stack[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        at = self.places.get(tag)
        if at and (tag in BLOCKS or at[-1] > (self.blocks[-1] if self.blocks else -1)):
            self._pop(at[-1])

    def handle_data(self, data: str) -> None:
        if not (self.stack and (self.stack[-1].dropped or self.stack[-1].name in ("script", "style"))):
            self.parts.append(data)
            self.linked += len(data) if self.places.get("a") else 0


def read_page(html: str) -> Page:
    """The lines of a page outside DROPPED and named furniture, with the tree of its blocks; linear in its length."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.page


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing with the ends held."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), "valid")


def threshold(scores: np.ndarray) -> float:
    """Scores of content reach the standard deviation of all; scores that are all alike are content."""
    return float(scores.std()) * (1 - 1e-12)


def _own(lines: list[Line]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, those outside links, and tags of each line."""
    size, linked = np.array([len(x.text) for x in lines], float), np.array([x.linked for x in lines], float)
    return size, np.maximum(size - linked, 0), np.array([max(x.tags, 1) for x in lines], float)


def groups(page: Page) -> list[int]:
    """For each element the container whose line it is, itself if it isn't one of _LEAVES."""
    out = list(range(len(page.names)))
    for k in range(1, len(out)):
        out[k] = out[page.parents[k]] if page.names[k] in _LEAVES else k
    return out


def content_lines(page: Page, sigma: float = 1.0) -> np.ndarray:
    """Which lines are content by themselves.

    Their smoothed ratio of unlinked code points to tags reaches the threshold, they are not mostly linked, and the
    lines of their container taken together pass the same threshold unsmoothed, so that a good neighbour is not enough.
    Where no line passes, the last condition falls, then all do.
    """
    size, own, tags = _own(page.lines)
    ratio = smoothed(own / tags, sigma)
    cut = threshold(ratio)
    found = (ratio >= cut) & (own > 0) & (2 * own >= size)
    group = np.array(groups(page))[[x.node for x in page.lines]]
    pooled = np.bincount(group, own) / np.maximum(np.bincount(group, tags), 1)
    for mask in (found & (pooled[group] >= cut), found):
        if mask.any():
            return mask
    return np.ones(len(size), bool)


def content_region(page: Page, content: np.ndarray) -> np.ndarray:
    """Which lines belong to the regions that the content lines make out.

    If articles or main elements hold half of the content or more, the innermost ones with content are the regions,
    whole. Else the region is the innermost container around all content. In it stay: lines of containers with content
    of their own; headings beside those; lists, and other parts that aren't mostly linked, if they stand in a container
    with content of its own; and parts between the first and the last content line that aren't mostly linked. Headings
    right before the region belong to it. All else is furniture without a name.
    """
    names, parents, n = page.names, page.parents, len(page.names)
    node = [x.node for x in page.lines]
    size, linked = [len(x.text) for x in page.lines], [min(x.linked, len(x.text)) for x in page.lines]
    article, group = [0] * n, groups(page)
    for k in range(1, n):
        article[k] = k if names[k] in ("article", "main") else article[parents[k]]
    held = sum(s for s, a, c in zip(size, node, content, strict=True) if c and article[a])
    if 2 * held >= sum(s for s, c in zip(size, content, strict=True) if c):
        chosen = {article[a] for a, c in zip(node, content, strict=True) if c and article[a]}
        inside = [False] * n
        for k in range(1, n):
            inside[k] = k in chosen or inside[parents[k]]
        return np.array([inside[a] for a in node])

    own = [False] * n  # content in lines of its own
    text, links, cores = [0] * n, [0] * n, [0] * n  # of the whole subtree
    for a, s, m, c in zip(node, size, linked, content, strict=True):
        text[a] += s
        links[a] += m
        if c and not own[group[a]]:
            own[group[a]] = True
            cores[group[a]] = 1
    n_cores = sum(own)
    for k in range(n - 1, 0, -1):
        text[parents[k]] += text[k]
        links[parents[k]] += links[k]
        cores[parents[k]] += cores[k]
    region = max(k for k in range(n) if cores[k] == n_cores)  # children come after parents
    inside, idle = [k == region for k in range(n)], [0] * n  # idle: the outermost container without content
    for k in range(1, n):
        inside[k] = inside[k] or inside[parents[k]]
        idle[k] = 0 if cores[group[k]] else idle[parents[k]] or group[k]
    first, last = int(np.flatnonzero(content)[0]), int(np.flatnonzero(content)[-1])
    keep = np.zeros(len(node), bool)
    for i, a in enumerate(node):
        if not inside[group[a]]:
            continue
        part = idle[a]
        if not part:
            keep[i] = own[group[a]] or names[a] in _HEADINGS
        elif 2 * links[part] < text[part]:
            keep[i] = own[group[parents[part]]] or first < i < last
        else:
            keep[i] = own[group[parents[part]]] and names[part] in _LISTS
    before = int(np.flatnonzero(keep)[0])
    while before and names[node[before - 1]] in _HEADINGS:
        before -= 1
        keep[before] = True
    return keep


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks, one per line, in page order.

    Elements, roles, classes and ids that name furniture are passed over while reading. Of the other lines, the ratio
    of unlinked text to tags, smoothed, and a threshold that parts them into two clusters tell content lines; the containers that
    hold them make out the regions, whose lines all stay, however short (content_region). Null, empty and textless
    pages give an empty text.
    """
    page = read_page(html) if html else Page()
    if not page.lines:
        return ""
    keep = content_region(page, content_lines(page, sigma))
    return "\n".join(x.text for x, k in zip(page.lines, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "text", sigma: float = 1.0) -> DataFrame:
    """Append the main text; null and empty pages give an empty text, broken markup is read as far as it goes."""

    def make():
        def run(batch: pa.RecordBatch) -> list:
            column = batch.column(batch.schema.get_field_index(html))
            return [pa.array([main_text(v.as_py(), sigma) for v in column], pa.string())]

        return run

    return with_arrow(pages, [T.StructField(out, T.StringType())], make)
