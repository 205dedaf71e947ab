"""Main text of web pages: parser events, text-to-tag ratio of each line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Element names of HTML, and words that name page furniture in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head script style noscript template nav aside footer form button select option textarea input svg canvas iframe object audio video dialog menu".split())
CONTENT = frozenset("article main".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner banners breadcrumb breadcrumbs comment comments commentlist cookie cookies cookiebar consent disqus footer form header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar sidebars signup skyscraper social sponsor sponsored subscribe toolbar widget widgets complementary contentinfo alert".split()
)
# Words of FURNITURE that also begin names of content (related-work, header-image, search-results): of a longer token, only with one of these behind.
SOFT = frozenset("alert banner form header notice related reply respond search social widget".split())
PARTS = frozenset("area articles bar block box button buttons container content field fields icons inner item items link links list main menu message nav panel popup posts section stories top widget wrap wrapper".split())
# Furniture that may hold a whole page all the same is judged once the page is read; of it, this is never the main text by its size.
JUDGED = frozenset("nav aside footer form header dialog menu".split())
ASIDE = frozenset("breadcrumb breadcrumbs comment comments commentlist disqus footer menu menubar nav navbar navigation pager pagination replies reply respond".split())
PAGE = frozenset("html body".split())
CLOSING = ("ul", "ol", "article", "section", "div", "main", "body", "table", "blockquote")  # a p or li ends an open one unless one of these is between
TOKEN = re.compile(r"([a-z]+)(?:[-_]+([a-z]+))?")


def furniture(value: str) -> set[str]:
    """The words of FURNITURE that a token of a class, id or role is or begins with (share-buttons, but neither has-comments nor related-work)."""
    found = (m for m in map(TOKEN.match, value.lower().split()) if m and m[1] in FURNITURE)
    return {m[1] for m in found if m[1] not in SOFT or m[2] is None or m[2] in PARTS}


class Lines(HTMLParser):
    """Cuts a page into lines, one for each block of text, with its tag count and where it stands. Time is linear in the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, hidden, box
        self.places: dict[str, list[int]] = defaultdict(list)  # of each name, where it stands in `open`
        self.blocks: list[int] = []  # places of names that an inline element's end does not reach over
        self.boxes: list[int] = [-1]  # each box's parent, which always has a smaller number
        self.content: set[int] = set()
        self.main: set[int] = set()  # those that are not article
        self.titles: set[int] = set()  # boxes of h1
        self.furniture: dict[int, bool] = {}  # boxes that look like furniture: whether they may be the main text by their size
        self.lines: list[tuple[str, int, int]] = []  # text, tags, box
        self.text: list[str] = []
        self.tags = 0
        self.endless = False

    def parse_html_declaration(self, i):
        """Declarations that the parser has no rule for are comments up to the next >."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def parse_comment(self, i, report=1):
        """Once a comment has no end, no later one has: they are not looked for again."""
        end = -1 if self.endless else super().parse_comment(i, report)
        self.endless = end < 0
        return end

    def read(self, html: str) -> None:
        """The whole page. Behind its last > no tag can end, so that is text."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        if self.cdata_elem is None:
            self.handle_data(unescape(html[end:]))
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.open[-1][2] if self.open else 0))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            if tag == "p" or tag == "li":
                wall = max((self.places[t][-1] for t in CLOSING if self.places[t]), default=-1)
                if self.places[tag] and self.places[tag][-1] > wall:
                    self.cut(self.places[tag][-1])
        hidden = bool(self.open and self.open[-1][1])
        box = self.open[-1][2] if self.open else 0
        exempt = tag in CONTENT or tag in PAGE or ("role", "main") in attrs
        looks = set() if exempt else {w for name, value in attrs if name in ("class", "id", "role") and value for w in furniture(value)}
        judged = tag in JUDGED and not exempt and (tag != "header" or not any(self.places[t] for t in CONTENT))
        if not hidden:
            hidden = tag in SKIPPED and tag not in JUDGED or bool(looks) and tag in INLINE or not exempt and any(name == "hidden" for name, _ in attrs)
        if tag not in INLINE and (tag not in ("p", "li") or looks):
            self.boxes.append(box)
            box = len(self.boxes) - 1
            if looks or judged:
                self.furniture[box] = ASIDE.isdisjoint(looks) and (tag == "form" or not judged)
            if tag in CONTENT or ("role", "main") in attrs:
                self.content.add(box)
                if tag != "article":
                    self.main.add(box)
            if tag == "h1":
                self.titles.add(box)
        self.places[tag].append(len(self.open))
        if tag not in INLINE and tag != "p":
            self.blocks.append(len(self.open))
        self.open.append((tag, hidden, box))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def cut(self, place: int) -> None:
        """Close all that is open from a place on."""
        while len(self.open) > place:
            self.places[self.open.pop()[0]].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        if self.places[tag] and (tag not in INLINE or not self.blocks or self.places[tag][-1] > self.blocks[-1]):
            self.cut(self.places[tag][-1])

    def handle_data(self, data):
        if not (self.open and self.open[-1][1]):
            self.text.append(data)

    def below(self, boxes) -> list[bool]:
        """Of every box, whether it is one of `boxes` or in one."""
        out = [False] * len(self.boxes)
        for b, parent in enumerate(self.boxes):
            out[b] = b in boxes or parent >= 0 and out[parent]
        return out

    def above(self, weight: list[int]) -> list[int]:
        """Sums of weights over every box and all in it."""
        out = list(weight)
        for b in range(len(out) - 1, 0, -1):
            out[self.boxes[b]] += out[b]
        return out

    def count(self, boxes) -> list[int]:
        out = [0] * len(self.boxes)
        for b in boxes:
            out[b] += 1
        return out


def smoothed(x: list[float], sigma: float) -> list[float]:
    """Gaussian smoothing; at the ends the weights that are left are scaled up."""
    reach = math.ceil(3 * sigma)
    weight = [math.exp(-((k / sigma) ** 2) / 2) for k in range(reach + 1)]
    out = []
    for i in range(len(x)):
        a, b = max(0, i - reach), min(len(x), i + reach + 1)
        out.append(sum(x[j] * weight[abs(j - i)] for j in range(a, b)) / sum(weight[abs(j - i)] for j in range(a, b)))
    return out


def threshold(x: list[float]) -> float:
    """The cut between two clusters: halfway between their means, repeated until it stays."""
    cut = sum(x) / len(x)
    for _ in range(50):
        low, high = [v for v in x if v < cut], [v for v in x if v >= cut]
        if not low:
            return cut
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def judge(p: Lines) -> tuple[set[int], bool]:
    """(boxes that look like furniture and are none, whether that was found only by article elements in them).

    They hold a main element, or over half of the text that isn't in menus, comments and the like; or, if no content element
    would show, an article.
    """
    never = p.below({b for b, may in p.furniture.items() if not may})
    size = [0] * len(p.boxes)
    for t, _, box in p.lines:
        size[box] += 0 if never[box] else len(t)
    weight, lines = p.above(size), p.above(p.count(box for _, _, box in p.lines))
    mains = p.above(p.count(b for b in p.main if lines[b]))
    lifted = {b for b in p.furniture if mains[b]} | {b for b, may in p.furniture.items() if may and 2 * weight[b] > weight[0]}
    off, content = p.below(p.furniture.keys() - lifted), p.below(p.content)
    if any(content[box] and not off[box] for _, _, box in p.lines):
        return lifted, False
    held = p.above(p.count(b for b in p.content if lines[b] and not never[b]))
    inner = {b for b in p.furniture if held[b]}
    return lifted | inner, not inner <= lifted


def main_text(html: str, sigma: float = 1.0) -> str:
    """The content blocks of a page, joined by an empty line.

    Furniture (menus, forms, adverts and so on, by element, class, id or role) is left out, unless judge() finds the page itself
    in it. The smoothed text-to-tag ratios of the other lines are cut into two clusters. The region is all article and main
    elements, or else the smallest box that holds all lines of the upper cluster and the h1. All lines of the region are its
    text, short ones too. Any text is a page: what is no markup is content, and declarations without a rule are comments.
    """
    p = Lines()
    p.read(html)
    lifted, wide = judge(p) if p.furniture else (set(), False)
    off = p.below(p.furniture.keys() - lifted)
    lines, more = [], 0
    for t, n, box in p.lines:  # tags of furniture count for the line after it
        if off[box]:
            more += n
        else:
            lines.append((t, n + more, box))
            more = 0
    if not lines:
        return ""
    inside = p.below(p.content)
    if wide or not any(inside[box] for _, _, box in lines):
        ratio = smoothed([len(t) / max(1, n) for t, n, _ in lines], sigma)
        cut = threshold(ratio)
        chosen = [box for (_, _, box), r in zip(lines, ratio) if r >= cut or box in p.titles]
        held = p.above(p.count(chosen))
        inside = p.below({max(b for b, n in enumerate(held) if n == len(chosen))})
    return "\n\n".join(t for t, _, box in lines if inside[box])


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row; a null or empty page has empty text, null ids and urls stay.

    Repeated rows come back repeated; other columns are dropped; an empty table gives an empty table. See main_text().
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        for b in batches:
            found = [main_text(h) if h else "" for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
