"""Main text of web pages by classified flat text blocks.

A page is read as a flat list of text blocks, cut at the tags of block elements.  Each block knows its words, its
share of words inside links, the same of the blocks before and after it, and its context: the innermost
ancestor that says what it holds (``article`` and the like: main; menus, footers, forms, adverts and the like:
boilerplate; none: open).  A decision tree, trained on the small labelled table below, tells main text from
the rest.  The text of scripts, styles and other elements that are not shown is no block at all.

Defined results: null and empty pages have no text; white space is one space, blocks are trimmed and empty ones
dropped; a line break is white space; unclosed and stray tags are read as browsers would, near enough;
repeated rows come out as often as they went in; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from sparkwalk.llm.common import map_batches, texts

# Elements by what they do to the flow of text.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg math iframe object canvas select textarea button head title audio video map datalist".split())
MAIN = {"article", "main"}
BOILER = set("nav footer aside form dialog menu".split())
ROWS, LISTS = frozenset(("li", "dt", "dd", "tr", "td", "th")), frozenset(("ul", "ol", "menu", "dl", "table"))
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Whole names in a class, id or role.  Hyphens, underscores and capitals part a name into words; one of several words says
# boilerplate if all of them do, but for words that say whose (before) or what kind of box (after): user-comments, AdBox.
MAIN_NAMES = set("article main content post entry story prose".split())
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside rail footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert "
    "warning popup modal overlay paywall subscribe subscription newsletter signup login share sharing social related recommended "
    "recommendations trending widget comment comments commentlist respond reply replies discussion disqus pagination pager form search "
    "tags contentinfo complementary skip copyright legal disclaimer hidden announcement announcements dialog alertdialog menubar register".split()
)
ADVERTS = set("ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion".split())
WHOSE = set("site page main top bottom left right primary secondary global mobile user users reader readers visitor post article entry content".split())
BOXES = set("box bar area block list section wrapper wrap container inner outer panel pane content item items link links button buttons icons header title text thread body posts articles stories tools unit slot group".split())
#: A wrapper that also has one of these names may be the layout of the whole page: an article in it is main text all the same.
LAYOUT = set("layout wrapper wrap page site container grid row columns app".split())

# Labelled blocks, page by page in order: context (m main, b boilerplate, o open), words, of these in links, main text or not.
LABELLED = """
b 3 3 n/b 1 1 n/m 7 0 y/m 85 2 y/m 3 0 y/m 60 0 y/m 1 0 y/b 9 0 n/b 6 2 n
b 12 0 n/m 4 0 y/m 1 0 y/m 140 6 y/m 9 9 y/m 2 0 y/b 40 3 n/b 25 0 n/b 8 4 n
o 1 1 n/o 1 1 n/o 2 2 n/o 6 0 y/o 70 1 y/o 55 0 y/o 12 0 y/o 90 4 y/o 5 5 n/o 4 3 n/o 7 0 n
o 2 2 n/o 3 3 n/o 8 0 y/o 120 0 y/o 33 2 y/o 3 0 y/o 47 0 y/b 30 0 n/b 18 0 n/o 5 4 n
b 60 0 n/b 1 1 n/b 80 4 n/o 9 0 y/o 66 0 y/o 41 3 y/b 5 0 n/b 22 0 n/o 3 0 n
o 4 4 n/o 20 18 n/o 15 12 n/o 11 11 n/o 2 2 n
m 2 0 y/m 11 0 y/b 14 0 n/m 52 0 y/b 3 3 n/m 6 0 y/m 75 75 y/b 100 2 n
o 5 0 y/o 38 0 y/o 29 1 y/o 2 0 n/o 3 3 n/o 2 2 n
b 2 0 n/b 4 0 n/m 1 0 y/b 200 0 n/b 1 0 n/m 16 0 y/m 14 0 y/m 22 1 y/b 12 0 n
o 10 9 n/o 7 0 y/o 150 10 y/o 64 3 y/o 6 6 n/o 9 7 n/o 4 0 n
o 2 2 n/o 3 3 n/o 90 0 y/o 130 2 y/o 2 2 n/o 1 1 n/o 88 1 y/o 3 3 n
o 1 1 n/o 4 0 y/o 18 0 y/o 14 0 y/o 9 0 y/o 22 1 y/o 13 0 y/o 17 0 y/o 2 2 n
o 6 6 n/o 12 12 n/o 200 3 y/o 24 0 y/o 19 1 y/o 11 0 y/o 25 20 n/o 60 55 n
b 110 0 n/m 100 0 y/m 5 5 y/m 3 3 y/m 8 0 y/b 70 0 n/b 90 10 n/m 20 0 y/b 150 1 n
b 5 5 n/m 6 0 y/m 72 1 y/m 33 0 y
b 9 1 n/m 58 0 y/m 2 0 y
o 3 3 n/o 7 0 y/o 61 2 y/o 48 0 y
o 95 0 y
o 5 0 y
o 14 0 y
o 3 0 y
m 6 6 y/m 8 0 y
b 3 3 n/m 30 29 y/m 2 0 y
b 12 12 n/m 40 0 y
b 7 7 n/m 1 0 y
m 9 8 y/m 2 0 y/b 2 2 n
o 5 0 y/o 28 0 y
m 4 0 y
o 2 2 n/o 31 0 y/o 7 0 y
m 1 1 y/m 40 40 y/b 44 0 n/b 31 31 n/b 64 2 n/o 30 0 y/o 45 1 y/o 7 7 n
"""

SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def says_boilerplate(words: tuple[str, ...]) -> bool:
    """Whether a name, as its words in lower case, names boilerplate."""
    at = [i for i, w in enumerate(words) if w in BOILER_NAMES]
    return bool(at) and all(
        w in BOILER_NAMES or (w in WHOSE if i < at[0] else w in BOXES) for i, w in enumerate(words)
    )


@dataclass
class Block:
    text: str
    words: int
    linked: int
    context: int  # 1 main, -1 boilerplate, 0 open


def unseen(given: dict[str, str | None]) -> bool:
    return "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "")


class Blocks(HTMLParser):
    """Reads a page into flat blocks; with ``adverts`` those inside a line are kept."""

    def __init__(self, adverts: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.adverts = adverts
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, bool]] = []  # elements, their context, whether they hide their text
        self.firm: dict[int, int] = {}  # of boilerplate elements by depth: 0 any article reopens it, 1 only main does, 2 none
        self.hidden = 0  # how many elements that are not shown are open
        self.links = 0
        self.parts: list[str] = []
        self.linked: list[str] = []

    def context(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(text, len(text.split()), len("".join(self.linked).split()), self.context()))
        self.parts, self.linked = [], []

    def firmness(self) -> int:
        """How firmly the open elements, as far as the innermost main text, say boilerplate."""
        main = max((i for i, e in enumerate(self.open) if e[1] == 1), default=-1)
        return max((f for depth, f in self.firm.items() if main < depth < len(self.open)), default=2)

    def told(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """Context of a new element: by its tag and names, else that of its parent."""
        given, now = dict(attrs), self.context()
        self.firm = {d: f for d, f in self.firm.items() if d < len(self.open)}
        if unseen(given) or tag in BOILER or tag == "header" and now != 1:
            self.firm[len(self.open)] = 2
            return -1
        if tag in HEADINGS and now != 0 or tag == "p" and now == 1:  # their names are anchors and looks
            return now
        whole = [
            n for a in ("class", "id", "role") if tag not in ("html", "body") and not (a == "id" and tag in HEADINGS)
            for n in (given.get(a) or "").split()
        ]
        names = [tuple(w.lower() for w in NAMES.findall(n)) for n in whole]
        words = {w for n in names for w in n}
        header = "header" in words and not words & MAIN_NAMES and now != 1
        if tag != "main" and (header or any(map(says_boilerplate, names))):
            self.firm[len(self.open)] = 0 if {n.lower() for n in whole} & LAYOUT and not header else 1
            return -1
        if tag in MAIN and (now != -1 or self.firmness() < (2 if tag == "main" else 1)):
            return 1
        return 1 if words & MAIN_NAMES and now != -1 else now

    def handle_starttag(self, tag, attrs) -> None:
        if tag in HIDDEN:
            if tag != "head":  # its end is often left out, and only its title and scripts hold text
                self.hidden += 1
                self.open.append((tag, self.context(), True))
            return
        if tag == "br":
            self.parts.append(" ")
            self.linked.append(" ")
        if tag == "a":
            self.links = 1
        if tag in INLINE and tag != "a" and self.context() != -1 and self.left_out(dict(attrs)):
            self.hidden += 1  # an advert inside a line: left out, and the line goes on
            self.open.append((tag, self.context(), True))
        if tag in INLINE or tag in VOID and tag != "hr":
            return
        self.flush()
        if self.open and self.open[-1][0] == "p":  # a paragraph holds no other blocks
            self.open.pop()
        if tag in ROWS:
            self.shut(tag, LISTS)
        if tag not in VOID:
            self.open.append((tag, self.told(tag, attrs), False))

    def left_out(self, given: dict[str, str | None]) -> bool:
        """Whether an element inside a line is not shown, or an advert; other names there only tell its looks."""
        names = [tuple(w.lower() for w in NAMES.findall(n)) for a in ("class", "id", "role") for n in (given.get(a) or "").split()]
        return unseen(given) or not self.adverts and any(says_boilerplate(n) and ADVERTS & {*n} for n in names)

    def shut(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        """Close the innermost open ``tag`` and all in it, unless an element of ``within`` lies between."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.hidden -= sum(hides for *_, hides in self.open[i:])
                del self.open[i:]
                return
            if name in within:
                return

    def handle_endtag(self, tag) -> None:
        if tag == "a":
            self.links = 0
        if tag in INLINE:
            if self.open and self.open[-1][0] == tag:
                self.shut(tag)
            return
        if tag in HIDDEN:
            if any(n == tag for n, *_ in self.open):
                self.shut(tag)
            return
        if tag == "br":
            self.parts.append(" ")
            return
        self.flush()
        if tag != "p" or self.open and self.open[-1][0] == "p":
            self.shut(tag)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.handle_endtag(tag)

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.parts.append(data)
            self.linked.append(data if self.links else " " if data[:1].isspace() else "")


def blocks(html: str | None, adverts: bool = False) -> list[Block]:
    if not html:
        return []
    reader = Blocks(adverts)
    reader.feed(html)
    reader.close()
    reader.flush()
    return reader.blocks


def features(page: list[Block]) -> list[tuple[float, ...]]:
    """Context, words and link share of each block, and words and link share of its neighbours."""
    own = [(b.words, b.linked / b.words if b.words else 0.0) for b in page]
    around = [(0, 0.0), *own, (0, 0.0)]
    return [(b.context, *around[i + 1], *around[i], *around[i + 2]) for i, b in enumerate(page)]


def grow(rows: list[tuple[tuple[float, ...], bool]], depth: int = 6):
    """A decision tree by least Gini impurity: (feature, cutoff, at most, above) or the share of main text."""
    share = sum(y for _, y in rows) / len(rows)
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = None
    for f in range(len(rows[0][0])):
        values = sorted({x[f] for x, _ in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            left, right = [y for x, y in rows if x[f] <= cut], [y for x, y in rows if x[f] > cut]
            gini = sum(2 * sum(s) * (1 - sum(s) / len(s)) for s in (left, right))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut)
    if best is None:
        return share
    _, f, cut = best
    return f, cut, grow([r for r in rows if r[0][f] <= cut], depth - 1), grow([r for r in rows if r[0][f] > cut], depth - 1)


@functools.cache
def classifier():
    """The tree trained on the labelled table."""
    rows = []
    for line in LABELLED.strip().splitlines():
        told = [b.split() for b in line.split("/")]
        page = [Block("", int(w), int(a), {"m": 1, "b": -1, "o": 0}[c]) for c, w, a, _ in told]
        rows += zip(features(page), [y == "y" for *_, y in told])
    return grow(rows)


def is_main(x: tuple[float, ...], tree) -> bool:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree >= 0.5


def main_text(html: str | None, tree) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, x in zip(page, features(page)) if is_main(x, tree))


class Shown(HTMLParser):
    """Reads all shown text of a page, block by block, and keeps nothing else.

    Open elements are kept with their attributes; what a page's names say about them is asked, of ``Blocks``, only
    where an element inside a line is not shown.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.open: list[tuple[str, list, bool]] = []
        self.hidden = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(text)
            self.parts = []

    def boilerplate(self) -> bool:
        reader = Blocks()
        for tag, attrs, hides in self.open:
            reader.open.append((tag, reader.context() if hides else reader.told(tag, attrs), hides))
        return reader.context() == -1

    def handle_starttag(self, tag, attrs) -> None:
        if tag in INLINE:
            if attrs and tag != "a" and unseen(dict(attrs)) and not self.boilerplate():
                self.hidden += 1
                self.open.append((tag, attrs, True))
        elif tag in HIDDEN:
            if tag != "head":
                self.hidden += 1
                self.open.append((tag, attrs, True))
        elif tag in VOID and tag != "hr":
            if tag == "br":
                self.parts.append(" ")
        else:
            self.flush()
            if self.open and self.open[-1][0] == "p":
                self.open.pop()
            if tag in ROWS:
                self.shut(tag, LISTS)
            if tag not in VOID:
                self.open.append((tag, attrs, False))

    def shut(self, tag: str, within: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                self.hidden -= sum(hides for *_, hides in self.open[i:])
                del self.open[i:]
                return
            if name in within:
                return

    def handle_endtag(self, tag) -> None:
        if tag in INLINE:
            if self.open and self.open[-1][0] == tag:
                self.shut(tag)
        elif tag in HIDDEN:
            self.shut(tag)
        elif tag == "br":
            self.parts.append(" ")
        else:
            self.flush()
            if tag != "p" or self.open and self.open[-1][0] == "p":
                self.shut(tag)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN:
            self.handle_endtag(tag)

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.parts.append(data)


def plain_text(html: str | None) -> str:
    """All shown text, main or not."""
    if not html:
        return ""
    reader = Shown()
    reader.feed(html)
    reader.close()
    reader.flush()
    return "\n".join(reader.lines)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(key, url, text) of every page."""
    tree = classifier()

    def run(batch):
        found = [main_text(h, tree) for h in texts(batch, "html")]
        return {"key": batch.column("key"), "url": batch.column("url"), "text": found}

    keyed = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    out = map_batches(keyed, run, {"key": "long", "url": "string", "text": "string"})
    return out.toDF(key, url, "text")
