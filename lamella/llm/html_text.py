"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks: the text between two boundaries of block elements.
A classifier (:mod:`lamella.llm.html_training`) turns what is known of a block,
its wording, its elements and how much of the page's prose stands around it, into
the log odds of content against boilerplate; these are the capacities of its edges
to the two terminals. Blocks that follow each other, and blocks next to each other
in one parent, have smoothness edges, the stronger the closer they are in the
document tree. The minimum cut gives the labels with the least total cost.

A block whose preference outweighs all its smoothness edges keeps its label in
some minimum cut, so only the others go through the max-flow.

Every step is linear in the page: an element knows its nearest block, its open
paragraph, list item and table cell, and end tags without an open element are
told by a count of the open names.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict, deque
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end a block (fixed values).
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead title tr ul".split()
)
#: Elements without an end tag (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is read up to their end tag and is no text of the page (fixed values).
RAW = frozenset("script style noscript iframe textarea title xmp noframes".split())
#: Elements of other languages, which may close themselves (fixed values).
FOREIGN = frozenset("svg math".split())
#: Elements whose content is no text of the page, but elements like any other (fixed values).
UNSEEN = frozenset("svg math object template audio video canvas".split())
#: Start tags that end an open foreign element (fixed values).
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre s small span strong sub sup table tt u ul var article section aside nav main header footer form a".split())
#: Elements beyond which a block start does not end an open paragraph (fixed values).
PARAGRAPH_ENDS = frozenset("table button td th object".split())
#: A start tag ends an open element of its group; some elements begin a new scope of groups (fixed values).
GROUP = {"li": 0, "dt": 1, "dd": 1, "tr": 2, "td": 3, "th": 3, "option": 4}
SCOPE = {"ul": (0,), "ol": (0,), "menu": (0,), "dl": (1,), "table": (2, 3), "select": (4,)}

#: Words of class, id, role and label that the classifier counts: some usual for boilerplate, some for main text (fixed values).
USUAL_OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail widget widgets comment comments reply replies respond disqus footer foot header masthead topbar share sharing social subscribe newsletter signup login search searchbox related recommended recommendations pagination pager copyright legal disclaimer toolbar complementary contentinfo form".split()
)
USUAL_INSIDE = frozenset("article content main body post entry story text paragraph".split())

#: What an element says about all that it holds, a bit each.
KINDS = ("nav", "footer", "aside", "form", "header", "head_of_article", "article", "main", "dialog", "head", "outside", "part_outside", "both", "inside", "part_inside", "cell", "item")
BIT = {name: 1 << i for i, name in enumerate(KINDS)}
OF_NAME = {
    "nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "select": "form", "option": "form", "label": "form", "fieldset": "form", "dialog": "dialog",
    "header": "header", "article": "article", "main": "main", "head": "head", "td": "cell", "th": "cell", "li": "item",
}
#: Words of a block from which on it counts as prose.
PROSE = 8

TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:@-][\w:.-]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
WORD = re.compile(r"[a-z]+")
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Element:
    """An open element. holder: nearest block element, itself included. paragraph: the paragraph that a block start ends. ends: the open element of each group. marked: nearest element whose names are usual outside."""

    __slots__ = ("name", "parent", "depth", "holder", "paragraph", "ends", "kinds", "hidden", "link", "foreign", "marked", "prose")

    def __init__(self, name: str, parent: Element | None):
        self.name, self.parent, self.prose = name, parent, 0
        if parent is None:
            self.depth, self.holder, self.paragraph, self.ends, self.kinds = 0, self, None, (None,) * 5, 0
            self.hidden, self.link, self.foreign, self.marked = False, False, None, None
            return
        self.depth, self.kinds, self.marked = parent.depth + 1, parent.kinds, parent.marked
        self.holder = self if name in BLOCK else parent.holder
        self.paragraph = self if name == "p" else None if name in PARAGRAPH_ENDS else parent.paragraph
        self.ends = parent.ends
        if name in GROUP or name in SCOPE:
            ends = list(parent.ends)
            for i in SCOPE.get(name, ()):
                ends[i] = None
            if name in GROUP:
                ends[GROUP[name]] = self
                if name == "tr":
                    ends[3] = None
            self.ends = tuple(ends)
        self.hidden = parent.hidden or name in UNSEEN
        self.link = parent.link or name == "a"
        self.foreign = self if name in FOREIGN and parent.foreign is None else parent.foreign
        kind = OF_NAME.get(name)
        if kind:
            self.kinds |= BIT["head_of_article" if kind == "header" and self.kinds & BIT["article"] else kind]

    def read(self, attributes: str) -> None:
        """What the attributes say about the content."""
        said: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role", "aria-label"):
                said.update(value.split())
            elif key == "hidden" or key == "style" and UNSHOWN.search(value) or key == "aria-hidden" and value == "true":
                self.hidden = True
        if not said or self.name in ("body", "html"):
            return
        parts = {p for name in said for p in WORD.findall(name)}
        outside, inside = parts & USUAL_OUTSIDE, parts & USUAL_INSIDE
        if said & USUAL_OUTSIDE:
            self.kinds |= BIT["outside"]
        elif outside:
            self.kinds |= BIT["both" if inside else "part_outside"]
        if said & USUAL_INSIDE:
            self.kinds |= BIT["inside"]
        elif inside:
            self.kinds |= BIT["part_inside"]
        if outside:
            self.marked = self


@dataclass
class Block:
    element: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    size: int = 0

    @property
    def text(self) -> str:
        return " ".join(html.unescape("".join(self.pieces)).split())


def blocks_of(page: str) -> tuple[list[Block], list[Element]]:
    """The blocks with text, in page order, and the elements whose names are usual outside, parents first."""
    root = now = Element("#root", None)
    out: list[Block] = []
    marked: list[Element] = []
    block: Block | None = None
    opened: Counter[str] = Counter()
    last_end: dict[str, int] = {}
    place = 0

    def leave(to: Element) -> None:
        """Close all up to ``to`` and it."""
        nonlocal now
        while True:
            at, now = now, now.parent
            opened[at.name] -= 1
            if at is to:
                return

    def say(text: str) -> None:
        nonlocal block
        if block is None:
            if not text or text.isspace():
                return
            block = Block(now if now.hidden else now.holder)
            out.append(block)
        block.pieces.append(text)
        n = len(text.strip())
        block.size += n
        block.linked += n if now.link else 0

    while place < len(page):
        m = TOKEN.search(page, place)
        if not m:
            say(page[place:])
            break
        say(page[place : m.start()])
        place = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK or name in UNSEEN:
                block = None
            elif name in ("td", "th") and block:
                say(" ")
            if opened[name] > 0:
                at = now
                while at.name != name:
                    at = at.parent
                leave(at)
            continue
        attributes = m[3] or m[6] or ""
        if now.foreign is not None:
            if name in BREAKS_OUT:
                leave(now.foreign)
            elif attributes.endswith("/"):
                continue
        if name in BLOCK or name in UNSEEN:
            block = None
        if name in BLOCK and now.paragraph is not None:
            leave(now.paragraph)
        if name in GROUP and (at := now.ends[GROUP[name]] or (now.ends[3] if name == "tr" else None)) is not None:
            leave(at)
        if block and (name == "br" or name in ("td", "th")):
            say(" ")
        if name in VOID or name in FOREIGN and attributes.endswith("/"):
            continue
        if name in UNSEEN and name not in FOREIGN:
            if name not in last_end:
                last_end[name] = max((x.start() for x in re.finditer(f"</{name}", page, re.I)), default=-1)
            if last_end[name] < place:
                continue  # it never ends: what follows is text of the page
        if name in RAW and now.foreign is None:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I).search(page, place)
            place = end.end() if end else len(page)
            continue
        now = Element(name, now)
        opened[name] += 1
        if attributes and not attributes.isspace():
            now.read(attributes)
            if now.marked is now:
                marked.append(now)
    return out, marked


#: Names of the columns of :func:`features`.
FEATURES = (
    "one", "log_words", "link_density", "short_links", "sentence", "paragraph", "heading", *KINDS, "outside_share", "part_outside_share", "both_share", "copyright", "commas", "siblings", "capitals", "digits", "prose"
)


def features(found: list[tuple[Block, str]], marked: list[Element]) -> np.ndarray:
    """A row of FEATURES for each block.

    The share of a marked element, or of a block's parent, is that of the page's
    prose which it holds: words of blocks of PROSE words at least, half of them in
    links at most.
    """
    words = [t.count(" ") + 1 for _, t in found]
    density = [b.linked / max(1, b.size) for b, _ in found]
    prose = [w if w >= PROSE and d <= 0.5 and not b.element.hidden else 0 for w, d, (b, _) in zip(words, density, found, strict=True)]
    total = max(1, sum(prose))
    siblings: dict[int, int] = defaultdict(int)
    for (b, _), n in zip(found, prose, strict=True):
        siblings[id(b.element.parent)] += n
        if b.element.marked is not None:
            b.element.marked.prose += n
    for x in reversed(marked):
        if x.parent.marked is not None:
            x.parent.marked.prose += x.prose
    out = np.zeros((len(found), len(FEATURES)))
    column = {name: i for i, name in enumerate(FEATURES)}
    first = column[KINDS[0]]
    for i, (b, t) in enumerate(found):
        e, n = b.element, words[i]
        share = e.marked.prose / total if e.marked is not None else 0.0
        row = out[i]
        for j in range(len(KINDS)):
            row[first + j] = e.kinds >> j & 1
        for name in ("outside", "part_outside", "both"):
            row[column[name + "_share"]] = share if e.kinds & BIT[name] else 0.0
        row[: column["heading"] + 1] = (
            1.0, min(1.5, math.log(n) / 3), density[i], density[i] if n < PROSE else 0.0, n > 4 and t[-1] in ".!?:;\"”»…", e.name in ("p", "blockquote", "pre", "figcaption", "dd"), len(e.name) == 2 and e.name[0] == "h" and e.name[1].isdigit()
        )
        row[column["copyright"]] = t.startswith(("©", "(c) ", "Copyright"))
        row[column["commas"]] = min(1.0, 5 * (t.count(",") + t.count(". ")) / n)
        row[column["siblings"]] = siblings[id(e.parent)] / total
        some = t[:400]
        row[column["capitals"]] = sum(map(str.isupper, some)) / len(some)
        row[column["digits"]] = sum(map(str.isdigit, some)) / len(some)
        row[column["prose"]] = prose[i] / total
    return out


def closeness(a: Element, b: Element, strength: float) -> float:
    """Weight of the edge between two blocks: less the more tree edges lie between them."""
    steps = 0
    x: Element | None = a
    y: Element | None = b
    while x is not y:
        if x is None or (y is not None and y.depth > x.depth):
            y = y.parent if y else None
        else:
            x = x.parent
        steps += 1
    return strength / (1 + steps)


def minimum_cut(lean: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the sum of -lean over content blocks and the weights of cut edges.

    Ties give boilerplate. Dinic's algorithm from the content to the boilerplate terminal.
    """
    n = len(lean)
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i, j, w in edges:
        around[i].append((j, w))
        around[j].append((i, w))
    lean, label = list(lean), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None:
            continue
        free = sum(w for j, w in around[i] if label[j] is None)
        if abs(lean[i]) > free or not free:
            label[i] = lean[i] > 0
            for j, w in around[i]:
                if label[j] is None:
                    lean[j] += w if label[i] else -w
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if not rest:
        return label
    number = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def edge(a: int, b: int, forward: float, backward: float) -> None:
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(backward)

    for i in rest:
        if lean[i] > 0:
            edge(source, number[i], lean[i], 0.0)
        elif lean[i] < 0:
            edge(number[i], sink, -lean[i], 0.0)
    for i, j, w in edges:
        if i in number and j in number:
            edge(number[i], number[j], w, w)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        at = [0] * len(out)
        while True:  # one augmenting path after another in the level graph, without recursion
            path, a = [], source
            while a != sink:
                while at[a] < len(out[a]):
                    e = out[a][at[a]]
                    if cap[e] > 1e-12 and level[to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(out[a]):
                    path.append(out[a][at[a]])
                    a = to[path[-1]]
                elif path:
                    a = to[path.pop() ^ 1]
                    at[a] += 1
                else:
                    break
            if a != sink:
                break
            most = min(cap[e] for e in path)
            for e in path:
                cap[e] -= most
                cap[e ^ 1] += most
    for i in rest:
        label[i] = level[number[i]] >= 0
    return label


@dataclass(frozen=True)
class MinCut:
    """weights: of FEATURES, the classifier. adjacent, sibling: strengths of the smoothness edges between blocks that follow each other, in the page and in their parent."""

    weights: tuple[float, ...]
    adjacent: float = 2.4
    sibling: float = 1.5

    def text(self, page: str | None) -> str:
        """The main text: content blocks in page order, joined by line feeds. Null or empty: empty."""
        if not page:
            return ""
        blocks, marked = blocks_of(page)
        found = [(b, t) for b in blocks if (t := b.text)]
        odds = np.clip(features(found, marked) @ np.array(self.weights), -12, 12).tolist()
        lean = [-30.0 if b.element.hidden else x for (b, _), x in zip(found, odds, strict=True)]
        edges, last = [], {}
        for i, (b, _) in enumerate(found):
            if i:
                edges.append((i - 1, i, closeness(found[i - 1][0].element, b.element, self.adjacent)))
            parent = id(b.element.parent)
            if parent in last and last[parent] != i - 1:
                edges.append((last[parent], i, self.sibling / 3))
            last[parent] = i
        return "\n".join(t for (_, t), keep in zip(found, minimum_cut(lean, edges), strict=True) if keep)


def main_texts(pages: DataFrame, cut: MinCut | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Null html counts as empty; a page without main text has an empty text. Pages
    that repeat an id each get a row; other columns are ignored; an empty table
    gives no rows. One page at a time is parsed, in time and memory linear in its
    length, however deep it nests.
    """
    from lamella.llm.html_training import trained

    cut = cut or MinCut(trained())

    def run(batches):
        for batch in batches:
            texts = [cut.text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
