"""Main text of web pages by wrapper induction.

Pages of one host are aligned by simple tree matching of their DOM trees. Slots
that say the same on nearly all pages are template, the others vary. The region
of the content is the part of the wrapper that holds most of the varying text,
summed over all pages. Inside it everything that varies is content. What tags
and names say counts as a doubt: a doubted part weighs less, and goes unless it
holds most of the text itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from itertools import groupby
from math import isqrt
from string import ascii_letters

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from quillframe.llm.url_rules import url_host
from quillframe.scratch import written

#: Distinct pages of a host that are aligned together, and their bytes, about.
GROUP_PAGES, GROUP_BYTES = 32, 8 << 20
#: Bytes never split a host into groups of fewer distinct pages than this, on average.
LEAST_PAGES = 10
#: A page whose copies on a host have more bytes together is taken once.
COPIES_BYTES = GROUP_BYTES // GROUP_PAGES
#: A node is template if it has one text on this share of at least so many pages.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.9, 5
#: Numbers of pairs of shapes are kept from page to page up to so many.
MEMORY_PAIRS = 200_000
#: Rows of a table that are longer are computed by numpy.
LONG_ROW = 32
#: Lists of large hosts and copied pages are sent to every task up to this size.
SHARED_BYTES = 8 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead title tr ul".split())
#: Elements whose text isn't shown as text.
UNSEEN = frozenset(
    "applet audio button canvas embed head iframe input map math noscript object script select style svg template "
    "textarea title video".split())
#: Elements that the content can lie in as a part among others.
CONTAINERS = frozenset("#page html body div section article main form center table tbody tr td fieldset details dl".split())
#: Marks of parts that mostly aren't content.
DOUBTED = frozenset("aside dialog footer form header menu nav".split())
DOUBTED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
DOUBTED_NAMES = frozenset(
    "ad ads adsense advert advertisement advertisements adverts banner breadcrumb breadcrumbs consent "
    "cookie cookies copyright footer gdpr login masthead menu menus modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promos promotion related recommended "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget "
    "widgets".split())
#: Marks of what readers write.
READER_NAMES = frozenset("comment comments discussion disqus replies reply respond".split())
#: First words that leave a compound name's meaning to its last word.
PLACES = frozenset("bottom cookie global left main page reader right site social top user".split())
#: A doubted part weighs so much, and a link's text.
DOUBT, LINK = 0.1, 0.25
#: The share of a part that holds most of it.
MAJORITY = 0.5
#: Less is enough for the largest part if it is marked as the article.
MARKED = 0.25
#: A form with more characters is not just its controls.
FORM_CHARS = 400
#: What an opening tag closes when it is still open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"},
}
SCOPES = frozenset("ul ol dl table select body html article section div main".split())
ENDS_P = BLOCKS - {"body", "html", "option", "title", "caption", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "summary"}


class Node:
    __slots__ = ("tag", "names", "role", "hidden", "parts", "number", "shape", "size", "titled", "marked", "chars", "said", "unseen", "doubted", "readers")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]] = ()):
        self.tag, self.parts = tag, []
        self.names, self.role, self.hidden = "", "", False
        for key, value in attributes:
            if key in ("class", "id"):
                self.names += " " + (value or "").lower()
            elif key == "role":
                self.role = (value or "").strip().lower()
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                self.hidden = True
            elif key == "style" and value and "display:none" in value.replace(" ", "").lower():
                self.hidden = True

    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def is_main(self) -> bool:
        return self.tag in ("article", "main") or self.role in ("article", "main")

    def named(self, names: frozenset) -> bool:
        """Whether a whole name is among these, or a compound of a place and one of them."""
        for name in self.names.split():
            first, _, last = name.replace("_", "-").partition("-")
            if name in names or first in PLACES and last in names:
                return True
        return False

    def is_doubted(self) -> bool:
        if self.tag == "header" and self.titled or self.tag == "form" and self.chars > FORM_CHARS:
            return False
        if self.tag in DOUBTED or self.role in DOUBTED_ROLES:
            return True
        return bool(self.names) and self.tag not in ("html", "body") and self.named(DOUBTED_NAMES)

    def text(self) -> str:
        """The node's own text, without that of its children."""
        return " ".join("".join(p for p in self.parts if isinstance(p, str)).split())


class _Builder(HTMLParser):
    """Builds a tree from tags, closing what the markup leaves open.

    Places in the stack are kept by tag, so that a tag finds what it closes at
    any depth at once.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#page")
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in CLOSES:
            self._close_open(CLOSES[tag], SCOPES)
        if tag in ENDS_P:
            self._close_open(("p",), SCOPES)
        node = Node(tag, attrs)
        self.stack[-1].parts.append(node)
        if tag not in VOID:
            self.open.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCKS:
                self.blocks.append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "path") and self.stack[-1].tag == tag:
            self._close_from(len(self.stack) - 1)

    def handle_endtag(self, tag):
        place = self._last((tag,))
        # an inline element doesn't end a block
        if place and (tag in BLOCKS or not self.blocks or self.blocks[-1] < place):
            self._close_from(place)

    def handle_data(self, data):
        self.stack[-1].parts.append(data)

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags, or 0."""
        return max((places[-1] for tag in tags if (places := self.open.get(tag))), default=0)

    def _close_open(self, tags, scopes):
        place = self._last(tags)
        if place and place >= self._last(scopes):
            self._close_from(place)

    def _close_from(self, place):
        for node in reversed(self.stack[place:]):
            self.open[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
        del self.stack[place:]


def parse(html: str | None) -> Node:
    """The tree of a page; any text gives one."""
    html = (html or "").replace("\x00", "")
    tail = html.rfind("<")
    if tail > html.rfind(">") and html[tail + 1:tail + 2] in {"/", "!", *ascii_letters}:
        html = html[:tail]  # a tag that the page's end cuts off isn't text
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _measure(builder.root)
    return builder.root


def _inside_out(root: Node) -> list[Node]:
    """All nodes of a tree, children before their parents."""
    nodes = [root]
    for node in nodes:
        nodes += node.children()
    nodes.reverse()
    return nodes


def _measure(root: Node) -> None:
    for node in _inside_out(root):
        kids = node.children()
        node.shape = hash((node.tag, node.names, tuple(k.shape for k in kids)))
        node.size = 1 + sum(k.size for k in kids)
        node.titled = any(k.titled or k.tag in ("h1", "h2") for k in kids)
        node.marked = node.is_main() or any(k.marked for k in kids)
        node.said = node.text()
        node.unseen = node.hidden or node.tag in UNSEEN
        node.chars = 0 if node.unseen else len(node.said) + sum(k.chars for k in kids)
        node.readers = bool(node.names) and node.named(READER_NAMES) and not (node.marked and not node.is_main())
        node.doubted = node.is_doubted()


# Simple tree matching -----------------------------------------------------

def matched(a: Node, b: Node, memory: dict) -> int:
    """Largest number of node pairs of an alignment of two trees that keeps order and parents.

    ``memory`` has the numbers of all pairs of shapes met inside.
    """
    todo = [(a, b)]
    while todo:
        x, y = todo[-1]
        key = x.shape, y.shape
        if _known(x, y, memory) is not None:
            todo.pop()
            continue
        left, right = _unlike(x.children(), y.children())
        if key not in memory:
            memory[key] = None  # opened: what it needs comes first
            kinds = [{k.shape: k for k in kids}.values() for kids in (left, right)]
            needed = [(p, q) for p in kinds[0] for q in kinds[1] if _known(p, q, memory) is None]
            if needed:
                todo += needed
                continue
        alike = sum(k.size for k in x.children()[len(left):])
        memory[key] = 1 + alike + (_best(left, right, memory) if left and right else 0)
        todo.pop()
    return _known(a, b, memory)


def _known(a: Node, b: Node, memory: dict) -> int | None:
    if a.shape == b.shape:
        return a.size
    if a.tag != b.tag or a.names != b.names:
        return 0
    return memory.get((a.shape, b.shape))


def _unlike(left: list[Node], right: list[Node]) -> tuple[list[Node], list[Node]]:
    """Two lists without their equal ends; a best alignment pairs these."""
    n = 0
    while n < min(len(left), len(right)) and left[-1 - n].shape == right[-1 - n].shape:
        n += 1
    return left[:len(left) - n], right[:len(right) - n]


class _Table:
    """Rows of the dynamic program over two lists of siblings, one at a time.

    Cell j of row i is the best of the first i and the first j siblings.
    """

    def __init__(self, left: list[Node], right: list[Node], memory: dict):
        self.left, self.memory, self.weights = left, memory, {}
        self.kinds = {}
        self.places = [self.kinds.setdefault(y.shape, len(self.kinds)) for y in right]
        self.of_kind = list({y.shape: y for y in right}.values())
        self.long = len(right) > LONG_ROW
        if self.long:
            self.places = np.array(self.places)

    def first(self) -> list[int] | np.ndarray:
        return np.zeros(len(self.places) + 1, np.int64) if self.long else [0] * (len(self.places) + 1)

    def weight(self, i: int) -> list[int] | np.ndarray:
        """Numbers of pairs of sibling i of the left with each kind of the right."""
        x = self.left[i]
        if x.shape not in self.weights:
            own = [_known(x, y, self.memory) for y in self.of_kind]
            self.weights[x.shape] = np.array(own, np.int64) if self.long else own
        return self.weights[x.shape]

    def after(self, before: list[int] | np.ndarray, i: int) -> list[int] | np.ndarray:
        """Row i + 1 from row i."""
        weight = self.weight(i)
        if self.long:
            row = before.copy()
            np.maximum(row[1:], before[:-1] + weight[self.places], out=row[1:])
            return np.maximum.accumulate(row)
        row = [0]
        for j, kind in enumerate(self.places):
            row.append(max(before[j + 1], row[j], before[j] + weight[kind]))
        return row


def _best(left: list[Node], right: list[Node], memory: dict) -> int:
    table = _Table(left, right, memory)
    row = table.first()
    for i in range(len(left)):
        row = table.after(row, i)
    return int(row[-1])


def _pairs(left: list[Node], right: list[Node], memory: dict) -> Iterator[tuple[Node, Node]]:
    """The pairs of siblings of a best alignment, from the last.

    Of a table of n rows every one after sqrt(n) is kept, and those between are
    computed again on the way back.
    """
    every, others = left, right
    left, right = _unlike(left, right)
    yield from zip(every[len(left):], others[len(right):])
    if not left or not right:
        return
    table = _Table(left, right, memory)
    step = isqrt(len(left) - 1) + 1
    row, kept = table.first(), []
    for i in range(len(left)):
        if i % step == 0:
            kept.append(row)
        row = table.after(row, i)
    i, j = len(left), len(right)
    while i and j:
        start = (i - 1) // step * step
        rows = [kept[start // step]]
        for k in range(start, i):
            rows.append(table.after(rows[-1], k))
        while i > start and j:
            w = table.weight(i - 1)[table.places[j - 1]]
            own, above = rows[i - start], rows[i - 1 - start]
            if w and own[j] == above[j - 1] + w:
                i, j = i - 1, j - 1
                yield left[i], right[j]
            elif own[j] == above[j]:
                i -= 1
            else:
                j -= 1


def align(a: Node, b: Node, memory: dict | None = None) -> Iterator[tuple[Node, Node]]:
    """The pairs of nodes of a best alignment."""
    memory = {} if memory is None else memory
    todo = [(a, b)] if matched(a, b, memory) else []
    while todo:
        x, y = todo.pop()
        yield x, y
        left, right = x.children(), y.children()
        todo += zip(left, right) if x.shape == y.shape else _pairs(left, right, memory)


def template_nodes(pages: list[Node]) -> set[int]:
    """ids of nodes that are template: their text is the same on nearly all pages."""
    return set().union(*(template for template, *_ in _wrapped(pages)))


def _wrapper_of(sizes: list[int]) -> int:
    """The page of middle size is the wrapper to which the others are aligned."""
    return sorted(range(len(sizes)), key=sizes.__getitem__)[len(sizes) // 2]


def _aligned(page: Node, wrapper: Node, memory: dict) -> list[tuple[Node, Node]]:
    if len(memory) > MEMORY_PAIRS:
        memory.clear()
    return list(align(page, wrapper, memory))


def _said(pairs: Iterable[tuple[Node, Node]]) -> list[tuple[int, int, str]]:
    """(id of a node of the page, id of its slot in the wrapper, text) of nodes with a text."""
    return [(id(own), id(slot), own.said) for own, slot in pairs if own.said]


def _constant(aligned: Iterable[list[tuple[int, int, str]]], pages: int) -> dict[int, str]:
    """The slots that have one text on nearly all pages, with it."""
    texts: dict[int, Counter] = {}
    for said in aligned:
        for _, slot, text in said:
            texts.setdefault(slot, Counter())[text] += 1
    common = ((slot, *counts.most_common(1)[0]) for slot, counts in texts.items())
    return {slot: text for slot, text, times in common if times >= TEMPLATE_SHARE * pages}


def _constant_nodes(said: list[tuple[int, int, str]], constant: dict[int, str]) -> set[int]:
    return {own for own, slot, text in said if constant.get(slot) == text}


# Regions ------------------------------------------------------------------

class Weights:
    """Varying text of every part of a page, in characters.

    ``own`` is a node's own text, ``all`` that of its whole part, and ``sure``
    the same with doubted parts weighing less. What readers write has no weight.
    """

    def __init__(self, page: Node, template: set[int]):
        self.own: dict[int, float] = {}
        self.all: dict[int, float] = {}
        self.sure: dict[int, float] = {}
        nodes = [(page, False)]
        for node, link in nodes:
            here = link or node.tag == "a"
            size = 0 if node.unseen or id(node) in template else len(node.said)
            self.own[id(node)] = size * (LINK if here else 1)
            if not node.unseen:
                nodes += [(k, here) for k in node.parts if k.__class__ is Node]
        for node, _ in reversed(nodes):
            every = sure = self.own[id(node)]
            if not node.unseen:
                for k in node.parts:
                    if k.__class__ is Node and not k.readers:
                        every += self.all[id(k)]
                        sure += self.sure[id(k)] * (DOUBT if k.doubted else 1)
            self.all[id(node)], self.sure[id(node)] = every, sure


def region_of(page: Node, own: dict[int, float], sure: dict[int, float]) -> Node:
    """The part of a page that the content lies in.

    From the page down, the part that holds most of the varying text is entered
    as long as what stands beside it are other parts of the page. Headings,
    paragraphs and text beside it belong to the same content, unless the part is
    marked as the article.
    """
    node = page
    while True:
        kids = [k for k in node.children() if sure.get(id(k)) and not k.unseen and not k.readers]
        weight = {id(k): sure[id(k)] * (DOUBT if k.doubted else 1) for k in kids}
        best = max(kids, key=lambda k: weight[id(k)], default=None)
        if best is None or best.tag not in CONTAINERS:
            return node
        main = _is_main_content(best, sure)
        if weight[id(best)] < (MARKED if main else MAJORITY) * sure[id(node)]:
            return node
        if not main:
            place = kids.index(best)
            beside = any(
                not k.doubted and (k.tag not in CONTAINERS or i < place and _has_title(k))
                for i, k in enumerate(kids) if k is not best)
            if beside or own.get(id(node)):
                return node
        node = best


def _is_main_content(node: Node, sure: dict[int, float]) -> bool:
    """Whether most of a part is in an element that is marked as the article."""
    most = MAJORITY * sure[id(node)]
    while not node.is_main():
        node = max((k for k in node.children() if k.marked and not k.readers), key=lambda k: sure.get(id(k), 0), default=None)
        if node is None or sure.get(id(node), 0) < most:
            return False
    return True


def _has_title(node: Node) -> bool:
    todo = [node]
    for inner in todo:
        if inner.tag == "h1":
            return True
        todo += inner.children()
    return False


class _Slots:
    """Varying text of the wrapper's slots, summed over pages."""

    def __init__(self, wrapper: Node):
        self.wrapper, self.own, self.sure = wrapper, Counter(), Counter()

    def add(self, pairs: Iterable[tuple[Node, Node]], weights: Weights) -> None:
        for own, slot in pairs:
            if id(own) in weights.all:
                self.own[id(slot)] += weights.own[id(own)]
                self.sure[id(slot)] += weights.sure[id(own)]

    def region(self) -> Node:
        return region_of(self.wrapper, self.own, self.sure)


def _own_region(page: Node, pairs: Iterable[tuple[Node, Node]], region: Node, weights: Weights) -> Node:
    """A page's part in the wrapper's region; the page's own one if it has none or nothing there."""
    for own, slot in pairs:
        if slot is region:
            if weights.sure.get(id(own)):
                return own
            break
    return region_of(page, weights.own, weights.sure)


def _wrapped(pages: list[Node]) -> list[tuple[set[int], Weights, Node]]:
    """(ids of template nodes, weights, region) of every page; too few pages have no template."""
    if len(pages) < TEMPLATE_PAGES:
        weights = [Weights(page, set()) for page in pages]
        return [(set(), w, region_of(page, w.own, w.sure)) for page, w in zip(pages, weights)]
    wrapper, memory = pages[_wrapper_of([p.size for p in pages])], {}
    aligned = [_aligned(page, wrapper, memory) for page in pages]
    constant = _constant(map(_said, aligned), len(pages))
    templates = [_constant_nodes(_said(pairs), constant) for pairs in aligned]
    slots, weights = _Slots(wrapper), [Weights(page, t) for page, t in zip(pages, templates)]
    for pairs, own in zip(aligned, weights):
        slots.add(pairs, own)
    region = slots.region()
    return [(t, w, _own_region(page, pairs, region, w)) for page, pairs, t, w in zip(pages, aligned, templates, weights)]


# Text ---------------------------------------------------------------------

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Lines:
    """Blocks of text in order. One that is all template goes; a heading of that
    kind stays if text that varies follows it in the same part."""

    def __init__(self):
        self.done: list[str] = []
        self.held: list[tuple[str, bool]] = []
        self.waiting: list[tuple[Node | None, str]] = []

    def end(self, block: Node, parent: Node | None) -> None:
        line = " ".join("".join(text for text, _ in self.held).split())
        varies = any(not constant and text.strip() for text, constant in self.held)
        self.held.clear()
        if line and varies:
            self.done += [text for _, text in self.waiting]
            self.done.append(line)
            self.waiting.clear()
        elif line and block.tag in HEADINGS:
            self.waiting.append((parent, line))

    def left(self, part: Node) -> None:
        """A part ends: headings that wait in it have nothing to stand above."""
        while self.waiting and self.waiting[-1][0] is part:
            self.waiting.pop()


def text_of(page: Node, template: set[int], weights: Weights, region: Node) -> str:
    """Blocks of the content in a page's region in order, one a line."""
    most = MAJORITY * weights.all.get(id(region), 0)
    lines = _Lines()

    def gone(node: Node) -> bool:
        if node.unseen or node.readers:
            return True
        return node.doubted and (not most or weights.all[id(node)] <= most)

    todo: list[tuple[Node, Iterator[str | Node]]] = [(region, iter(region.parts))]
    while todo:
        node, parts = todo[-1]
        parent = todo[-2][0] if len(todo) > 1 else None
        for part in parts:
            if isinstance(part, str):
                lines.held.append((part, id(node) in template))
            elif part.tag == "br":
                lines.held.append((" ", True))
            elif not gone(part):
                if part.tag in BLOCKS:
                    lines.end(node, parent)
                todo.append((part, iter(part.parts)))
                break
            elif part.tag in BLOCKS:
                lines.end(node, parent)
        else:
            todo.pop()
            if node.tag in BLOCKS or not todo:
                lines.end(node, parent)
            lines.left(node)
    return "\n".join(lines.done)


def texts_of_pages(pages: list[str | None]) -> list[str]:
    """Texts of pages of one host, aligned with each other; equal pages count once."""
    distinct = list(dict.fromkeys(p or "" for p in pages))
    if len(distinct) >= TEMPLATE_PAGES and sum(map(len, distinct)) > GROUP_BYTES:
        texts = _texts_of_long_pages(distinct)
    else:
        trees = [parse(html) for html in distinct]
        texts = [text_of(tree, *found) for tree, found in zip(trees, _wrapped(trees))]
    found = dict(zip(distinct, texts))
    return [found[p or ""] for p in pages]


def _texts_of_long_pages(pages: list[str]) -> list[str]:
    """The same texts with two trees in memory at a time; pages are parsed again instead."""
    wrapper, memory = parse(pages[_wrapper_of([parse(html).size for html in pages])]), {}
    constant = _constant((_said(_aligned(parse(html), wrapper, memory)) for html in pages), len(pages))

    def weighed(html: str) -> tuple[Node, list, set[int], Weights]:
        page = parse(html)
        pairs = _aligned(page, wrapper, memory)
        template = _constant_nodes(_said(pairs), constant)
        return page, pairs, template, Weights(page, template)

    slots = _Slots(wrapper)
    for html in pages:
        _, pairs, _, weights = weighed(html)
        slots.add(pairs, weights)
    region = slots.region()

    def text(html: str) -> str:
        page, pairs, template, weights = weighed(html)
        return text_of(page, template, weights, _own_region(page, pairs, region, weights))

    return [text(html) for html in pages]


def _groups_of_hosts(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """How many cells the distinct pages of large hosts are dealt to, and the cells that join another.

    A cell with fewer than ``TEMPLATE_PAGES`` pages joins the one before it that
    has as many, or the first such one.
    """
    pages, size = F.count(F.lit(1)), F.sum("_bytes")
    wanted = F.least(F.ceil(F.greatest(pages / GROUP_PAGES, size / GROUP_BYTES)), F.floor(pages / LEAST_PAGES))
    large = written(
        distinct.groupBy("_host").agg(wanted.cast("int").alias("_cells")).where("_cells > 1"), "large-hosts")
    cells = distinct.join(_shared(large), "_host").groupBy("_host", _cell()).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("_host")
    enough = F.when(F.col("n") >= TEMPLATE_PAGES, F.col("_cell"))
    target = F.coalesce(F.last(enough, True).over(own.orderBy("_cell")), F.min(enough).over(own))
    moved = cells.select("_host", "_cell", target.alias("_to")).where("_cell <> _to")
    return large, written(moved, "moved-cells")


def _cell() -> Column:
    return F.pmod(F.xxhash64("_page"), F.coalesce("_cells", F.lit(1))).cast("int").alias("_cell")


def _shared(rows: DataFrame) -> DataFrame:
    """Sent to every task if it is small."""
    size = rows.agg(F.sum(F.octet_length("_host") + 56)).first()[0] or 0
    return F.broadcast(rows) if size <= SHARED_BYTES else rows


def extract_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Adds text (empty if there is none) and n_chars to every row of pages.

    Null and empty html have no text. Pages without a host are one host.
    Repeated rows get the same text; columns of the added names are replaced; an
    empty table gives no rows.

    The distinct pages of a host are dealt out by their digests to groups of
    about ``GROUP_PAGES`` pages and ``GROUP_BYTES``, so a large host is many
    small groups. Bytes don't split a host below about ``LEAST_PAGES`` pages a
    group, and every group of a host with ``TEMPLATE_PAGES`` pages has as many;
    groups of more bytes are aligned with two trees in memory at a time. Pages
    are shuffled once. A page with many copies takes part once, and the copies
    get its text by a join. Only hosts with several groups, cells that join
    others and pages with many copies need to be known beforehand; these lists
    are sent to the tasks if they are small, and joined otherwise.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    # the other columns travel as one, so none of them can clash
    own = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    rows = pages.select(
        F.coalesce(url_host(F.col(url)), F.lit("")).alias("_host"), F.unhex(F.md5(body)).alias("_page"),
        F.struct(*own).alias("_row"), F.col(html).alias("_html"))
    columns = [F.col("_html").alias(c) if c == html else F.col("_row").getField(c).alias(c)
               for c in pages.columns if c not in ("text", "n_chars")]
    kept = ["_row", "_html"]
    distinct = written(
        rows.select("_host", "_page", F.coalesce(F.octet_length("_html"), F.lit(0)).cast("long").alias("_bytes"))
        .groupBy("_host", "_page").agg(F.first("_bytes").alias("_bytes"), F.count(F.lit(1)).alias("n")), "distinct-pages")
    large, moved = _groups_of_hosts(distinct)
    copied = written(distinct.where(F.expr(f"n > 1 and n * _bytes > {COPIES_BYTES}")).select("_host", "_page"), "copied-pages")
    schema = StructType([
        StructField("_host", StringType()), StructField("_page", BinaryType()),
        StructField("_copied", BooleanType()), *(StructField(c, rows.schema[c].dataType) for c in kept),
        StructField("text", StringType()), StructField("n_chars", LongType())])
    place = 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            texts = texts_of_pages([html for part in group for html in part.column(place).to_pylist()])
            at = 0
            for part in group:
                own = texts[at:at + part.num_rows]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array(own, pa.string()), pa.array([len(t) for t in own], pa.int64())],
                    names=schema.names)

    def extracted(pages: DataFrame, cells: DataFrame | None = None) -> DataFrame:
        dealt = (
            pages.join(_shared(large), "_host", "left").withColumn("_cell", _cell())
            .join(_shared(moved), ["_host", "_cell"], "left").withColumn("_group", F.coalesce("_to", "_cell")))
        if cells is not None:
            dealt = dealt.join(_shared(cells), ["_host", "_group"], "left_semi")
        return (
            dealt.select("_host", "_group", "_page", "_copied", *kept)
            .repartition("_host", "_group").sortWithinPartitions(
                "_host", "_group", "_page", F.col("_row").getField(id_column), F.col("_row").getField(url))
            .mapInArrow(run, schema)
        )

    if copied.isEmpty():
        return extracted(rows.withColumn("_copied", F.lit(False))).select(*columns, "text", "n_chars")
    single = rows.join(_shared(copied), ["_host", "_page"], "left_anti").withColumn("_copied", F.lit(False))
    copies = rows.join(_shared(copied), ["_host", "_page"])
    once = copies.groupBy("_host", "_page").agg(F.first("_html").alias("_html")).select(
        "_host", "_page", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_html", F.lit(True).alias("_copied"))
    every = single.unionByName(once)
    cells = (
        copied.join(_shared(large), "_host", "left").withColumn("_cell", _cell())
        .join(_shared(moved), ["_host", "_cell"], "left").select("_host", F.coalesce("_to", "_cell").alias("_group")).distinct())
    texts = written(
        extracted(every, written(cells, "copied-cells")).where("_copied").select("_host", "_page", "text", "n_chars"), "copied-texts")
    return (
        extracted(every).where("not _copied").select(*columns, "text", "n_chars")
        .unionByName(copies.join(texts, ["_host", "_page"]).select(*columns, "text", "n_chars"))
    )


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal first two columns, each as the slices it came in."""
    held, own = [], None
    for batch in batches:
        at = 0
        for key, run in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            n = sum(1 for _ in run)
            if held and key != own:
                yield held
                held = []
            own = key
            held.append(batch.slice(at, n))
            at += n
    if held:
        yield held
