"""Main text of web pages by wrapper induction.

Pages of a host share a template. A page becomes a DOM tree, and its *shape*: the tree in which
successive siblings of one label (tag and class; plain divisions also by whether they hold blocks) are
one repeating slot. The shape of the host's first page is aligned with that of every other by simple
tree matching (the largest number of matched nodes that keeps labels, order and ancestors). Slots that
the first page lacks are known by their path below the aligned ones, so that other layouts and notices
are counted too. Counted are the slots of blocks, each with the text of the inline elements in it,
over all pages of the host that differ in their content (copies are one page).

* A slot whose text stays the same, or is mostly links, is template; a slot whose text varies is
  content, and weighs as much as its text does on the average of the host's pages.
* The main region of a page is the smallest container that holds ``REGION`` of the weight of the
  page's content slots. Its blocks, without template, are the main text, whatever its tags are.

What the page says of itself only breaks ties: elements marked as something else (navigation, forms,
notices, adverts, comments) weigh nothing and are left out; where an article or main element has half
of the region's weight, it is the region; and slots in such an element are template only from
``LEAST_MAIN_PAGES`` contents on. Hosts whose pages all have one content have no wrapper: there the
marks alone decide.

A page is reduced to digests of its slots before anything is shuffled, and counts are summed by task,
so that a host with very many pages costs no more than others. First pages and wrappers of all hosts
are broadcast only while they are below ``BROADCAST_BYTES``; beyond that they are joined by host,
which Spark can split at skewed hosts. Reading takes time in proportion to the page and no recursion.
Matching is the same whatever the sizes: it takes time with the product of the numbers of children that
are matched, or with the larger number where they are much alike, and memory with that number times the
square root of the other.

Null html counts as empty, a null url as a host of its own. Repeated rows give repeated results.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.graph import cut

BROADCAST_BYTES = 8 << 20
LEAST_PAGES = 2
LEAST_MAIN_PAGES = 5
CONSTANT = 0.9
LINKED = 0.6
REGION = 0.8
#: Sizes that decide on time and memory alone: bytes of gains held, rows held at once, and how much
#: worse than the smaller side the matching of a first, narrow band may be.
HELD = 64 << 20
STEP = 64
NARROW = 1024

#: Fixed values of HTML: elements without content, with raw content, and that close an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Elements, roles and words in class or id that mark what is not main text.
OTHER_TAGS = frozenset("head nav footer aside form button select option input label fieldset dialog svg canvas object audio video menu".split()) | RAW
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments commentlist replies disqus respond notice notices cookie cookies consent gdpr popup modal overlay toast newsletter subscribe signup login share sharing social related recommended pagination pager widget skip".split()
)
MAIN_TAGS = frozenset({"article", "main"})

#: Elements without a meaning of their own, told apart by whether they hold blocks.
PLAIN_TAGS = frozenset({"div", "section", "td", "center"})

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_WORD = re.compile(r"[a-z]+")
_HOST = re.compile(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Node:
    __slots__ = ("children", "label", "main", "other", "parts", "tag")

    def __init__(self, tag: str, words: tuple[str, ...] = (), other: bool = False, main: bool = False):
        self.tag, self.label, self.other, self.main = tag, ".".join((tag, *words)), other, main
        self.children: list[Node] = []
        self.parts: list[str | Node] = []  # texts and children in order


class _Open:
    """The open elements, with the places of each tag among them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, tags: set[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of some tags, 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, k: int) -> None:
        for node in self.nodes[k:]:
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        del self.nodes[k:]


def parse(text: str) -> Node:
    """A forgiving reading of HTML; texts still hold their character references. A tag that never ends
    hides what follows it, as browsers have it."""
    root = Node("#root")
    open_ = _Open(root)

    def add(data: str) -> None:
        if data:
            open_.nodes[-1].parts.append(data)

    def past(mark: str, at: int) -> int:
        end = text.find(mark, at)
        return len(text) if end < 0 else end + len(mark)

    at = 0
    while (begin := text.find("<", at)) >= 0:
        add(text[at:begin])
        if text.startswith("<!--", begin):
            at = past("-->", begin + 4)
            continue
        if text.startswith("<![CDATA[", begin):
            at = past("]]>", begin)
            continue
        if text.startswith(("<!", "<?"), begin):
            at = past(">", begin)
            continue
        name = begin + 2 if text.startswith("</", begin) else begin + 1
        if not ("a" <= text[name : name + 1].lower() <= "z"):
            add("<")
            at = begin + 1
            continue
        found = _TAG.match(text, begin)
        if not found:
            return root
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            if k := open_.last((tag,)):
                open_.close(k)
            continue
        if tag in BLOCK and (k := open_.last(("p",))) and k >= open_.blocks[-1]:
            open_.close(k)
        if tag in CLOSES and (k := open_.last(CLOSES[tag])) > open_.last(SCOPES[tag]):
            open_.close(k)
        node = _element(tag, found[3])
        open_.nodes[-1].children.append(node)
        open_.nodes[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(text, at)
            node.parts.append(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text)
            continue
        if not found[3].endswith("/"):
            open_.push(node)
    add(text[at:])
    return root


def _element(tag: str, raw: str) -> Node:
    attributes = {a[0].lower(): html.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(raw)} if raw else {}
    words = tuple(dict.fromkeys(_WORD.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())))
    role = attributes.get("role", "").lower()
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    main = tag in MAIN_TAGS or role == "main" or attributes.get("itemprop", "").lower() == "articlebody"
    other = tag in OTHER_TAGS or role in OTHER_ROLES or hidden or not OTHER_WORDS.isdisjoint(words)
    return Node(tag, words, other and tag not in ("html", "body"), main)


class Slot:
    """A node of a shape: one label that stands for a run of siblings."""

    __slots__ = ("children", "kind", "label", "linked", "nodes", "other", "size", "text")

    def __init__(self, label: str, nodes: list[Node], linked: bool, other: bool):
        self.label, self.nodes = label, nodes
        self.children: list[Slot] = []
        self.text = _SPACE.sub(" ", html.unescape(" ".join([p for n in nodes for p in n.parts if isinstance(p, str)]))).strip()
        self.linked = len(self.text) if linked else 0
        self.other = other or all(n.other for n in nodes)
        self.kind = self.size = 0


def _label(node: Node) -> str:
    if node.label in PLAIN_TAGS and any(c.tag in BLOCK for c in node.children):
        return node.label + "+"
    return node.label


def shape(page: Node) -> Slot:
    """The shape of a page. Slots get a number that equal subtrees of labels share in ``match``."""
    top = Slot(page.label, [page], False, False)
    todo = [(top, False)]
    while todo:
        slot, linked = todo.pop()
        last, runs = None, []
        for child in [c for n in slot.nodes for c in n.children]:
            if child.tag in RAW:
                continue
            label = _label(child)
            if label != last:
                runs.append((label, [child]))
                last = label
            else:
                runs[-1][1].append(child)
        slot.children = [Slot(label, run, linked or run[0].tag == "a", slot.other) for label, run in runs]
        todo += [(c, linked or c.nodes[0].tag == "a") for c in slot.children]
    return top


def numbered(top: Slot) -> list[Slot]:
    """The slots of a shape in document order."""
    out, todo = [], [top]
    while todo:
        out.append(todo.pop())
        todo += reversed(out[-1].children)
    return out


def _kinds(slots: list[Slot], known: dict[tuple, int]) -> None:
    """Sizes, and numbers that slots with equal subtrees of labels share; slots in document order."""
    for slot in reversed(slots):
        key: list[str | int] = [slot.label]
        slot.size = 1
        for child in slot.children:
            key.append(child.kind)
            slot.size += child.size
        slot.kind = known.setdefault(tuple(key), len(known))


class Peers:
    """Slots of one path of labels, one of each kind, whose children lie in one row of cells: before those
    of a slot there is a cell without child. Cells of a slot start at ``starts``, and hold what was matched
    below it more than ``base``, which keeps the cells of a slot above those before it."""

    __slots__ = ("base", "cells", "ends", "inner", "of", "places", "slots", "starts")

    def __init__(self, slots: list[Slot]):
        self.slots = slots
        self.places = {s.kind: k for k, s in enumerate(slots)}
        base, starts, ends, at = [], [], [], 0
        found: dict[str, tuple[dict[int, int], list[Slot], list[int], list[int]]] = {}
        for slot in slots:
            starts.append(len(base))
            base.append(at)
            for child in slot.children:
                kinds, inner, cells, of = found.setdefault(child.label, ({}, [], [], []))
                if child.kind not in kinds:
                    kinds[child.kind] = len(inner)
                    inner.append(child)
                cells.append(len(base))
                of.append(kinds[child.kind])
                base.append(at)
            ends.append(len(base) - 1)
            at += slot.size
        self.base, self.starts, self.ends = np.array(base, np.int32), np.array(starts), np.array(ends)
        self.inner: dict[str, list[Slot] | Peers] = {label: f[1] for label, f in found.items()}
        self.cells = {label: np.array(f[2]) for label, f in found.items()}
        self.of = {label: np.array(f[3]) for label, f in found.items()}

    def below(self, label: str) -> Peers | None:
        """The children of a label, as peers."""
        inner = self.inner.get(label)
        if isinstance(inner, list):
            inner = self.inner[label] = Peers(inner)
        return inner

    def add(self, row: np.ndarray, label: str, gains: np.ndarray) -> None:
        """The row with one more child on the other side, of a label and with gains for the peers below."""
        cells = self.cells[label]
        row[cells] = np.maximum(row[cells], row[cells - 1] + gains[self.of[label]])
        np.fmax.accumulate(row, out=row)


class Gains:
    """The most matched nodes of a slot with each of some peers. Those found are held up to ``HELD``
    bytes; what was let go is found again."""

    def __init__(self):
        self.held: dict[tuple[int, Peers], np.ndarray] = {}
        self.bytes = 0

    def known(self, slot: Slot, peers: Peers) -> np.ndarray | None:
        if not slot.children or not peers.inner:
            return np.ones(len(peers.slots), np.int32)
        if len(peers.slots) == 1 and peers.slots[0].kind == slot.kind:
            return np.array([slot.size], np.int32)
        return self.held.get((slot.kind, peers))

    def of(self, slot: Slot, peers: Peers) -> np.ndarray:
        gains = self.known(slot, peers)
        if gains is not None:
            return gains
        todo = [(slot, peers, iter(slot.children), peers.base.copy())]
        while True:
            slot, peers, rest, row = todo[-1]
            for child in rest:
                below = peers.below(child.label)
                if below is None:
                    continue
                gains = self.known(child, below)
                if gains is None:
                    todo.append((child, below, iter(child.children), below.base.copy()))
                    break
                peers.add(row, child.label, gains)
            else:
                gains = 1 + row[peers.ends] - row[peers.starts]
                self._hold((slot.kind, peers), gains)
                todo.pop()
                if not todo:
                    return gains
                todo[-1][1].add(todo[-1][3], slot.label, gains)

    def _hold(self, key: tuple[int, Peers], gains: np.ndarray) -> None:
        self.held[key] = gains
        self.bytes += gains.nbytes + 300
        while self.bytes > HELD:
            self.bytes -= self.held.pop(next(iter(self.held))).nbytes + 300


class Table:
    """Row i, cell j: the most matched nodes below the first i of some slots and the first j of others,
    these being the last children of one of ``peers``. A row is kept of every ``step``, the others are
    found again from there. Only cells are filled through which ``least`` matched nodes can be reached."""

    def __init__(self, xs: list[Slot], ys: list[Slot], peers: Peers, k: int, gains: Gains):
        self.xs, self.peers, self.gains = xs, peers, gains
        end = int(peers.ends[k]) + 1
        begin = end - len(ys)
        self.cells: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for label in {q.label for q in ys}:
            cells = peers.cells[label]
            at = slice(*np.searchsorted(cells, (begin, end)))
            self.cells[label] = cells[at] - (begin - 1), peers.of[label][at]
        self.before = np.cumsum([0, *(p.size for p in xs)]), np.cumsum([0, *(q.size for q in ys)])
        self.step = max(STEP, math.isqrt(len(xs)))
        sizes = int(self.before[0][-1]), int(self.before[1][-1])
        if len(xs) < self.step:
            self._band(0)
            self.kept = [np.zeros(len(ys) + 1, np.int32)]
        else:
            # What a narrow band reaches is reached; if it is less than what the band takes in, a band that does.
            least = max(min(sizes) - NARROW, 0)
            if (reached := self._fill(least)) < least:
                self._fill(reached)

    def _band(self, least: int) -> None:
        x, y = self.before
        self.low = np.searchsorted(y, x - (x[-1] - least)).tolist()
        self.high = (np.searchsorted(y, x + (y[-1] - least), "right") - 1).tolist()

    def _fill(self, least: int) -> int:
        self._band(least)
        row = np.zeros(len(self.before[1]), np.int32)
        self.kept = [row.copy()]
        for i in range(1, len(self.xs) + 1):
            self._next(row, i)
            if i % self.step == 0:
                self.kept.append(row.copy())
        return int(row[-1])

    def _next(self, row: np.ndarray, i: int) -> None:
        """Row i from the one before, in place."""
        p, low, high = self.xs[i - 1], self.low[i], min(self.high[i], len(row) - 1)
        if p.label in self.cells:
            cells, of = self.cells[p.label]
            if low > 1 or high < len(self.before[1]) - 1:
                at = slice(*np.searchsorted(cells, (low, high + 1)))
                cells, of = cells[at], of[at]
            gains = self.gains.of(p, self.peers.below(p.label))
            row[cells] = np.maximum(row[cells], row[cells - 1] + gains[of])
        part = row[max(low - 1, 0) : high + 1]
        np.fmax.accumulate(part, out=part)  # of integers the same as maximum, but faster

    def _rows(self, first: int, width: int) -> list[tuple[int, np.ndarray]]:
        """The filled cells of a kept row and of those up to the next, with the place of their first."""
        row, rows = self.kept[first // self.step][:width].copy(), []
        for i in range(first, min(first + self.step, len(self.xs) + 1)):
            if i > first:
                self._next(row, i)
            rows.append((self.low[i], row[self.low[i] : self.high[i] + 1].copy()))
        return rows

    def pairs(self) -> list[tuple[int, int]]:
        """The places matched, from the last. Cells that aren't filled lie on no largest matching."""
        out, i, j = [], len(self.xs), len(self.before[1]) - 1
        first = i - i % self.step
        rows = self._rows(first, j + 1)
        low, here = rows.pop()
        while i and j:
            if not rows:
                first -= self.step
                rows = self._rows(first, j + 1)
            start, above = rows[-1]
            if start <= j < start + len(above) and here[j - low] == above[j - start]:
                i -= 1
                low, here = rows.pop()
            elif j > low and here[j - low] == here[j - low - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                low, here = rows.pop()
                out.append((i, j))
        return out


def match(a: list[Slot], b: list[Slot]) -> list[tuple[Slot, Slot]]:
    """Simple tree matching of two shapes, given in document order with the top first: the matched pairs.
    Of equally large matchings the one with the earliest slots, those of ``a`` first."""
    known: dict[tuple, int] = {}
    _kinds(a, known)
    _kinds(b, known)
    if a[0].label != b[0].label:
        return []
    gains = Gains()
    found: list[tuple[Slot, Slot]] = []
    todo: list[tuple[Slot, Slot, Peers | None]] = [(a[0], b[0], None)]
    while todo:
        x, y, peers = todo.pop()
        found.append((x, y))
        if x.kind == y.kind:
            todo += zip(x.children, y.children, [None] * len(x.children), strict=True)
            continue
        same = 0  # equal first children are matched in every such matching
        for p, q in zip(x.children, y.children, strict=False):
            if p.kind != q.kind:
                break
            todo.append((p, q, None))
            same += 1
        xs, ys = x.children[same:], y.children[same:]
        if len(xs) == len(ys) == 1:
            if xs[0].label == ys[0].label:
                todo.append((xs[0], ys[0], peers and peers.below(xs[0].label)))
        elif xs and ys:
            peers = peers or Peers([y])
            todo += [(xs[i], ys[j], peers.below(xs[i].label)) for i, j in Table(xs, ys, peers, peers.places[y.kind], gains).pairs()]
    return found


def _outermost(tops: list[Node], wanted: Callable[[Node], bool], entered: Callable[[Node], bool]) -> list[Node]:
    """The outermost nodes wanted, in order, of those reached through nodes that are entered."""
    out, todo = [], list(reversed(tops))
    while todo:
        node = todo.pop()
        if not entered(node):
            continue
        if wanted(node):
            out.append(node)
        else:
            todo += reversed(node.children)
    return out


def text_of(tops: list[Node], inside: bool, template: set[int]) -> str:
    """The blocks of some nodes in order, joined by a space. inside: whether headers count, as those of
    an article do; template: ids of nodes whose own text is left out."""
    blocks: list[list[str]] = [[]]
    todo: list[Node | tuple[str, Node] | None] = []
    for top in reversed(tops):
        todo += [None, top]
    while todo:
        node = todo.pop()
        if node is None:
            blocks.append([])
            continue
        if isinstance(node, tuple):
            if id(node[1]) not in template:
                blocks[-1].append(node[0])
            continue
        if node.other or (node.tag == "header" and not inside):
            continue
        if node.tag == "br":
            blocks[-1].append(" ")
            continue
        if node.tag in BLOCK:
            blocks.append([])
            todo.append(None)
        todo += [part if isinstance(part, Node) else (part, node) for part in reversed(node.parts)]
    cleaned = (_SPACE.sub(" ", html.unescape("".join(b))).strip(" ") for b in blocks if b)
    return " ".join(b for b in cleaned if b)


def marked_text(page: Node) -> str:
    """The main text by what the page says of itself alone."""
    tops = _outermost([page], lambda n: n.main, lambda n: not n.other)
    return text_of(tops or [page], bool(tops), set())


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, _HOST.pattern.replace(r"\A", "^"), 1), F.lit("")))


def _digest(*parts: object) -> int:
    return int.from_bytes(blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Block:
    """A block's slot with the inline slots in it. main: whether it lies in a main element."""

    __slots__ = ("key", "linked", "main", "slots", "text")

    def __init__(self, key: int, slots: list[Slot], main: bool):
        self.key, self.slots, self.main = key, slots, main
        shown = [s for s in slots if s.text and not s.other]
        self.text, self.linked = " ".join(s.text for s in shown), sum(s.linked + (s.linked > 0) for s in shown)


def blocks_of(seed: list[Slot], page: Node) -> tuple[Slot, list[Block]]:
    """The shape of a page and its blocks that have text. Their keys are places in the seed, or digests
    of the path below an aligned slot."""
    top = shape(page)
    place = {id(s): k for k, s in enumerate(seed)}
    aligned = {id(y): place[id(x)] for x, y in match(seed, numbered(top))}
    found: list[tuple[int, list[Slot], bool]] = []
    todo: list[tuple[Slot, int, list[Slot], bool]] = [(top, 0, [], False)]
    while todo:
        slot, key, block, main = todo.pop()
        main = main or any(n.main for n in slot.nodes)
        if slot is top or slot.nodes[0].tag in BLOCK:
            found.append((key, block := [slot], main))
        else:
            block.append(slot)
        before: dict[str, int] = {}
        inner = []
        for child in slot.children:
            below = aligned.get(id(child))
            if below is None:
                before[child.label] = before.get(child.label, 0) + 1
                below = _digest(key, child.label, before[child.label]) >> 1 & (1 << 62) - 1 | 1 << 62
            inner.append((child, below, block, main))
        todo += reversed(inner)
    return top, [b for b in (Block(*x) for x in found) if b.text]


#: What a host's wrapper says of a slot: whether it is template, and its weight.
Wrapper = dict[int, tuple[bool, float]]


def main_text(page: Node, seed: list[Slot], wrapper: Wrapper) -> str:
    """The blocks of the page's main region without the template."""
    top, blocks = blocks_of(seed, page)
    template: set[int] = set()
    weight: dict[int, float] = {}
    for b in blocks:
        gone, size = wrapper.get(b.key, (False, float(len(b.text))))
        if gone:
            template.update(id(n) for s in b.slots for n in s.nodes)
        else:
            weight[id(b.slots[0])] = size
    for slot in reversed(numbered(top)):
        weight[id(slot)] = weight.get(id(slot), 0.0) + sum(weight[id(c)] for c in slot.children)
    region, whole = top, weight[id(top)]
    while whole:
        inner = [c for c in region.children if weight[id(c)] >= REGION * whole and any(s.nodes[0].tag in BLOCK for s in c.children)]
        if not inner:
            break
        region = inner[0]
    tops, outer, todo = region.nodes, [], [region]
    while todo:
        slot = todo.pop()
        if any(n.main and not n.other for n in slot.nodes):
            outer.append(slot)
        else:
            todo += reversed(slot.children)
    if sum(weight[id(s)] for s in outer) * 2 >= weight[id(region)] > 0:
        tops = [n for s in outer for n in s.nodes if n.main]
    elif not weight[id(region)]:
        tops = _outermost([page], lambda n: n.main, lambda n: not n.other) or tops
    return text_of(tops, tops != [page], template)


class Hosts:
    """Parsed first pages and wrappers of the hosts that a task meets."""

    def __init__(self):
        self.known: dict[str, tuple[list[Slot], Wrapper]] = {}

    def get(self, name: str, told: Callable[[], tuple[str | None, list | None]]) -> tuple[list[Slot], Wrapper]:
        if name not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            seed, slots = told()
            self.known[name] = numbered(shape(parse(seed or ""))), {s["slot"]: (s["template"], s["weight"]) for s in slots or ()}
        return self.known[name]


def by_page(rows: DataFrame, told: DataFrame, size: int, f: Callable[[dict, list[Slot], Wrapper], tuple], arrow: pa.Schema, schema: str) -> DataFrame:
    """f of each row, the shape of its host's seed and its wrapper. told: host, seed and slots, of ``size``
    bytes: broadcast if these are few, else joined."""
    columns = [c for c in rows.columns if c != "host"]
    few = size <= BROADCAST_BYTES
    if few:
        shared = rows.sparkSession.sparkContext.broadcast({r["host"]: (r["seed"], [s.asDict() for s in r["slots"] or ()]) for r in told.collect()})
    else:
        rows = rows.join(told, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts = Hosts()
        for batch in batches:
            held = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            values = {c: held[c].to_pylist() for c in ("host", *columns)}
            out = []
            for k, name in enumerate(values["host"]):
                of = (lambda: shared.value.get(name, (None, None))) if few else (lambda: (held["seed"][k].as_py(), held["slots"][k].as_py()))
                out.append(f({c: values[c][k] for c in columns}, *hosts.get(name, of)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


SLOTS = "array<struct<slot: long, template: boolean, weight: double>>"


def induced(rows: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """host, slot, template and weight of the slots that two or more of a host's contents have, one page
    of each content."""
    slot = pa.struct([("slot", pa.int64()), ("text", pa.int64()), ("size", pa.int64()), ("linked", pa.int64()), ("main", pa.bool_())])
    arrow = pa.schema([("host", pa.string()), ("content", pa.int64()), ("page_id", pa.int64()), ("print", pa.int64()), ("slots", pa.list_(slot))])

    def read(row: dict, seed: list[Slot], _: Wrapper) -> tuple:
        page = parse(row["html"] or "")
        slots = [{"slot": b.key, "text": _digest(b.text), "size": len(b.text), "linked": b.linked, "main": b.main} for b in blocks_of(seed, page)[1]]
        return row["of"], _digest(marked_text(page)), row["page_id"], _digest(row["html"] or ""), slots

    told = seeds.withColumn("slots", F.lit(None).cast(SLOTS))
    pages = by_page(rows.select("host", F.col("host").alias("of"), "html", "page_id"), told, size, read, arrow, "host string, content long, page_id long, print long, slots array<struct<slot: long, text: long, size: long, linked: long, main: boolean>>")
    single = pages.groupBy("host", "content").agg(F.min(F.struct("page_id", "print", "slots")).alias("page"))
    texts = single.select("host", F.explode("page.slots").alias("s")).select("host", "s.*").groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.max("main").alias("main"))
    slots = texts.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("same"), F.sum("linked").alias("linked"), F.sum("size").alias("size"), F.max("main").alias("main"))
    enough = F.col("pages") >= F.when(F.col("main"), LEAST_MAIN_PAGES).otherwise(LEAST_PAGES)
    constant = (F.col("same") >= F.col("pages") * CONSTANT) | (F.col("linked") >= F.col("size") * LINKED)
    return slots.filter(F.col("pages") >= LEAST_PAGES).select("host", "slot", (enough & constant).alias("template"), (F.col("size") / F.col("pages")).alias("weight"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    seeds = cut(rows.groupBy("host").agg(F.min_by(F.coalesce("html", F.lit("")), F.struct("page_id", F.xxhash64("html"))).alias("seed")))
    bytes_ = F.octet_length("seed") + F.octet_length("host")
    size = seeds.agg(F.coalesce(F.sum(bytes_), F.lit(0))).first()[0]
    slots = induced(rows, seeds, size).groupBy("host").agg(F.collect_list(F.struct("slot", "template", "weight")).alias("slots"))
    wrappers = cut(seeds.join(slots, "host", "left"))
    whole = wrappers.agg(F.coalesce(F.sum(bytes_ + F.coalesce(F.size("slots"), F.lit(0)) * 100), F.lit(0))).first()[0]
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def read(row: dict, seed: list[Slot], wrapper: Wrapper) -> tuple:
        page = parse(row["html"] or "")
        text = main_text(page, seed, wrapper) if wrapper else marked_text(page)
        return row["page_id"], row["url"], text, len(text)

    return by_page(rows, wrappers, whole, read, arrow, "page_id long, url string, text string, n_chars long")
