"""HTML extraction by wrapper induction.

The wrapper of a host is induced from all its pages. One page (the one of the smallest hash) is the reference; the DOM
tree of every page is aligned with it by simple tree matching (`match`: of two nodes of one tag and class, the heaviest
order-preserving matching of their children). A text held at one slot (path of tags and classes) by at least three
different pages (both, on a host of two) and by one in SHARE of the pages with that slot is constant: template. What
varies is added up over all pages by the reference node it is aligned with, and the content region is where it is:
from the root, the child that holds most of the varying text is entered as long as there is one (`region`); a varying
h1 on the way stays. So menus, adverts and footers whose text changes from page to page go too, being outside of the
region. Elements that are boilerplate by kind (nav, footer, form, script ...) never count; inside the region, elements
whose class names boilerplate go as well, and lists of little but links outside an article.

An article or main element is a tie-break: a child that holds one is entered for a smaller share, and the descent ends
there. Only pages without a wrapper (alone on their host, or not aligned with its region) are judged by such elements alone.
Inside an article only boxes can be template, not paragraphs, headings, quotes or list items. Pages of the same text and
slots count once, so copies say nothing of what is template; a page of which nothing would be left keeps its text.

Matching is exact: long lists of children are compared near the diagonal first, after equal ends are matched, and further off until
the band must hold the heaviest matching. Equal subtrees match whole and shapes are compared once, so deep pages, and wide ones that
are alike, stay near linear; wide ones that differ much take time by the product of their lengths. Nothing recurses.

Defined cases: a null html is empty and gives an empty text; a page without host is alone; markup that is cut off or
unbalanced closes where it must; null ids and repeated rows give a row each; extra columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Of these, repeated ones inside an article are its own words (a quoted or standing phrase), not its frame.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th figcaption".split()) | INLINE
CLOSED_BY_BLOCK = frozenset(("p",))
#: An opening tag closes an open element of these kinds first.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option input textarea iframe object embed svg canvas audio video map dialog menu".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of a class or id that name boilerplate.
DROPPED_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup
    modal overlay comment comments respond disqus sidebar sidebars aside nav navigation navbar menu menus breadcrumb breadcrumbs header masthead footer
    share sharing social related recommended newsletter subscribe signup login search pagination pager widget widgets toolbar skip copyright legal
    disclaimer tags byline""".split()
)
MAIN = ("article", "main")
#: Elements that hold a text of their own; no region is inside one.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption".split())
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?/][^>]*>?|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?|[^<]++|<", re.S
)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: A text at a slot is template if one in so many of the pages with the slot hold it.
SHARE = 20


class Node:
    """An element: tag, whether it is boilerplate by kind or by name, class signature, children (nodes and text), and what `index` finds."""

    __slots__ = ("tag", "dropped", "named", "sig", "kids", "slot", "inside", "size", "mark")

    def __init__(self, tag: str, sig: str = "", dropped: bool = False, named: bool = False):
        self.tag, self.sig, self.dropped, self.named, self.kids = tag, sig, dropped, named, []
        self.slot, self.inside, self.size, self.mark = 0, False, 0, 0


def parse(page: str) -> Node:
    """A lenient DOM: unclosed and stray tags are tolerated, raw elements are skipped, entities decoded."""
    root = Node("#root")
    stack = [root]
    at = 0
    while m := _TOKEN.match(page, at):
        at = m.end()
        if at == m.start():
            break
        first = page[m.start() : m.start() + 2]
        if first[0] != "<" or first == "<":
            text = m[0]
            stack[-1].kids.append(entities.unescape(text) if "&" in text else text)
        elif m[1]:
            tag, attrs = m[1].lower(), m[2]
            if tag in RAW:
                end = page.lower().find(f"</{tag}", at) if len(page) < 2000 else _find_close(page, tag, at)
                at = len(page) if end < 0 else end
                continue
            sig, dropped, named = "", tag in DROPPED, False
            if "=" in attrs:
                for name, *values in _ATTR.findall(attrs):
                    value = "".join(values).lower()
                    if name.lower() == "role":
                        dropped |= value in DROPPED_ROLES
                    else:
                        named |= tag not in ("html", "body", "main", "article") and not DROPPED_WORDS.isdisjoint(_SPLIT.split(value))
                        sig = value if name.lower() == "class" else sig
            if tag not in INLINE and stack[-1].tag != "#root":
                _close_paragraph(stack)
            for like in SIBLINGS.get(tag, ()):
                if stack[-1].tag == like:
                    stack.pop()
            node = Node(tag, sig, dropped, named)
            if tag == "header":
                node.dropped |= not any(x.tag in ("article", "main") for x in stack)
            stack[-1].kids.append(node)
            if tag not in VOID and not attrs.endswith("/"):
                stack.append(node)
            elif tag == "br":
                node.kids.append(" ")
        elif first == "</":
            tag = m[0][2:].rstrip(">").strip().lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
    return root


def _find_close(page: str, tag: str, at: int) -> int:
    m = re.compile(f"</{tag}", re.I).search(page, at)
    return m.start() if m else -1


def _close_paragraph(stack: list[Node]) -> None:
    """A block element ends an open paragraph, with the inline elements open in it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in CLOSED_BY_BLOCK:
            del stack[k:]
            return
        if stack[k].tag not in INLINE:
            return


def index(dom: Node) -> Node:
    """Slot and whether an article encloses it, of every node from the root down; then length of text and a hash of it, upwards."""
    order = [dom]
    for x in order:
        for k in x.kids:
            if not isinstance(k, str):
                k.slot = x.slot if k.tag in INLINE else _digest(f"{k.tag} {k.sig}", x.slot)
                k.inside = x.inside or x.tag in MAIN
                order.append(k)
    for x in reversed(order):
        found = [(len(t), _digest(t)) for k in x.kids if isinstance(k, str) and (t := " ".join(k.split()))] if all(isinstance(k, str) for k in x.kids) else [
            (len(t), _digest(t)) if isinstance(k, str) else (k.size, k.mark) for k in x.kids if not isinstance(k, str) and k.size or isinstance(k, str) and (t := " ".join(k.split()))
        ]
        x.size = sum(f[0] for f in found)
        x.mark = found[0][1] if len(found) == 1 else _digest(str([f[1] for f in found]))
    return dom


def _gone(node: Node) -> bool:
    return node.dropped or node.named


def _in_order(node: Node):
    """Nodes below and with one that aren't boilerplate, in page order."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if not _gone(x):
            stack.extend(k for k in reversed(x.kids) if not isinstance(k, str))


def _roots(dom: Node) -> list[Node]:
    """Without a wrapper: the outermost articles with a good share of the longest one's text; else main; else the page."""
    for tag in MAIN:
        found = [n for n in _in_order(dom) if n.tag == tag and not _gone(n) and n.size]
        if found:
            inner = {id(k) for n in found for k in _in_order(n) if k is not n} if len(found) > 1 else set()
            outer = [n for n in found if id(n) not in inner]
            longest = max(n.size for n in outer)
            return [n for n in outer if 4 * n.size >= longest]
    return [dom]


class Tree:
    """The block elements of a page that aren't boilerplate by kind, as numbered nodes with their children."""

    def __init__(self, dom: Node):
        self.nodes, self.kids = [dom], [[]]
        for k, x in enumerate(self.nodes):
            stack = list(reversed(x.kids))
            while stack:
                y = stack.pop()
                if isinstance(y, str) or y.dropped:
                    continue
                if y.tag in INLINE:
                    stack.extend(reversed(y.kids))
                    continue
                self.kids[k].append(len(self.nodes))
                self.nodes.append(y)
                self.kids.append([])

    def shapes(self, known: dict) -> list[int]:
        """A number for each node's shape: tag, class and shapes of the children; `known` numbers them over several trees."""
        out = [0] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            x = self.nodes[k]
            out[k] = known.setdefault((x.tag, x.sig, tuple(out[c] for c in self.kids[k])), len(known))
        return out


#: Lists of children of up to so many pairs are compared in full at once.
FEW = 1024
#: Children off the diagonal at which longer lists are compared first.
BAND = 16
#: Weights kept as arrays for one pair of lists; the others are looked up again.
KEPT = 1 << 24


class _Matching:
    """Simple tree matching of shapes: the weight of a pair is 1 and that of the heaviest ordered matching of its children."""

    def __init__(self, known: dict):
        self.key = [None] * len(known)
        self.kids: list[tuple[int, ...]] = [()] * len(known)
        self.size = [1] * len(known)
        for (tag, sig, kids), k in known.items():
            self.key[k], self.kids[k] = (tag, sig), kids
            self.size[k] = 1 + sum(self.size[c] for c in kids)  # children are numbered first
        self.weight: dict[tuple[int, int], int] = {}
        self.cheap: dict[tuple[int, int], int] = {}  # those of flat shapes, found again when gone
        self.flat = [all(not self.kids[c] for c in kids) for kids in self.kids]
        self.places: dict[int, dict] = {}
        self.last: tuple = (None, [])  # the pair settled last and its matching

    def _known(self, a: int, b: int) -> int | None:
        if a == b:
            return self.size[a]
        if self.key[a] != self.key[b]:
            return 0
        if not self.kids[a] or not self.kids[b]:
            return 1
        found = self.weight.get((a, b))
        if found is None and (self.flat[a] or self.flat[b]):
            found = self.cheap.get((a, b))
            if found is None:
                if len(self.cheap) >= KEPT >> 6:
                    self.cheap.clear()
                found = self.cheap[a, b] = 1 + self._common(a, b)
        return found

    def _common(self, a: int, b: int) -> int:
        """Weight of the children's matching if those of one shape are leaves: the longest common sequence of their keys, a bit a child."""
        if b not in self.places:
            held = self.places[b] = {}
            for j, c in enumerate(self.kids[b]):
                held[self.key[c]] = held.get(self.key[c], 0) | 1 << j
        held, ones = self.places[b], (1 << len(self.kids[b])) - 1
        free = ones
        for c in self.kids[a]:
            if bits := held.get(self.key[c]):
                bits &= free
                free = (free + bits | free - bits) & ones
        return len(self.kids[b]) - free.bit_count()

    def _ends(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int]:
        """Lengths of the equal start and end of two lists; matching those is never worse."""
        n = min(len(a), len(b))
        start = 0
        while start < n and a[start] == b[start]:
            start += 1
        end = 0
        while end < n - start and a[-1 - end] == b[-1 - end]:
            end += 1
        return start, end

    def settle(self, a: int, b: int) -> int:
        """The weight of a pair of shapes; what it needs is settled first, on a stack of its own."""
        stack, begun = [(a, b)], {}
        while stack:
            p = stack[-1]
            if self._known(*p) is not None:
                stack.pop()
                continue
            x, y = self.kids[p[0]], self.kids[p[1]]
            if p not in begun:
                begun[p] = self._heaviest(x, y)
            try:
                stack.extend(next(begun[p]))
            except StopIteration as found:
                self.last = p, found.value
                self.weight[p] = 1 + sum(self._known(x[i], y[j]) for i, j in found.value)
                del begun[p]
        return self._known(a, b)

    def pairs(self, a: int, b: int) -> list[tuple[int, int]]:
        """The heaviest ordered matching of the children of two shapes of one key, as places."""
        weight = self.settle(a, b)
        if self.last[0] == (a, b):
            return self.last[1]
        try:
            next(self._heaviest(self.kids[a], self.kids[b], weight - 1))
        except StopIteration as found:
            return found.value
        raise AssertionError("a settled pair lacks a weight")

    def _heaviest(self, a: tuple[int, ...], b: tuple[int, ...], weight: int | None = None):
        """Yields the pairs of shapes to settle first, then returns the heaviest ordered matching of two lists of shapes, as places."""
        start, end = self._ends(a, b)
        ends = [(k, k) for k in range(start)] + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
        a_at, b_at = range(start, len(a) - end), range(start, len(b) - end)
        shared = {self.key[a[i]] for i in a_at} & {self.key[b[j]] for j in b_at}
        a_at, b_at = [i for i in a_at if self.key[a[i]] in shared], [j for j in b_at if self.key[b[j]] in shared]  # others match nothing
        x, y = [a[i] for i in a_at], [b[j] for j in b_at]
        if len(x) * len(y) <= FEW:
            missing = {(p, q) for p in set(x) for q in set(y) if self._known(p, q) is None}
            if missing:
                yield missing
            found = self._in_full(x, y)
        else:
            found = yield from self._in_band(x, y, None if weight is None else weight - sum(self.size[a[i]] for i, _ in ends))
        return ends + [(a_at[i], b_at[j]) for i, j in found]

    def _in_full(self, x: list[int], y: list[int]) -> list[tuple[int, int]]:
        best = [[0] * (len(y) + 1)]
        for p in x:
            above, own, left = best[-1], [0], 0
            for j, q in enumerate(y):
                left = max(left, above[j + 1], above[j] + self._known(p, q))
                own.append(left)
            best.append(own)
        out, i, j = [], len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((i, j))
        return out

    def _in_band(self, x: list[int], y: list[int], weight: int | None):
        """As `_in_full`, within a band that is widened until it must hold every heaviest matching.

        A child can give at most its size, nor more than the largest of its key on the other side; let these add up to s over the first
        i children of x and to t over the first j of y. What a matching falls short of them, over both lists, is its loss. A matching
        that settles these i and j apart from the rest has lost |s - t| before and |(S - s) - (T - t)| after, S and T being the whole
        sums. So matchings of at most some loss pass only where both together are no more; one found there of no more loss is the
        heaviest. Else the band grows to twice the loss, at most to that of the matching found. `weight`: the result's, if known.
        """
        own, other = {}, {}
        for held, shapes in ((own, x), (other, y)):
            for p in shapes:
                held[self.key[p]] = max(held.get(self.key[p], 0), self.size[p])
        s = np.cumsum([0] + [min(self.size[p], other[self.key[p]]) for p in x])
        t = np.cumsum([0] + [min(self.size[q], own[self.key[q]]) for q in y])
        n, m, both, apart = len(x), len(y), int(s[-1] + t[-1]), int(s[-1] - t[-1])
        kinds = {q: k for k, q in enumerate(dict.fromkeys(y))}
        names, place = list(kinds), np.array([kinds[q] for q in y])
        rows: dict[int, np.ndarray] = {}
        missing: set[tuple[int, int]] = set()

        def weights(i: int, low: int, high: int) -> np.ndarray:
            p = x[i]
            if p not in rows:
                if (len(rows) + 1) * len(names) > KEPT:
                    rows.clear()
                rows[p] = np.full(len(names), -1, np.int32)
            out = rows[p][place[low:high]]
            if out.size and out.min() < 0:
                for k in np.unique(place[low:high][out < 0]).tolist():
                    w = self._known(p, names[k])
                    if w is None:
                        missing.add((p, names[k]))
                    else:
                        rows[p][k] = w
                out = rows[p][place[low:high]]
            return out

        def step(above: np.ndarray, i: int) -> np.ndarray:
            """Best weights of the first i of x and j of y, for j of the band."""
            own = np.full(max(0, top[i] - bottom[i]), -both - 1)  # less than any weight, and so with a weight added
            low, high = max(bottom[i - 1], bottom[i]), min(top[i - 1], top[i])
            if low < high:
                own[low - bottom[i] : high - bottom[i]] = above[low - bottom[i - 1] : high - bottom[i - 1]]
            low, high = max(bottom[i - 1], bottom[i] - 1), min(top[i - 1], top[i] - 1)
            if low < high:
                part = own[low + 1 - bottom[i] : high + 1 - bottom[i]]
                np.maximum(part, above[low - bottom[i - 1] : high - bottom[i - 1]] + weights(i - 1, low, high), out=part)
            return np.maximum.accumulate(own)

        every = math.isqrt(n) + 1
        spare = BAND * (both // (n + m) + 1) if weight is None else (both - 2 * weight - abs(apart)) // 2
        while True:
            bottom = np.searchsorted(t, s - max(0, apart) - spare, "left").tolist()
            top = np.searchsorted(t, s - min(0, apart) + spare, "right").tolist()
            for i in range(1, n + 1):
                low, high = max(bottom[i - 1], bottom[i] - 1), min(top[i - 1], top[i] - 1)
                if low < high:
                    weights(i - 1, low, high)
            if missing:
                yield set(missing)
                missing.clear()
            row = np.zeros(top[0] - bottom[0], np.int64)
            kept = {0: row}
            for i in range(1, n + 1):
                row = step(row, i)
                if i % every == 0:
                    kept[i] = row
            best = int(row[m - bottom[n]])
            if best >= 0 and both - 2 * best <= abs(apart) + 2 * spare:
                break
            spare = 2 * spare + 1 if best < 0 else min(2 * spare + 1, (both - 2 * best - abs(apart)) // 2)

        out, i, j = [], n, m
        while i and j:  # rows are worked out again from the last one kept
            first = (i - 1) // every * every
            block = [kept[first]]
            for k in range(first + 1, i + 1):
                block.append(step(block[-1], k))
            best_at = lambda k, c: block[k - first][c - bottom[k]] if bottom[k] <= c < top[k] else -1
            while i > first and j:
                here = best_at(i, j)
                if here == best_at(i - 1, j):
                    i -= 1
                elif here == best_at(i, j - 1):
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((i, j))
        return out


def match(page: Tree, reference: Tree) -> list[int]:
    """Of each node of the page the reference node it is aligned with, or -1."""
    known: dict = {}
    x, y = page.shapes(known), reference.shapes(known)
    matching = _Matching(known)
    out = [-1] * len(x)
    stack = [(0, 0)] if matching.key[x[0]] == matching.key[y[0]] else []
    while stack:
        a, b = stack.pop()
        out[a] = b
        if x[a] == y[b]:
            stack.extend(zip(page.kids[a], reference.kids[b]))
        elif page.kids[a] and reference.kids[b]:
            p, r = page.kids[a], reference.kids[b]
            stack.extend((p[i], r[j]) for i, j in matching.pairs(x[a], y[b]))
    return out


#: Share of a node's varying text that its heaviest child must hold to be entered; with an article or main element in it.
MOST, MOST_OF_ARTICLE = 0.6, 0.35


def region(reference: Tree, varying: dict[int, int]) -> list[int]:
    """The reference nodes that hold the content, given the varying characters aligned with each node; [] if it is the whole page."""
    n = len(reference.nodes)
    total, article, parent = [varying.get(k, 0) for k in range(n)], [x.tag in MAIN for x in reference.nodes], [-1] * n
    for k in range(n - 1, -1, -1):
        for c in reference.kids[k]:
            parent[c] = k
            total[k] += total[c]
            article[k] |= article[c]
    at, keep = 0, []
    while reference.nodes[at].tag not in MAIN:
        ways = [c for c in reference.kids[at] if reference.nodes[c].tag not in LEAVES and total[c] >= (MOST_OF_ARTICLE if article[c] else MOST) * max(1, total[at])]
        if not ways:
            break
        down = max(ways, key=lambda c: (article[c], total[c]))
        for c in reference.kids[at][: reference.kids[at].index(down)]:
            below = [c]
            for x in below:
                below.extend(reference.kids[x])
            keep += [x for x in below if reference.nodes[x].tag == "h1" and total[x] and not reference.nodes[x].named]
        at = down
    return [*keep, at] if at else []


def _digest(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace"), seed & 0xFFFFFFFFFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


#: A run of text between block elements: whether outside articles, its pieces as (text, letters in links, (slot, unit) pairs that speak for the piece), anchor.
Block = tuple[bool, list[tuple[str, int, tuple[tuple[int, int], ...]]], int]


def _blocks(root: Node, all_kinds: bool = False, anchors: dict[int, int] | None = None) -> list[Block]:
    """The blocks below a node that aren't boilerplate by kind or name (`all_kinds`: by kind), in page order.

    With `anchors` (reference node by id of a node), a block's units name the anchor it stands at as (anchor, letters).
    """
    out: list[Block] = []
    run: list[tuple[str, int, Node | None]] = []
    #: Of the open block elements: node, units of enclosing elements, whether there is no block element below, anchor.
    path: list[tuple[Node, tuple, bool, int]] = []

    def flush():
        if not run:
            return
        node, around, leaf, anchor = path[-1]
        inside = node.inside or node.tag in MAIN
        parts: list[tuple[Node | None, list]] = []
        if leaf or any(top is None and not raw.isspace() for raw, _, top in run if raw):
            parts.append((None, run))
        else:
            for item in run:
                if parts and parts[-1][0] is item[2]:
                    parts[-1][1].append(item)
                else:
                    parts.append((item[2], [item]))
        own = not inside or (node.tag not in MAIN and node.tag not in PROSE)
        pieces = []
        for top, items in parts:
            raw = "".join(x[0] for x in items)
            units = around
            if own and (text := " ".join(raw.split())):
                at = _digest(f"{top.tag} {top.sig}", node.slot) if top else node.slot
                units = (*around, (at, _digest(text, at)))
            pieces.append((raw, sum(x[1] for x in items), units))
        if any(raw and not raw.isspace() for raw, _, _ in pieces):
            out.append((not inside, pieces, anchor))
        run.clear()

    stack: list = [(root, None, False)]
    while stack:
        x, top, done = stack.pop()
        if isinstance(x, str):
            run.append((x, 0, top))
        elif done:
            flush()
            path.pop()
        elif x.dropped or (x.named and not all_kinds and x is not root):
            if x.tag not in INLINE:
                flush()
        elif x.tag in INLINE and path:
            top = top or x
            if x.tag == "a":
                run.append(("", x.size, top))
            stack.extend((k, top, False) for k in reversed(x.kids))
        else:
            if path:
                flush()
            leaf = all(isinstance(k, str) or k.tag in INLINE for k in x.kids)
            around = path[-1][1] if path else ()
            if x.inside and path and not leaf and x.tag not in PROSE:
                around = (*around, (x.slot, _digest(str(x.mark), x.slot)))
            anchor = anchors.get(id(x), path[-1][3] if path else 0) if anchors else 0
            path.append((x, around, leaf, anchor))
            stack.append((x, None, True))
            stack.extend((k, None, False) for k in reversed(x.kids))
    return out


def _render(blocks: list[Block], template: frozenset[int] | set[int]) -> str:
    out = []
    for free, pieces, _ in blocks:
        kept = [p for p in pieces if not any(unit in template for _, unit in p[2])] if template else pieces
        text = " ".join("".join(p[0] for p in kept).split())
        if text and not (free and 2 * sum(p[1] for p in kept) > len(text)):
            out.append(text)
    return "\n\n".join(out)


def without(blocks: list[Block], template: frozenset[int] | set[int]) -> str:
    """The text of the blocks without the template's units; with them where nothing else is left."""
    return _render(blocks, template) or _render(blocks, frozenset())


#: What a page tells of its host, as (slot, unit, letters, anchor): (0, 0) once, (slot, 0) and (slot, unit) of what it holds,
#: (node, 1) of each reference node its text is aligned with, with the letters there that are no link.
Told = list[tuple[int, int, int, int]]


def tell(dom: Node, reference: Tree) -> tuple[int, Told]:
    """A hash of the page's text and slots, and what it tells."""
    tree = Tree(dom)
    anchors = {id(x): b for x, b in zip(tree.nodes, match(tree, reference)) if b >= 0}
    blocks = _blocks(dom, True, anchors)
    found: dict[tuple[int, int], tuple[int, int]] = {(0, 0): (0, 0)}
    for _, pieces, anchor in blocks:
        letters = 0
        for raw, links, units in pieces:
            size = max(0, len(" ".join(raw.split())) - links)
            letters += size
            for slot, unit in units:
                found[slot, 0] = (0, 0)
                found.setdefault((slot, unit), (size, anchor))
        if letters:
            found[anchor, 1] = (found.get((anchor, 1), (0, 0))[0] + letters, 0)
    out = sorted((*k, *v) for k, v in found.items())
    return _digest("\0".join(p[0] for _, pieces, _ in blocks for p in pieces), _digest(str(out))), out


def least_pages(pages, holding, greatest=max, least=min, up=lambda n: -(-n // SHARE)):
    """Pages (numbers or columns) that must hold a text at a slot for it to be template: of `pages` of the host, `holding` have the slot."""
    return greatest(least(3, pages), up(holding))


class Wrapper:
    """What is known of a host: its reference page, template units and content region."""

    def __init__(self, reference: str, units: set[int] | frozenset[int], varying: dict[int, int]):
        self.tree, self.units = Tree(index(parse(reference))), frozenset(units)
        self.region = set(region(self.tree, varying))

    def roots(self, dom: Node) -> list[Node]:
        """The page's nodes aligned with the region, in page order; judged without the wrapper if there are none."""
        if not self.region:
            return _roots(dom)
        tree = Tree(dom)
        held = {id(x) for x, b in zip(tree.nodes, match(tree, self.tree)) if b in self.region}
        return [x for x in _in_page_order(dom) if id(x) in held and x.size] or _roots(dom)


def _in_page_order(dom: Node):
    stack = [dom]
    while stack:
        x = stack.pop()
        yield x
        if not x.dropped:
            stack.extend(k for k in reversed(x.kids) if not isinstance(k, str))


def page_text(page: str | None, wrapper: Wrapper | None) -> str:
    """The main text of a page, given its host's wrapper."""
    if not page:
        return ""
    dom = index(parse(page))
    blocks = [b for r in (wrapper.roots(dom) if wrapper else _roots(dom)) for b in _blocks(r)]
    return without(blocks, wrapper.units if wrapper else frozenset())


def induce(pages: list[str]) -> Wrapper | None:
    """The wrapper of one host from all its pages; none without two different ones."""
    distinct = sorted(set(pages), key=lambda p: (_digest(p), p))
    if len(distinct) < 2:
        return None
    reference = Tree(index(parse(distinct[0])))
    told = dict(tell(index(parse(p)), reference) for p in pages)
    count, letters, places = Counter(), Counter(), {}
    for held in told.values():
        for slot, unit, size, anchor in held:
            count[slot, unit] += 1
            letters[slot, unit] = letters[slot, unit] + size if unit == 1 else max(letters[slot, unit], size)
            places[slot, unit] = min(places.get((slot, unit), anchor), anchor)
    template = [(s, u) for (s, u), n in count.items() if u not in (0, 1) and n > 1 and n >= least_pages(count[0, 0], count[s, 0])]
    varying = {s: n for (s, u), n in letters.items() if u == 1}
    for k in template:
        varying[places[k]] = varying.get(places[k], 0) - count[k] * letters[k]
    return Wrapper(distinct[0], {u for _, u in template}, varying)


def extract(page: str | None, references: list[str | None] = ()) -> str:
    """The main text of a page, given other pages of its host."""
    return page_text(page, induce([p for p in (page, *references) if p]))


#: Templates of all hosts together go to every executor if they are no more bytes than this.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    """The host of a URL, lower case; null without one."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def wrappers(rows: DataFrame) -> DataFrame:
    """host, ref, units, varying (list of (node, letters)) of each host with two different pages, from all of them, as `induce`."""
    own = rows.where("host IS NOT NULL AND html != ''")
    digest = F.xxhash64("html")
    refs = own.groupBy("host").agg(F.min_by("html", digest).alias("ref"), (F.min(digest) != F.max(digest)).alias("several")).where("several").select("host", "ref")
    refs = materialize(refs)
    size = refs.agg(F.sum(F.length("ref"))).first()[0] or 0
    joined = own.join(F.broadcast(refs) if size <= BROADCAST_BYTES else refs, "host")
    kind = pa.list_(pa.struct([("slot", pa.int64()), ("unit", pa.int64()), ("letters", pa.int64()), ("anchor", pa.int64())]))

    def run(batches):
        trees: dict[str, Tree] = {}
        for batch in batches:
            told = []
            for page, ref in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if ref not in trees:
                    if len(trees) == 128:
                        trees.clear()
                    trees[ref] = Tree(index(parse(ref)))
                told.append(tell(index(parse(page)), trees[ref]))
            found = [[{"slot": s, "unit": u, "letters": n, "anchor": a} for s, u, n, a in held] for _, held in told]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([seen for seen, _ in told], pa.int64()), pa.array(found, kind)], names=["host", "seen", "found"])

    told = joined.select("host", "html", "ref").mapInArrow(run, "host string, seen bigint, found array<struct<slot:bigint,unit:bigint,letters:bigint,anchor:bigint>>")
    held = told.groupBy("host", "seen").agg(F.first("found").alias("found")).select("host", F.inline("found"))  # pages of one hash tell the same
    held = held.groupBy("host", "slot", "unit").agg(F.count("*").alias("n"), F.max("letters").alias("letters"), F.sum("letters").alias("sum"), F.min("anchor").alias("anchor"))
    counts = materialize(held.where("n > 1 OR unit = 1"))
    of_host = counts.where("slot = 0 AND unit = 0").select("host", F.col("n").alias("pages"))
    of_slot = counts.where("slot != 0 AND unit = 0").select("host", "slot", F.col("n").alias("holding"))
    least = least_pages(F.col("pages"), F.col("holding"), F.greatest, lambda n, p: F.least(F.lit(n), p), lambda n: F.ceil(n / SHARE))
    template = materialize(counts.where("unit NOT IN (0, 1)").join(of_slot, ["host", "slot"]).join(of_host, "host").where(F.col("n") >= least).select("host", "unit", "anchor", (F.col("n") * F.col("letters")).alias("fixed")))
    varying = counts.where("unit = 1").select("host", F.col("slot").alias("node"), "sum").unionByName(template.select("host", F.col("anchor").alias("node"), (-F.col("fixed")).alias("sum")))
    varying = varying.groupBy("host", "node").agg(F.sum("sum").alias("n")).groupBy("host").agg(F.collect_list(F.struct("node", "n")).alias("varying"))
    return materialize(refs.join(template.groupBy("host").agg(F.collect_set("unit").alias("units")), "host", "left").join(varying, "host", "left"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumn("host", F.nullif(host_of(F.col("url")), F.lit("")))
    induced = wrappers(rows)
    size = induced.agg(F.sum(F.length("ref") + 8 * F.coalesce(F.size("units"), F.lit(0)) + 16 * F.coalesce(F.size("varying"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        induced = F.broadcast(induced)  # no page is shuffled; beyond the bound a skew-aware shuffle join
    joined = rows.join(induced, "host", "left").select("page_id", "url", "html", "host", "ref", "units", "varying")

    def run(batches):
        held: dict[str | None, Wrapper | None] = {}
        for batch in batches:
            texts = []
            for k, (page, own) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if own not in held:
                    if len(held) == 128:
                        held.clear()
                    ref, units, varying = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                    held[own] = Wrapper(ref, frozenset(units or ()), {v["node"]: v["n"] for v in varying or ()}) if ref else None
                texts.append(page_text(page, held[own]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = dict(pages.dtypes)
    out = joined.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
