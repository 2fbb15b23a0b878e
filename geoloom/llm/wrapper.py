"""Main text of web pages by wrapper induction.

Pages of one host share a template. One page of each host is its reference:
that of the least id among the pages whose upper tree (the labels of its first
``TOP`` levels, repeats left out) is the most common of the host; pages without
elements come last. Every page's tree of block elements is aligned with its
reference by simple tree matching: the largest top-down, order-keeping
matching, found over lists of children by dynamic programming. Equal subtrees
are matched at once and each pair of different ones is compared once, so long
tables of like rows cost no more than their length.

Over all pages of the host each reference node counts how often it was matched,
how often with the same text, how many texts it had (a bitmap of ``BITS`` bits)
and how much of its text was linked. Nodes that stay the same are template;
nodes that take few texts in turn are no content either; the others are slots. Evidence finds
the content before names do. The content root grows from the element with most varying, unlinked text
(``content_root``). A page is then aligned once more, and its text is what lies
in the content root, without template nodes. Outside an article or main element
lists of links and slots of few texts go too.

Names only decide what alignment leaves open: elements and roles that HTML
itself defines as navigation, footer, aside or form are no content. Class names made of
words for adverts, menus or reader comments (``_STRONG``) reject a varying slot inside the
content root as long as other content remains, since readers' comments vary as articles do;
words that may mean either (``_WEAK``: related, notice, social) reject only what is
template, a pool or links for the most part. Paragraphs, headings and list items of fixed text
stay where they stand between varying siblings (``among_content``). Hosts with fewer than
``MIN_PAGES`` pages besides the reference have no template; their pages are
judged each by itself, by the same rules with all text taken as varying.

Evidence is summed inside each task, so a host with a third of all pages
sends a few rows. References and wrappers of the hosts with most pages are
broadcast, as many as ``BROADCAST_BYTES`` hold (counted first); pages of the
other hosts, of which none is large, are shuffled to theirs.

Defined results: a null page is empty and has an empty text; pages without
host form a group of their own; rows with a repeated id are extracted each by
itself; extra columns are not read; an empty table gives an empty one; damaged
markup (unclosed elements, pages cut off anywhere, stray brackets) is read as
far as it goes: only the code of an unclosed script or style is left out; trees
may be of any depth and width. Where nearly all of the root's text is the
same on all pages, the pages are copies of one article and nothing is template.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

#: A node is template if at least this share of its matches have its text,
MIN_SAME = 0.9
#: and at least this many pages other than copies of the reference match it.
MIN_PAGES = 8
#: A node with this share of different texts, or less, shows a few in turn.
MAX_POOL = 0.4
#: Share of linked text from which a list of three links and more is a menu.
MAX_LINKED = 0.6
#: An ancestor with so many times the text holds the content.
GROWTH = 1.5
#: Bits that count the texts of a node (four words).
BITS = 256
BROADCAST_BYTES = 8 << 20
#: Levels of a page's tree whose labels tell whole pages from damaged ones.
TOP = 4
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|<[a-zA-Z/!?][^>]*\Z|<[a-zA-Z/][^>]*>|[^<]+|<", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?([a-zA-Z]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORD = re.compile(r"[a-z]+")
# Names of HTML elements and usual class words.
_RAW = {"script", "style", "textarea", "title", "iframe"}
_FOREIGN = {"svg", "object", "select", "noscript", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_NO_CONTENT = {"nav", "footer", "aside", "form", "button", "head", "dialog", "menu"}
_NO_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
_TITLES, _CELLS = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "dt", "td", "th", "caption"}
_WRITING = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "dd", "figcaption"}
# What readers call no part of an article wherever it stands, and what may be either.
_STRONG = {"ad", "ads", "advert", "advertisement", "adsense", "sponsor", "sponsored", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead", "cookie", "cookies", "consent", "popup", "modal", "newsletter", "subscribe", "comments", "comment", "disqus", "replies", "respond", "pagination", "pager", "contentinfo", "complementary"}
_WEAK = {"promo", "banner", "menu", "widget", "topbar", "notice", "alert", "overlay", "signup", "login", "share", "sharing", "social", "related", "recommended", "toolbar", "search"}
_NEUTRAL = {"area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "global", "group", "holder", "icon", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post", "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "top", "unit", "wrap", "wrapper", "zone"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Node:
    """A block element. ``items`` are texts and child nodes in page order.

    ``bad``: HTML itself says that it is no content; ``doubt``: how much class words
    say so (``doubtful``). ``links``, ``linked``: its own links and the length of their text.
    """

    __slots__ = ("tag", "label", "bad", "doubt", "items", "kids", "index", "form", "links", "linked")

    def __init__(self, tag: str, names: str = "", bad: bool = False, doubt: int = 0):
        self.tag, self.label, self.bad, self.doubt = tag, f"{tag} {names}", bad, doubt
        self.items: list = []
        self.kids: list[Node] = []
        self.index = self.form = -1
        self.links = self.linked = 0

    def text(self) -> str:
        """The node's own text, without that of child blocks."""
        return " ".join("".join(x if isinstance(x, str) else " " for x in self.items).split())


def _closed(page: str, tag: str) -> dict[int, int]:
    """Where the elements of a foreign tag start and end, without self-closed and unclosed ones."""
    out, opened = {}, []
    for m in re.finditer(rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?){tag}(?=[\s/>])((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>", page, re.I | re.S):
        if m[3] is None:
            continue
        if not m[2]:
            if not m[3].endswith("/"):
                opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def doubtful(names: str, inside: bool) -> int:
    """2: a class word says that an element is no content; 1: it may be none; 0: nothing says so.

    Only a name counts that consists of such words and of neutral ones, so "related-links"
    does and "social-history" does not.
    """
    found = 0
    for name in names.split():
        words = set(_WORD.findall(name))
        strong = words & _STRONG or "header" in words and not inside
        if words - _STRONG - _WEAK - _NEUTRAL - {"header"}:
            continue
        found = max(found, 2 if strong else 1 if words & _WEAK else 0)
    return found


def parse(page: str) -> Node:
    """The tree of block elements of a page; inline elements are their text."""
    root = Node("#page")
    stack, at = [root], 0
    where: dict[str, list[int]] = {}  # the places in the stack of the open elements of each tag
    closed: dict[str, dict[int, int]] = {}
    unclosed: dict[str, int] = {}  # raw tags that are not closed from a place on
    link = False

    def last(tag: str) -> int:
        places = where.get(tag)
        return places[-1] if places else 0

    def close(k: int) -> None:
        for n in stack[k:]:
            where[n.tag].pop()
        del stack[k:]

    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                text = entities.unescape(text) if "&" in text else text
                stack[-1].items.append(text)
                if link:
                    stack[-1].linked += len(" ".join(text.split()))
            elif text.startswith("<![CDATA["):
                stack[-1].items.append(text[9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                link = not m[1]
                stack[-1].links += link
            continue
        link = link and tag == "br"
        if m[1]:
            if k := last(tag):
                close(k)
            continue
        if tag in _VOID:
            stack[-1].items.append(" ")
            continue
        if tag in _RAW and tag not in unclosed:
            if end := re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(page, at):
                at = end.end()
                continue
            unclosed[tag] = at
        if tag in ("script", "style"):  # code up to the page's end
            break
        if tag in _FOREIGN:
            if tag not in closed:
                closed[tag] = _closed(page, tag)
            if m.start() in closed[tag]:
                at = closed[tag][m.start()]
                continue
        if (tag in _FOREIGN or tag in _RAW) and m[3].endswith("/"):
            stack[-1].items.append(" ")
            continue
        if tag in _CLOSES_P and (k := last("p")) and k >= len(stack) - 4:
            close(k)
        elif tag in _SAME_CLOSES:
            same = ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)
            if (k := max(map(last, same))) > max(map(last, _SAME_CLOSES[tag])):
                close(k)
        names, bad, doubt = "", tag in _NO_CONTENT, 0
        inside = last("article") > 0 or last("main") > 0
        if m[3]:
            names = " ".join(x for g in _NAMES.findall(m[3]) for x in g if x).lower()
            role = _ROLE.search(m[3])
            bad = bad or bool(_HIDDEN.search(m[3])) or bool(role) and role[1].lower() in _NO_ROLES
            doubt = 0 if tag in ("html", "body", "main", "article") else doubtful(names, inside)
        if tag == "header" and not inside:
            bad = True
        node = Node(tag, names, bad, doubt)
        stack[-1].items.append(node)
        stack[-1].kids.append(node)
        where.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        n.index = len(out)
        out.append(n)
        todo += n.kids[::-1]
    return out


def signature(root: Node) -> tuple[int, int]:
    """(hash, number) of the distinct labels of each of the upper levels, in order of appearance."""
    labels, level = [], [root]
    for k in range(1, TOP + 1):
        level = [n for p in level for n in p.kids]
        labels += [f"{k} {x}" for x in dict.fromkeys(n.label for n in level)]
    return int.from_bytes(hashlib.blake2b("\n".join(labels).encode(), digest_size=8).digest(), "big", signed=True), len(labels)


class Forms:
    """Forms of subtrees (label and forms of the children) as integers, and the
    best matching of two forms. Equal subtrees share a form, so a repeated
    table row or paragraph is compared once."""

    def __init__(self):
        self.ids: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.kids: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.noted = 0  # entries of pairs

    def note(self, nodes: list[Node]) -> None:
        """Sets the form of each node of a tree (numbered, in page order)."""
        for n in reversed(nodes):
            key = (n.label, *(k.form for k in n.kids))
            form = self.ids.get(key)
            if form is None:
                form = self.ids[key] = len(self.labels)
                self.labels.append(n.label)
                self.kids.append(np.array(key[1:], np.int64))
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
            n.form = form

    def score(self, a: int, b: int) -> int | None:
        """The pairs of the best matching of two forms, if it needs no more work."""
        if a == b:
            return self.sizes[a]
        if self.labels[a] != self.labels[b]:
            return 0
        if not len(self.kids[a]) or not len(self.kids[b]):
            return 1
        return self.memo.get((a, b))

    def matched(self, a: int, b: int) -> list[tuple[int, int]]:
        """The places of matched children of two forms."""
        found = self.pairs.get((a, b))
        if found is None:
            x, y = self.kids[a], self.kids[b]
            pairs = pairs_of(x, y, self)
            found = self.pairs[a, b] = [(i, j) for i, j in pairs if self.labels[x[i]] == self.labels[y[j]]]
            self.noted += len(found)
        return found

    def gains(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matrix over the distinct forms, rows of x, columns of y) of known scores."""
        p, row = np.unique(x, return_inverse=True)
        q, col = np.unique(y, return_inverse=True)
        return np.array([[self.score(s, t) for t in q.tolist()] for s in p.tolist()], np.int64), row, col

    def fill(self, x: np.ndarray, y: np.ndarray) -> None:
        """Finds the scores of all forms of x with those of y, by a stack of its own, as trees may be of any depth."""
        todo = [(s, t) for s in set(x.tolist()) for t in set(y.tolist()) if self.score(s, t) is None]
        while todo:
            a, b = todo[-1]
            if (a, b) in self.memo:
                todo.pop()
                continue
            lo, n, m = ends(self.kids[a], self.kids[b])
            p, q = self.kids[a][lo:n], self.kids[b][lo:m]
            deeper = [(s, t) for s in set(p.tolist()) for t in set(q.tolist()) if self.score(s, t) is None]
            if deeper:
                todo += deeper
                continue
            same = sum(self.sizes[k] for k in self.kids[a][:lo].tolist()) + sum(self.sizes[k] for k in self.kids[a][n:].tolist())
            self.memo[a, b] = 1 + same + (int(last_row(*self.gains(p, q))[-1]) if len(p) and len(q) else 0)
            todo.pop()


def ends(x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(lo, n, m): x[:lo] equals y[:lo] and x[n:] equals y[m:]; equal ends are part of a best matching."""
    k = min(len(x), len(y))
    differ = np.flatnonzero(x[:k] != y[:k])
    lo = int(differ[0]) if len(differ) else k
    k -= lo
    differ = np.flatnonzero(x[len(x) - k :][::-1] != y[len(y) - k :][::-1])
    tail = int(differ[0]) if len(differ) else k
    return lo, len(x) - tail, len(y) - tail


def last_row(gain: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Best sums of all rows with the first 0, 1, ... columns, in order."""
    best = np.zeros(len(col) + 1, np.int64)
    for r in row:
        step = best.copy()
        np.maximum(best[1:], best[:-1] + gain[r][col], out=step[1:])
        best = np.maximum.accumulate(step)
    return best


def pairs_of(x: np.ndarray, y: np.ndarray, forms: Forms) -> list[tuple[int, int]]:
    """The pairs (place in x, place in y) of a best order-keeping matching of two lists of forms.

    Halves of x are solved with the part of y that suits them best, so the
    memory is linear in the lists at any length.
    """
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, n, j, m = todo.pop()
        lo, hi_x, hi_y = ends(x[i:n], y[j:m])
        out += [(i + k, j + k) for k in range(lo)] + [(i + k, j + k + hi_y - hi_x) for k in range(hi_x, n - i)]
        i, n, j, m = i + lo, i + hi_x, j + lo, j + hi_y
        if i == n or j == m:
            continue
        forms.fill(x[i:n], y[j:m])
        gain, row, col = forms.gains(x[i:n], y[j:m])
        if n - i == 1:
            found = gain[row[0]][col]
            if found.max() > 0:
                out.append((i, j + int(found.argmax())))
            continue
        half = (n - i) // 2
        cut = int((last_row(gain, row[:half], col) + last_row(gain, row[half:][::-1], col[::-1])[::-1]).argmax())
        todo += [(i, i + half, j, j + cut), (i + half, n, j + cut, m)]
    return sorted(out)


def align(a: Node, b: Node, forms: Forms | None = None) -> list[tuple[Node, Node]]:
    """The pairs of the best matching of two trees with equal root labels; given
    ``forms`` already hold ``a``."""
    if forms is None:
        forms = Forms()
        forms.note(number(a))
    forms.note(number(b))
    out, todo = [], [(a, b)]
    while todo:
        p, q = todo.pop()
        out.append((p, q))
        if p.kids and q.kids:
            if p.form == q.form:
                todo += zip(p.kids, q.kids)
            else:
                todo += [(p.kids[i], q.kids[j]) for i, j in forms.matched(p.form, q.form)]
    return out


class Wrapper(NamedTuple):
    """What is known of a reference: the content root, nodes whose text is
    template, nodes whose own text goes whatever it is, whole nodes that go, and
    whether class words count."""

    root: int
    constant: list[bool]
    hollow: list[bool]
    drop: list[bool]
    doubts: bool


def alone(nodes: list[Node]) -> list[dict]:
    """The evidence of a page taken by itself: all its text varies."""
    return [{"matched": 1, "same": 0, "filled": 1, "distinct": 1.0, "length": len(n.text()), "linked": n.linked, "links": n.links} for n in nodes]


def induce(ref: list[Node], stats: list[dict]) -> Wrapper:
    """The wrapper of a reference from the evidence of each of its nodes."""
    pages = max(1, stats[0]["matched"])
    constant = [s["matched"] >= MIN_PAGES and s["same"] >= MIN_SAME * s["matched"] for s in stats]
    pool = [s["filled"] >= MIN_PAGES and s["distinct"] <= MAX_POOL * s["filled"] for s in stats]
    own = [0.0 if c or p else max(0, s["length"] - s["linked"]) / pages for c, p, s in zip(constant, pool, stats)]
    doubts = True
    root, total = content_root(ref, own, [n.bad or n.doubt > 0 for n in ref])
    if not total and any(n.doubt for n in ref):
        doubts = False
        root, total = content_root(ref, own, [n.bad for n in ref])
    inside = subtree(ref, root)
    if 10 * total < sum(len(ref[i].text()) for i in inside if constant[i]):
        constant = [False] * len(ref)
    named, judged = ref[root].tag in ("article", "main"), pages >= MIN_PAGES
    sums = [[s["length"] / pages, s["linked"] / pages, s["links"] / pages, w] for s, w in zip(stats, own)]
    for n in reversed(ref):
        sums[n.index] = [a + sum(sums[k.index][j] for k in n.kids) for j, a in enumerate(sums[n.index])]
    drop, hollow = [n.bad for n in ref], [False] * len(ref)
    for n in ref:
        length, linked, links, varying = sums[n.index]
        if doubts and n.doubt:  # a weak word needs evidence where there can be some
            drop[n.index] = n.doubt > 1 or not (judged or named) or 2 * varying <= length
        if not named and n.kids and n.index in inside and n.index != root and linked > MAX_LINKED * length and links >= 3:
            drop[n.index] = True
    fixed = [c or p and not named for c, p in zip(constant, pool)]
    for i in among_content(ref, inside, own, [w for _, _, _, w in sums], drop, fixed, named):
        constant[i] = pool[i] = False
    if not named:
        hollow = pool
    return Wrapper(root, constant, hollow, drop, doubts)


def among_content(ref: list[Node], inside: range, own: list[float], varying: list[float], drop: list[bool], fixed: list[bool], named: bool) -> list[int]:
    """The nodes of fixed text that are part of the article: paragraphs, headings, list items and cells with
    varying siblings before and after them, one of them a plain block of text; in an article or main
    element also a heading right before varying text."""
    out = []
    for parent in ref[inside.start : inside.stop]:
        kids = [k for k in parent.kids if not drop[k.index]]
        plain = any(own[k.index] and not k.kids for k in kids)
        for at, k in enumerate(kids):
            if not fixed[k.index] or k.tag not in _WRITING | _CELLS:
                continue
            before = any(varying[x.index] for x in kids[:at])
            after = any(varying[x.index] for x in kids[at + 1 :])
            title = named and k.tag in _TITLES and at + 1 < len(kids) and varying[kids[at + 1].index]
            if title or plain and before and after:
                out.append(k.index)
    return out


def subtree(ref: list[Node], top: int) -> range:
    """The indexes of a node and all nodes below it."""
    last = ref[top]
    while last.kids:
        last = last.kids[-1]
    return range(top, last.index + 1)


def content_root(ref: list[Node], own: list[float], rejected: list[bool]) -> tuple[int, float]:
    """(index of the node that holds the content, weight of the content in it).

    ``own`` is the weight of each node's own text; what lies under a rejected node has
    none. The element whose own and childless children's weight is greatest is
    the kernel. It grows to an ancestor that adds text in headings, paragraphs and
    the like, or half of its weight in any element. The only article (else
    main) element above or below the one found takes its place if a quarter of all is in it.
    """
    up, dead = [-1] * len(ref), list(rejected)
    for n in ref:
        for k in n.kids:
            up[k.index] = n.index
            dead[k.index] = dead[k.index] or dead[n.index]
    own = [0.0 if d else w for d, w in zip(dead, own)]
    total, prose = own[:], [w * (n.tag in _WRITING) for n, w in zip(ref, own)]
    for i in range(len(ref) - 1, 0, -1):
        total[up[i]] += total[i]
        prose[up[i]] += prose[i]
    if not total[0]:
        return 0, 0.0
    kernel = [own[n.index] + sum(own[k.index] for k in n.kids if not k.kids) if n.kids or not n.index else 0.0 for n in ref]
    best = at = max(range(len(ref)), key=lambda i: (kernel[i], -i))
    for at in above(up, at):
        if prose[at] > prose[best] or total[at] >= GROWTH * total[best]:
            best = at
    for tag in ("article", "main"):
        named = [n.index for n in ref if n.tag == tag and total[n.index] and not any(ref[a].tag == tag for a in above(up, n.index))]
        if len(named) == 1 and total[named[0]] >= 0.25 * total[0] and (best == named[0] or best in above(up, named[0]) or named[0] in above(up, best)):
            return named[0], total[named[0]]
    return best, total[best]


def above(up: list[int], at: int) -> Iterator[int]:
    while up[at] >= 0:
        at = up[at]
        yield at


def blocks(node: Node, drop: set[int], doubts: bool = True) -> list[str]:
    """Texts of the blocks under a node, in page order, without dropped nodes; of nodes that
    the reference lacks a strong class word rejects."""
    out: list[str] = []
    todo: list = [node]
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    while todo:
        x = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif x is node or not (id(x) in drop or x.bad or doubts and x.doubt > 1):
            flush()
            todo.append(None)
            todo += x.items[::-1]
        else:
            flush()
    flush()
    return out


def extract(page: str, ref: list[Node] | None, constant: list[bool], root: int, wrapper: Wrapper | None = None, forms: Forms | None = None) -> str:
    """The main text of a page, given its host's reference and wrapper.

    Without a wrapper, or where that has no content root (-1), the page is judged by
    itself.
    """
    tree = parse(page)
    wrapper = wrapper or Wrapper(root, constant, [False] * len(constant), [False] * len(constant), True)
    drop, start = set(), None
    if ref is not None and wrapper.root >= 0:
        for r, n in align(ref[0], tree, forms):
            if r.index == wrapper.root:
                start = n
            if wrapper.hollow[r.index] or wrapper.constant[r.index] and n.text() == r.text():
                n.items = [x for x in n.items if not isinstance(x, str)]
            if wrapper.drop[r.index]:
                drop.add(id(n))
    if start is None:
        nodes = number(tree)
        wrapper = induce(nodes, alone(nodes))
        start, drop = nodes[wrapper.root], {id(n) for n, d in zip(nodes, wrapper.drop) if d}
    return " ".join(blocks(start, drop, wrapper.doubts))


class _Refs:
    """Parsed references of the hosts seen by a task (a bounded number), and their forms."""

    def __init__(self):
        self.held: dict[str, list[Node]] = {}
        self.wrappers: dict[str, Wrapper] = {}
        self.forms = Forms()

    def get(self, host: str, page: str) -> list[Node]:
        if len(self.held) > 200 or len(self.forms.labels) + len(self.forms.memo) + self.forms.noted > 200_000:
            self.__init__()
        if host not in self.held:
            self.held[host] = number(parse(page))
            self.forms.note(self.held[host])
        return self.held[host]


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the signature of each page's tree (shape, labels) in place of the page."""
    for batch in batches:
        found = [signature(parse(page.as_py() or "")) for page in batch.column(0)]
        cols = [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int32())]
        yield pa.RecordBatch.from_arrays([*cols, *batch.columns[1:]], ["shape", "labels", *batch.schema.names[1:]])


def references(pages: DataFrame) -> DataFrame:
    """(host, n, sample): the number of pages and the reference page of each host of pages
    (page_id, html, host) with more than ``MIN_PAGES`` pages."""
    key = F.struct("page_id", F.length("html").alias("size"), F.xxhash64("html").alias("hash"))
    keyed = pages.select("html", "host", "page_id", key["size"].alias("size"), key["hash"].alias("hash"))
    fields = {f.name: f.dataType.simpleString() for f in keyed.schema}
    shapes = keyed.mapInArrow(_shapes, "shape long, labels int, " + ", ".join(f"{k} {fields[k]}" for k in ("host", "page_id", "size", "hash")))
    counts = shapes.groupBy("host", "shape", "labels").agg(F.count("*").alias("n"), F.min(F.struct("page_id", "size", "hash")).alias("first"))
    rank = F.struct(F.col("labels") > 0, "n", "labels", "shape")
    picked = counts.groupBy("host").agg(F.sum("n").alias("n"), F.max_by("first", rank).alias("first")).where(F.col("n") > MIN_PAGES)
    p = runtime.written(picked.select(F.col("host").alias("__host"), "n", "first.*").withColumnsRenamed({"page_id": "__id", "size": "__size", "hash": "__hash"}), "wrapper-picks")
    maybe, _ = runtime.split_by_bitmap(keyed, "hash", runtime.bitmap(p, "__hash"))
    same = (F.col("host") == F.col("__host")) & F.col("page_id").eqNullSafe(F.col("__id")) & F.col("size").eqNullSafe(F.col("__size")) & F.col("hash").eqNullSafe(F.col("__hash"))
    return maybe.join(p, same).groupBy("host").agg(F.max("n").alias("n"), F.min("html").alias("sample"))


_COUNTS = ("matched", "same", "filled", "length", "linked", "links")
_EVIDENCE = "host string, node int, " + ", ".join(f"{c} long" for c in _COUNTS) + ", b0 long, b1 long, b2 long, b3 long"


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's pages for each node of each reference."""
    refs, sums = _Refs(), {}
    names = ["host", "node", *_COUNTS, "b0", "b1", "b2", "b3"]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 10]

    def flush() -> pa.RecordBatch:
        words = lambda bits: [((bits >> 64 * k & (1 << 64) - 1) ^ 1 << 63) - (1 << 63) for k in range(4)]
        rows = [(host, i, *s[:6], *words(s[6])) for host, nodes in sums.items() for i, s in enumerate(nodes) if s[0]]
        sums.clear()
        cols = list(zip(*rows)) or [()] * 12
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        for host, page, sample in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            page, sample = page.as_py() or "", sample.as_py() or ""
            ref = refs.get(host, sample)
            if page == sample:
                continue
            found = sums.setdefault(host, [[0] * 7 for _ in ref])
            for r, n in align(ref[0], parse(page), refs.forms):
                text, s = n.text(), found[r.index]
                s[0] += 1
                s[1] += text == r.text()
                s[2] += text != ""
                s[3] += len(text)
                s[4] += n.linked
                s[5] += n.links
                if text:
                    s[6] |= 1 << int.from_bytes(hashlib.blake2b(text.encode(errors="surrogatepass"), digest_size=2).digest()) % BITS
        if len(sums) > 500:
            yield flush()
    yield flush()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of rows (page_id, url, html, host, sample, stats); without a sample a page is judged by itself."""
    refs = _Refs()
    for batch in batches:
        texts = []
        for host, page, sample, stats in zip(batch.column(3).to_pylist(), batch.column(2), batch.column(4), batch.column(5)):
            page, sample = page.as_py() or "", sample.as_py()
            if sample is None:
                texts.append(extract(page, None, [], -1))
                continue
            ref = refs.get(host, sample)
            if host not in refs.wrappers:  # made once for each reference
                refs.wrappers[host] = _wrapper(ref, stats.as_py() or ())
            wrapper = refs.wrappers[host]
            texts.append(extract(page, ref, [], -1, wrapper, refs.forms))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _wrapper(ref: list[Node], stats: list[dict]) -> Wrapper:
    none = dict.fromkeys(_COUNTS, 0) | {"distinct": 0.0}
    by_node = {s["node"]: s | {"distinct": _distinct(s)} for s in stats}
    wrapper = induce(ref, [by_node.get(i, none) for i in range(len(ref))])
    # a reference below whose root nothing varies says nothing of where the content is
    useful = by_node.get(0, none)["matched"] >= MIN_PAGES and any(s["length"] and s["same"] < s["matched"] for i, s in by_node.items() if i)
    return wrapper if useful else wrapper._replace(root=-1)


def _distinct(s: dict) -> float:
    """The number of different texts, estimated from the bits that are set."""
    empty = BITS - sum((s[f"b{k}"] & (1 << 64) - 1).bit_count() for k in range(4))
    return -BITS * math.log(empty / BITS) if empty else math.inf


def _with_references(pages: DataFrame, refs: DataFrame, size: str) -> DataFrame:
    """``pages`` with the columns of their host's reference, null for hosts without.

    The references of the hosts with most pages are broadcast, down to the power of
    two of pages at which they would exceed ``BROADCAST_BYTES``.
    """
    totals = refs.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.sum(F.expr(size)).alias("bytes")).orderBy(F.desc("power")).collect()
    held, edge = 0, None
    for row in totals:
        held += row.bytes
        if held > BROADCAST_BYTES:
            edge = 2 ** (row.power + 1)
            break
    refs = refs.withColumnRenamed("host", "__host")
    same = F.col("host") == F.col("__host")
    if edge is None:
        return pages.join(F.broadcast(refs), same, "left").drop("__host", "n")
    large, small = refs.where(F.col("n") >= edge), refs.where(F.col("n") < edge)
    names = F.broadcast(large.select("__host"))
    shuffled, lone = runtime.split_by_bitmap(pages.join(names, same, "left_anti"), "host", runtime.bitmap(small, "__host"))
    parts = [pages.join(F.broadcast(large), same), shuffled.join(small, same, "left")]
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in refs.schema if f.name not in ("__host", "n")]
    return parts[0].unionByName(parts[1]).drop("__host", "n").unionByName(lone.select("*", *empty))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of ``pages``."""
    pages = runtime.bounded_batches(pages)
    host = F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    refs = runtime.written(references(pages), "wrapper-references")
    aligned = _with_references(pages, refs, "coalesce(length(sample), 0) + 100").where("sample is not null")
    evidence = aligned.select("host", "html", "sample").mapInArrow(_evidence, _EVIDENCE)
    sums = evidence.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in _COUNTS], *[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(4)])
    stats = sums.groupBy("host").agg(F.collect_list(F.struct("node", *_COUNTS, "b0", "b1", "b2", "b3")).alias("stats"))
    wrappers = runtime.written(refs.join(stats, "host", "left"), "wrappers")
    texts = _with_references(pages, wrappers, "coalesce(length(sample), 0) + 100 + 100 * coalesce(size(stats), 0)").select("page_id", "url", "html", "host", "sample", "stats")
    texts = texts.mapInArrow(_extract, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
