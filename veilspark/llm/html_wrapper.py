"""Wrappers: union-free regular expressions over the token streams of a host's pages.

A wrapper is a sequence of nodes: a text slot, an element with a sequence inside, or a
group; each may be optional or repeated. Two wrappers (a page is one) are aligned level by
level. Texts that differ become slots and equal ones stay constants; tokens without a
partner become optional; squares, equal runs of neighbours, become repeated groups. A
sequence that grows past WIDTH becomes one repeated group of optional nodes, and a wrapper
past NODES is cut at the depth where it fits, so wrappers are bounded whatever the pages.

Nodes are lists, so that they are stored as JSON:
  ["#", quantifier, constant text's hash or null, characters, characters in links, hashes of up to PAGES pages]
  [label, quantifier, sequence or null (cut)]       an element
  ["(", quantifier, sequence]                       a group
  ["*", 3, sequence]                                a repeated group of optional nodes, any order
"""

from __future__ import annotations

import hashlib
import html
from collections.abc import Callable

from .html_tree import BLOCKS, CELLS, Element, Link

OPTIONAL, REPEATED = 1, 2
#: Nodes of a sequence; nodes of a wrapper; neighbours of a square; pages that a text is known from.
WIDTH, NODES, SQUARE, PAGES = 64, 4000, 4, 3
#: Names that custom elements share in a sequence of many labels.
OTHER = "other"


def squeezed(text: str) -> str:
    """Character references decoded, white space as single spaces, trimmed."""
    return " ".join(html.unescape(text).split())


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7).digest(), "big")


def items(element: Element) -> list[tuple[str, Element | list[str]]]:
    """(label, element) and ("#", neighbouring texts) in order; texts of white space alone are no token."""
    out: list[tuple[str, Element | list[str]]] = []
    for x in element.body:
        if isinstance(x, Element):
            out.append((x.label, x))
        elif out and out[-1][0] == "#":
            out[-1][1].append(x)
        else:
            out.append(("#", [x]))
    return [(k, v) for k, v in out if k != "#" or any(not s.isspace() for s in v)]


def of_page(root: Element, page: int) -> list:
    """A page's own wrapper: a root node."""

    def node(label: str, x: Element | list[str]) -> list:
        if label != "#":
            return [label, 0, collapsed([node(k, v) for k, v in items(x)])]
        text = squeezed("".join(x))
        return ["#", 0, digest(text), len(text), sum(len(s) for s in x if isinstance(s, Link)), [page]]

    return bounded(node("", root))


def key(node: list) -> str:
    return "(" + " ".join(map(key, node[2])) + ")" if node[0] == "(" else node[0]


def merged(a: list, b: list, one_page: bool = False) -> list:
    """Both nodes in one. In a run of one page a node is optional if all are, between pages if any is."""
    q = a[1] & b[1] & OPTIONAL | (a[1] | b[1]) & REPEATED | REPEATED if one_page else a[1] | b[1]
    if a[0] == "#":
        return ["#", q, a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], sorted({*a[5], *b[5]})[:PAGES]]
    return [a[0], q, aligned(a[2], b[2])]


def _loose(nodes: list) -> list:
    """Members of all groups, one by one."""
    return [m for n in nodes for m in (_loose(n[2]) if n[0] in "(*" else [n])]


def any_order(nodes: list) -> list:
    """One repeated group that takes the nodes in any order and number."""

    def gathered(label: Callable[[str], str]) -> dict[str, list]:
        found: dict[str, list] = {}
        for n in _loose(nodes):
            k = label(n[0])
            n = [k, OPTIONAL, *n[2:]]
            found[k] = merged(found[k], n) if k in found else n
        return found

    found = gathered(lambda k: k)
    if len(found) > WIDTH:
        found = gathered(lambda k: k if k == "#" or k in BLOCKS else k.split(".")[0] if k.split(".")[0] in BLOCKS else OTHER)
    return [["*", OPTIONAL | REPEATED, list(found.values())]]


def collapsed(nodes: list) -> list:
    """Neighbours of one label become a repeated node, squares of up to SQUARE neighbours repeated groups."""
    out: list = []
    for n in nodes:
        if out and n[0] not in "(*" and out[-1][0] == n[0]:
            out[-1] = merged(out[-1], n, True)
        else:
            out.append(n)
    for k in range(2, SQUARE + 1):
        i = 0
        while i + k < len(out):
            window = [key(n) for n in out[i : i + k]]
            times = 1
            while [key(n) for n in out[i + times * k : i + times * k + k]] == window:
                times += 1
            if times > 1:
                out[i : i + times * k] = [_repeat(out[i : i + times * k], k)]
            i += 1
    return any_order(out) if len(out) > WIDTH else out


def _repeat(nodes: list, k: int) -> list:
    body = nodes[:k]
    for i in range(k, len(nodes), k):
        body = [merged(a, b) for a, b in zip(body, nodes[i : i + k], strict=True)]
    return ["(", REPEATED, body]


def _grouped(nodes: list, groups: list) -> list:
    """Stretches of `nodes` that repeat one of the other side's groups become that group."""
    for g in groups:
        window, k, i = [key(n) for n in g[2]], len(g[2]), 0
        while i + k <= len(nodes):
            if [key(n) for n in nodes[i : i + k]] == window:
                nodes = [*nodes[:i], ["(", 0, nodes[i : i + k]], *nodes[i + k :]]
            i += 1
    return nodes


def aligned(a: list | None, b: list | None) -> list | None:
    """The sequence that takes what either takes."""
    if a is None or b is None:
        return None
    if any(n[0] == "*" for n in (*a, *b)):
        return any_order([*a, *b]) if a and b else any_order(a or b)
    a, b = _grouped(a, [n for n in b if n[0] == "("]), _grouped(b, [n for n in a if n[0] == "("])
    left, right = [key(n) for n in a], [key(n) for n in b]
    if left == right:
        return [merged(x, y) for x, y in zip(a, b, strict=True)]
    worth = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best = max(worth[i + 1][j], worth[i][j + 1])
            worth[i][j] = max(best, worth[i + 1][j + 1] + (1 if left[i] == "#" else 2)) if left[i] == right[j] else best
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and left[i] == right[j] and worth[i][j] == worth[i + 1][j + 1] + (1 if left[i] == "#" else 2):
            out.append(merged(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and worth[i][j] == worth[i + 1][j]:
            out.append([a[i][0], a[i][1] | OPTIONAL, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], b[j][1] | OPTIONAL, *b[j][2:]])
            j += 1
    return collapsed(out)


def bounded(node: list) -> list:
    """The node, cut at the depth from which on it has no more than NODES nodes."""

    def sizes(n: list, depth: int, into: dict[int, int]) -> dict[int, int]:
        into[depth] = into.get(depth, 0) + 1
        for m in (n[2] or []) if n[0] != "#" else []:
            sizes(m, depth + (n[0] not in "(*"), into)
        return into

    def cut(n: list, left: int) -> list:
        if n[0] == "#":
            return n
        inside = n[0] in "(*"
        return [n[0], n[1], None if n[2] is None or left == 0 and not inside else [cut(m, left - (not inside)) for m in n[2]]]

    total, depth = 0, 0
    for depth, n in sorted(sizes(node, 0, {}).items()):  # noqa: B007
        total += n
        if total > NODES:
            return cut(node, max(0, depth - 1))
    return node


# What names, class names, identifiers and roles say about an element.
ASIDE_NAMES = frozenset("head nav footer aside form dialog menu search select option button".split())
ASIDE_WORDS = frozenset(
    "!hidden ad ads advert advertisement adverts adsense alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disclaimer disqus footer form gdpr "
    "login menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup "
    "social sponsor sponsored subscribe toolbar widget widgets".split()
)
HEADER_WORDS = frozenset("header masthead topbar".split())
MAIN_PAIRS = tuple(map(frozenset, (("article", "body"), ("article", "content"), ("post", "body"), ("post", "content"), ("entry", "content"), ("story", "body"), ("main", "content"), ("page", "content"))))
MAIN_WORDS = frozenset("article content entry main post story".split())
LINK_LISTS = frozenset("ul ol dl div section table td".split())

#: Share of characters in links from which on a list is a menu.
MENU = 0.6

NOT_MAIN, DATA, MAIN, ARTICLE = 0, 1, 2, 3


def level_inside(label: str, level: int) -> int:
    """The level of texts inside an element, from the level around it; NOT_MAIN is final."""
    name, *words = label.split(".")
    found = frozenset(words)
    whole = name in ("html", "body", "article", "main") and not found & {"comment", "comments", "reply"}
    if level == NOT_MAIN or name in ASIDE_NAMES or (found & ASIDE_WORDS and not whole) or "!hidden" in found:
        return NOT_MAIN
    if name == "article":
        return ARTICLE
    if name == "main" or any(p <= found for p in MAIN_PAIRS) or len(found) == 1 and found <= MAIN_WORDS and name not in ("html", "body"):
        return max(level, MAIN)
    return NOT_MAIN if level < MAIN and (name == "header" or found & HEADER_WORDS) else level


class Wrapper:
    """A wrapper that says of each text of its pages whether it belongs to the main text."""

    def __init__(self, root: list):
        self.root = root
        self._next: dict[int, tuple] = {}

    @staticmethod
    def _shares(node: list) -> tuple[int, int]:
        if node[0] == "#":
            return node[3], node[4]
        parts = [Wrapper._shares(m) for m in node[2] or []]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)

    def _automaton(self, sequence: list) -> tuple[list, list[int], list[list[int]]]:
        """(nodes, positions that may come first, positions that may follow each) of a sequence."""
        if id(sequence) in self._next:
            return self._next[id(sequence)]
        leaves: list = []
        follow: list[set[int]] = []

        def walk(nodes: list, q: int, every: bool) -> tuple[bool, list[int], list[int]]:
            """(may be empty, first, last) of nodes in a row, or in any order; repeated if q says so."""
            empty, first, last = True, [], []
            for n in nodes:
                if n[0] in "(*":
                    e, f, z = walk(n[2], n[1], n[0] == "*")
                else:
                    leaves.append(n)
                    follow.append({len(leaves) - 1} if n[1] & REPEATED else set())
                    e, f, z = False, [len(leaves) - 1], [len(leaves) - 1]
                e = e or bool(n[1] & OPTIONAL)
                for x in last:
                    follow[x].update(f)
                first = first + f if empty or every else first
                last = last + z if e or every else z
                empty = empty and e
            if q & REPEATED:
                for x in last:
                    follow[x].update(first)
            return empty or bool(q & OPTIONAL), first, last

        _, first, _ = walk(sequence, 0, False)
        self._next[id(sequence)] = leaves, first, [sorted(f) for f in follow]
        return self._next[id(sequence)]

    def matched(self, labels: list[str], sequence: list) -> list[list | None]:
        """The node that takes each token; None where the sequence does not take the tokens so."""
        if len(sequence) == 1 and sequence[0][0] == "*":
            by = {n[0]: n for n in sequence[0][2]}
            return [by.get(k) or by.get(k.split(".")[0]) or by.get(OTHER) for k in labels]
        leaves, states, follow = self._automaton(sequence)
        back: list[dict[int, int]] = []
        for k in labels:
            now: dict[int, int] = {}
            for s in dict.fromkeys(states) if not back else back[-1]:
                for t in [s] if not back else follow[s]:
                    if leaves[t][0] == k:
                        now.setdefault(t, s)
            if not now:
                by = {n[0]: n for n in reversed(leaves)}
                return [by.get(k) for k in labels]
            back.append(now)
        at, out = min(back[-1], default=-1) if back else -1, []
        for step in reversed(back):
            out.append(leaves[at])
            at = step[at]
        return out[::-1]

    def text(self, root: Element) -> str:
        """The main text of a page: its blocks, one a line."""
        parts: list[tuple[int, str]] = []  # (level, text); -1 between blocks

        def walk(element: Element, node: list | None, level: int) -> None:
            inside = items(element)
            body = node[2] if node else None
            nodes = self.matched([k for k, _ in inside], body) if body is not None else [None] * len(inside)
            menu = False
            if level == DATA and node and element.name in LINK_LISTS:
                chars, links = self._shares(node)
                menu = links > MENU * chars
            for (k, x), n in zip(inside, nodes, strict=True):
                if k == "#":
                    template = level == DATA and n and n[2] is not None and len(n[5]) >= PAGES
                    parts.append((NOT_MAIN if menu or template else level, "".join(x)))
                    continue
                breaks = x.name in BLOCKS and x.name not in CELLS
                parts.append((-1, "") if breaks else (level, " ") if x.name in CELLS else (NOT_MAIN, ""))
                walk(x, n, NOT_MAIN if menu else level_inside(k, level))
                parts.append((-1, "") if breaks else (NOT_MAIN, ""))

        walk(root, self.root, DATA)
        top = max((n for n, s in parts if n > NOT_MAIN and squeezed(s)), default=None)
        blocks, line = [], ""
        for n, s in [*parts, (-1, "")]:
            if n == -1:
                if done := squeezed(line):
                    blocks.append(done)
                line = ""
            elif n == top:
                line += s
        return "\n".join(blocks)
