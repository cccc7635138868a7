"""Web pages as balanced token streams: a forest of labelled elements and texts.

The reader is lenient: unclosed and stray tags are repaired as browsers do for the usual
cases, comments and the contents of scripts and styles go, and nothing else is lost.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object title textarea".split())
BLOCKS = frozenset(
    "html head body article aside nav header footer main section div p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "hr blockquote pre figure figcaption form fieldset address details summary dialog menu center hr search option select button".split()
)
#: What a start tag closes, if it is open inside the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Elements that an unclosed paragraph or list item never reaches out of.
SCOPES = frozenset("table td th button html body article aside nav header footer main section".split())
#: Cells stand in the line of their row.
CELLS = frozenset(["td", "th"])

#: Elements nested deeper stay open as their ancestor at this depth.
DEPTH = 40

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?=[!?])[^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass(slots=True)
class Element:
    """An element; `body` holds elements and texts (a text is a str, a link's text a Link)."""

    name: str
    label: str
    body: list = field(default_factory=list)


class Link(str):
    """Text inside a link."""

    __slots__ = ()


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _element(name: str, attributes: dict[str, str]) -> Element:
    """The element of a start tag; its label is its name and what its class, id or role say, without numbers."""
    if not attributes:
        return Element(name, name)
    words = dict.fromkeys(w.lower() for key in ("role", "id", "class", "itemprop") for w in _WORDS.findall(attributes.get(key, "")) if not w.isdigit())
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display:\s*none", attributes.get("style", "")) is not None
    return Element(name, ".".join([name, *list(words)[:6], *["!hidden"] * hidden]))


def parse(text: str) -> Element:
    """The forest of a page as the body of a root element."""
    root = Element("", "")
    stack, link, at = [root], False, 0
    beyond: dict[str, int] = {}  # open elements that are too deep for the stack
    while at < len(text):
        m = _TOKEN.search(text, at)
        upto = m.start() if m else len(text)
        if upto > at:
            piece = text[at:upto]
            stack[-1].body.append(Link(piece) if link else piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:  # an end tag
            if name == "a":
                link = False
            if beyond.get(name):
                beyond[name] -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in SCOPES and name not in SCOPES:
                    break
            continue
        attributes = m[3] if m[3] is not None else m[6]
        if name in RAW and not attributes.rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(text, at)
            at = end.end() if end else len(text)
            continue
        if name == "br":
            stack[-1].body.append(" ")
            continue
        if name == "a":
            link = True
            continue
        if name in VOID and name != "hr":
            continue
        if name in BLOCKS:
            link = False
            if name not in ("html", "head") and any(x.name == "head" for x in stack[:3]):
                del stack[next(i for i, x in enumerate(stack) if x.name == "head") :]
            shut, bound = CLOSES.get(name, (set(), set()))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p" and name not in ("button", "select", "option"):
                    del stack[i:]
                elif stack[i].name in shut:
                    del stack[i:]
                    break
                elif stack[i].name in bound or stack[i].name in SCOPES and not shut:
                    break
        made = _element(name, _attributes(attributes))
        if name not in BLOCKS and made.label == name:
            continue  # plain inline markup
        stack[-1].body.append(made)
        if name == "hr":
            continue
        if len(stack) < DEPTH:
            stack.append(made)
        else:
            beyond[name] = beyond.get(name, 0) + 1
    return root
