"""HTML to a tree of elements and texts, tolerant of broken markup and linear in the page.

Defined results: an empty page is a root without children; whatever is not closed ends with its parent; a tag whose quotes are
not closed, and all after it, end at the next >; what is left open at the end of the page is text.
"""

from __future__ import annotations

import html as entities
import re

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
#: Subtrees that are not shown; one that is never closed hides nothing.
HIDDEN = frozenset("svg noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br head title".split())
#: What an open element is closed by: a start tag of the other names.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
    "head": frozenset(["body"]),
}
#: An end tag does not reach beyond these.
_WALLS = frozenset(["table", "td", "th", "body", "html"])
#: Where the search for an element that a start tag closes ends, besides the root and hidden elements.
_STOPS = _WALLS | (BLOCK - frozenset("p li dt dd tr td th head".split()))
#: End tags that reach through walls.
_THROUGH = frozenset("body html table tr tbody".split())

_SKIPPED = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
#: A tag whose quotes are closed; what only looks like the start of one ends the scanning of quotes for the rest of the page.
_TOKEN = re.compile(_SKIPPED + r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?=/?[a-zA-Z])", re.S)
_SIMPLE = re.compile(_SKIPPED + r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<(?=/?[a-zA-Z])", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: The next start or end of elements whose content is raw as far as their end tag.
_NEXT = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in ("iframe", "noscript")}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: White space inside a block; no-break spaces count.
_SPACE = re.compile(r"\s+")


class Node:
    """An element, or a text (tag '#'); gate: the nearest of itself and its ancestors that a start tag may close or that stops the search; walls: how many walls it is in or is."""

    __slots__ = ("tag", "attrs", "parent", "children", "text", "stats", "gate", "walls")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None, text: str = ""):
        self.tag, self.attrs, self.parent, self.children, self.text, self.stats = tag, attrs, parent, [], text, None
        self.walls = (parent.walls if parent else 0) + (tag in _WALLS)
        self.gate = self if parent is None or tag in CLOSED_BY or tag in _STOPS or tag in HIDDEN else parent.gate

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(self.attrs)}


def parse(source: str) -> Node:
    """The tree; unclosed elements end with their parent, stray end tags are ignored.

    Linear in the page: elements that can be closed are found through gates, end tags through the open elements of their
    name, and every element is left once.  Null pages are the caller's; empty ones give a root without children.
    """
    root = at = Node("#root")
    pos, n, token = 0, len(source), _TOKEN
    opened: dict[str, list[Node]] = {}
    unclosed = set()

    def add_text(text: str) -> None:
        if text:
            at.children.append(Node("#", parent=at, text=text))

    def leave(node: Node, up: Node) -> None:
        """Everything from node to below up ends; hidden elements without an end tag hide nothing."""
        while node is not up:
            opened[node.tag].pop()
            if node.tag in HIDDEN:
                node.tag = "span"
            node = node.parent

    while pos < n:
        m = token.search(source, pos)
        if m is None:
            add_text(source[pos:])
            break
        add_text(source[pos : m.start()])
        if m[2] is None:
            if m.end() - m.start() > 1:
                pos = m.end()
            elif token is _TOKEN:  # quotes that are not closed
                token, pos = _SIMPLE, m.start()
            else:  # no tag is closed from here on
                add_text(source[m.start() :])
                break
            continue
        pos = m.end()
        tag = m[2].lower()
        if m[1]:
            same = opened.get(tag)
            if same and (tag in _THROUGH or at.walls == same[-1].walls):
                up = same[-1]
                leave(at, up)
                opened[tag].pop()
                at = up.parent
            continue
        up = at.gate
        while up is not root and (tag == "body" or up.tag not in HIDDEN) and up.tag not in _STOPS:
            if tag in CLOSED_BY.get(up.tag, ()):
                leave(at, up)
                opened[up.tag].pop()
                at = up.parent
                break
            up = up.parent.gate
        node = Node(tag, m[3], at)
        at.children.append(node)
        if tag in RAW:
            end = _RAW_END[tag].search(source, pos) if tag not in unclosed else None
            if end is None:
                unclosed.add(tag)
            node.children.append(Node("#", parent=node, text=source[pos : end.start() if end else n]))
            pos = end.end() if end else n
        elif tag not in VOID and not m[3].endswith("/"):
            end = _NEXT[tag].search(source, pos) if tag in _NEXT and tag not in unclosed else None
            if end and end[1]:
                pos = end.end()
            else:
                if tag in _NEXT and end is None:
                    unclosed.add(tag)
                opened.setdefault(tag, []).append(node)
                at = node
    leave(at, root)
    return root


def clean(text: str) -> str:
    return _SPACE.sub(" ", text).strip()
