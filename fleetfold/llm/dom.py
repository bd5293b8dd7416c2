"""A small HTML reader: block-level nodes of a page with their text, tolerant of what real pages do.

Inline elements belong to the block they stand in. Text is kept as pieces in page order, each with the
node it belongs to; None marks a border between blocks. Formulas are inline text (without their annotations),
the fallback of an object is a block like any other, and xmp is a block whose text holds no markup.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# The elements of HTML by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes template svg annotation annotation-xml".split())
HIDDEN = frozenset("head select button datalist".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr img br input "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose maction "
    "msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd".split()
)
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body div section article main aside nav header footer form table ul ol dl tr td th blockquote figure details".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str]
    mark: str = ""
    children: list[int] = field(default_factory=list)
    own: int = 0  # characters of its own text
    linked: int = 0
    words: int = 0
    stops: int = 0
    controls: int = 0


def _tokens(attributes: str) -> list[str]:
    if not attributes or "=" not in attributes:
        return []
    return [t for _, value in _NAMED.findall(attributes) for t in _TOKEN.findall(value.lower())]


_MARK = re.compile(r'data-keep="(\d)"')


def read(page: str) -> tuple[list[Node], list[tuple[int, str] | None]]:
    """(nodes, pieces); node 0 is the document."""
    nodes = [Node("document", -1, 0, [])]
    pieces: list[tuple[int, str] | None] = []
    stack: list[tuple[str, int]] = [("document", 0)]
    links = hidden = at = 0

    def leave(position: int) -> None:
        nonlocal links, hidden
        for tag, _ in stack[position:]:
            links -= tag == "a"
            hidden -= tag in HIDDEN
        del stack[position:]

    def say(text: str) -> None:
        own = stack[-1][1]
        solid = len(text.split())
        if solid:
            node = nodes[own]
            length = len(text)
            node.own += length
            node.words += solid
            node.linked += length if links else 0
            node.stops += text.count(".") + text.count("!") + text.count("?") + text.count(",")
        pieces.append((own, text))

    size = len(page)
    while at < size:
        found = _TAG.search(page, at)
        end = found.start() if found else size
        if end > at and not hidden:
            text = page[at:end]
            say(html.unescape(text) if "&" in text else text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            for position in range(len(stack) - 1, 0, -1):
                if stack[position][0] == tag:
                    leave(position)
                    break
                if tag in INLINE and stack[position][0] in SCOPES:
                    break
            if tag not in INLINE:
                pieces.append(None)
            continue
        if tag in RAW:
            if not found[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(page, at)
                at = close.end() if close else size
            if tag == "textarea":
                nodes[stack[-1][1]].controls += 1
            continue
        if tag in VOID:
            if tag == "input":
                nodes[stack[-1][1]].controls += 1
            if tag in ("br", "hr"):
                pieces.append(None)
            continue
        if tag in INLINE:
            links += tag == "a"
            stack.append((tag, stack[-1][1]))
            continue
        if tag == "body" and hidden:  # a head that was never closed
            leave(next(i for i, (t, _) in enumerate(stack) if t in HIDDEN))
        closing = CLOSES.get(tag, ())
        for position in range(len(stack) - 1, 0, -1):
            name = stack[position][0]
            if name == "p" or name in closing:
                leave(position)
                break
            if name in SCOPES and not (closing and name in ("tr", "td", "th")):
                break
        parent = stack[-1][1]
        if tag in HIDDEN:
            nodes[parent].controls += tag in ("button", "select")
            hidden += 1
            stack.append((tag, parent))
            continue
        mark = _MARK.search(found[3]) if "data-keep" in found[3] else None
        nodes.append(Node(tag, parent, nodes[parent].depth + 1, _tokens(found[3]), mark[1] if mark else ""))
        nodes[parent].children.append(len(nodes) - 1)
        stack.append((tag, len(nodes) - 1))
        pieces.append(None)
        if tag == "xmp":  # its text is neither markup nor escaped
            close = re.compile(r"</xmp\s*/?>", re.I).search(page, at)
            if not hidden:
                say(page[at : close.start() if close else size])
            at = close.end() if close else size
            leave(len(stack) - 1)
            pieces.append(None)
    return nodes, pieces


def text_of(pieces: list[tuple[int, str] | None], kept: list[bool]) -> str:
    """Text of the kept nodes: blank runs are one space, blocks are joined by one space."""
    parts = [" " if piece is None else piece[1] if kept[piece[0]] else " " for piece in pieces]
    return " ".join("".join(parts).split())
