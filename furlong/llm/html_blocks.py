"""Leaf text blocks of an HTML page, in page order, with the path of tags above each.

Markup, comments, scripts, styles and other content that no reader sees are left
out. Only scripts, styles, ``textarea``, ``title`` and comments run to the end
of the page if nothing ends them. ``noscript``, ``template`` and ``iframe`` are
left out up to their end tag, if there is one; ``svg`` and ``select`` also end
before a block-level tag. ``math`` and ``object`` are read like inline tags. Block-level tags end a block; inline tags and ``br`` do not. Tags that HTML
closes by itself (``p``, ``li``, table cells ...) are closed here too, and end
tags without a start are ignored, so broken pages give blocks as well. A page
that is cut off inside a tag loses that tag.

Time and memory are linear in the page: a quote that has no partner counts as a
plain character, nothing is tried twice, and paths share their upper parts.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

# What follows a tag's name. Quantifiers never give back what they took, so a tag is read in one go.
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>script|style|textarea|title)\b{_INSIDE}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{_INSIDE})>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html head legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("noscript template iframe".split())
FOREIGN = frozenset("svg select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# An opening tag closes an open one of these, down to the nearest of the stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}


# Start and end tags of a name that is left out, and what else ends it.
_TAGS = {
    name: re.compile(
        rf"<(?P<end>/?){name}(?=[\s/>]){_INSIDE}>" + (rf"|(?P<block></?(?:{'|'.join(BLOCKS - {'hr'})})(?=[\s/>]))" if name in FOREIGN else ""),
        re.I,
    )
    for name in HIDDEN | FOREIGN
}


def _left_out(page: str, name: str, at: int) -> int:
    """Where the content ends that begins at ``at``, at the last end tag if some lack theirs; -1 if nothing ends it."""
    depth, last = 1, -1
    for tag in _TAGS[name].finditer(page, at):
        if name in FOREIGN and tag["block"]:
            return tag.start()
        if tag["end"]:
            depth, last = depth - 1, tag.end()
            if not depth:
                return last
        elif name in ("svg", "template") and not tag[0].endswith("/>"):
            depth += 1
    return last


class Node:
    """A tag and, through ``above``, the tags around it; iterates from the outermost tag to this one."""

    __slots__ = ("name", "tokens", "above")

    def __init__(self, name: str, tokens: tuple[str, ...], above: Node | None):
        self.name, self.tokens, self.above = name, tokens, above  # tokens: parts of class, id and role

    def __iter__(self) -> Iterator[Node]:
        found, node = [], self
        while node.above is not None:
            found.append(node)
            node = node.above
        return reversed(found)


# Stands above all tags and is none itself.
OUTSIDE = Node("", (), None)


class Block(NamedTuple):
    text: str
    path: Node
    linked: int  # characters inside links


class _Open:
    """The open tags, and where those of each name stand."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def last(self, names: Iterable[str]) -> int:
        last, places = -1, self.places
        for name in names:
            if (found := places.get(name)) and found[-1] > last:
                last = found[-1]
        return last

    def push(self, name: str, attributes: str) -> None:
        self.places[name].append(len(self.stack))
        self.stack.append(Node(name, _tokens(attributes), self.top()))

    def top(self) -> Node:
        return self.stack[-1] if self.stack else OUTSIDE

    def close(self, names: Iterable[str], stops: Iterable[str] = ()) -> None:
        """Closes down to the innermost tag of these names, unless a stop stands in between."""
        at = self.last(names)
        if at < 0 or self.last(stops) > at:
            return
        for node in self.stack[at:]:
            self.places[node.name].pop()
        del self.stack[at:]


def _tokens(attributes: str) -> tuple[str, ...]:
    tokens = []
    if "=" in attributes:
        for found in _ATTRIBUTE.finditer(attributes):
            tokens += [part.lower() for part in _PARTS.findall(found[2] or found[3] or found[4] or "")]
    return tuple(tokens)


def blocks(page: str | None) -> list[Block]:
    found: list[Block] = []
    opened = _Open()
    pieces: list[str] = []
    path = OUTSIDE
    linked = links = 0
    filled = False  # whether the pieces hold more than white space

    def flush() -> None:
        nonlocal linked, filled
        if filled:
            found.append(Block(" ".join("".join(pieces).split()), path, linked))
        pieces.clear()
        linked, filled = 0, False

    def add(raw: str) -> None:
        nonlocal path, linked, filled
        text = html.unescape(raw) if "&" in raw else raw
        if not pieces or path is OUTSIDE:
            path = opened.top()
        if text.strip():
            if not filled:
                path, filled = opened.top(), True
            if links:
                linked += len(text.strip())
        pieces.append(text)

    at, size = 0, len(page or "")
    page = (page or "") + ">"  # ends a tag that the page is cut off in
    open_ended = set()
    while token := _TOKEN.search(page, at):
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        name = token["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _TAGS:
            if not token["end"] and not token["attrs"].endswith("/") and name not in open_ended:
                end = _left_out(page, name, at)
                if end < 0:
                    open_ended.add(name)  # nothing ends it from here on
                else:
                    at = end
            continue
        if name in BLOCKS:
            flush()
        if name == "br":
            if pieces:
                pieces.append(" ")
        if token["end"]:
            opened.close((name,))
        elif name not in VOID:
            if name in CLOSES:
                opened.close(*CLOSES[name])
            elif name in BLOCKS:
                opened.close(("p",), ("div", "td", "th", "li", "article", "section", "blockquote", "button"))
            if not token["attrs"].endswith("/"):
                opened.push(name, token["attrs"])
        links = len(opened.places["a"]) if name == "a" or name in BLOCKS else links
    if at < size:
        add(page[at:size])
    flush()
    return found
