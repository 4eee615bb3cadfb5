"""A small tolerant HTML tree: blocks, their text, and what tags enclose them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without text of the page; the content of the raw ones is not parsed.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
MARKUP = frozenset("script style head title template iframe noembed noframes svg math object embed audio video canvas noscript".split())
FORM = frozenset("form input select option optgroup button textarea label fieldset legend datalist output".split())
#: A start tag of the key closes an open element of the values, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"}}
HOLDS = frozenset("html body article section main div nav aside header footer table ul ol dl form blockquote td th figure details fieldset".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_NAMES = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)


@dataclass
class Node:
    """A block element; parent is its place in the list of nodes, -1 for the root."""

    tag: str
    names: str
    parent: int
    in_link: int = 0  # characters of own text inside links
    chars: int = 0
    blocks: list[int] = field(default_factory=list)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(block nodes, parents first; (node, text) of every block in page order)."""
    nodes, blocks = [Node("#root", "", -1)], []
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their block node
    text: list[str] = []
    dropped = links = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal text
        if text:
            block = " ".join("".join(text).split())
            text = []
            if block:
                node = stack[-1][1]
                nodes[node].blocks.append(len(blocks))
                nodes[node].chars += len(block)
                blocks.append((node, block))

    def close(down_to: int) -> None:
        nonlocal dropped, links
        if any(t not in INLINE for t, _ in stack[down_to:]):
            flush()
        while len(stack) > down_to:
            tag, _ = stack.pop()
            dropped -= tag in MARKUP
            links -= tag == "a"

    while at < size:
        found = _TAG.search(page, at)
        end = found.start() if found else size
        if end > at and not dropped:
            piece = html.unescape(page[at:end])
            text.append(piece)
            if links:
                nodes[stack[-1][1]].in_link += len(piece.strip())
        if not found:
            break
        at = found.end()
        shut, tag, names = (found[1], found[2], found[3]) if found[2] is not None else (found[4], found[5], found[6])
        if tag is None:
            continue
        tag = tag.lower()
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            else:
                if tag in ("p", "br"):
                    flush()
            continue
        if tag in VOID:
            if tag == "br":
                text.append("\n")
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            closing = CLOSES.get(tag, frozenset())
            outermost = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in closing or stack[i][0] == "p":
                    outermost = i
                elif stack[i][0] in HOLDS:
                    break
            if outermost:
                close(outermost)
            flush()
            described = " ".join(f"{k}={(v or '').strip(chr(34) + chr(39))}" for k, v in _NAMES.findall(names)).lower() if names and not names.isspace() else ""
            nodes.append(Node(tag, described, stack[-1][1]))
            stack.append((tag, len(nodes) - 1))
        else:
            stack.append((tag, stack[-1][1]))
            links += tag == "a"
        dropped += tag in MARKUP
        if tag in RAW:
            shut_at = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            inner = page[at : shut_at.start() if shut_at else size]
            if not dropped:
                text.append(html.unescape(inner))
            at = shut_at.start() if shut_at else size
    close(1)
    flush()
    return nodes, blocks
