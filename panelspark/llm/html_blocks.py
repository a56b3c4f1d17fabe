"""Pages as sequences of leaf blocks: text, tag path and what the path is made of."""

from __future__ import annotations

import html
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content isn't text of the page.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "object", "canvas", "annotation", "annotation-xml"}
CLOSE = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mover", "munder", "munderover", "mstyle", "semantics"}
#: An open element of these ends where another of its group begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SPACED = {"br", "hr", "img"}
PATHS = 1 << 12
#: Names that a path keeps, the outermost first: pages nested without end cost no more than this a block.
MOST_NAMES = 200


class Block(NamedTuple):
    text: str
    path: tuple[int, ...]  #: hashes of the tags, classes, ids and roles above it
    linked: float  #: share of its characters inside links
    names: tuple[str, ...]


@lru_cache(100_000)
def parts(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element adds to a path."""
    out = ["t:" + tag]
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            out += ["c:" + w for w in re.findall(r"[a-z]+", value)]
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            out.append("c:hidden")
    return tuple(dict.fromkeys(out))


@lru_cache(100_000)
def hashed(names: tuple[str, ...], last: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(n.encode()) % PATHS for n in (*names, "l:" + last))


class Scanner:
    """The markup of a page, piece by piece, in one pass.

    Each quote is followed to its end at most once, as those from which no tag's end is reached are remembered. A tag with a quote that is
    never closed ends at the first >.
    """

    def __init__(self, page: str):
        self.page, self.ends, self.lost = page, True, set()  # ends: whether any > follows

    def next(self, at: int) -> tuple[int, int, bool, str | None, str] | None:
        """Start, end, whether it closes, name (None: a comment or the like) and attributes of the first piece from `at` on."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            head = page[at : at + 8]
            if head[:1] in ("!", "?"):
                close = "-->" if head.startswith("!--") else "]]>" if head == "![CDATA[" else ">"
                end = page.find(close, at + (3 if close == "-->" else 1)) if self.ends or close != ">" else -1
                if end < 0 and close == ">":
                    self.ends = False
                    continue
                return start, end + len(close) if end >= 0 else len(page), False, None, ""
            closing = head[:1] == "/"
            name = NAME.match(page, at + closing) if self.ends else None
            if not name:
                continue
            i, passed = name.end(), []
            while (stop := STOP.search(page, i)) and stop[0] != ">":
                quote = stop.start()
                after = -1 if quote in self.lost else page.find(stop[0], quote + 1)
                passed.append(quote)
                if after < 0:
                    stop = None
                    break
                i = after + 1
            end = stop.start() if stop else page.find(">", name.end())
            if not stop:
                self.lost.update(passed)
            if end < 0:
                self.ends = False
                continue
            return start, end + 1, closing, name[0].lower(), page[name.end() : end]
        return None


def blocks(page: str) -> list[Block]:
    """The page's leaf blocks in order; broken markup is read as a browser would, roughly. The time is in proportion to the page's length."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str]] = []  # tag, names of the path down to it, its last tag that isn't inline
    places: dict[str, list[int]] = {}  # of open elements by tag, and at "" of those that aren't inline
    text: list[str] = []
    links = in_link = size = 0
    at = 0
    in_head = False

    def flush() -> None:
        nonlocal text, links, size
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                _, key, last = stack[-1] if stack else ("", (), "body")
                out.append(Block(words, hashed(key, last), links / max(size, 1), key))
        text, links, size = [], 0, 0

    def add(piece: str) -> None:
        nonlocal links, size
        if piece and not in_head:
            text.append(piece)
            n = len(piece.strip())
            size += n
            links += n if in_link else 0

    def pop() -> None:
        tag = stack.pop()[0]
        places[tag].pop()
        if tag not in INLINE:
            places[""].pop()

    def push(tag: str, attributes: str) -> None:
        _, key, last = stack[-1] if stack else ("", (), "body")
        places.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            places.setdefault("", []).append(len(stack))
            more = [n for n in parts(tag, attributes) if n not in key]
            key, last = (key + tuple(more))[:MOST_NAMES] if more and len(key) < MOST_NAMES else key, tag
        stack.append((tag, key, last))

    scanner = Scanner(page)
    while piece := scanner.next(at):
        start, end, closing, tag, attributes = piece
        add(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                found = CLOSE[tag].search(page, at)
                close = page.find(">", found.end()) if found else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag == "head":
            in_head = not closing
            continue
        if tag in ("html", "body"):
            in_head = False
            flush()
            continue
        if tag in SPACED:
            add(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in INLINE:
            in_head = False
            flush()
        if closing:
            mine = places.get(tag)
            if mine and not (tag in INLINE and places.get("") and places[""][-1] > mine[-1]):
                low = mine[-1]
                while len(stack) > low:
                    pop()
            continue
        if tag not in INLINE:
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                pop()
            if stack and stack[-1][0] in ENDS.get(tag, ()):
                pop()
        push(tag, attributes)
    add(page[at:])
    flush()
    return out
