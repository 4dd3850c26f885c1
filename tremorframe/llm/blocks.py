"""HTML into leaf blocks of text with their tag paths.

A small reader of real-world HTML: comments, raw-text elements, character
references, optional end tags and unclosed elements.  A block is the text
between two borders of block elements; inline elements do not part it, line
breaks and table cells become white space.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

#: Comments, CDATA and declarations; a tag with quoted values; a tag up to the next >.
NOTE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
QUOTED = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Tags whose quotes do not close are read anew as PLAIN; so many times the page's length may be read in vain before no quotes are looked for.
VAIN = 8
NAMES = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
SPACE = re.compile(r"\s+")

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp noembed noframes textarea title iframe".split())
UNSEEN = frozenset("head script style noscript template textarea title iframe svg math object select datalist canvas audio video noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th wbr button input img".split())
#: A start tag of the key ends open elements of these kinds, up to a border of the scope.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"table", "tr"}),
    "th": ({"td", "th", "p"}, {"table", "tr"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
KEEPS_P = frozenset("html body option".split())


#: Elements whose presence round a block is one of its measures.
LISTS = frozenset("ul ol dl table".split())


class Element:
    """An open element: its own tag and names, and those round it by ``parent``.

    Blocks share their elements, so a page of n blocks and m tags has n + m of
    these however deep its tags are nested.
    """

    __slots__ = ("hidden", "in_list", "memo", "names", "parent", "tag")

    def __init__(self, tag: str, names: tuple[str, ...] = (), hidden: bool = False, parent: Element | None = None) -> None:
        self.tag, self.names, self.hidden, self.parent = tag, names, hidden, parent
        self.in_list = tag in LISTS or parent is not None and parent.in_list
        #: For whoever computes something of the elements from the outside in.
        self.memo = None


@dataclass
class Block:
    text: str
    element: Element | None
    linked: int

    @property
    def path(self) -> tuple[str, ...]:
        """The elements outside in, each as tag or tag.name..."""
        out, e = [], self.element
        while e is not None:
            out.append(".".join((e.tag, *e.names)))
            e = e.parent
        return tuple(reversed(out))


def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for m in NAMES.finditer(attributes):
        found += [p.lower() for p in PART.findall(m[1] or m[2] or m[3] or "")]
    return tuple(found)


class _Open:
    """The open elements, and where those of each tag stand, so that no search walks through them."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, e: Element) -> None:
        self.at[e.tag].append(len(self.stack))
        if e.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)

    def pop(self) -> Element:
        e = self.stack.pop()
        self.at[e.tag].pop()
        if e.tag in BLOCK:
            self.blocks.pop()
        return e

    def last(self, tags) -> int:
        """The depth of the innermost of these, -1 if none is open."""
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=-1)

    def first_inside(self, tags, border: int) -> int:
        """The depth of the outermost of these inside of the border, or the number of elements."""
        out = len(self.stack)
        for t in tags:
            own = self.at.get(t)
            if own and own[-1] > border:
                out = min(out, own[bisect_right(own, border)])
        return out


def read_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, in time and memory that grow with its length, whatever its markup."""
    opened = _Open()
    stack = opened.stack
    out: list[Block] = []
    pieces: list[str] = []
    linked, links, unseen, at = 0, 0, 0, 0
    last, vain = page.rfind(">"), VAIN * len(page)

    def close() -> None:
        nonlocal linked
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(text, stack[-1] if stack else None, linked))
            pieces.clear()
        linked = 0

    def pop() -> None:
        nonlocal links, unseen
        e = opened.pop()
        links -= e.tag == "a"
        unseen -= e.hidden

    def cut(depth: int) -> None:
        if opened.blocks and opened.blocks[-1] >= depth:
            close()
        while len(stack) > depth:
            pop()

    def say(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            pieces.append(text)
            if links:
                linked += len(text)

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        at = begin
        sign = page[at + 1 : at + 2]
        if sign == "!" or sign == "?":
            m = NOTE.match(page, at)
            at = m.end()
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        if at > last or sign not in LETTERS and not (sign == "/" and page[at + 2 : at + 3] in LETTERS):
            say("<")
            at += 1
            continue
        m = QUOTED.match(page, at) if vain >= 0 else None
        if not m:
            vain -= len(page) - at
            m = PLAIN.match(page, at)
        at = m.end()
        end, tag, attributes = m[1], m[2].lower(), m[3]
        if end:
            depth = opened.last((tag,))
            if depth < 0:
                if tag in BLOCK:
                    close()
            elif tag in BLOCK or depth >= opened.last(("table", "td", "th")):
                cut(depth)
            continue
        if tag in BLOCK:
            if tag not in KEEPS_P and opened.blocks and stack[opened.blocks[-1]].tag == "p":
                cut(opened.blocks[-1])
            close()
        if tag in ENDS:
            kinds, scope = ENDS[tag]
            cut(opened.first_inside(kinds, opened.last(scope)))
        if tag in SPACED:
            say(" ")
        if tag in VOID:
            continue
        hidden = tag in UNSEEN or bool(HIDDEN.search(attributes))
        names = _names(attributes) if attributes else ()
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "math", "path"):
            opened.push(Element(tag, names, hidden, stack[-1] if stack else None))
            links += tag == "a"
            unseen += hidden
        if tag in RAW:
            stop = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            pop()
    close()
    return out
