"""Leaf blocks of an HTML page: text runs between block-level tags, with their tag paths."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

# HTML element kinds.
SILENT = {"script", "style", "template", "head", "title", "iframe", "select", "textarea"}
RAW = ("script", "style", "textarea", "title", "iframe", "xmp")
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "audio", "b", "bdi", "bdo", "big", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "math", "object", "q", "rp", "rt", "ruby",
    "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mspace", "mtable", "mtr", "mtd", "semantics", "annotation",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "time", "tt", "u", "var", "video", "wbr", "br", "input", "button", "area", "embed", "source", "track",
}
#: What may stand in a head; anything else ends it.
IN_HEAD = {"html", "head", "title", "style", "script", "noscript", "template", "meta", "link", "base"}
#: Starting one of these ends an open one of the named kinds (up to the nearest container).
CLOSES = {"li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

# A quote opens a quoted value only right behind an equals sign; elsewhere in a tag it is a character like others.
# Every repetition is possessive, so that no page makes the search go back.
VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
ATTRIBUTES = rf"""(?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+{VALUE}?+)?+)*+"""
COMMENT = r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"
TAG = re.compile(rf"{COMMENT}|<(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})(?:>|\Z)", re.S)
NAMES = re.compile(rf"""(?:^|(?<=[\s/"']))(?:class|id|role)\s*=\s*({VALUE})""", re.I)
PART = re.compile(r"[a-z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


class Path:
    """An open element and those around it, shared by all blocks inside; ``marks`` is for whoever reads paths."""

    __slots__ = ("label", "outer", "depth", "marks")

    def __init__(self, label: str, outer: Path | None):
        self.label, self.outer, self.depth = label, outer, 1 + (outer.depth if outer else 0)
        self.marks: object = None

    def labels(self) -> Iterator[str]:
        """Innermost first."""
        at: Path | None = self
        while at:
            yield at.label
            at = at.outer


@dataclass
class Block:
    path: Path | None  # each label is a tag with the words of its class, id and role: "div.ad"
    text: str
    n_link: int  # characters inside links


def _label(name: str, attributes: str) -> str:
    words = PART.findall(" ".join(m[1].strip("\"'") for m in NAMES.finditer(attributes)).lower())
    return ".".join([name, *words])


class _Open:
    """The open elements but inline ones; where each kind stands is known, so nothing is searched for."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.paths: list[Path] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.silent = 0

    def push(self, tag: str, label: str) -> None:
        self.places[tag].append(len(self.tags))
        self.tags.append(tag)
        self.paths.append(Path(label, self.paths[-1] if self.paths else None))
        self.silent += tag in SILENT

    def last(self, kinds: tuple[str, ...]) -> int:
        """Where the innermost open element of these kinds stands, -1 if none is open."""
        return max((self.places[k][-1] for k in kinds if self.places[k]), default=-1)

    def pop(self, k: int) -> None:
        """Close the element at place k and all inside."""
        for tag in reversed(self.tags[k:]):
            self.places[tag].pop()
            self.silent -= tag in SILENT
        del self.tags[k:], self.paths[k:]


def blocks(page: str | None) -> list[Block]:
    """Blocks in page order, white space folded to one space; blocks without text are left out.

    Scripts, styles, heads, lists of options and text fields give nothing; a
    comment is no text; an unclosed tag at the end of a cut page is no text
    either. A null page has no blocks. Time and memory follow the length of the
    page, however deep it is.
    """
    page = page or ""
    found: list[Block] = []
    open_ = _Open()
    links = 0
    run: list[str] = []
    linked: list[str] = []

    def end_block() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                found.append(Block(open_.paths[-1] if open_.paths else None, text, len("".join(linked).strip())))
            run.clear()
            linked.clear()

    def pop(k: int) -> None:
        end_block()
        open_.pop(k)

    def say(text: str) -> None:
        if open_.tags and open_.tags[-1] == "head" and not text.isspace():
            pop(len(open_.tags) - 1)
        if not open_.silent:
            run.append(text)
            if links:
                linked.append(text)

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not closing and name not in IN_HEAD and open_.places["head"]:
            pop(open_.places["head"][-1])
        if name in INLINE:
            if name == "br":
                say(" ")
            elif name == "a":
                links = 0 if closing else 1
            continue
        if closing:
            k = open_.last(HEADINGS if name in HEADINGS else (name,))  # any heading's end ends an open heading
            if k >= 0:
                pop(k)
            else:
                end_block()
            continue
        end_block()
        if name in VOID:
            continue
        if name in CLOSES:
            k = open_.last(CLOSES[name])
            if k > open_.last(HOLDS[name]):
                pop(k)
        elif open_.tags and open_.tags[-1] == "p":
            pop(len(open_.tags) - 1)
        if name in RAW_END:
            end = RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
            if name in SILENT:
                close = TAG.match(page, at)
                at = close.end() if close else len(page)
                continue
        if m[3].rstrip().endswith("/") and name not in SILENT:
            continue
        open_.push(name, _label(name, m[3]))
    if at < len(page):
        say(page[at:])
    end_block()
    return found
