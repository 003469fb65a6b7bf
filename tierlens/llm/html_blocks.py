"""Leaf blocks of an HTML page in page order, each with its text and the features of its place and text."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

#: Feature numbers; names are hashed onto them.
FEATURES = 1 << 13
#: The attribute that marks labelled pages; features never look at it.
LABEL = "data-main"

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead "
    "title tr ul".split()
)
#: What stands in these is never text of the page.
_SILENT = frozenset("script style template iframe object svg math canvas audio video noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the first kind ends where one of the second starts, unless one of the third lies between.
_ENDED_BY = {
    "p": (_BLOCKS - {"body", "button", "label", "noscript"}, frozenset("article aside blockquote body dd details div fieldset figure footer form header li main nav section td th".split())),
    "li": (frozenset({"li"}), frozenset("menu ol ul".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "tbody", "thead", "tfoot"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "tr", "tbody", "tfoot"}), frozenset({"table"})), "th": (frozenset({"td", "th", "tr", "tbody", "tfoot"}), frozenset({"table"})),
    "option": (frozenset({"option", "optgroup"}), frozenset({"select"})), "head": (frozenset({"body", "article", "div", "main", "p", "nav", "header"}), frozenset()),
}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=100_000)
def feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


@dataclass
class Block:
    """One leaf block: text without surplus white space, features, and the label of a labelled page."""

    text: str
    place: frozenset[int]
    own: list[int] = field(default_factory=list)
    main: bool = False


class _Open:
    """An open element: its tag, the features of it and all around it, whether it is a link, or labelled as main."""

    __slots__ = ("tag", "place", "link", "main", "block")

    def __init__(self, tag, place, link, main, block):
        self.tag, self.place, self.link, self.main, self.block = tag, place, link, main, block


# fixed values: where a tag, a comment and a declaration end, by the HTML standard; tags whose quotes never close end at the next >
_NAME = r"(/?)([a-zA-Z][^\s/>]*+)"
_TAG = re.compile(_NAME + r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(_NAME + r"([^>]*+)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLING = re.compile(r"class|id|role|itemprop|aria-|hidden|style|" + LABEL, re.I)
_NAMING = frozenset(("class", "id", "role", "itemprop", "aria-label"))


def _attribute_features(tag: str, attributes: str) -> tuple[frozenset[int], bool | None]:
    """(features of a start tag, whether its label says main; None without a label)."""
    names, main = set(), None
    if tag in _BLOCKS or tag == "a":
        names.add(f"in:{tag}")
    if attributes and _TELLING.search(attributes):
        for key, value in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if value[:1] in "\"'":
                value = value[1:-1]
            if key in _NAMING:
                names.update(f"said:{w.lower()}" for w in _WORD.findall(unescape(value)))
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "none" in value):
                names.add("hidden")
            elif key == LABEL:
                main = value == "1"
    return frozenset(map(feature, names)), main


_cached_features = lru_cache(maxsize=50_000)(_attribute_features)


class _Blocks:
    """Reads one page from left to right and keeps its leaf blocks."""

    def __init__(self):
        self.open = [_Open("", frozenset(), False, False, True)]
        self.counts: dict[str, int] = {}
        self.found: list[Block] = []
        self.said: list[str] = []
        self.linked = 0
        self.where: _Open | None = None

    def read(self, html: str) -> None:
        at, size, tags = 0, len(html), _TAG
        while at < size:
            mark = html.find("<", at)
            if mark < 0:
                self.text(html[at:])
                return
            if mark > at:
                self.text(html[at:mark])
            sign = html[mark + 1 : mark + 2]
            if sign.isascii() and (sign.isalpha() or (sign == "/" and html[mark + 2 : mark + 3].isalpha())):
                tag = tags.match(html, mark + 1)
                if tag is None and tags is _TAG:
                    tags = _PLAIN_TAG
                    tag = tags.match(html, mark + 1)
                if tag is None:
                    return      # a tag that the end of the page cuts off
                at = tag.end()
                name = tag[2].lower()
                if tag[1]:
                    self.end(name)
                elif name in _SILENT:
                    closed = _silent_end(name).search(html, at)
                    at = closed.end() if closed else size
                else:
                    self.start(name, tag[3])
            elif html.startswith("!--", mark + 1):
                if html.startswith((">", "->"), mark + 4):
                    at = html.index(">", mark + 4) + 1
                else:
                    closed = _COMMENT_END.search(html, mark + 4)
                    at = closed.end() if closed else size
            elif sign in ("!", "?", "/", ""):
                closed = html.find(">", mark + 1)
                at = closed + 1 if closed >= 0 else size
            else:
                self.text("<")
                at = mark + 1

    def flush(self) -> None:
        if self.where is None:
            return
        text = " ".join("".join(self.said).split())
        if text:
            block = Block(text, self.where.place, main=self.where.main)
            block.own = _text_features(text, min(self.linked / len(text), 1.0))
            block.own.append(_LEAVES[self.leaf])
            self.found.append(block)
        self.said, self.linked, self.where = [], 0, None

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text("\n")
            return
        block = tag in _BLOCKS
        if block:
            self.flush()
            for kind in _ENDED[tag]:
                if self.counts.get(kind):
                    walls = _ENDED_BY[kind][1]
                    for i in range(len(self.open) - 1, 0, -1):
                        if self.open[i].tag == kind:
                            self.cut(i)
                            break
                        if self.open[i].tag in walls:
                            break
        if tag in _VOID:
            return
        above = self.open[-1]
        more, main = (_cached_features if len(attributes) < 200 else _attribute_features)(tag, attributes)
        place = above.place if more <= above.place else above.place | more
        self.open.append(_Open(tag, place, above.link or tag == "a", above.main if main is None else main, block))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def cut(self, i: int) -> None:
        for gone in self.open[i:]:
            self.counts[gone.tag] -= 1
        del self.open[i:]

    def end(self, tag: str) -> None:
        if tag == "br":
            self.text("\n")
            return
        block = tag in _BLOCKS
        if block:
            self.flush()
        if not self.counts.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return
            # an inline end tag doesn't close blocks around it
            if not block and self.open[i].block:
                return

    def text(self, data: str) -> None:
        here = self.open[-1]
        if self.where is None:
            if data.isspace():
                return
            self.where = here
            self.leaf = here.tag if here.block else next(o.tag for o in reversed(self.open) if o.block)
        self.said.append(unescape(data) if "&" in data else data)
        if here.link:
            self.linked += len(data.strip())


@lru_cache(maxsize=None)
def _silent_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


_ENDED = {tag: [kind for kind, (ends, _) in _ENDED_BY.items() if tag in ends] for tag in _BLOCKS}
_LEAVES = {tag: feature(f"leaf:{tag}") for tag in (*_BLOCKS, "")}


def _numbers(name: str, edges: tuple) -> tuple[tuple, list[int]]:
    return edges, [feature(f"{name}:{k}") for k in range(len(edges) + 1)]


_WORDS = _numbers("words", (2, 4, 8, 16, 32, 64))
_CHARS = _numbers("chars", (8, 20, 50, 120, 300))
_LINKED = _numbers("linked", (0.01, 0.3, 0.6, 0.9))
_MARKS = _numbers("marks", (1, 2, 4, 8))
_AT = _numbers("at", (0.2, 0.4, 0.6, 0.8))
_SIZES = (4, 16, 48)
_NEXT = [feature(f"next:{k}") for k in range(len(_SIZES) + 2)]
_PRIOR = [[feature(f"prior:{k}:{own}") for own in range(len(_SIZES) + 1)] for k in range(len(_SIZES) + 2)]
_SAME = [feature(f"same:{k}") for k in range(2)]
_SENTENCE = ".!?;:,。，"
_ALL, _COPYRIGHT, _SEPARATED, _ENDS = (feature(x) for x in ("all", "copyright", "separated", "ends"))


def _step(n: float, scale: tuple[tuple, list[int]]) -> int:
    return scale[1][bisect_right(scale[0], n)]


def _text_features(text: str, linked: float) -> list[int]:
    own = [_ALL, _step(text.count(" ") + 1, _WORDS), _step(len(text), _CHARS), _step(linked, _LINKED), _step(sum(map(text.count, _SENTENCE)), _MARKS)]
    if text[-1] in ".!?…。":
        own.append(_ENDS)
    if "©" in text:
        own.append(_COPYRIGHT)
    if "|" in text or "·" in text or "»" in text:
        own.append(_SEPARATED)
    return own


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page, with the features of their neighbours and their place in the page added."""
    reader = _Blocks()
    reader.read(html)
    reader.flush()
    found = reader.found
    n = len(found)
    sizes = [0, *[bisect_right(_SIZES, b.text.count(" ") + 1) + 1 for b in found], 0]
    for i, block in enumerate(found):
        same = i > 0 and found[i - 1].place == block.place
        block.own += (_step(i / n, _AT), _SAME[same], _NEXT[sizes[i + 2]], _PRIOR[sizes[i]][sizes[i + 1] - 1])
    return found
