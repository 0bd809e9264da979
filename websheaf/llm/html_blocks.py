"""Leaf blocks of an HTML page: runs of text between block-level tags, with what stands above them."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass

#: Tags that take no end, tags whose content is no text, and tags that begin and end blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select datalist".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul button label textarea".split()
)
#: An opening tag ends an open element of these kinds, up to the nearest of those that hold it.
CLOSES = {t: ({"p"}, frozenset({"table", "td", "th", "button"})) for t in BLOCK if t not in {"li", "dd", "dt", "tr", "td", "th", "button", "label", "textarea", "body", "html"}}
CLOSES |= {"li": ({"li", "p"}, frozenset({"ul", "ol", "menu"})), "dd": ({"dd", "dt", "p"}, frozenset({"dl"})), "dt": ({"dd", "dt", "p"}, frozenset({"dl"}))}
CLOSES |= {"tr": ({"tr", "td", "th", "p"}, frozenset({"table"})), "td": ({"td", "th", "p"}, frozenset({"tr", "table"})), "th": ({"td", "th", "p"}, frozenset({"tr", "table"}))}
#: Tags that a head can hold; any other tag, and text, ends it (its end tag and the body's tags are optional).
IN_HEAD = frozenset("head base link meta title style script noscript template".split())

#: Tags that say what part of a page this is.
SECTIONS = frozenset("article main nav header footer aside form section figure".split())
#: The distinct rules of CLOSES, each a scope in which an open element is looked for.
_RULES = list({(frozenset(c), h): None for c, h in CLOSES.values()})
_RULE_OF = {t: _RULES.index((frozenset(c), h)) for t, (c, h) in CLOSES.items()}
_SCOPED = frozenset().union(*(c | h for c, h in _RULES))

_MARKUP = re.compile(r"<(?:!--(?P<comment>.*?(?:-->|\Z))|[!?][^>]*>?|(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z))", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
#: What stands before the slash of <a name="x"/>; in <a href=/x/> the slash is the value's.
_SHUT = ("", " ", "\t", "\n", "\r", '"', "'")
_END_OF = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


class Node:
    """An open element with what is above it. Children share their parent's sets unless they add to them, and `at[rule]` is
    where the element stands that the rule would close, so that deep nesting costs no more than flat."""

    __slots__ = ("tag", "tags", "names", "block", "section", "link", "at")

    def __init__(self, tag: str, names: frozenset[str], up: Node | None, depth: int):
        self.tag = tag
        self.tags = up.tags if up and tag in up.tags else (up.tags if up else frozenset()) | {tag}
        self.names = up.names if up and names <= up.names else (up.names if up else frozenset()) | names
        self.block = tag if tag in BLOCK else up.block if up else ""
        self.section = tag if tag in SECTIONS else up.section if up else "none"
        self.link = tag == "a" or (up is not None and up.link)
        self.at = up.at if up else (-1,) * len(_RULES)
        if tag in _SCOPED:
            self.at = tuple(-1 if tag in holders else depth if tag in closing else old for (closing, holders), old in zip(_RULES, self.at))


@dataclass
class Block:
    """A run of text, the distinct tags and names above it, the nearest block tag and section, and its characters in links."""

    text: str
    tag: str
    tags: frozenset[str]
    names: frozenset[str]
    section: str
    linked: int
    order: int = 0


def blocks(page: str, tags: Collection[str] | None = None, names: Collection[str] | None = None) -> list[Block]:
    """The page's blocks in order, texts with decoded references and white space runs as one space; empty ones left out.

    Of tags outside BLOCK and SECTIONS, and of names, only those in `tags` and `names` are kept, where given: memory then
    follows the page's length whatever it nests.
    """
    found: list[Block] = []
    stack: list[Node] = []
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked = silent = 0
    state: Node | None = None
    spoken = False

    def cut(depth: int) -> None:
        nonlocal silent
        for node in stack[depth:]:
            open_tags[node.tag] -= 1
            silent -= node.tag in SILENT
        del stack[depth:]

    def flush() -> None:
        nonlocal linked, state, spoken
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text and spoken:
                up = state
                found.append(Block(text, up.block if up else "", up.tags if up else frozenset(), up.names if up else frozenset(), up.section if up else "none", min(linked, len(text)), len(found)))
            parts.clear()
        linked, state, spoken = 0, None, False

    def leave_head() -> None:
        while stack and stack[-1].tag == "head":
            cut(len(stack) - 1)

    def say(text: str) -> None:
        nonlocal linked, state, spoken
        blank = text.isspace()
        if silent and not blank:
            leave_head()
        if silent:
            return
        if not spoken and not blank:
            state, spoken = stack[-1] if stack else None, True
        parts.append(text)
        if stack and stack[-1].link:
            linked += len(text)

    at, size = 0, len(page)
    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tags is not None and tag not in BLOCK and tag not in SILENT and tag not in tags and tag not in VOID and tag != "a":
            tag = "span"
        if m["end"]:
            if tag in BLOCK:
                flush()
            if open_tags[tag] > 0:
                cut(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag in BLOCK:
            flush()
        if tag not in IN_HEAD:
            leave_head()
        if tag in VOID:
            if tag == "br":
                say(" ")
            continue
        if stack and tag in _RULE_OF and (closed := stack[-1].at[_RULE_OF[tag]]) >= 0:
            cut(closed)
        attrs = m["attrs"]
        if attrs.endswith("/") and attrs[-2:-1] in _SHUT and tag not in BLOCK and tag not in RAW:
            continue
        if tag in RAW:
            end = _END_OF[tag].search(page, at)
            at = end.end() if end else size
            continue
        own = frozenset(w for a in _NAMES.findall(attrs) for w in _WORDS.split("".join(a).lower()) if w and (names is None or w in names)) if attrs else frozenset()
        stack.append(Node(tag, own, stack[-1] if stack else None, len(stack)))
        open_tags[tag] += 1
        silent += tag in SILENT
    flush()
    return found
