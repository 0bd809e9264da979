"""HTML pages as markdown: a tree of elements, consent notices taken out, sparse blocks pruned from the leaves up, the rest written.

Third-party converters differ in detail and none is the measure here; what this one keeps and how it writes it is stated below.
One Arrow pass a column, in slices of a batch; a page's work and memory grow with its length, whatever it nests.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column

from websheaf.functions.text import by_slices

#: Elements of consent notices, as selectors.
CONSENT = (
    "[class*='cookie-banner']", "[id*='cookie-banner']", "[class*='cookie-consent']", "[id*='cookie-consent']", "[class*='cookie-notice']", "[id*='cookie-notice']", "[class*='cookie-law']", "[id*='cookie-law']",
    "[class*='cky-consent']", "[class*='cky-banner']", "[class*='cky-modal']", "[class*='onetrust']", "[id*='onetrust']", "[id*='CookiebotDialog']", "[class*='CookiebotWidget']", "[class*='cc-banner']",
    "[class*='cc-window']", "[class*='gdpr']", "[id*='gdpr']",
)
#: The score under which a block is pruned, and blocks that are never pruned with what holds them.
THRESHOLD, PRESERVED = 0.48, frozenset({"pre", "code"})
#: What each measure counts in a block's score, what tags weigh, and names that speak against a block.
MEASURES = {"text": 0.4, "links": 0.2, "tag": 0.2, "names": 0.1, "length": 0.1}
TAG_WEIGHTS = {"article": 1.5, "main": 1.5, "h1": 1.2, "h2": 1.1, "p": 1.0, "section": 1.0, "h3": 1.0, "table": 1.0, "blockquote": 1.0, "h4": 0.9, "h5": 0.8, "h6": 0.7}
OTHER_TAG, BAD_NAMES = 0.5, re.compile(r"nav|footer|header|sidebar|ads\b|advert|comment|promo|social|share", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("head script style noscript template title iframe object svg math canvas audio video select datalist textarea".split())
#: Parts that a pruned page never has.
_CHROME = frozenset("nav header footer aside form dialog menu button".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul button".split()
)
_LISTS = frozenset({"ul", "ol", "menu"})
#: Blocks that are pruned or not; rows, cells and items go with their table or list.
_JUDGED = _BLOCK - set("html body li dt dd tr td th tbody thead tfoot caption figcaption legend hr".split())
#: An opening tag ends these, up to the nearest of those.
_ENDS = {"li": ({"li"}, _LISTS), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}
_WRAPS = {"b": "**", "strong": "**", "i": "_", "em": "_", "code": "`", "kbd": "`", "samp": "`"}
_HEADING = re.compile(r"h([1-6])$")
#: Stands for a line break until a block is written.
BREAK = "\0"
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_SELECTOR = re.compile(r"\s*(?P<tag>[a-zA-Z][\w-]*|\*)?\[\s*(?P<attribute>[\w-]+)\s*(?:(?P<operator>[*^$~|]?=)\s*(?P<quote>['\"]?)(?P<value>.*?)(?P=quote)\s*)?\]\s*$")
_HOLDS = {"=": str.__eq__, "*=": str.__contains__, "^=": str.startswith, "$=": str.endswith, "~=": lambda have, value: value in have.split(), "|=": lambda have, value: have == value or have.startswith(value + "-")}


@dataclass(frozen=True)
class Selector:
    """An element test: a tag (None: any), an attribute, and how its value has to hold `value` (operator None: in any way)."""

    tag: str | None
    attribute: str
    operator: str | None
    value: str

    @classmethod
    def of(cls, text: str) -> Selector:
        m = _SELECTOR.match(text)
        if not m:
            raise ValueError(f"not an attribute selector: {text!r}")
        return cls(None if m["tag"] in (None, "*") else m["tag"].lower(), m["attribute"].lower(), m["operator"], m["value"] or "")

    def matches(self, tag: str, attributes: dict[str, str]) -> bool:
        if self.tag not in (None, tag) or self.attribute not in attributes:
            return False
        if self.operator is None:
            return True
        empty = not self.value and self.operator != "="  # matches nothing, as in style sheets
        return not empty and _HOLDS[self.operator](attributes[self.attribute], self.value)


class Tree(HTMLParser):
    """A page's elements and texts in order: tag (None: a text), attributes, parent, text, and length of the start tag."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.tag: list[str | None] = ["html"]
        self.attributes: list[dict[str, str]] = [{}]
        self.up, self.text, self.markup = [-1], [""], [0]
        self._open, self._count = [0], Counter({"html": 1})
        self.feed(page)
        self.close()

    def _add(self, tag: str | None, attributes: dict[str, str], text: str, markup: int) -> int:
        for column, value in ((self.tag, tag), (self.attributes, attributes), (self.up, self._open[-1]), (self.text, text), (self.markup, markup)):
            column.append(value)
        return len(self.tag) - 1

    def _cut(self, depth: int) -> None:
        for i in self._open[depth:]:
            self._count[self.tag[i]] -= 1
        del self._open[depth:]

    def _end_open(self, tags: Iterable[str], holders: Iterable[str]) -> None:
        if any(self._count[t] > 0 for t in tags):
            for depth in range(len(self._open) - 1, 0, -1):
                name = self.tag[self._open[depth]]
                if name in holders:
                    return
                if name in tags:
                    return self._cut(depth)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in _BLOCK:
            self._end_open({"p"}, {"table", "td", "th", "button"})
        if tag in _ENDS:
            self._end_open(*_ENDS[tag])
        if tag in _BLOCK and self._count["head"] > 0:
            self._end_open({"head"}, ())
        i = self._add(tag, {k: v or "" for k, v in attrs}, "", len(self.get_starttag_text() or ""))
        if tag not in _VOID:
            self._open.append(i)
            self._count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag != "html" and self._count[tag] > 0:
            self._cut(next(d for d in range(len(self._open) - 1, 0, -1) if self.tag[self._open[d]] == tag))

    def handle_data(self, data: str) -> None:
        self._add(None, {}, data, 0)


def _scores(tree: Tree, shown: list[bool]) -> list[float]:
    """Each element's score from its subtree's text, links and markup, summed from the leaves up; only what is `shown` counts."""
    n = len(tree.tag)
    text, linked, markup = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        tag, up = tree.tag[i], tree.up[i]
        if not shown[i]:
            continue
        if tag is None:
            text[i] = len(_SPACE.sub(" ", tree.text[i]).strip())
            markup[i] = len(tree.text[i])
        else:
            markup[i] += tree.markup[i] + (0 if tag in _VOID else len(tag) + 3)
            linked[i] = text[i] if tag == "a" else linked[i]
        text[up] += text[i]
        linked[up] += linked[i]
        markup[up] += markup[i]
    out = []
    for tag, attributes, t, k, m in zip(tree.tag, tree.attributes, text, linked, markup):
        names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
        parts = {"text": t / m if m else 0.0, "links": 1 - (k / t if t else 1.0), "tag": TAG_WEIGHTS.get(tag or "", OTHER_TAG), "names": -0.5 if BAD_NAMES.search(names) else 0.0, "length": math.log(t + 1)}
        out.append(sum(MEASURES[name] * x for name, x in parts.items()))
    return out


def _shown(tree: Tree, selectors: tuple[Selector, ...]) -> tuple[list[bool], int]:
    """What is left without silent elements and those that a selector matches, and how many of these there were."""
    shown, removed = [True], 0
    for i in range(1, len(tree.tag)):
        tag, keep = tree.tag[i], shown[tree.up[i]]
        if keep and tag is not None:
            if any(s.matches(tag, tree.attributes[i]) for s in selectors):
                keep, removed = False, removed + 1
            elif tag in _SILENT:
                keep = False
        shown.append(keep)
    return shown, removed


def _pruned(tree: Tree, shown: list[bool], threshold: float) -> list[bool]:
    """What is left without chrome and blocks under the threshold; PRESERVED elements stay where a block around them goes."""
    scores, banned, kept = _scores(tree, shown), [False], [True]
    for i in range(1, len(tree.tag)):
        tag, up = tree.tag[i], tree.up[i]
        out = banned[up] or not shown[i] or tag in _CHROME
        banned.append(out)
        poor = tag in _JUDGED and scores[i] < threshold
        kept.append(not out and (tag in PRESERVED or (kept[up] and not poor)))
    return kept


class _Writer:
    """Markdown of the kept nodes, visited in order: blocks parted by empty lines, list items and table rows by line ends."""

    def __init__(self):
        self.blocks: list[tuple[str, str]] = []
        self.line: list[str] = []
        self.marks: list[int] = []
        self.lists: list[list] = []
        self.item, self.heading, self.quote, self.raw = "", "", 0, 0
        self.tables: list[list[list[str]]] = []

    def flush(self) -> None:
        whole = "".join(self.line)
        self.line.clear()
        self.marks = [0] * len(self.marks)
        parts = [_SPACE.sub(" ", p).strip() for p in whole.split(BREAK)]
        text = ("  \n" if not self.heading and not self.tables else " ").join(parts).strip()
        if not text:
            return
        if self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            row = self.tables[-1][-1]
            cell = text.replace("|", "\\|")
            if row and row[-1]:
                row[-1] += " " + cell
            elif row:
                row[-1] = cell
            else:
                row.append(cell)
            return
        inside = "  " * len(self.lists) if self.lists and not self.item else ""
        self.put(self.heading + self.item + inside + text, "item" if self.lists else "block")
        self.item = ""

    def put(self, text: str, kind: str) -> None:
        if self.quote:
            text = "\n".join("> " * self.quote + x for x in text.split("\n"))
        self.blocks.append((text, kind))

    def enter(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in _BLOCK:
            self.flush()
        if tag in _LISTS:
            start = attributes.get("start", "")
            self.lists.append(["ol" if tag == "ol" else "ul", int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1])
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 1]
            self.item = "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "* ")
            kind[1] += 1
        elif m := _HEADING.match(tag):
            self.heading = "#" * int(m[1]) + " "
        elif tag == "blockquote":
            self.quote += 1
        elif tag == "pre":
            self.raw += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append("")
        elif tag == "hr":
            self.put("* * *", "block")
        elif tag == "br":
            self.line.append("\n" if self.raw else BREAK)
        elif tag == "img" and (attributes.get("alt") or attributes.get("src")):
            self.line.append(f"![{attributes.get('alt', '')}]({attributes.get('src', '')})")
        if tag == "a" or tag in _WRAPS:
            self.marks.append(len(self.line))

    def leave(self, tag: str, attributes: dict[str, str]) -> None:
        if tag == "a" or tag in _WRAPS:
            at = self.marks.pop()
            inner = "".join(self.line[at:])
            body = inner.strip(" \t\n\r\f\v\0")
            if body and not (self.raw and tag != "a"):
                front, end = inner[: len(inner) - len(inner.lstrip(" \t\n\r\f\v\0"))], inner[len(inner.rstrip(" \t\n\r\f\v\0")) :]
                wrapped = f"{_WRAPS[tag]}{body}{_WRAPS[tag]}" if tag in _WRAPS else f"[{_SPACE.sub(' ', body)}]({attributes['href'].strip()})" if attributes.get("href") and not self.raw else body
                self.line[at:] = [front, wrapped, end]
        if tag == "pre":
            code = "".join(self.line).replace(BREAK, "\n").strip("\n")
            self.line.clear()
            self.marks = [0] * len(self.marks)
            self.raw -= 1
            if code.strip() and not self.tables:
                self.put(f"```\n{code}\n```", "block")
            elif code.strip():
                self.line.append(code)
                self.flush()
            return
        if tag in _BLOCK:
            self.flush()
        if tag in _LISTS and self.lists:
            self.lists.pop()
            if not self.lists and self.blocks:
                self.blocks.append(("", "end"))
        elif _HEADING.match(tag):
            self.heading = ""
        elif tag == "li":
            self.item = ""
        elif tag == "blockquote":
            self.quote -= 1
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop() if any(r)]
            width = max(map(len, rows), default=0)
            lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            if self.tables and rows:
                self.line.append(" ".join(c for r in rows for c in r if c))
                self.flush()
            elif width > 1:
                self.put("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]), "block")
            elif rows:
                for r in rows:
                    self.put(r[0], "block")

    def done(self) -> str:
        self.flush()
        out, before = [], None
        for text, kind in self.blocks:
            if kind == "end":
                before = kind
                continue
            if before is not None:
                out.append("\n" if kind == before == "item" else "\n\n")
            out.append(text)
            before = kind
        return "".join(out)


def _written(tree: Tree, kept: list[bool]) -> str:
    writer, open_ = _Writer(), []

    def close(to: int) -> None:
        while open_ and open_[-1] != to:
            i = open_.pop()
            if kept[i]:
                writer.leave(tree.tag[i], tree.attributes[i])

    for i in range(1, len(tree.tag)):
        close(tree.up[i])
        tag = tree.tag[i]
        if tag is None:
            if kept[i]:
                writer.line.append(tree.text[i].replace(BREAK, " "))
            continue
        if kept[i]:
            writer.enter(tag, tree.attributes[i])
        if tag not in _VOID:
            open_.append(i)
    close(-2)
    return writer.done()


def page_markdown(page: str | None, selectors: tuple[Selector, ...], threshold: float = THRESHOLD) -> tuple[str, str, int]:
    """(raw, fit, removed): the page as markdown, its pruned form, and how many elements the selectors took out."""
    tree = Tree(page or "")
    shown, removed = _shown(tree, selectors)
    return _written(tree, shown), _written(tree, _pruned(tree, shown, threshold)), removed


def markdown(html: Column, *, selectors: Iterable[str] = CONSENT, threshold: float = THRESHOLD) -> Column:
    """Struct of `raw`, `fit` and `removed` of an HTML column; null pages count as empty.

    Elements that a selector matches go with all they hold, as do scripts, styles, heads and other silent ones. `raw` is the rest. `fit`
    has no navigation, headers, footers, asides, forms and buttons either, and no block whose score is under `threshold`;
    inline elements stay with their block, code stays even where its block goes. Headings, nested lists, links, pictures, emphasis,
    code, quotes, rules and tables are written as markdown; cells hold one line; markup characters in texts are not escaped.
    """
    tests = tuple(map(Selector.of, selectors))

    def convert(pages: list) -> pa.Array:
        raw, fit, removed = zip(*(page_markdown(p, tests, threshold) for p in pages))
        return pa.StructArray.from_arrays([pa.array(raw, pa.string()), pa.array(fit, pa.string()), pa.array(removed, pa.int32())], ["raw", "fit", "removed"])

    return by_slices(convert, "raw string, fit string, removed int")(html)
