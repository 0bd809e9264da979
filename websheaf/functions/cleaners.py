"""Cleanup of crawled markdown by rules: title detection, navigation, site rules as a table, stateful sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from websheaf.functions.pages import with_previous
from websheaf.functions.text import bound, rstrip, strip

_SOURCE = r"^<!-- source: .* -->\s*\n?"
#: A line that is a link only, navigation phrases, a heading of any level, and one of the first.
_LINK_LINE = r"^\s*[\*\-]?\s*\[[^\]]*\]\([^)]*\)\s*$"
_NAV_PHRASE = r"(?i)^\s*(Toggle navigation|Menu|Search this site)\b"
_HEADING, _TITLE = r"^#{1,6} +\S", r"^# +\S"
#: Markup and what of it is seen: a linked picture's caption, no picture, a link's text, no address, no emphasis.
_LINK = r"\[([^\]]*)\]\([^)]*\)"
_SEEN = ((r"\[!\[[^\]]*\]\([^)]*\)([^\]]*)\]\([^)]*\)", "$1"), (r"!\[[^\]]*\]\([^)]*\)", ""), (_LINK, "$1"), (r"https?://\S+", ""), (r"[\*_`]", ""))
#: The address of an issue or pull request, the end of its title, the site of a story list, its menu and vote links.
_ISSUE, _ISSUE_TITLE = r"(?dm)^<!-- source: https?://github\.com/[^/]+/[^/]+/(?:issues|pull)/(\d+)", r"^# +.+ #(\d+)\s*$"
_STORIES, _STORY_MENU, _VOTE = r"(?dm)^<!-- source: https?://news\.ycombinator\.com/", "[Hacker News](https://news.ycombinator.com/news)", r"\(https://news\.ycombinator\.com/vote\?id=\d+"
#: Visible characters over which a line is prose.
PROSE = 60


def source_line(text: Column) -> Column:
    return rstrip(F.regexp_extract(text, _SOURCE, 0))


def seen(line: Column, markup: tuple = _SEEN) -> Column:
    """What a reader sees of a markdown line."""
    for pattern, rest in markup:
        line = F.regexp_replace(line, pattern, rest)
    return strip(line)


def _from_first(text: Column, lines: Column, begins, apt: Column, least: int = 1) -> Column:
    """The source line and the page's lines from the first that `begins` on, where the page is apt and that line is no
    earlier than `least`; else the page as it is."""

    def cut(ls: Column) -> Column:
        kept = lambda at: F.concat_ws("\n", source_line(text), F.lit(""), F.slice(ls, at, F.size(ls)))
        return bound(F.array_position(F.transform(ls, begins), True).cast("int"), lambda at: F.when(at >= least, kept(at)).otherwise(text))

    return F.when(apt, bound(lines, cut)).otherwise(text)


def _prose(line: Column) -> Column:
    """A line's length without links and emphasis, if it is prose; else 0."""

    def count(s: Column) -> Column:
        n = F.length(seen(s, ((_LINK, "$1"), (r"[\*_`!]", ""))))
        return F.when((s == "") | s.rlike(r"^[#|]") | s.rlike(_LINK_LINE), 0).otherwise(bound(n, lambda k: F.when(k <= PROSE, 0).otherwise(k)))

    return bound(strip(line), count)


def from_title(text: Column, least: int = 200) -> Column:
    """A sourced page from its title on: the first H1 with `least` characters of prose before the next one, else the
    first H1. Pages without a source line or an H1 stay."""

    def kept(heads: Column) -> Column:
        rich = F.transform(heads, lambda p: F.aggregate(F.split(p, "\n"), F.lit(0), lambda s, x: s + _prose(x)) >= least)
        good = F.array_position(rich, True).cast("int")
        return F.when(F.size(heads) > 0, F.array_join(F.slice(heads, F.greatest(good, F.lit(1)), F.size(heads)), ""))

    heads = F.filter(F.split(text, r"(?dm)(?=^# +\S)"), lambda p: p.rlike(_TITLE))
    whole = lambda source: F.when(source != "", F.concat(source, F.lit("\n\n"), bound(heads, kept)))
    return F.coalesce(bound(source_line(text), whole), text)


def from_content(text: Column) -> Column:
    """A sourced page without H1 from its first heading or prose line on; a page without such a line stays."""

    def opens(line: Column) -> Column:
        prose = (F.length(seen(line)) > PROSE) & ~line.rlike(f"{_LINK_LINE}|{_NAV_PHRASE}")
        return ~strip(line).startswith("<!--") & (strip(line).rlike(_HEADING) | prose)

    lines = F.split(F.regexp_replace(text, _SOURCE, ""), "\n")
    return _from_first(text, lines, opens, (source_line(text) != "") & ~text.rlike("(?dm)" + _TITLE))


def from_issue_title(text: Column) -> Column:
    """A code host's issue or pull request page from the H1 that ends in its number."""
    number = F.regexp_extract(text, _ISSUE, 1)
    return _from_first(text, F.split(text, "\n"), lambda s: F.regexp_extract(s, _ISSUE_TITLE, 1) == number, number != "", least=2)


def from_story_row(text: Column) -> Column:
    """A link aggregator's page from its first row with a vote link, where it begins with the site's navigation."""
    return _from_first(text, F.split(text, "\n"), lambda s: s.rlike(_VOTE), text.rlike(_STORIES) & text.contains(_STORY_MENU), least=2)


@dataclass(frozen=True)
class Rules:
    """How a domain's pages are cleaned: the pattern of the first line kept, of the first line cut, of lines dropped, of
    headings whose sections are dropped, and of lines that go with the line after them."""

    domain: str
    start: str = r"^#{1,6} +\S"
    footer: str | None = None
    drop: tuple[str, ...] = ()
    sections: str | None = None
    with_next: str | None = None


def by_rules(text: Column, domain: Column, rules: list[Rules], fallback_footer: str = r"(?i)^(©|copyright)\b") -> Column:
    """Cleaned pages: each domain by its rules, unknown domains only cut at a copyright line; the source line stays."""
    known = F.coalesce(*[F.when(domain == r.domain, _by_rule(text, r)) for r in rules]) if rules else F.lit(None)
    other = _tidy(_cut(F.split(text, "\n"), fallback_footer))
    return F.coalesce(known, other)


def _cut(ls: Column, footer: str) -> Column:
    at = lambda xs: F.array_position(F.transform(xs, lambda s: s.rlike(footer)), True).cast("int")
    return bound(ls, lambda xs: bound(at(xs), lambda n: F.when(n > 0, F.slice(xs, 1, n - 1)).otherwise(xs)))


def _tidy(ls: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(F.transform(ls, rstrip), "\n"), "\n{3,}", "\n\n"))


def _by_rule(text: Column, r: Rules) -> Column:
    ls = F.split(F.regexp_replace(text, _SOURCE, ""), "\n")
    at = lambda xs: F.array_position(F.transform(xs, lambda s: s.rlike(r.start)), True).cast("int")
    ls = bound(ls, lambda xs: F.slice(xs, F.greatest(at(xs), F.lit(1)), F.size(xs)))
    if r.footer:
        ls = _cut(ls, r.footer)
    if r.sections:
        body = F.concat(F.lit("\n"), F.array_join(ls, "\n"))
        ls = F.split(F.regexp_replace(F.regexp_replace(body, rf"(?s)\n## (?:{r.sections})[^\n]*\n.*?(?=\n## |\z)", ""), "^\n", ""), "\n")
    if r.with_next:
        paired = with_previous(ls, lambda before, s: F.when(s.rlike(r.with_next) | F.coalesce(before.rlike(r.with_next), F.lit(False)), F.lit(None).cast("string")).otherwise(s))
        ls = F.filter(paired, lambda s: s.isNotNull())
    if r.drop:
        ls = F.filter(ls, lambda s: ~s.rlike("|".join(r.drop)))
    head = source_line(text)
    return F.concat(head, F.when(head != "", "\n\n").otherwise(""), _tidy(ls))


def merged_headings(text: Column) -> Column:
    """A heading mark alone on its line takes the next text line as its heading."""
    return F.regexp_replace(text, r"(?dm)^(#{1,6}) *\n+(?=[^#\s])", "$1 ")


def without_trailing_links(text: Column) -> Column:
    """Without the rule and the link-only lines that end a page."""
    return F.regexp_replace(text, r"(?:\n(?:\s*[\*\-]?\s*\[[^\]\n]*\]\([^)\n]*\)|\s*\* \* \*|\s*))+\z", "")
