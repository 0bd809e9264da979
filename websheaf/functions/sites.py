"""Cleaners of documentation sites: a line transducer whose rules are rows of a table, folded over a page's lines.

A site is one row: how its source line is set apart, in which state its pages begin, substitutions before and after the fold,
and rules. A rule holds in some states; it looks at a line and the three lines after it, and says what becomes of the
line and which state follows. New sites are new rows, not new code.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.operators.shared import fresh

#: Lines that a rule sees: its own and the next three.
LOOK = 4
#: Lines that are folded before their results are put aside, so that long pages cost no more a line than short ones.
BLOCK = 128

_PAIR = "array<struct<pattern:string,text:string>>"
_RULE = "array<struct<states:array<string>,pattern:string,action:string,text:string,into:string>>"
SCHEMA = f"site string, head string, joint string, hint string, opens {_PAIR}, before {_PAIR}, rules {_RULE}, others {_RULE}, after {_PAIR}"


@dataclass(frozen=True)
class Rule:
    """In `states`, a line where `pattern` is found at its start is kept, dropped, or `turned` into `text` (with groups); then
    `into` is the state (None: as before). In state `end` everything is dropped."""

    states: str
    pattern: str
    action: str = "drop"
    into: str | None = None
    text: str = ""


@dataclass(frozen=True)
class Site:
    """`head` finds the source line in its first group, `joint` follows it. `opens` gives the state of the first pattern found
    in the page, else `body`. `others` are (state, action, next state) of lines without a rule; unnamed states keep them."""

    rules: tuple[Rule, ...]
    opens: tuple[tuple[str, str], ...] = ()
    others: tuple[tuple[str, str, str | None], ...] = ()
    head: str = r"(\z)"
    joint: str = ""
    before: tuple[tuple[str, str], ...] = ()
    after: tuple[tuple[str, str], ...] = ()


_BLANK = r"[^\S\n]*"
_SKIP_HEAD = (("head", "drop", None),)
#: Ends of pages, source lines, and what the sites add to their pages.
_SOURCE_AND_SPACE = r"\A(<!-- source:[^\n]*?-->\s*\n?)"
_SOURCE_LINE = r"\A(?:[^\n]*\n){0,2}?(<!-- source:[^\n]*)"
_NO_BLANK_END = (rf"(?:\n{_BLANK})+\z", "")
_RULER = r"(?:\* \* \*|---|\*\*\*)"
_LINK_ROW = r"(?:\[[^\]\n]+\]\([^)\n]+\))+"
_CARDS = r"\[[^\n]+?\]\(https?://[^)\n]+\)(?:\[[^\n]+?\]\(https?://[^)\n]+\))+"
_ANCHOR = r"\[\]\(https://[^)\n]+\)"
#: Where the footer begins on pages whose file names begin so, by the first cleaner; `other` is any other name.
_FOOTERS = {
    "metasearch": r"\[ !\[Logo of [^\]\n]*\]",
    "trafilatura": r"(?:\[ !\[Trafilatura|© Copyright \d{4})",
    "crawl4ai": r"(?:Page Copy|ESC to close)\s*$",
    "playwright": r"\[Previous\s",
    "tor": r"\[Edit this page\]\(",
    "anthropic": r"(?:\[\]\(https://(?:platform\.claude\.com|x\.com|www\.linkedin\.com|instagram\.com)|### (?:Solutions|Partners|Company|Learn|Help and security|Terms and policies))",
    "onetrust": r"(?:Getting Started|Did this page help you\?)\s*$",
    "cookieyes": r"## (?:Have more questions\?|CookieYes)\s*$",
    "other": r"(?:Copyright ©|© Copyright|© \d{4})",
}


def _by_footer(footer: str) -> Site:
    """From the first H1 to the footer, without inline source markers, copy buttons and what follows the question of help."""
    return Site(
        head=_SOURCE_AND_SPACE, joint="\n", opens=((r"^# .+", "head"),), others=_SKIP_HEAD,
        rules=(Rule("head", r"# .+", "keep", "body"), Rule("body", footer, into="end")),
        after=((r"\[docs\]\[\]\(https?://[^)]*\)\n?", ""), (r"^Copy page\s*$", ""), (r"^Was this page helpful\?\s*$[\s\S]*", ""), (r"\n{3,}", "\n\n"), (r"(?U)\A\s+|\s+\z", "")),
    )


def _docs(opens: tuple, rules: tuple[Rule, ...], others: tuple = (), after: tuple = ()) -> Site:
    return Site(head=_SOURCE_LINE, joint="\n\n", opens=(*opens, (r"^##? ", "head")), others=(*_SKIP_HEAD, *others), rules=(Rule("head", "##? ", "keep", "body"), *rules), after=(*after, _NO_BLANK_END))


_HELPFUL = "open head body related icon jump"
#: The rule sets of the sites.
SITES = {f"footer/{name}": _by_footer(footer) for name, footer in _FOOTERS.items()} | {
    "onetrust": Site(
        head=r"\A(<!-- source:[^\n]*)", joint="\n\n", opens=((r"\A<!-- source:", "head"),), others=(*_SKIP_HEAD, ("merged", "drop", "body")),
        before=(
            _NO_BLANK_END, (rf"(?<=\n){_BLANK}{_LINK_ROW}{_BLANK}\z", "\u0000"), (rf"(?:\n{_BLANK}{_RULER}{_BLANK})*\n\u0000\z", ""), _NO_BLANK_END,
            (rf"\A([\s\S]*?\S{_BLANK})(?:\n{_BLANK})*(?:\n{_BLANK}{_RULER}{_BLANK})+\z", "$1"), _NO_BLANK_END, (rf"^({_BLANK})\n(?:{_BLANK}\n)+", "$1\n"),
        ),
        rules=(
            Rule("head", "#", "again", "body"), Rule("body", rf"{_ANCHOR}\s*$"), Rule("body", rf"\d+ of \d+\[\]\([^)\n]*\)\s*$"),
            Rule("body", rf"(#{{1,6}}){_BLANK}\n(?:{_BLANK}\n)?{_BLANK}(?!#|{_ANCHOR}{_BLANK}(?:\n|\z))(\S(?:[^\n]*\S)?){_BLANK}(?:\n[\s\S]*|\z)", "turned", "merged", "$1 $2"),
            Rule("body", rf"#{{1,6}}{_BLANK}(?:\n|\z)"), Rule("merged", rf"{_BLANK}(?:\n|\z)"),
        ),
        after=((rf"^({_BLANK})\n(?:{_BLANK}\n)+", "$1\n"), _NO_BLANK_END),
    ),
    "cookieyes": Site(
        opens=((r"\A", "open"),), others=(("related", "drop", None), ("icon", "keep", "body"), ("jump", "keep", "body")),
        rules=(
            Rule("open", r"\s*<!-- source:", "keep", "head"), Rule("head", rf"{_BLANK}(?:\n|\z)"), Rule("head", r"\s*# ", "keep", "body"),
            Rule("body icon jump", rf"{_BLANK}Search for:Search Button\s*$", "drop", "body"), Rule("body icon jump", rf"{_BLANK}\[Help Guides\]\([^\n]* > ", "drop", "body"),
            Rule(_HELPFUL, rf"{_BLANK}Was this article helpful\?{_BLANK}(?:\n|\z)", into="end"), Rule(_HELPFUL, rf"{_BLANK}Was this article helpful\? Yes No", into="end"),
            Rule(_HELPFUL, r"([^\n]*?) Was this article helpful\? Yes No[\s\S]*", "turned", "end", "$1"),
            Rule(_HELPFUL, rf"{_BLANK}## Subscribe to get a monthly", into="end"),
            Rule("open head body related icon jump", rf"{_BLANK}## Related articles{_BLANK}(?:\n|\z)", into="related"), Rule("related", rf"{_BLANK}## ", "again", "body"),
            Rule("open head body icon jump", r"[^\n]*g2-badges"), Rule("open head body icon jump", rf"{_BLANK}!\[skip icon\][^\n]*skip\.svg", into="icon"),
            Rule("icon", rf"{_BLANK}Jump to{_BLANK}(?:\n|\z)", into="jump"), Rule("jump", rf"{_BLANK}\[[^\n]+\]\([^\n]+#[^\n]+\){_BLANK}(?:\n|\z)"),
        ),
        after=(_NO_BLANK_END,),
    ),
    "tor": Site(
        others=(("label", "drop", "body"),),
        rules=(
            Rule("body", r"\s*\*\s*\[[^\]\n]+\]\(https://www\.torproject\.org/(?:[a-z]{2}(?:-[A-Z]{2})?/)?about/jobs/\)", into="end"),
            Rule("body", r"View for: ?$", into="label"), Rule("body", r"Expand all Collapse all$"),
        ),
        after=(_NO_BLANK_END,),
    ),
    "anthropic": Site(
        opens=((r"\A(?:<!-- source:|\s*\n)", "top"),),
        rules=(
            Rule("top", "<!-- source:", "keep"), Rule("top", rf"{_BLANK}(?:\n[\s\S]*|\z)", "turned", "gap", ""), Rule("gap", rf"{_BLANK}(?:\n|\z)"),
            Rule("top gap body", rf"(#{{1,4}}) \n{_BLANK}(?!#)(\S(?:[^\n]*\S)?){_BLANK}(?:\n[\s\S]*|\z)", "turned", "merged", "$1 $2"),
        ),
        others=(("merged", "drop", "body"), ("top", "keep", "body"), ("gap", "keep", "body")),
        after=((rf"(?:\n(?:{_CARDS}{_BLANK}|{_BLANK}))+\z", ""),),
    ),
    "playwright": Site(
        head=_SOURCE_LINE, joint="\n\n", opens=((r"^# ", "head"), (r"\A", "whole")), others=_SKIP_HEAD,
        rules=(Rule("head", "# ", "keep", "body"), Rule("body", r"\[(?:Previous|Next)\b", into="end"), Rule("body", rf"{_BLANK}(?:Learn|Community|More){_BLANK}\n(?:{_BLANK}\n){{0,2}}{_BLANK}\* \[", into="end")),
        after=(_NO_BLANK_END,),
    ),
    "docs/playwright": _docs((), (Rule("body", r"\[(?:Previous|Next)\b", into="end"),), after=(("\\[\u200b\\]\\([^)\n]*\"Direct link to[^\"\n]*\"\\)", ""),)),
    "docs/crawl4ai": _docs(
        ((r"^\s*\[Crawl4AI Documentation[\s\S]*?^##? ", "bar"), (r"^\s*\[Crawl4AI Documentation", "list")),
        (
            Rule("bar", rf"{_BLANK}\[Crawl4AI Documentation", into="head"), Rule("list", rf"{_BLANK}\[Crawl4AI Documentation", into="items"),
            Rule("items", rf"{_BLANK}(?:\n|\z|[*\[-]|×{_BLANK}(?:\n|\z))"),
            Rule("body", rf"{_BLANK}(?:#### On this page|> Feedback|(?:xClose|Type to start searching){_BLANK}(?:\n|\z)|\[ Ask AI \])", into="end"), Rule("body", r"Copy\s*$"),
        ),
        (("bar", "drop", None), ("list", "drop", None), ("items", "again", "body")),
    ),
    "docs/trafilatura": _docs((), (Rule("body", rf"{_BLANK}(?:\[ ?previous |On this page{_BLANK}(?:\n|\z)|### This Page{_BLANK}(?:\n|\z))", into="end"),), after=((r'\[#\]\([^)\n]*"Link to this heading"\)', ""),)),
}


def rule_table(spark: SparkSession, sites: dict[str, Site] | None = None) -> DataFrame:
    """The rule sets as rows, one a site."""
    flags = "(?dm)"
    rows = []
    for name, s in (SITES if sites is None else sites).items():
        pairs = lambda x: [(flags + p, t) for p, t in x]
        rules = [(r.states.split(), rf"{flags}\A{r.pattern}", r.action, r.text, r.into) for r in s.rules]
        others = [([state], "", action, "", into) for state, action, into in s.others] + [(["end"], "", "drop", "", None)]
        hint = rf"{flags}\A(?:{'|'.join(f'(?:{r.pattern})' for r in s.rules)})"
        rows.append((name, flags + s.head, s.joint, hint, pairs(s.opens), pairs(s.before), rules, others, pairs(s.after)))
    return spark.createDataFrame(rows, SCHEMA)


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _first(rules: Column, state: Column, window: Column | None = None) -> Column:
    apt = lambda r: F.array_contains(r["states"], state) & (F.lit(True) if window is None else F.rlike(window, r["pattern"]))
    return F.get(F.filter(rules, apt), 0)


def _substituted(text: Column, passes: Column) -> Column:
    return F.aggregate(passes, text, lambda t, p: F.regexp_replace(t, p["pattern"], p["text"]))


def _folded(text: Column, start: Column, hint: Column, rules: Column, others: Column) -> Column:
    """The page after its rules, line by line. A line's rule is the first that holds; `again` looks once more, in the next state.
    `hint` is found where any rule's pattern is: most lines meet that one pattern only."""
    kind = "struct<state:string,out:array<string>>"
    begin = lambda state: F.struct(state.alias("state"), F.array().cast("array<string>").alias("out")).cast(kind)

    def step(acc: Column, window: Column) -> Column:
        line = F.substring_index(window, "\n", 1)

        def act(rule: Column) -> Column:
            done = F.when(rule["action"] == "turned", F.regexp_replace(window, rule["pattern"], rule["text"])).when(rule["action"] != "drop", line)
            out = F.when(done.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], done))
            return F.struct(F.coalesce(rule["into"], acc["state"]).alias("state"), out.alias("out")).cast(kind)

        found = lambda state: F.coalesce(F.when(F.rlike(window, hint), _first(rules, state, window)), _first(others, state), F.struct(F.array(state).alias("states"), F.lit("").alias("pattern"), F.lit("keep").alias("action"), F.lit("").alias("text"), state.alias("into")))
        again = lambda rule: F.when(rule["action"] == "again", found(rule["into"])).otherwise(rule)
        return _let(_let(found(acc["state"]), again), act)

    def page(windows: Column) -> Column:
        def block(done: Column, k: Column) -> Column:
            state = F.element_at(done, -1)["state"]
            return F.array_append(done, F.aggregate(F.slice(windows, k * BLOCK + 1, BLOCK), begin(state), step))

        blocks = F.sequence(F.lit(0), F.floor((F.size(windows) - 1) / BLOCK).cast("int"))
        done = F.aggregate(blocks, F.array(begin(start)).cast(f"array<{kind}>"), block)
        return F.array_join(F.flatten(F.transform(done, lambda b: b["out"])), "\n")

    seen = lambda lines: F.transform(lines, lambda _, i: F.array_join(F.slice(lines, i + 1, LOOK), "\n"))
    return _let(_let(F.split(text, "\n"), seen), page)


def cleaned(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """`pages` (site string, text string, any other columns) with `text` cleaned by their site's row of rule_table().

    Pages of sites without a row, and null texts, stay as they are. A clean page ends in one line end; a page that its rules
    leave whole (`whole`: no title where one is needed) is not touched. Lines end at \\n (\\r\\n and \\r count as such). A source
    line that is set apart comes once, in front. Everything runs in the engine; the rules are a few rows, which Spark
    broadcasts by their size.
    """
    row, start = fresh(pages, "row"), fresh(pages, "start")
    joined = pages.join(rules.select("site", F.struct(*[c for c in rules.columns if c != "site"]).alias(row)), "site", "left")
    text = F.regexp_replace("text", "\r\n?", "\n")
    r = lambda name: F.col(row)[name]
    head = F.call_function("regexp_extract", text, r("head"), F.lit(1))
    rest = F.when(head != "", F.regexp_replace(text, r("head"), "")).otherwise(text)
    opening = F.get(F.filter(r("opens"), lambda o: F.rlike(text, o["pattern"])), 0)["text"]
    folded = _folded(_substituted(rest, r("before")), F.col(start), r("hint"), r("rules"), r("others"))
    clean = F.concat(head, F.when(head != "", r("joint")).otherwise(""), _substituted(folded, r("after")))
    clean = F.concat(F.regexp_replace(clean, r"\n+\z", ""), F.lit("\n"))
    known = F.col(row).isNotNull() & F.col("text").isNotNull() & (F.col(start) != "whole")
    out = joined.withColumn(start, F.coalesce(opening, F.lit("body")))
    return out.withColumn("text", F.when(known, clean).otherwise(F.col("text"))).select(*pages.columns)
