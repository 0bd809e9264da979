"""Page text: verdicts and cleanup as Column expressions over whole markdown texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from websheaf.functions.text import bound, rstrip, squeezed, strip

#: Signals of pages that hold no content.
ERROR_TEXTS = ["crawl4ai error:", "document is empty", "page is not fully supported"]
HTTP_TEXTS = ["not_found", "404", "403", "forbidden", "access denied", "page not found"]
LOGIN_TEXTS = "sign in|log in|login|subscribe to continue|create account|create an account|premium content|paywall|members only|subscriber only".split("|")
COOKIE_TEXTS = ["consent preferences", "cookieyes", "cookie preferences"]
CONSENT_WORDS = "cookie consent einwilligung tracking akzeptieren datenschutz zweck".split()
#: Headings and lines from which on a page is no article any more.
TAIL = r"(?dm)^(?:## Continue reading\s*$|## Related posts?\s*$|## Related articles?\s*$|## Comments\s*$|## Webmentions?\s*$|## Replies\s*$|You are here:\s*$|\s*Copyright\s+\d{4})"
#: End marks of feed markdown, and lines of it that are dropped.
FEED_ENDS = [r"^More For You\s*$", "^## More For You", "^## We Care About Your Privacy", r"^(\[[^\]]+\]\([^)]+\)){2,}$"]
FEED_DROPS = [
    r"^(\[[^\]]+\]\([^)]+\))+$", r"\[Make\s*\]\(https://www\.google\.com/preferences/source", r"^(?:Updated |Published )?[A-Z][a-z]+ \d{1,2}, \d{4},.*read$",
    r"^By \[.*?\]\(.*?\)(?:[,|].*)?\s*$", r"^!\[.*?\]\(.*?\)\s*$", r"^\[!\[.*?\]\(.*?\)\]\(.*?\)\s*$",
]
#: What article markdown loses, in this order, and what comes instead.
ARTICLE_REMOVALS = [
    (r"\[([^\]]+)\]\(https?://[^)]+\)", "$1"), (r"(?s)<span[^>]*data-mce-type[^>]*>.*?</span>", ""), (r"(?dm)^Disclaimer: The Block is an independent media outlet.*$", ""),
    (r"(?dm)^©\s*\d{4}\s+(?:The Block Crypto,\s*Inc\.|The Block)\.?\s*All Rights Reserved.*$", ""), (r"(?dm)^_.*subscribe to the .*newsletter.*$", ""), (r"(?dm)^_?This post is commissioned\b.*$", ""),
    (r"(?dm)^[*_]*Listen below[,.]?\s+and subscribe to\b.*$", ""),
]
#: str.splitlines() ends lines at these.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def has_any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def times(text: Column, words: list[str]) -> Column:
    """How often these words occur, overlapping words counted each."""
    out = F.lit(0)
    for w in words:
        out = out + F.regexp_count(text, F.lit(w))
    return out


def selected(fit: Column, raw: Column, least: int = 200) -> Column:
    """(text, fell_back): the fitted text, or the raw one where the fitted is shorter than `least` and the raw isn't empty."""
    back = (F.length(fit) < least) & (F.length(raw) > 0)
    return F.struct(F.when(back, raw).otherwise(fit).alias("text"), back.alias("fell_back"))


#: Words of consent walls and how often they make one, texts of browser checks (the last two only together), links to
#: skip menus, links to headings, and pilcrow links.
WALL_WORDS, WALL_TIMES = ["cookie", "consent", "duration"], 15
CHECK_TEXTS, CHECK_PAIR = ["checking your browser", "enable javascript and cookies"], ("just a moment", "cloudflare")
SKIP_LINK = r"(?dmi)^\s*\[\s*Skip to [^\]]+\]\([^)]+\)\s*$"
HEADING_LINK = r"\[(#|¶)\]\([^)]+\s+\"(?:Link to this heading|Permalink[^\"]*)\"\)"
PILCROW_LINK = r"\[¶\]\([^)]*\)"


def garbage(text: Column) -> Column:
    """Why a text is no content: the first rule that fires; null for content. Long texts are searched in their head only
    where the rule says so."""
    low = F.lower(text)
    filled = F.regexp_count(text, F.lit(r"(?mU)^[^\S\n\r]*\S"))
    links = F.regexp_count(text, F.lit(r"(?mU)^[^\S\n\r]*\[.+\]\(.+\)[^\S\n\r]*$"))
    head = F.left(low, F.lit(5000))
    n = F.length(text)
    return (
        F.when(text.isNull() | (F.length(strip(text)) < 50), "minimal_content")
        .when(has_any(low, ERROR_TEXTS), "crawl4ai_error")
        .when((n < 1000) & has_any(low, HTTP_TEXTS), "http_error")
        .when((filled >= 20) & (links / filled > 0.6), "nav_dump")
        .when((times(head, WALL_WORDS) > WALL_TIMES) & has_any(head, COOKIE_TEXTS), "cookie_wall")
        .when((n < 2000) & has_any(low, LOGIN_TEXTS), "login_wall")
        .when((n < 500) & has_any(low, CHECK_TEXTS), "cloudflare")
        .when(low.contains(CHECK_PAIR[0]) & low.contains(CHECK_PAIR[1]), "cloudflare")
    )


def crawl_body(text: Column) -> Column:
    """Without pilcrow links, runs of three or more line ends as two, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(text, PILCROW_LINK, ""), "\n{3,}", "\n\n"))


def article_clean(md: Column) -> Column:
    """Article markdown without a site's own additions; lines right-stripped, at most one empty line in a row."""
    for pattern, instead in ARTICLE_REMOVALS:
        md = F.regexp_replace(md, pattern, instead)
    md = F.array_join(F.transform(lines(md), rstrip), "\n")
    return strip(F.regexp_replace(md, "\n{3,}", "\n\n"))


def feed_body(md: Column) -> Column:
    """Lines from the first H1 to the first end mark after it; all of a text without H1."""

    def to_end(ls: Column) -> Column:
        end = F.array_position(F.transform(F.slice(ls, 2, F.size(ls)), lambda s: s.rlike("|".join(FEED_ENDS))), True).cast("int")
        return bound(end, lambda n: F.when(n > 0, F.slice(ls, 1, n)).otherwise(ls))

    def from_start(ls: Column) -> Column:
        start = F.array_position(F.transform(ls, lambda s: s.startswith("# ")), True).cast("int")
        return bound(start, lambda n: F.when(n > 0, bound(F.slice(ls, n, F.size(ls)), to_end)).otherwise(F.array(strip(md))))

    return bound(lines(md), from_start)


def feed_lines(body: Column) -> Column:
    """Lines without bylines, badges, images and tag lists; links as their text; right-stripped."""
    kept = F.filter(body, lambda s: ~s.rlike("|".join(FEED_DROPS)))
    bare = F.transform(kept, lambda s: F.regexp_replace(F.regexp_replace(s, r"\[\]\(.*?\)", ""), r"\[([^\]]+)\]\([^)]+\)", "$1"))
    return F.transform(bare, lambda s: F.rtrim(s, F.lit(" \t")))


def with_previous(items: Column, f) -> Column:
    """f(previous or null, item) over an array, without looking items up by their place."""
    shifted = lambda xs: F.concat(F.array(F.lit(None).cast("string")), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))))
    return bound(items, lambda xs: F.zip_with(shifted(xs), xs, f))


def paragraphs(body: Column) -> Column:
    """One empty line between adjacent body paragraphs, none twice, none at the ends. A body paragraph begins with none
    of # * -."""
    plain = lambda s: F.coalesce((s != "") & ~F.ltrim(s).rlike("^[#*-]"), F.lit(False))
    ls = F.transform(body, lambda s: F.when(strip(s) == "", "").otherwise(s))
    spaced = F.array_join(with_previous(ls, lambda before, s: F.when(plain(before) & plain(s), F.concat(F.lit("\n"), s)).otherwise(s)), "\n")
    return F.regexp_replace(F.regexp_replace(spaced, "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def feed_clean(md: Column) -> Column:
    has_h1 = md.rlike(rf"(?:\A|{LINE_END})# ")
    return F.when(has_h1, paragraphs(feed_lines(feed_body(md)))).otherwise(strip(md))


def without_skip_links(text: Column) -> Column:
    return F.regexp_replace(text, SKIP_LINK, "")


def without_anchors(text: Column) -> Column:
    return F.regexp_replace(text, HEADING_LINK, "")


def without_tail(text: Column) -> Column:
    """Up to the first tail mark, right-stripped, with one line end."""
    cut = F.get(F.split(text, TAIL, 2), 0)
    return F.concat(rstrip(cut), F.lit("\n"))


def chrome_clean(text: Column) -> Column:
    """The generic steps of chrome removal: skip links, anchors, tail, runs of four or more line ends as three."""
    return F.regexp_replace(without_tail(without_anchors(without_skip_links(text))), "\n{4,}", "\n\n\n")


def without_consent(text: Column) -> Column:
    """A text whose head speaks of consent more than five times begins at its first H1 or H2 after 300 characters."""
    dense = times(F.lower(F.left(text, F.lit(3000))), CONSENT_WORDS) > 5
    rest = F.substring(text, 301, 1 << 30)
    at = F.regexp_instr(rest, F.lit("\n#{1,2} "))
    return F.when(dense & (at > 0), F.substring(rest, at + 1, F.length(rest))).otherwise(text)


def code_blocks(text: Column) -> Column:
    """(blocks, mangled): complete fences, and whether one is left open."""
    fences = F.size(F.filter(lines(text), lambda s: F.ltrim(s).startswith("```")))
    return F.struct(F.floor(fences / 2).cast("int").alias("blocks"), (fences % 2 == 1).alias("mangled"))


def line_set(text: Column) -> Column:
    """Different lines, lower-cased and squeezed, without empty ones and the source comment."""
    low = F.transform(lines(F.lower(text)), squeezed)
    return F.array_distinct(F.filter(low, lambda s: (s != "") & ~s.startswith("<!-- source:")))


def line_scores(found: Column, gold: Column) -> Column:
    """(recall, precision, f1) of two line sets; 0 where either is empty."""

    def scores(n: Column) -> Column:
        recall, precision = n["common"] / n["gold"], n["common"] / n["found"]
        both = (n["found"] > 0) & (n["gold"] > 0)
        f1 = F.when(both & (n["common"] > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)
        return F.struct(F.when(both, recall).otherwise(0.0).alias("recall"), F.when(both, precision).otherwise(0.0).alias("precision"), f1.alias("f1"))

    counts = lambda a, b: F.struct(F.size(F.array_intersect(a, b)).alias("common"), F.size(a).alias("found"), F.size(b).alias("gold"))
    return bound(counts(found, gold), scores)


def page_title(page: Column) -> Column:
    return strip(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1))


def citation_pdf(page: Column) -> Column:
    """A page's citation_pdf_url, whichever attribute comes first; null without one."""
    a = F.regexp_extract(page, r"(?is)<meta[^>]+name=[\"']citation_pdf_url[\"'][^>]+content=[\"']([^\"']+)", 1)
    b = F.regexp_extract(page, r"(?is)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]+name=[\"']citation_pdf_url[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def links(page: Column) -> Column:
    """href values of a page, in order."""
    return F.regexp_extract_all(page, F.lit(r"href=\"([^\"]*)\""), 1)


def stated_date(page: Column) -> Column:
    """A page's publication day: JSON-LD, then the usual meta tags (either attribute first), then a time element; null
    without one."""
    day = r"(\d{4}-\d{2}-\d{2})"
    name = r"(?:article:published_time|datePublished|date|pubdate|publishdate)"
    patterns = [
        rf'(?is)"datePublished"\s*:\s*"{day}', rf"(?is)<meta[^>]+(?:name|property|itemprop)=[\"']{name}[\"'][^>]+content=[\"']{day}",
        rf"(?is)<meta[^>]+content=[\"']{day}[^\"']*[\"'][^>]+(?:name|property|itemprop)=[\"']{name}[\"']", rf"(?is)<time[^>]+datetime=[\"']{day}",
    ]
    return F.coalesce(*[F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in patterns])
