"""A page's publication day: candidates from metadata, address and visible text, scored by what they say they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from websheaf.functions.text import MONTHS

#: Sources in order of trust. `modified` days are used only where nothing else is found.
SOURCES = ("json-ld", "meta", "time published", "url", "text published", "time", "text", "modified")
#: Days before this are mistakes.
EARLIEST = "1995-01-01"

_ISO = r"(\d{4}-\d{2}-\d{2})"
_PUBLISHED = r"(?:article:published_time|og:published_time|datePublished|dateCreated|date|pubdate|publishdate|publish_date|dc\.date(?:\.issued|\.created)?|dcterms\.(?:created|issued|date)|parsely-pub-date|sailthru\.date|citation_publication_date|citation_date)"
_CHANGED = r"(?:article:modified_time|og:updated_time|dateModified|last-modified|lastmod|dcterms\.modified|revised)"
_NAMES = "|".join(sorted((n for names in MONTHS.values() for n in names.split()), key=lambda n: (-len(n), n)))
_DAY_FIRST = rf"(?iu)\b(\d{{1,2}})(?:\.|st|nd|rd|th)? ({_NAMES})\.?,? (\d{{4}})\b"
_MONTH_FIRST = rf"(?iu)\b({_NAMES})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})\b"
_NUMERIC = rf"(?<![\d-]){_ISO}(?![\d-])"
_SAYS = r"(?iu)\b(?:published|posted|first published|veröffentlicht|erschienen|stand|date|datum)\b[^\n]{0,40}$"
_HIDDEN = r"(?is)<(script|style|noscript|template|head)\b.*?</\1\s*>|<!--.*?-->"


def _month(name: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(name).isin(names.split()), F.lit(f"{n:02d}")) for n, names in MONTHS.items()])


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), month, F.lit("-"), F.lpad(day, 2, "0"))


def _found(source: str, days: Column) -> Column:
    return F.transform(days, lambda d: F.struct(F.lit(SOURCES.index(source)).alias("rank"), F.try_to_date(d, "yyyy-MM-dd").alias("day")))


def _all(text: Column, *patterns: str) -> Column:
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])


def _meta(names: str) -> tuple[str, str]:
    return rf"(?is)<meta\s[^>]*(?:name|property|itemprop|http-equiv)=[\"']?{names}[\"']?\s[^>]*content=[\"']?{_ISO}", rf"(?is)<meta\s[^>]*content=[\"']?{_ISO}[^>]*?\s(?:name|property|itemprop|http-equiv)=[\"']?{names}[\"'\s/>]"


def _in_text(text: Column) -> Column:
    """Days written in a line of text, in the three usual ways."""
    named = F.transform(F.regexp_extract_all(text, F.lit(_DAY_FIRST), F.lit(0)), lambda m: _iso(F.regexp_extract(m, _DAY_FIRST, 3), _month(F.regexp_extract(m, _DAY_FIRST, 2)), F.regexp_extract(m, _DAY_FIRST, 1)))
    first = F.transform(F.regexp_extract_all(text, F.lit(_MONTH_FIRST), F.lit(0)), lambda m: _iso(F.regexp_extract(m, _MONTH_FIRST, 3), _month(F.regexp_extract(m, _MONTH_FIRST, 1)), F.regexp_extract(m, _MONTH_FIRST, 2)))
    return F.concat(_all(text, _NUMERIC), named, first)


def _of_lines(lines: Column) -> Column:
    """Days in visible lines; those of lines that say so, or that follow a line which ends with saying so, are trusted more."""

    def said(i: Column) -> Column:
        before = F.when(i > 0, F.get(lines, i - 1)).otherwise("")
        own = F.regexp_replace(F.get(lines, i), rf"{_ISO}.*|{_DAY_FIRST}.*|{_MONTH_FIRST}.*", "")
        return F.rlike(before, F.lit(_SAYS)) | F.rlike(own, F.lit(_SAYS))

    days = F.transform(lines, lambda line, i: F.struct(_in_text(line).alias("days"), i.alias("i")))
    dated = F.filter(days, lambda x: F.size(x["days"]) > 0)
    both = lambda x: F.concat(_found("text", x["days"]), F.when(said(x["i"]), _found("text published", x["days"])).otherwise(F.array()))
    return F.flatten(F.transform(dated, both))


def candidates(html: Column, url: Column) -> Column:
    """Array of (rank, day), rank being the place in SOURCES; days that do not exist are null."""
    page, address = F.coalesce(html, F.lit("")), F.coalesce(url, F.lit(""))
    visible = F.regexp_replace(F.regexp_replace(F.regexp_replace(page, _HIDDEN, " "), r"(?i)<(?:br|/?(?:p|div|li|h[1-6]|tr|td|article|section|header|footer|time|span))\b[^>]*>", "\n"), "<[^>]*>", " ")
    lines = F.split(F.regexp_replace(F.regexp_replace(visible, r"(?U)[^\S\n]+", " "), r"\s*\n\s*", "\n"), "\n")
    path = F.regexp_extract(address, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    in_path = F.transform(F.regexp_extract_all(path, F.lit(r"(?<!\d)((?:19|20)\d{2}[/_.-]\d{1,2}[/_.-]\d{1,2})(?!\d)"), F.lit(1)), lambda m: _iso(F.regexp_extract(m, r"^(\d+)\D(\d+)\D(\d+)$", 1), F.lpad(F.regexp_extract(m, r"^(\d+)\D(\d+)\D(\d+)$", 2), 2, "0"), F.regexp_extract(m, r"^(\d+)\D(\d+)\D(\d+)$", 3)))
    return F.concat(
        _found("json-ld", _all(page, rf'(?i)"(?:datePublished|dateCreated)"\s*:\s*"{_ISO}')),
        _found("meta", _all(page, *_meta(_PUBLISHED))),
        _found("time published", _all(page, rf"(?is)<time\s(?=[^>]*(?:pubdate|datePublished|published|entry-date))[^>]*datetime=[\"']?{_ISO}")),
        _found("url", in_path),
        F.flatten(F.transform(F.array(lines), _of_lines)),
        _found("time", _all(page, rf"(?is)<time\s[^>]*datetime=[\"']?{_ISO}")),
        _found("modified", F.concat(_all(page, rf'(?i)"dateModified"\s*:\s*"{_ISO}'), _all(page, *_meta(_CHANGED)))),
    )


def publication_day(html: Column, url: Column, latest: Column) -> Column:
    """Struct of `day` and `source`: the earliest plausible day of the most trusted source that has one; nulls without any.

    Sources in order: JSON-LD, metadata of publication, a time element that says it is the publication's, the address,
    a text line that says so, other time elements, any day in the visible text, metadata of the last change. Plausible days
    lie between EARLIEST and `latest`. Days are taken to the day; what is hidden (scripts, styles, comments) is not text.
    """
    plausible = F.filter(candidates(html, url), lambda c: c["day"].isNotNull() & (c["day"] >= F.lit(EARLIEST).cast("date")) & (c["day"] <= latest))
    best = F.array_min(plausible)
    return F.struct(best["day"].alias("day"), F.get(F.array(*map(F.lit, SOURCES)), best["rank"]).alias("source"))
