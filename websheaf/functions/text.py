"""Text functions as Column expressions; the few that Spark has no expression for are Arrow UDFs over slices of a batch."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType

MAX_SNIPPET = 500
#: Characters of a text that are searched for a doubled beginning.
HEAD = 300
#: Bytes of texts that a Python worker turns into objects at once.
SLICE = 1_000_000
#: The English and German stop words of the density measure.
STOPWORDS = (
    "a about above after again all also although among an and any are as at be because been before being between both but by can could did do"
    " does doing during each even ever for from get got had has have having he her here him his how if in into is it its itself just like may"
    " me might more most much my nor not now of off on or other our out own per s shall she should since so some such t than that the their"
    " them then there these they this those through to too under up us very was we were what when where which while who will with would you"
    " your re ve ll d m no use aber alle allem allen aller alles als also am an ander andere anderen anderer anderes auf aus bei bin bis bist"
    " da damit dann das dass dem den denn der des dessen die dies diese diesem diesen dieser dieses doch dort du durch ein eine einem einen"
    " einer eines er es etwas fur gegen gibt hat hatte haben hier hin hinter ich im in ist ja jede jedem jeden jeder jedes jetzt kann kein"
    " keine konnte mal man mehr mein mit nach nicht noch nun nur ob oder ohne schon sehr seit sich sie sind so soll sondern uber um und uns"
    " unter viel vom von vor war was weil wenn werden wie will wir wird wo wurde zum zur zu"
).split()
#: Marks of bloated snippets.
BLOAT = [
    ("B1", "›"), ("B2", r"(?U)\bRead more\b"), ("B3", "^Web results"), ("B4", "^Featured snippet from the web"), ("B5", r"\d[\d,.]*[Kk]?\+? *(likes|comments|answers|posts) *·"), ("B6", r"(?U)^…\s|\s…\s|…$"),
    ("B7", r"^\.\.\. .{5,150} \.\.\.$"), ("B8", r"&[a-z]+;|&#\d+;"), ("B9", r"(?U)Tagged with [\w, ]+\.?$"), ("B10", r"<jats:|<ns\d+:"),
]
#: What strip_bloat takes out, in this order, and what comes instead.
STRIPPED = [
    ("^Web results", ""), ("^Featured snippet from the web", ""), (r"(?U)^\s*·\s*Translate this page", ""), (r"(?dU)\bRead more.*", ""), (r"\d[\d,.]*[Kk]?\+? *(likes|comments|answers|posts) *·[^\n]*", ""),
    (r"(?U)\S*›\S*", ""), (r"(?U)\d{1,2} \w{3,9} \d{4} — ", ""), (r"&[a-z]+;|&#\d+;", ""), (r"(?U)Tagged with [\w, ]+\.?$", ""), ("<[^>]+>", " "),
]
#: Month names of localised dates.
MONTHS = {
    1: "jan january januar jän jänner", 2: "feb february februar", 3: "mar march märz mär", 4: "apr april", 5: "may mai", 6: "jun june juni",
    7: "jul july juli", 8: "aug august", 9: "sep sept september", 10: "oct october okt oktober", 11: "nov november", 12: "dec december dez dezember",
}

#: Unicode white space, and runs of it other than a single space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = r"(?U) \s+|[^\S ]\s*"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), where `value` is computed once however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def strip(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(text, F.lit(WHITE))


def rstrip(text: Column) -> Column:
    """Without Unicode white space at the end."""
    return F.rtrim(text, F.lit(WHITE))


def single_spaced(text: Column) -> Column:
    """Every run of white space one space."""
    return F.regexp_replace(text, _RUN, " ")


def squeezed(text: Column) -> Column:
    """Stripped, and every run of white space one space."""
    return strip(single_spaced(text))


def ranges(texts: pa.Array, most: int = SLICE) -> list[tuple[int, int]]:
    """[a, b) of parts of an Arrow array of about `most` bytes each, so that a task's memory does not follow the batch."""
    bytes_ = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(bytes_, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def by_slices(convert: Callable[[list], pa.Array], returns: DataType | str):
    """An Arrow UDF over a column of texts: `convert` makes an array of a list of them (or of nulls), a slice of a batch at a
    time, and each slice's result leaves the worker before the next one is made."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for a, b in ranges(batch):
                yield convert(batch.slice(a, b - a).to_pylist())

    return run


#: A character reference, as Python's html.unescape finds it; it holds no line end.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_decoded = by_slices(lambda found: pa.array([None if x is None else list(map(html.unescape, x.split("\n"))) for x in found], pa.list_(pa.string())), ArrayType(StringType()))


def unescape(text: Column) -> Column:
    """Character references decoded once. Python sees a text's references only, not the text."""
    decoded = _decoded(F.array_join(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), "\n"))
    whole = F.array_join(F.zip_with(F.split(text, _REFERENCE), decoded, lambda between, found: F.concat(between, F.coalesce(found, F.lit("")))), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def _fixpoint(text: str) -> str:
    while (after := html.unescape(text)) != text:
        text = after
    return text


def unescape_all(text: Column) -> Column:
    """Character references decoded until none is left."""
    return by_slices(lambda texts: pa.array([None if t is None else _fixpoint(t) for t in texts], pa.string()), StringType())(text)


def doubled_cut(text: str, lengths: tuple[int, ...] = (100, 70, 50, 30), head: int = HEAD, starts: int = 100, least: int = 60) -> int:
    """Where the longest doubled beginning ends: the farthest end of a second copy of a piece of the text's head, over all
    piece lengths and starts; 0 if nothing is doubled."""
    if len(text) < least:
        return 0
    top, best = text[:head], 0
    for n in lengths:
        for i in range(min(max(len(top) - 2 * n, 0), starts)):
            again = top.find(top[i : i + n], i + n)
            if again >= 0:
                best = max(best, again + n)
    return best


_cuts = by_slices(lambda heads: pa.array([None if h is None else doubled_cut(h) for h in heads], pa.int32()), IntegerType())


def without_doubled(text: Column) -> Column:
    """A text from the end of its doubled beginning on. Python sees the head that doubled_cut() looks at, not the text."""
    return F.substring(text, _cuts(F.left(text, F.lit(HEAD))) + 1, F.length(text))


def strip_bloat(text: Column, decode: bool = True, doubled: bool = True) -> Column:
    """A snippet without what search pages add to it. `decode` reads character references first, `doubled` cuts a doubled
    beginning; both need Python, the rest is expressions."""
    if decode:
        text = unescape(text)
    if doubled:
        text = without_doubled(text)
    for pattern, instead in STRIPPED:
        text = F.regexp_replace(text, pattern, instead)
    return squeezed(text)


def truncate(text: Column, most: int = MAX_SNIPPET) -> Column:
    """At most `most` characters: up to the last sentence end in the second half, else the last space and …, else a cut."""
    sub = F.left(text, F.lit(most))
    back = F.reverse(sub)
    stop, space = F.instr(back, " ."), F.instr(back, " ")
    at_stop, at_space = most - stop, most - space  # characters up to and with the period; before the space
    return (
        F.when(F.length(text) <= most, text)
        .when((stop > 0) & (at_stop - 1 >= most // 2), F.left(text, at_stop))
        .when(space > 0, F.concat(F.left(text, at_space), F.lit("…")))
        .otherwise(F.concat(sub, F.lit("…")))
    )


def bloat_marks(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in BLOAT]), lambda x: x.isNotNull())


def lexical_density(text: Column) -> Column:
    """Different words that aren't stop words over all words of three letters or more; 0 without words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b[a-zA-ZäöüÄÖÜßé]{3,}\b"), 0)
    content = F.array_except(words, F.array(*map(F.lit, [w for w in STOPWORDS if len(w) > 2])))
    return F.when(F.size(words) > 0, F.size(content) / F.size(words)).otherwise(0.0)


def usefulness(text: Column) -> Column:
    """Length without bloat times density."""
    return F.length(strip_bloat(text, decode=False)) * lexical_density(text)


def strip_html(text: Column, most: int = MAX_SNIPPET) -> Column:
    return F.left(squeezed(unescape(F.regexp_replace(text, "<[^>]+>", " "))), F.lit(most))


def strip_jats(text: Column) -> Column:
    """An abstract's XML: tags and references go, white space is squeezed."""
    return squeezed(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"&[a-zA-Z]+;|&#\d+;", ""))


def partial_date(parts: Column) -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD of [year, month, day], cut at the first null; null without a year."""
    y, m, d = (F.get(parts, i) for i in range(3))
    year = F.lpad(y.cast("string"), 4, "0")
    month = F.concat(year, F.lit("-"), F.lpad(m.cast("string"), 2, "0"))
    day = F.concat(month, F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    return F.when(y.isNull(), F.lit(None).cast("string")).when(m.isNull(), year).when(d.isNull(), month).otherwise(day)


def citation(family: Column, initial: Column, n_authors: Column, year: Column, container: Column) -> Column:
    """Family, I. et al. (year), Container; parts that are missing are left out, nothing without a year."""
    name = F.when(family.isNull(), F.lit(None).cast("string")).when(initial.isNull(), family).otherwise(F.concat(family, F.lit(", "), F.left(initial, F.lit(1)), F.lit(".")))
    who = F.when(n_authors > 1, F.concat(name, F.lit(" et al."))).otherwise(name)
    stem = F.when(who.isNull(), F.concat(F.lit("("), year, F.lit(")"))).otherwise(F.concat(who, F.lit(" ("), year, F.lit(")")))
    return F.when(year.isNull(), "").when(container.isNull(), stem).otherwise(F.concat(stem, F.lit(", "), container))


def inverted_index(words: Column) -> Column:
    """Map of an array's words to their positions from 0, ascending: one sort inside the row, no shuffle."""

    def grouped(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["w"] != x["w"]), i)), lambda i: i.isNotNull())
        places = lambda a, z: F.transform(F.sequence(a, z), lambda i: F.get(s, i)["at"])
        entry = lambda starts: F.transform(starts, lambda a, k: F.struct(F.get(s, a)["w"].alias("w"), places(a, F.coalesce(F.get(starts, k + 1), F.size(s)) - 1).alias("ats")))
        return bound(begins, entry)

    pairs = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    return F.map_from_entries(bound(F.sort_array(pairs), grouped))


def abstract(index: Column) -> Column:
    """Text of an inverted index (word -> positions): words by position; where two claim one, the later in word order."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    pairs = bound(F.sort_array(flat), lambda o: F.zip_with(o, F.slice(o, 2, F.greatest(F.size(o), F.lit(1))), lambda x, y: F.struct(x.alias("x"), y["p"].alias("next"))))
    last = F.filter(pairs, lambda e: F.coalesce(e["next"] != e["x"]["p"], F.lit(True)) & e["x"].isNotNull())
    return F.array_join(F.transform(last, lambda e: e["x"]["w"]), " ")


def epoch_day(seconds: Column) -> Column:
    """The UTC day of epoch seconds, whatever the session's time zone; years of five digits and more have no sign in front."""
    day = F.date_from_unix_date(F.floor(seconds / 86400).cast("int"))
    return F.regexp_replace(day.cast("string"), r"^\+", "")


def localised_date(text: Column) -> Column:
    """YYYY-MM-DD of `12. März 2024`, `Mar 5, 2024` and their like; null otherwise. Days are not checked against months."""
    pairs = [F.lit(x) for n, names in MONTHS.items() for name in names.split() for x in (name, f"{n:02d}")]
    months = F.create_map(*pairs)
    first = [F.regexp_extract(text, r"(?U)^\s*(\d{1,2})\.?\s+(\p{L}+)\.?\s+(\d{4})", i) for i in (1, 2, 3)]
    second = [F.regexp_extract(text, r"(?U)^\s*(\p{L}+)\.?\s+(\d{1,2}),?\s+(\d{4})", i) for i in (2, 1, 3)]
    d, m, y = (F.when(first[0] != "", a).otherwise(b) for a, b in zip(first, second))
    month = F.try_element_at(months, F.lower(m))
    return F.when(month.isNotNull(), F.concat_ws("-", y, month, F.lpad(d, 2, "0")))


def iso_day(text: Column) -> Column:
    """A leading YYYY-MM-DD, after white space of any kind; null otherwise."""
    found = F.regexp_extract(text, r"(?U)^\s*(\d{4}-\d{2}-\d{2})", 1)
    return F.when(found != "", found)


def prompt_item(position: Column, title: Column, snippet: Column) -> Column:
    """A numbered line for a selector: title to 120 characters, snippet to 200, line ends as spaces."""
    flat = lambda c, n: F.left(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(n))
    return F.concat(position.cast("string"), F.lit(". "), flat(title, 120), F.lit(" | "), flat(snippet, 200))


def indexed_counts(text: Column) -> Column:
    """(files, chunks) of `Done: N files indexed (M chunks)`; 0 where it isn't said."""
    number = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"Done: (\d+) files? indexed \((\d+) chunks?\)", i), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    return F.struct(number(1).alias("files"), number(2).alias("chunks"))


def book_snippet(author: Column, year: Column, editions: Column, access: Column) -> Column:
    """What is known of a book: author and year where they are, editions, and how it can be read."""
    rest = F.concat(F.coalesce(editions, F.lit(0)).cast("string"), F.lit(" eds, ebook: "), F.coalesce(access, F.lit("unknown")))
    who = F.when((author != "") & year.isNotNull(), F.concat(author, F.lit(" ("), year.cast("string"), F.lit(") — "))).when(author != "", F.concat(author, F.lit(" — ")))
    when = F.when(year.isNotNull(), F.concat(F.lit("("), year.cast("string"), F.lit(") — ")))
    return F.concat(F.coalesce(who, when, F.lit("")), rest)
