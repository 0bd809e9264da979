"""Queries over whole HTML pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.functions import dates, markdown
from websheaf.plans.fixtures import load

_CONSENT = [markdown.Selector.of(s) for s in markdown.CONSENT]


def _markdown(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "pages").select("page_id", markdown.markdown(F.col("html")).alias("m")).select("page_id", "m.raw", "m.fit", "m.removed")


def _without_consent(s: SparkSession, d: str) -> DataFrame:
    """Every page that has html with a notice that one of the selectors matches, its own navigation inside, in front of the
    article, or of all if there is none."""
    names = F.array(*[F.struct(F.lit(c.attribute).alias("kind"), F.lit(c.value).alias("value")) for c in _CONSENT])
    pick = F.element_at(names, (F.col("page_id") % len(_CONSENT) + 1).cast("int"))
    kind, value = pick["kind"], pick["value"]
    notice = F.concat(F.lit("<section "), kind, F.lit('="x '), value, F.lit('-y"><p>We value <b>your privacy</b>'), F.regexp_extract("html", "(?s)<nav>.*</nav>", 0), F.lit("</section><article>"))
    placed = F.regexp_replace("html", F.lit("<article>"), F.regexp_replace(notice, r"([\\$])", r"\\$1"))
    html = F.when(F.contains("html", F.lit("<article>")), placed).otherwise(F.concat(notice, "html"))
    return load(s, d, "pages").filter("html IS NOT NULL").select("page_id", value.alias("name"), markdown.markdown(html).alias("m")).select("page_id", "name", "m.raw", "m.removed")


def _day(n: int) -> F.Column:
    """A day that depends on the page, `n` tells several of them apart."""
    return F.date_add(F.lit("2003-01-01").cast("date"), ((F.col("page_id") * 37 + n * 1009) % 7000).cast("int"))


def _publication_days(s: SparkSession, d: str) -> DataFrame:
    """Whole pages with days of several sources: which ones goes by the page's number, in bits; a later change is always named."""
    iso = [_day(n).cast("string") for n in range(5)]
    has = lambda bit: F.col("page_id").bitwiseAND(1 << bit) > 0
    head = F.concat(
        F.lit('<meta property="article:modified_time" content="'), F.date_add(_day(0), 30).cast("string"), F.lit('T00:00:00Z">'),
        F.when(has(0), F.concat(F.lit('<script type="application/ld+json">{"@type": "NewsArticle", "datePublished": "'), iso[0], F.lit('T01:02:03Z"}</script>'))).otherwise(""),
        F.when(has(1), F.concat(F.lit("<meta content='"), iso[1], F.lit("' name='pubdate'>"))).otherwise(""), F.lit("</head>"),
    )
    body = F.concat(F.lit("<article>"), F.when(has(2), F.concat(F.lit("<p>Published on "), F.date_format(_day(2), "d MMMM yyyy"), F.lit("</p>"))).otherwise(""), F.when(has(3), F.concat(F.lit('<time datetime="'), iso[3], F.lit('">then</time>'))).otherwise(""))
    url = F.when(has(4), F.concat(F.lit("https://n.example/"), F.date_format(_day(4), "yyyy/MM/dd"), F.lit("/story"))).otherwise(F.lit("https://n.example/story"))
    html = F.replace(F.replace("html", F.lit("</head>"), head), F.lit("<article>"), body)
    return load(s, d, "pages").select("page_id", dates.publication_day(html, url, F.lit("2024-01-01").cast("date")).alias("p")).select("page_id", F.col("p.day").cast("string").alias("day"), "p.source")


QUERIES = {"c03_page_markdown": _markdown, "c04_without_consent": _without_consent, "c05_publication_day": _publication_days}


def _decoded(x: str) -> str:
    return rf"regexp_replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', chr(34)), '&amp;?', '&', 'g')"


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f\v]+', ' ', 'g'))"


#: Blocks of a driver page in order: text, what stands around it in markdown, its score; a score has the text's and markup's
#: characters, the links' share (none), the tag's weight and the length.
_BLOCKS = rf"""WITH h AS (
  SELECT page_id, html, regexp_extract_all(html, '<li><a href="([^"]*)">[^<]*</a></li>', 1) AS refs, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS names,
    regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS ad, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1, regexp_extract(html, '<footer>([^<]*)</footer>', 1) AS footer,
    list_filter(string_split(regexp_extract(html, '</h1>(.*)</article>', 1, 's'), '<p>'), lambda x: x <> '') AS ps
  FROM pages WHERE html IS NOT NULL
), n AS (
  SELECT page_id, array_to_string(list_transform(range(1, len(refs) + 1), lambda i: '* [' || {_decoded("names[i]")} || '](' || {_decoded("refs[i]")} || ')'), chr(10)) AS nav FROM h
), b AS (
  SELECT page_id, 0 AS i, {_decoded("ad")} AS t, '' AS mark, '' AS around, length('<div class="ad"></div>') AS m, 0.5 AS w FROM h
  UNION ALL SELECT page_id, 1, {_decoded("h1")}, '# ', '', length('<h1></h1>'), 1.2 FROM h
  UNION ALL SELECT page_id, 1 + i, {_decoded("regexp_replace(p, '<[^>]*>', '', 'g')")}, '', CASE WHEN starts_with(p, '<b>') THEN '**' ELSE '' END, length('<p></p>') + CASE WHEN starts_with(p, '<b>') THEN length('<b></b><br>') ELSE 0 END, 1.0
  FROM (SELECT page_id, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i FROM h) x
), s AS (
  SELECT *, {_squeezed("t")} AS c, 0.4 * length({_squeezed("t")}) / (m + length(t)) + CASE WHEN {_squeezed("t")} = '' THEN 0 ELSE 0.2 END + 0.2 * w + 0.1 * ln(length({_squeezed("t")}) + 1) AS score FROM b
), a AS (
  SELECT page_id, string_agg(mark || around || c || around, chr(10) || chr(10) ORDER BY i) FILTER (c <> '') AS body,
    string_agg(mark || around || c || around, chr(10) || chr(10) ORDER BY i) FILTER (c <> '' AND score >= {markdown.THRESHOLD}) AS fit FROM s GROUP BY page_id
), r AS (
  SELECT page_id, concat_ws(chr(10) || chr(10), nullif(nav, ''), body, nullif({_squeezed(_decoded("footer"))}, '')) AS raw, coalesce(fit, '') AS fit FROM a JOIN n USING (page_id) JOIN h USING (page_id)
)"""

SQL = {
    "c05_publication_day": """SELECT page_id, CASE source WHEN 'json-ld' THEN d[1] WHEN 'meta' THEN d[2] WHEN 'url' THEN d[5] WHEN 'text published' THEN d[3] WHEN 'time' THEN d[4] ELSE d[1] + INTERVAL 30 DAY END::DATE::VARCHAR AS day, source FROM (
  SELECT page_id, list_transform(range(5), lambda n: DATE '2003-01-01' + ((page_id * 37 + n * 1009) % 7000)::INTEGER) AS d,
    CASE WHEN page_id & 1 > 0 THEN 'json-ld' WHEN page_id & 2 > 0 THEN 'meta' WHEN page_id & 16 > 0 THEN 'url' WHEN page_id & 4 > 0 THEN 'text published' WHEN page_id & 8 > 0 THEN 'time' ELSE 'modified' END AS source
  FROM pages WHERE html IS NOT NULL) x""",
    "c03_page_markdown": _BLOCKS + "\nSELECT page_id, raw, fit, 0 AS removed FROM r UNION ALL SELECT page_id, '', '', 0 FROM pages WHERE html IS NULL",
    "c04_without_consent": _BLOCKS + f"\nSELECT page_id, ({[c.value for c in _CONSENT]})[(page_id % {len(_CONSENT)} + 1)::INTEGER] AS name, raw, 1 AS removed FROM r",
}
