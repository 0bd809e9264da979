"""Text and page queries over documents and pages, decorated as search pages and crawls decorate them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.functions import pages as p
from websheaf.functions import text as t
from websheaf.operators import ranking
from websheaf.plans.fixtures import DERIVED, load, sql

#: Decorations of a snippet: before and after the text.
_BEFORE = ["Web results", "", "site › path ", "12 answers · asked ", "", "Featured snippet from the web", "3 May 2024 — "]
_AFTER = ["", " Read more at our site", "", "", " Tagged with a, b, c.", "", " &amp; <b>x</b>"]
_PAGES = [
    "404 page not found, sorry, this page is gone, it is really gone", "short", "[a](b)\n" * 25 + "x", "cookie consent " * 12 + "consent preferences and so on and on",
    "Please log in to read this article; it is long enough to count as a text.", "Checking your browser before you go on, it takes a few seconds only", "Just a moment... cloudflare is looking at your browser, please wait a bit",
    "document is empty, said the reader of this page, and went away again at once",
]


def _pick(values: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(number) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], number: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values)
    return f"([{quoted}])[({number} % {len(values)} + 1)::INTEGER]"


DERIVED |= {
    "snips": f"SELECT doc_id, {_pick_sql(_BEFORE, 'doc_id')} || text || {_pick_sql(_AFTER, 'doc_id')} AS s FROM documents",
    "crawled": f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_pick_sql(_PAGES, 'doc_id // 3')} ELSE text END AS md FROM documents",
    "marked_up": """SELECT doc_id, '<!-- source: https://x/' || doc_id || ' -->' || chr(10) || 'nav' || chr(10) || '# Title ' || doc_id || chr(10) || 'By [A](b)' || chr(10) || replace(text, '. ', '.' || chr(10)) || chr(10) || '![i](j)' || chr(10) || '[a](b)[c](d)' || chr(10) ||
    'see [link](https://y/z) here  ' || chr(10) || '[Skip to content](#m)' || chr(10) || '```' || chr(10) || 'x' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '```' ELSE '' END || chr(10) || '## Comments' || chr(10) || 'More For You' || chr(10) || 'rest' AS md FROM documents""",
    "stripped": r"""SELECT doc_id, trim(regexp_replace(s10, '\s+', ' ', 'g')) AS s FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s,
    '^Web results', ''), '^Featured snippet from the web', ''), '\bRead more.*', '', 'g'), '\d[\d,.]*[Kk]?\+? *(likes|comments|answers|posts) *·[^\n]*', '', 'g'), '\S*›\S*', '', 'g'), '\d{1,2} [\p{L}\d_]{3,9} \d{4} — ', '', 'g'), '&[a-z]+;|&#\d+;', '', 'g'), 'Tagged with [\w, ]+\.?$', '') AS s9,
    regexp_replace(s9, '<[^>]+>', ' ', 'g') AS s10 FROM snips) x""",
    "density": rf"""SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_distinct(list_filter(w, lambda x: NOT list_contains([{", ".join(repr(x) for x in t.STOPWORDS)}], x)))) / len(w) ELSE 0 END AS d
    FROM (SELECT doc_id, regexp_extract_all(' ' || regexp_replace(lower(s), '([^\p{{L}}\p{{N}}\p{{M}}_]+)', '  ', 'g') || ' ', ' ([a-zA-ZäöüÄÖÜßé]{{3,}}) ', 1) AS w FROM snips) y""",
}


def snips(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", F.concat(_pick(_BEFORE, "doc_id"), F.col("text"), _pick(_AFTER, "doc_id")).alias("s"))


def crawled(s: SparkSession, d: str) -> DataFrame:
    odd = F.element_at(F.array(*map(F.lit, _PAGES)), (F.floor(F.col("doc_id") / 3) % len(_PAGES) + 1).cast("int"))
    return load(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, odd).otherwise(F.col("text")).alias("md"))


def marked_up(s: SparkSession, d: str) -> DataFrame:
    body = F.replace(F.col("text"), F.lit(". "), F.lit(".\n"))
    n = F.col("doc_id").cast("string")
    md = F.concat(F.lit("<!-- source: https://x/"), n, F.lit(" -->\nnav\n# Title "), n, F.lit("\nBy [A](b)\n"), body, F.lit("\n![i](j)\n[a](b)[c](d)\nsee [link](https://y/z) here  \n[Skip to content](#m)\n```\nx\n"), F.when(F.col("doc_id") % 2 == 0, "```").otherwise(""), F.lit("\n## Comments\nMore For You\nrest"))
    return load(s, d, "documents").select("doc_id", md.alias("md"))


def _on(source, **columns):
    def query(s: SparkSession, d: str) -> DataFrame:
        df = source(s, d)
        return df.select("doc_id", *[f(F.col(df.columns[1])).alias(name) for name, f in columns.items()])

    return query


def _bloat_stats(s: SparkSession, d: str) -> DataFrame:
    """Per source: snippets, empty ones, lengths, share with a mark, lengths without bloat, densities, usefulness."""
    rows = snips(s, d).withColumn("source", F.col("doc_id") % 14).withColumn("clean", t.strip_bloat(F.col("s"), decode=False, doubled=False)).withColumn("density", t.lexical_density(F.col("s")))
    marked = F.avg((F.size(t.bloat_marks(F.col("s"))) > 0).cast("int"))
    return rows.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.avg(F.length("s")), 4).alias("mean_len"), F.median(F.length("s")).cast("double").alias("median_len"), F.round(100 * marked, 4).alias("marked_pct"),
        F.round(F.avg(F.length("clean")), 4).alias("clean_len"), F.round(F.avg("density"), 6).alias("density"),
    )


def _best_source(s: SparkSession, d: str) -> DataFrame:
    """Wins per source: of a url's snippets the one with the largest clean length times density, short ones last."""
    rows = snips(s, d).withColumn("url", F.col("doc_id") % 97).withColumn("source", F.col("doc_id") % 14)
    rows = rows.withColumn("n", F.length(t.strip_bloat(F.col("s"), decode=False, doubled=False))).withColumn("score", F.round(F.col("n") * t.lexical_density(F.col("s")), 6))
    best = ranking.top_n(rows.withColumn("short", F.col("n") < 40), 1, F.col("short"), F.desc("score"), F.col("doc_id"), by=("url",))
    return best.groupBy("source").agg(F.count("*").alias("wins"), F.sum(F.col("short").cast("long")).alias("short_wins"))


def _line_f1(s: SparkSession, d: str) -> DataFrame:
    rows = marked_up(s, d).select("doc_id", p.line_set(F.col("md")).alias("gold"), p.line_set(p.feed_clean(F.col("md"))).alias("found"))
    scored = rows.select("doc_id", p.line_scores(F.col("found"), F.col("gold")).alias("x")).select("doc_id", "x.*")
    return scored.select("doc_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


def _abstract(s: SparkSession, d: str) -> DataFrame:
    index = t.inverted_index(F.split("text", r"[\s]+"))
    return load(s, d, "documents").select("doc_id", t.abstract(index).alias("abstract"))


def _dates(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    names = F.element_at(F.array(*map(F.lit, ["Mai", "March", "Okt", "Dez", "Foo", "juni"])), (n % 6 + 1).cast("int"))
    german = F.concat((n % 28 + 1).cast("string"), F.lit(". "), names, F.lit(" 2024"))
    english = F.concat(names, F.lit(" "), (n % 28 + 1).cast("string"), F.lit(", 2023"))
    parts = F.array(F.lit(2020), F.when(n % 3 > 0, n % 12 + 1), F.when(n % 3 > 1, n % 28 + 1)).cast("array<int>")
    return load(s, d, "documents").select("doc_id", t.localised_date(german).alias("german"), t.localised_date(english).alias("english"), t.partial_date(parts).alias("partial"), t.epoch_day(n * 86400 * 7).alias("day"), t.iso_day(F.concat(F.lit(" 2024-05-0"), (n % 9 + 1).cast("string"), F.lit(" - x"))).alias("iso"))


def _citation(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    when = lambda k, v: F.when(n % k > 0, v)
    return load(s, d, "documents").select("doc_id", t.citation(when(5, F.lit("Müller")), when(3, F.lit("Jana")), n % 4, when(7, F.lit("2021")), when(2, F.lit("Journal"))).alias("citation"))


QUERIES = {
    "a16_snippet_stats": _bloat_stats,
    "a17_a18_best_source": _best_source,
    "c01_selection": lambda s, d: snips(s, d).select("doc_id", p.selected(F.left(F.col("s"), (F.col("doc_id") % 400).cast("int")), F.col("s")).alias("x")).select("doc_id", F.length("x.text").alias("n"), "x.fell_back"),
    "c02_garbage": _on(crawled, verdict=p.garbage),
    "c06_crawl_body": _on(marked_up, body=lambda c: p.crawl_body(F.replace(c, F.lit("\n## "), F.lit("\n\n\n\n[¶](x)## ")))),
    "c11_c12_feed_clean": _on(marked_up, body=p.feed_clean),
    "c13_c16_chrome_clean": _on(marked_up, body=p.chrome_clean),
    "c18_near_empty": lambda s, d: load(s, d, "documents").select(F.col("doc_id") % 50, F.length("text").alias("n")).toDF("g", "n").groupBy("g").agg(F.sum((F.col("n") < 500).cast("long")).alias("skipped"), F.sum(F.when(F.col("n") >= 500, F.col("n")).otherwise(0)).alias("kept_chars")),
    "c20_consent_prefix": _on(crawled, body=lambda c: p.without_consent(F.concat(F.lit("Cookie consent tracking " * 3 + "." * 300 + "\n## Head\n"), c))),
    "c21_code_blocks": lambda s, d: marked_up(s, d).select("doc_id", p.code_blocks(F.col("md")).alias("x")).select("doc_id", "x.*"),
    "c22_line_scores": _line_f1,
    "t02_strip_bloat": _on(snips, s=lambda c: t.strip_bloat(c, decode=False, doubled=False)),
    "t04_truncate": _on(snips, s=t.truncate),
    "t05_bloat_marks": lambda s, d: snips(s, d).select("doc_id", F.array_join(t.bloat_marks(F.col("s")), ",").alias("marks")),
    "t06_density": lambda s, d: snips(s, d).select("doc_id", F.round(t.lexical_density(F.col("s")), 6).alias("density")),
    "t08_tokens": lambda s, d: snips(s, d).select("doc_id", F.size(ranking.tokens(F.col("s"))).alias("n"), F.array_join(F.slice(ranking.tokens(F.col("s")), 1, 5), " ").alias("first")),
    "t09_representation": lambda s, d: snips(s, d).select("doc_id", F.length(ranking.representation(F.lit("A title"), F.col("s"), 3)).alias("n")),
    "t12_jats": _on(snips, s=lambda c: t.strip_jats(F.concat(F.lit("<jats:p>"), c, F.lit("</jats:p>")))),
    "t13_citation": _citation,
    "t14_t20_dates": _dates,
    "t16_abstract": _abstract,
    "t23_page_title": lambda s, d: load(s, d, "pages").select("page_id", p.page_title(F.col("html")).alias("title"), F.size(p.links(F.col("html"))).cast("long").alias("links")),
    "t27_prompt_item": lambda s, d: snips(s, d).select("doc_id", t.prompt_item(F.col("doc_id") % 20, F.lit("A\ntitle"), F.col("s")).alias("item")),
    "t28_indexed_counts": lambda s, d: snips(s, d).select("doc_id", t.indexed_counts(F.concat(F.lit("Done: "), F.col("doc_id").cast("string"), F.lit(" files indexed (7 chunks)"))).alias("x")).select("doc_id", "x.*"),
}

SQL = {
    "a16_snippet_stats": sql(r"""SELECT doc_id % 14 AS source, count(*) AS n, round(avg(length(n.s)), 4) AS mean_len, median(length(n.s))::DOUBLE AS median_len, round(100 * avg((len(m.marks) > 0)::INTEGER), 4) AS marked_pct, round(avg(length(c.s)), 4) AS clean_len, round(avg(d.d), 6) AS density
  FROM snips n JOIN stripped c USING (doc_id) JOIN density d USING (doc_id) JOIN marks m USING (doc_id) GROUP BY 1""", marks=r"SELECT doc_id, list_filter([CASE WHEN contains(s, '›') THEN 'B1' END, CASE WHEN regexp_matches(s, '\bRead more\b') THEN 'B2' END, CASE WHEN s LIKE 'Web results%' THEN 'B3' END, CASE WHEN s LIKE 'Featured snippet from the web%' THEN 'B4' END, CASE WHEN regexp_matches(s, '\d[\d,.]*[Kk]?\+? *(likes|comments|answers|posts) *·') THEN 'B5' END, CASE WHEN regexp_matches(s, '&[a-z]+;|&#\d+;') THEN 'B8' END, CASE WHEN regexp_matches(s, 'Tagged with [\w, ]+\.?$') THEN 'B9' END], lambda x: x IS NOT NULL) AS marks FROM snips"),
    "a17_a18_best_source": sql("SELECT source, count(*) AS wins, count(*) FILTER (short) AS short_wins FROM (SELECT doc_id % 14 AS source, length(s) < 40 AS short FROM stripped JOIN density USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id % 97 ORDER BY length(s) < 40, round(length(s) * d, 6) DESC, doc_id) = 1) b GROUP BY source"),
    "c01_selection": sql("SELECT doc_id, CASE WHEN length(f) < 200 AND length(s) > 0 THEN length(s) ELSE length(f) END AS n, length(f) < 200 AND length(s) > 0 AS fell_back FROM (SELECT doc_id, s, left(s, doc_id % 400) AS f FROM snips) x"),
    "c02_garbage": sql("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (['http_error', 'minimal_content', 'nav_dump', 'cookie_wall', 'login_wall', 'cloudflare', 'cloudflare', 'crawl4ai_error'])[(doc_id // 3 % 8 + 1)::INTEGER]
  WHEN length(trim(md)) < 50 THEN 'minimal_content' WHEN length(md) < 1000 AND regexp_matches(lower(md), 'not_found|404|403|forbidden|access denied|page not found') THEN 'http_error' END AS verdict FROM crawled"""),
    "c18_near_empty": "SELECT doc_id % 50 AS g, count(*) FILTER (length(text) < 500) AS skipped, coalesce(sum(length(text)) FILTER (length(text) >= 500), 0)::BIGINT AS kept_chars FROM documents GROUP BY 1",
    "c20_consent_prefix": sql("SELECT doc_id, '## Head' || chr(10) || md AS body FROM crawled"),
    "c21_code_blocks": sql("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS blocks, doc_id % 2 = 1 AS mangled FROM marked_up"),
    "t02_strip_bloat": sql("SELECT doc_id, s FROM stripped"),
    "t04_truncate": sql("""SELECT doc_id, CASE WHEN length(s) <= 500 THEN s WHEN stop >= 251 THEN left(s, stop) WHEN space > 0 THEN left(s, space - 1) || '…' ELSE left(s, 500) || '…' END AS s FROM (
  SELECT doc_id, s, CASE WHEN contains(left(s, 500), '. ') THEN 500 - instr(reverse(left(s, 500)), ' .') ELSE 0 END AS stop, CASE WHEN contains(left(s, 500), ' ') THEN 501 - instr(reverse(left(s, 500)), ' ') ELSE 0 END AS space FROM snips) x"""),
    "t05_bloat_marks": sql(r"SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(s, '›') THEN 'B1' END, CASE WHEN regexp_matches(s, '\bRead more\b') THEN 'B2' END, CASE WHEN s LIKE 'Web results%' THEN 'B3' END, CASE WHEN s LIKE 'Featured snippet from the web%' THEN 'B4' END, CASE WHEN regexp_matches(s, '\d[\d,.]*[Kk]?\+? *(likes|comments|answers|posts) *·') THEN 'B5' END, CASE WHEN regexp_matches(s, '&[a-z]+;|&#\d+;') THEN 'B8' END, CASE WHEN regexp_matches(s, 'Tagged with [\w, ]+\.?$') THEN 'B9' END], lambda x: x IS NOT NULL), ',') AS marks FROM snips"),
    "t06_density": sql("SELECT doc_id, round(d, 6) AS density FROM density"),
    "t08_tokens": sql(r"SELECT doc_id, len(w) AS n, array_to_string(w[1:5], ' ') AS first FROM (SELECT doc_id, regexp_extract_all(lower(s), '[\p{L}\p{N}\p{M}_]+') AS w FROM snips) x"),
    "t09_representation": sql("SELECT doc_id, length(s) + 24 AS n FROM snips"),
    "t12_jats": sql(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(s, '<[^>]+>', '', 'g'), '&[a-zA-Z]+;|&#\d+;', '', 'g'), '\s+', ' ', 'g')) AS s FROM snips"),
    "t13_citation": """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN '' ELSE CASE WHEN doc_id % 5 = 0 THEN '(2021)' ELSE 'Müller' || CASE WHEN doc_id % 3 > 0 THEN ', J.' ELSE '' END || CASE WHEN doc_id % 4 > 1 THEN ' et al.' ELSE '' END || ' (2021)' END
  || CASE WHEN doc_id % 2 > 0 THEN ', Journal' ELSE '' END END AS citation FROM documents""",
    "t14_t20_dates": """SELECT doc_id, CASE WHEN m IS NOT NULL THEN '2024-' || m || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS german, CASE WHEN m IS NOT NULL THEN '2023-' || m || '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS english,
  '2020' || CASE WHEN doc_id % 3 > 0 THEN '-' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') ELSE '' END || CASE WHEN doc_id % 3 > 1 THEN '-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS "partial",
  strftime(DATE '1970-01-01' + (doc_id * 7)::INTEGER, '%Y-%m-%d') AS day, '2024-05-0' || (doc_id % 9 + 1) AS iso FROM (SELECT doc_id, (['05', '03', '10', '12', NULL, '06'])[(doc_id % 6 + 1)::INTEGER] AS m FROM documents) x""",
    "t16_abstract": r"SELECT doc_id, array_to_string(regexp_split_to_array(text, '\s+'), ' ') AS abstract FROM documents",
    "t23_page_title": r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, 'href="([^"]*)"')) AS links FROM pages""",
    "t27_prompt_item": sql("SELECT doc_id, (doc_id % 20) || '. A title | ' || left(replace(s, chr(10), ' '), 200) AS item FROM snips"),
    "t28_indexed_counts": "SELECT doc_id, doc_id::INTEGER AS files, 7 AS chunks FROM documents",
    "c13_c16_chrome_clean": sql("SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_extract(md, '(?s)^(.*?)\n## Comments', 1), '\\s+$', ''), '[Skip to content](#m)', ''), '\n{4,}', '\n\n\n', 'g') || chr(10) AS body FROM marked_up"),
    "c06_crawl_body": sql("SELECT doc_id, trim(regexp_replace(replace(md, chr(10) || '## ', chr(10) || chr(10) || '## '), '\n{3,}', '\n\n', 'g')) AS body FROM marked_up"),
}
