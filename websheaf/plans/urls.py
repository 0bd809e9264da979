"""URL queries over pages.url, and over urls made from the driver tables where pages hold too few kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.functions import urls as u
from websheaf.plans.fixtures import DERIVED, load, sql

#: Patterns of made urls; {n} is a row's number.
SHAPES = [
    "https://www.arxiv.org/abs/{n}", "https://sub.books.google.com/books/{n}?id=7", "https://github.com/a/b/{n}.pdf", "https://docs.example.org/api/learn/{n}/", "https://example.org/search/?q={n}", "https://aclanthology.org/P{n}",
    "https://openreview.net/forum?id={n}", "https://medium.com/blog/{n}", "https://www.amazon.de/dp/{n}", "https://developer.example.net/docs/reference/{n}#top", "https://x.readthedocs.io/en/v1@{n}/guide/", "https://www.google.com/url?sa=t&q=https%3A%2F%2Fa.example%2F{n}&z=1",
    "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fb.example%2F{n}&rut=x", "https://news.example.org/markets/2024/05/17/live-{n}", "https://www.nature.com/articles/{n}.pdf", "https://link.springer.com/book/{n}", "https://video.yandex.com/{n}", "https://doi.org/10.1/{n}",
]

_SHAPE_SQL = "replace(([" + ", ".join("'" + s + "'" for s in SHAPES) + f"])[(o_orderkey % {len(SHAPES)} + 1)::INTEGER], '{{n}}', o_orderkey::VARCHAR)"
_AUTHORITY = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
DERIVED |= {
    "made": f"SELECT o_orderkey::BIGINT AS id, {_SHAPE_SQL} AS url FROM orders",
    "split": rf"SELECT id, url, regexp_replace(lower({_AUTHORITY}), '^www\.', '') AS d, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM made",
}


def made(s: SparkSession, d: str) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("o_orderkey") % len(SHAPES) + 1).cast("int"))
    return load(s, d, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.replace(shape, F.lit("{n}"), F.col("o_orderkey").cast("string")).alias("url"))


def _made(**columns) -> object:
    def query(s: SparkSession, d: str) -> DataFrame:
        return made(s, d).select("id", *[f(F.col("url")).alias(name) for name, f in columns.items()])

    return query


def _pages(**columns) -> object:
    def query(s: SparkSession, d: str) -> DataFrame:
        return load(s, d, "pages").select("page_id", *[f(F.col("url")).alias(name) for name, f in columns.items()])

    return query


def _docs_heuristics(s: SparkSession, d: str) -> DataFrame:
    return made(s, d).select("id", F.array_join(u.docs_marks(F.col("url")), ",").alias("marks"))


def _coverage(s: SparkSession, d: str) -> DataFrame:
    rows = made(s, d).withColumn("engine", F.col("id") % 14).withColumn("m", u.docs_marks(F.col("url")))
    flat = rows.select("engine", F.explode(F.when(F.size("m") > 0, F.col("m")).otherwise(F.array(F.lit("none")))).alias("mark"))
    return flat.groupBy("mark").pivot("engine", list(range(14))).agg(F.count(F.lit(1))).fillna(0).select("mark", *[F.col(str(i)).alias(f"e{i}") for i in range(14)])


def _histogram(s: SparkSession, d: str) -> DataFrame:
    c = lambda cond: F.sum(cond.cast("long"))
    url = F.col("url")
    return made(s, d).agg(c(url.rlike(r"[?&](q|query|search|keyword|term|p)=")).alias("query_param"), c(url.contains("/search/")).alias("search_path"), c(url.contains("/sresults/")).alias("sresults_path"), c(url.contains("/scholar?q=")).alias("scholar_query"))


def _renumbered(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = made(s, d).withColumn("q", F.col("id") % 50).filter(~F.array_contains(F.split(u.host_label(F.col("url")), r"\."), "yandex"))
    return rows.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy("id")).alias("position"))


def _key(s: SparkSession, d: str) -> DataFrame:
    q = F.concat(F.lit("  Query "), F.col("id").cast("string"), F.lit(" X "))
    return made(s, d).select("id", u.cache_key(q, F.lit("en"), F.when(F.col("id") % 2 == 0, "google,bing"), F.when(F.col("id") % 3 == 0, "month")).alias("key"))


def _proxy(s: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.when(F.col("id") % 2 == 0, "socks5://user:p@ss@10.0.0.").otherwise("http://10.0.0."), (F.col("id") % 200).cast("string"), F.lit(":0"), (F.col("id") % 9000 + 1).cast("string"))
    return made(s, d).select("id", u.proxy_key(p).alias("key"))


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, [200, 429, 404, 500, 403])), (F.col("id") % 5 + 1).cast("int"))
    body = F.when(F.col("id") % 7 == 0, "x<HTML>").when(F.col("id") % 7 == 1, F.concat(F.repeat(F.lit("é"), 248), F.lit("<rss>"))).when(F.col("id") % 7 == 2, F.concat(F.repeat(F.lit("é"), 247), F.lit("<rss>"))).otherwise("nothing")
    return made(s, d).select("id", u.outcome(status, F.col("id") % 211, F.when(F.col("id") % 11 == 0, "dns")).alias("outcome"), u.gate(status, body, ["<html", "<rss>"], ignore_case=True).alias("gate"), u.gate(status, body, ["<html", "<rss>"]).alias("strict"))


def _connect_fail(s: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(F.lit("Timeout 30000ms exceeded"), F.lit("net::ERR_TIMED_OUT"), F.lit("ERR_TUNNEL_FAILED"), F.lit("SOCKS error"), F.lit(None).cast("string")), (F.col("id") % 5 + 1).cast("int"))
    return made(s, d).select("id", u.connect_fail(text).alias("kind"))


def _query(s: SparkSession, d: str) -> DataFrame:
    engine, mode = F.when(F.col("id") % 2 == 0, "google").otherwise("bing"), F.element_at(F.array(*map(F.lit, ["general", "pdf", "books", "docs"])), (F.col("id") % 4 + 1).cast("int"))
    q = F.concat(F.lit("Wie geht's? "), F.col("id").cast("string"), F.lit(" -- a very long question indeed"))
    return made(s, d).select("id", u.modified_query(q, engine, mode).alias("query"), u.query_slug(q).alias("slug"))


QUERIES = {
    "p02_cache_key": _key,
    "p03_url_hash": _pages(hash=u.url_hash),
    "p05_crawl_normal": _made(normal=u.crawl_normal),
    "p06_dedup_normal": _pages(normal=u.dedup_normal),
    "p08_domains": _pages(domain=u.domain, authority=u.authority, host=u.host_label),
    "p09_redirect": _made(target=lambda c: u.unwrapped(c, r"google\.[a-z.]+/url\?", "q")),
    "p10_redirect": _made(target=lambda c: u.unwrapped(c, "duckduckgo\\.com/l/", "uddg")),
    "p12_own_links": _renumbered,
    "p13_block_url": _made(blocked=lambda c: u.has_signal(F.lower(c), ["showcaptcha", "checkcaptcha", "/live-"])),
    "p14_search_page": _made(search=u.is_search_page),
    "p15_search_histogram": _histogram,
    "p16_pdf": _made(pdf=u.is_pdf),
    "p17_book": _made(book=u.is_book),
    "p18_docs": _made(docs=u.is_docs),
    "p19_mode": _made(pdf=lambda c: u.in_mode(c, "pdf"), general=lambda c: u.in_mode(c, "general")),
    "p20_by_path": _made(pdf=lambda c: u.is_pdf_by_path(c, ["arxiv.org"]), book=lambda c: u.is_book_by_path(c, ["books.google.com"])),
    "p21_docs_marks": _docs_heuristics,
    "a21_coverage": _coverage,
    "p22_tier": _made(tier=u.tier),
    "p23_pdf_url": _made(pdf=u.pdf_url),
    "p24_real_path": _pages(real=u.has_real_path),
    "p25_p26_query": _query,
    "p27_page_file": _pages(file=lambda c: u.page_file(c, F.lit("site__"))),
    "p28_file_name": _made(file=u.file_name),
    "p29_url_slug": _made(slug=u.url_slug),
    "p30_publication_date": _made(dedup=lambda c: u.publication_date(F.lit(""), c, ""), publish=lambda c: u.publication_date(F.lit(None).cast("string"), c, "unknown")),
    "p31_section": _pages(section=u.section),
    "p32_live_blog": _made(live=u.is_live_blog),
    "p34_proxy_key": _proxy,
    "p36_p37_outcomes": _outcomes,
    "p39_connect_fail": _connect_fail,
}


def _hosts(hosts: list[str]) -> str:
    return "regexp_matches(d, '(^|\\.)(" + "|".join(h.replace(".", "\\.") for h in hosts) + ")$')"


def _any(column: str, marks: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


_PDF = f"CASE WHEN {_hosts(u.PDF_DENIED)} THEN false WHEN {_hosts(u.PDF_HOSTS)} THEN true ELSE {_any('lower(p)', u.PDF_PATHS)} END"
_MARKS = ", ".join("CASE WHEN " + " OR ".join((f"starts_with({'d' if w == 'host' else 'p'}, '{x}')" if h == "starts" else f"contains({'d' if w == 'host' else 'p'}, '{x}')") for x in xs) + f" THEN '{c}' END" for c, w, h, xs in u.DOCS_MARKS)
DERIVED |= {"marked": f"SELECT id, list_filter([{_MARKS}], lambda x: x IS NOT NULL) AS m FROM split"}
_ISO = r"CASE WHEN regexp_matches(url, '/\d{4}/\d{2}/\d{2}/') THEN replace(regexp_extract(url, '/(\d{4}/\d{2}/\d{2})/', 1), '/', '-') ELSE "

SQL = {
    "p02_cache_key": sql("SELECT id, left(sha256('query ' || id || ' x|en|' || CASE WHEN id % 2 = 0 THEN 'google,bing' ELSE '' END || '|' || CASE WHEN id % 3 = 0 THEN 'month' ELSE '' END), 16) AS key FROM made"),
    "p03_url_hash": "SELECT page_id, left(sha256(url), 12) AS hash FROM pages",
    "p05_crawl_normal": sql(r"SELECT id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]+@[^/]+', '', 'g'), '/+$', '') AS normal FROM made"),
    "p06_dedup_normal": "SELECT page_id, CASE WHEN url LIKE '%/' THEN left(url, length(url) - 1) ELSE url END AS normal FROM pages",
    "p08_domains": rf"SELECT page_id, regexp_replace(lower({_AUTHORITY}), '^www\.', '') AS domain, {_AUTHORITY} AS authority, regexp_replace(lower({_AUTHORITY}), '^www\.', '') AS host FROM pages",
    "p09_redirect": sql("SELECT id, CASE WHEN contains(url, 'google.com/url?') THEN 'https://a.example/' || id ELSE url END AS target FROM made"),
    "p10_redirect": sql("SELECT id, CASE WHEN contains(url, 'duckduckgo.com/l/') THEN 'https://b.example/' || id ELSE url END AS target FROM made"),
    "p12_own_links": sql("SELECT id % 50 AS q, id, row_number() OVER (PARTITION BY id % 50 ORDER BY id) AS position FROM split WHERE NOT list_contains(string_split(d, '.'), 'yandex')"),
    "p13_block_url": sql("SELECT id, contains(url, '/live-') AS blocked FROM made"),
    "p14_search_page": sql(f"SELECT id, regexp_matches(url, '{u.SEARCH_PAGE}') AS search FROM made"),
    "p15_search_histogram": sql(r"SELECT count(*) FILTER (regexp_matches(url, '[?&](q|query|search|keyword|term|p)=')) AS query_param, count(*) FILTER (contains(url, '/search/')) AS search_path, count(*) FILTER (contains(url, '/sresults/')) AS sresults_path, count(*) FILTER (contains(url, '/scholar?q=')) AS scholar_query FROM made"),
    "p16_pdf": sql(f"SELECT id, {_PDF} AS pdf FROM split"),
    "p17_book": sql(f"SELECT id, CASE WHEN {_hosts(u.BOOK_DENIED)} THEN false WHEN {_hosts(u.BOOK_HOSTS)} THEN true ELSE {_any('lower(p)', u.BOOK_PATHS)} END AS book FROM split"),
    "p18_docs": sql(f"SELECT id, NOT {_hosts(u.DOCS_DENIED)} AND NOT {_any('lower(p)', u.DOCS_DENIED_PATHS)} AS docs FROM split"),
    "p19_mode": sql(f"SELECT id, {_PDF} AS pdf, true AS general FROM split"),
    "p20_by_path": sql(f"SELECT id, lower(p) LIKE '%.pdf' OR {_hosts(['arxiv.org'])} AS pdf, {_hosts(['books.google.com'])} OR (contains(d, 'amazon.') AND contains(lower(url), '/dp/')) OR (d = 'springer.com' AND contains(url, '/book/')) OR d = 'jstor.org' AS book FROM split"),
    "p21_docs_marks": sql("SELECT id, array_to_string(m, ',') AS marks FROM marked"),
    "a21_coverage": sql("SELECT mark, " + ", ".join(f"count(*) FILTER (id % 14 = {i}) AS e{i}" for i in range(14)) + " FROM (SELECT id, unnest(CASE WHEN len(m) > 0 THEN m ELSE ['none'] END) AS mark FROM marked) x GROUP BY mark"),
    "p22_tier": sql("SELECT id, CASE " + " ".join(f"WHEN d IN ({', '.join(repr(h) for h in hosts)}) THEN '{name}'" for name, hosts in u.TIERS) + " END AS tier FROM split"),
    "p23_pdf_url": sql(r"SELECT id, CASE WHEN d = 'arxiv.org' THEN regexp_replace(url, '/(abs|html)/', '/pdf/') WHEN d = 'aclanthology.org' THEN url || '.pdf' WHEN d = 'openreview.net' THEN replace(url, '/forum?', '/pdf?') ELSE url END AS pdf FROM split"),
    "p24_real_path": "SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) NOT IN ('', '/') AS real FROM pages",
    "p25_p26_query": sql("""SELECT id, q || CASE WHEN id % 2 = 0 AND id % 4 > 0 THEN CASE id % 4 WHEN 1 THEN ' pdf' WHEN 2 THEN ' book' ELSE ' documentation' END ELSE '' END AS query,
  trim(left(regexp_replace(lower(q), '[^a-z0-9]+', '_', 'g'), 30), '_') AS slug FROM (SELECT id, 'Wie geht''s? ' || id || ' -- a very long question indeed' AS q FROM made) x"""),
    "p27_page_file": r"SELECT page_id, 'site__' || CASE WHEN p = '' THEN 'index' ELSE replace(p, '/', '__') END || '.md' AS file FROM (SELECT page_id, regexp_replace(trim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), '\.html?$', '') AS p FROM pages) x",
    "p28_file_name": sql("SELECT id, left(trim(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9]+', '_', 'g'), '_'), 100) AS file FROM made"),
    "p29_url_slug": sql("SELECT id, left(trim(regexp_replace(regexp_replace(url, '^https?://', ''), '[^a-zA-Z0-9]+', '-', 'g'), '-'), 80) AS slug FROM made"),
    "p30_publication_date": sql(f"SELECT id, {_ISO} '' END AS dedup, {_ISO} 'unknown' END AS publish FROM made"),
    "p31_section": "SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], '') AS section FROM pages",
    "p32_live_blog": sql("SELECT id, contains(url, '/live-') AS live FROM made"),
    "p34_proxy_key": sql("SELECT id, CASE WHEN id % 2 = 0 THEN 'socks5' ELSE 'http' END || '://10.0.0.' || (id % 200) || ':' || (id % 9000 + 1) AS key FROM made"),
    "p36_p37_outcomes": sql("""SELECT id, CASE WHEN id % 11 = 0 THEN 'error' WHEN id % 5 = 1 THEN 'waf_429' WHEN id % 5 > 1 THEN 'http_error' WHEN id % 211 < 100 THEN 'empty' ELSE 'ok' END AS outcome,
  CASE WHEN id % 5 = 2 THEN 'dead' WHEN id % 5 > 0 THEN 'fail' WHEN regexp_matches(lower(h), '^(..)*(3c68746d6c|3c7273733e)') THEN 'ok' ELSE 'fail' END AS gate,
  CASE WHEN id % 5 = 2 THEN 'dead' WHEN id % 5 > 0 THEN 'fail' WHEN regexp_matches(lower(g), '^(..)*(3c68746d6c|3c7273733e)') THEN 'ok' ELSE 'fail' END AS strict
  FROM (SELECT id, hex(lower(b))[1:1000] AS h, hex(b)[1:1000] AS g FROM (SELECT id, CASE id % 7 WHEN 0 THEN 'x<HTML>' WHEN 1 THEN repeat('é', 248) || '<rss>' WHEN 2 THEN repeat('é', 247) || '<rss>' ELSE 'nothing' END AS b FROM made) x) y"""),
    "p39_connect_fail": sql("SELECT id, (['page_timeout', 'net_timed_out', 'proxy_connect', 'proxy_connect', 'other'])[(id % 5 + 1)::INTEGER] AS kind FROM made"),
}
