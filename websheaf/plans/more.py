"""Smaller operators: hashes, shapes, book lines, stated dates, clean passes, crawl stops, embedded links, selection totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.functions import cleaners, pages, text, urls
from websheaf.operators import evaluate
from websheaf.plans.fixtures import entries, load, manifest, results, runs, sql
from websheaf.plans.urls import made
from websheaf.sources import readers, writers

SHAPES = [("arxiv", "paper"), ("github", "code"), ("docs", "docs"), ("example", "site")]


def _html(s: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    meta = (
        F.when(n % 5 == 0, '<script type="application/ld+json">{"datePublished": "2024-05-01T10:00:00Z"}</script>').when(n % 5 == 1, '<meta property="article:published_time" content="2023-04-02T00:00">')
        .when(n % 5 == 2, '<meta content="2022-03-03" name="date">').when(n % 5 == 3, '<time datetime="2021-02-04">').otherwise("")
    )
    return load(s, d, "pages").select("page_id", F.concat(meta, F.regexp_replace("html", "<time[^>]*>", "")).alias("html"))


#: A page's embedded data: a tree of pages below a page of its own, addresses with escapes, other sites, and links outside trees.
_TREE = ['{"href": "/no", "props": {"tree": {"href": "/en/p', '", "childPages": [{"href": "\\/en\\/a\\u0062/', '", "childPages": [{"href": "/en/deep"}, {"href": "https://x"}]}, {"title": "t"}, {"href": "/fr/', '", "childPages": []}]}}}']


def _page_trees(s: SparkSession, d: str) -> DataFrame:
    n = (F.col("page_id") % 50).cast("string")
    data = F.concat(F.lit(_TREE[0]), n, F.lit(_TREE[1]), n, F.lit(_TREE[2]), n, F.lit(_TREE[3]))
    data = F.when(F.col("page_id") % 9 == 0, F.lit("{broken")).otherwise(data)
    html = F.concat("html", F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"))
    return readers.embedded_links(load(s, d, "pages").withColumn("html", html), "https://d")


def _navigated(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    line = F.rpad(F.concat(F.lit("prose "), n, F.lit(" ")), 80, "x")
    plain = F.concat(F.lit("<!-- source: https://x/ -->\n* [a](b)\nMenu\nshort\n"), line, F.lit("\nrest"))
    issue = F.concat(F.lit("<!-- source: https://github.com/a/b/issues/"), n, F.lit(" -->\n# nav\n# A bug #1x\n# A bug #"), n, F.lit("\ntext"))
    story = F.concat(F.lit("<!-- source: https://news.ycombinator.com/item?id=1 -->\n[Hacker News](https://news.ycombinator.com/news) new\nx\n(https://news.ycombinator.com/vote?id="), n, F.lit(") story\ntext"))
    return load(s, d, "documents").select("doc_id", cleaners.from_content(plain).alias("plain"), cleaners.from_issue_title(issue).alias("issue"), cleaners.from_story_row(story).alias("story"), cleaners.merged_headings(F.concat(F.lit("x\n##\n\nHead "), n, F.lit("\ny"))).alias("merged"), cleaners.without_trailing_links(F.concat(n, F.lit("\n\n* * *\n[a](b)\n* [c](d)\n"))).alias("trimmed"))


def _drilldowns(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d)
    kind = F.when(F.col("seq") % 5 == 0, "drilldown").when(F.col("seq") % 5 == 1, "workflow_summary").otherwise("engine_run")
    log = r.select(kind.alias("record_type"), F.col("seq").cast("string").alias("ts"), F.concat(F.lit("q"), F.col("seq").cast("string")).alias("query"), F.concat(F.lit("k"), (F.col("seq") % 700).cast("string")).alias("search_key"))
    return readers.drilldowns(log).select("ts", "search_key", "searched_at")


def _clean_pass(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).select(F.left(F.sha2("url", 256), F.lit(12)).alias("hash"), "url", F.when(F.col("seq") % 11 > 0, F.col("publication_date")).alias("publication_date"), "seq")
    raw = e.filter("seq % 4 > 0").select("hash", F.when(F.col("seq") % 4 == 1, "").otherwise("body").alias("body"))
    return evaluate.clean_pass(e, raw)


def _batches(s: SparkSession, d: str) -> DataFrame:
    b = runs(s, d).groupBy("engine", F.floor(F.col("seq") / 400).alias("batch")).agg(F.sum((F.col("status") == "RATE_SKIP").cast("int")).alias("n"))
    return evaluate.blocked_batches(b.select("engine", "batch", F.greatest(F.col("n") - 7, F.lit(0)).alias("blocked")), "engine")


def _selection(s: SparkSession, d: str) -> DataFrame:
    r = results(s, d)
    return evaluate.selection_totals(r.select(F.col("engine").alias("source"), F.when(F.col("position") > 3, "low").otherwise("high").alias("cls"), (F.length("snippet") < 15).alias("short")))


def _printed(s: SparkSession, d: str) -> DataFrame:
    out = F.concat(F.lit("Found 2\nURL: https://a/"), F.col("id").cast("string"), F.lit("\nSnippet: x URL: no\n  URL: https://b rest"))
    return made(s, d).select("id", F.array_join(readers.found_blocks(out), " ").alias("urls"))


def _configs(s: SparkSession, d: str) -> DataFrame:
    n = F.col("id").cast("string")
    return made(s, d).select("id", urls.config_hash(F.concat(F.lit('{"b": 1, "a": '), n, F.lit("}"))).alias("hash"))


QUERIES = {
    "p04_config_hash": _configs,
    "p44_page_shape": lambda s, d: made(s, d).select("id", urls.page_shape(urls.domain(F.col("url")), SHAPES).alias("shape")),
    "p38_signals": lambda s, d: load(s, d, "documents").select("doc_id", urls.has_signal(F.col("text"), ["The and", "idiot"]).alias("walled")),
    "t17_book_snippet": lambda s, d: load(s, d, "documents").select("doc_id", text.book_snippet(F.when(F.col("doc_id") % 3 > 0, "A. Author").otherwise(""), F.when(F.col("doc_id") % 4 > 0, F.lit(1999)), F.col("doc_id") % 7, F.when(F.col("doc_id") % 5 > 0, "public")).alias("snippet")),
    "t26_facts": lambda s, d: manifest(s, d).select("seq", writers.facts(F.col("url"), F.lit(200), F.lit("e"), F.col("char_count"), F.when(F.col("status") != "ok", F.col("status"))).alias("facts")),
    "s13_s14_written_texts": lambda s, d: load(s, d, "documents").select("doc_id", F.length(writers.page_markdown(F.lit("u"), F.lit("# T\n\n\n\nx "))).alias("page"), F.length(writers.sidecar(F.lit("u"), F.lit("t"), F.lit("e"), F.lit("ok"), F.lit("h"), F.when(F.col("doc_id") % 2 == 0, "body").otherwise(" "))).alias("side")),
    "s12_cache_hits": lambda s, d: readers.cache_hits(runs(s, d).select(F.col("engine").alias("search_key"), "seq", F.col("ts").alias("written_at")), "bing", F.lit("2024-01-05 00:00:00").cast("timestamp"), 86400).select("seq"),
    "c05_stated_date": lambda s, d: _html(s, d).select("page_id", pages.stated_date(F.col("html")).alias("day")),
    "c10_clean_pass": _clean_pass,
    "c15_c17_navigation": _navigated,
    "c24_blocked_batches": _batches,
    "j03_drilldowns": _drilldowns,
    "a19_selection_totals": _selection,
    "v03_printed_urls": _printed,
    "v08_embedded_links": _page_trees,
    "v08_categories": lambda s, d: readers.category_counts(_page_trees(s, d), "https://d/"),
    "t22_engine_caps": lambda s, d: readers.capped_results(results(s, d).withColumn("position", F.col("position") * 4)).groupBy("engine").agg(F.count("*").alias("n"), F.max("position").alias("last")),
}

_QUOTED = [x.replace("'", "''") for x in _TREE]
_TREES_SQL = f"""WITH RECURSIVE raw AS (SELECT page_id, '{_QUOTED[0]}' || (page_id % 50) || '{_QUOTED[1]}' || (page_id % 50) || '{_QUOTED[2]}' || (page_id % 50) || '{_QUOTED[3]}' AS data FROM pages WHERE page_id % 9 > 0),
  nodes AS (SELECT page_id, json_extract(data, '$.props.tree') AS node, 0 AS depth FROM raw UNION ALL
    SELECT page_id, unnest(from_json(json_extract(node, '$.childPages'), '["json"]')) AS node, depth + 1 FROM nodes WHERE json_extract(node, '$.childPages') IS NOT NULL),
  found AS (SELECT page_id, 'https://d' || json_extract_string(node, '$.href') AS url, depth FROM nodes WHERE json_extract_string(node, '$.href') LIKE '/%') """

SQL = {
    "p04_config_hash": sql("""SELECT id, left(sha256('{"a": ' || id || ', "b": 1}'), 10) AS hash FROM made"""),
    "p44_page_shape": sql("SELECT id, CASE WHEN contains(d, 'arxiv') THEN 'paper' WHEN contains(d, 'github') THEN 'code' WHEN contains(d, 'docs') THEN 'docs' WHEN contains(d, 'example') THEN 'site' ELSE 'other' END AS shape FROM split"),
    "p38_signals": "SELECT doc_id, contains(text, 'The and') OR contains(text, 'idiot') AS walled FROM documents",
    "t17_book_snippet": """SELECT doc_id, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 > 0 THEN 'A. Author (1999) — ' WHEN doc_id % 3 > 0 THEN 'A. Author — ' WHEN doc_id % 4 > 0 THEN '(1999) — ' ELSE '' END || (doc_id % 7) || ' eds, ebook: ' || CASE WHEN doc_id % 5 > 0 THEN 'public' ELSE 'unknown' END AS snippet FROM documents""",
    "t26_facts": sql("SELECT seq, 'url: ' || url || chr(10) || 'status: 200' || chr(10) || 'engine: e' || chr(10) || 'chars: ' || char_count || CASE WHEN status <> 'ok' THEN chr(10) || 'error: ' || status ELSE '' END AS facts FROM manifest"),
    "s13_s14_written_texts": "SELECT doc_id, 26 AS page, CASE WHEN doc_id % 2 = 0 THEN 96 END AS side FROM documents",
    "s12_cache_hits": sql("SELECT seq FROM runs WHERE engine = 'bing' AND epoch(TIMESTAMP '2024-01-05 00:00:00') - epoch(ts) <= 86400"),
    "c05_stated_date": "SELECT page_id, (['2024-05-01', '2023-04-02', '2022-03-03', '2021-02-04', NULL])[(page_id % 5 + 1)::INTEGER] AS day FROM pages",
    "c10_clean_pass": sql("SELECT left(sha256(url), 12) AS hash, url, CASE WHEN seq % 4 = 0 THEN 'missing' WHEN seq % 4 = 1 THEN 'bodyless' ELSE 'cleaned' END AS state, CASE WHEN seq % 4 > 1 THEN CASE WHEN seq % 11 > 0 THEN publication_date ELSE 'unknown' END || '__' || left(sha256(url), 12) || '.md' END AS file FROM entries"),
    "c15_c17_navigation": """SELECT doc_id, '<!-- source: https://x/ -->' || n || n || rpad('prose ' || doc_id || ' ', 80, 'x') || n || 'rest' AS plain, '<!-- source: https://github.com/a/b/issues/' || doc_id || ' -->' || n || n || '# A bug #' || doc_id || n || 'text' AS issue,
  '<!-- source: https://news.ycombinator.com/item?id=1 -->' || n || n || '(https://news.ycombinator.com/vote?id=' || doc_id || ') story' || n || 'text' AS story, 'x' || n || '## Head ' || doc_id || n || 'y' AS merged, doc_id::VARCHAR AS trimmed FROM (SELECT doc_id, chr(10) AS n FROM documents) x""",
    "c24_blocked_batches": sql("""SELECT engine, batch, blocked, CASE WHEN again THEN 'stop' WHEN blocked > 0 THEN 'back off' ELSE 'go on' END AS action FROM (SELECT *, max(again::INTEGER) OVER (PARTITION BY engine ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM (
  SELECT *, blocked > 0 AND coalesce(lag(blocked) OVER (PARTITION BY engine ORDER BY batch) > 0, false) AS again FROM (SELECT engine, seq // 400 AS batch, greatest(count(*) FILTER (status = 'RATE_SKIP') - 7, 0) AS blocked FROM runs GROUP BY ALL))) x WHERE coalesce(gone, 0) = 0"""),
    "j03_drilldowns": sql("SELECT d.seq::VARCHAR AS ts, 'k' || (d.seq % 700) AS search_key, w.seq::VARCHAR AS searched_at FROM (SELECT * FROM runs WHERE seq % 5 = 0) d LEFT JOIN (SELECT * FROM runs WHERE seq % 5 = 1) w ON w.seq % 700 = d.seq % 700"),
    "a19_selection_totals": sql("SELECT engine AS source, cls, count(*) AS n, count(*) FILTER (length(snippet) < 15) AS short_n FROM (SELECT *, CASE WHEN position > 3 THEN 'low' ELSE 'high' END AS cls FROM results) x GROUP BY CUBE (engine, cls)"),
    "v03_printed_urls": sql("SELECT id, 'https://a/' || id || ' https://b' AS urls FROM made"),
    "v08_embedded_links": _TREES_SQL + "SELECT page_id, url, depth FROM found",
    "v08_categories": _TREES_SQL + "SELECT split_part(replace(url, 'https://d/', ''), '/', 1) AS category, count(*) AS n FROM found GROUP BY 1",
    "t22_engine_caps": sql("SELECT engine, count(*) AS n, max(position * 4)::INTEGER AS last FROM results JOIN (VALUES " + ", ".join(f"('{e}', {n})" for e, n in readers.MAX_RESULTS.items()) + ") c(engine, cap) USING (engine) WHERE position * 4 <= cap GROUP BY engine"),
}
