"""Evaluation, parser and cleaner queries; parsers read payloads that are built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.functions import cleaners, pages, text, urls
from websheaf.operators import crawl, evaluate, fusion, ingest, ranking
from websheaf.operators.shared import new_path
from websheaf.plans import fusion as fused
from websheaf.plans.fixtures import DERIVED, entries, load, manifest, results, runs, sql
from websheaf.sources import readers, writers

DERIVED |= {
    "scored": "SELECT run_id AS config, CASE WHEN status = 'ok' THEN 'ok' ELSE 'failed' END AS status, CASE WHEN status = 'ok' THEN (seq % 101) / 100.0::DOUBLE END AS f1, (seq % 53) / 53.0::DOUBLE AS recall, (seq % 47) / 47.0::DOUBLE AS \"precision\", char_count - 30000 AS byte_diff, (seq % 5)::BIGINT AS shape FROM manifest",
    "fetched": "SELECT o_orderkey::BIGINT AS id, (o_custkey % 9)::BIGINT AS g, CASE o_orderkey % 6 WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS status FROM orders",
}


def _scored(s: SparkSession, d: str) -> DataFrame:
    ok = F.col("status") == "ok"
    return manifest(s, d).select(
        F.col("run_id").alias("config"), F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, F.col("seq") % 101 / F.lit(100.0)).alias("f1"), (F.col("seq") % 53 / F.lit(53.0)).alias("recall"),
        (F.col("seq") % 47 / F.lit(47.0)).alias("precision"), (F.col("char_count") - 30000).alias("byte_diff"), (F.col("seq") % 5).alias("shape"),
    )


def _downloads(s: SparkSession, d: str) -> DataFrame:
    n = F.col("o_orderkey")
    status = F.when(n % 6 == 0, 404).when(n % 6 == 1, 503).otherwise(200)
    kind = F.when(n % 6 == 2, "application/pdf").otherwise("text/html; charset=utf-8")
    body = F.when(n % 6 == 3, '<meta content="https://x/p.pdf" name="citation_pdf_url">').when(n % 6 == 4, "<p>Get full access to this text</p>").otherwise("<p>text</p>")
    return load(s, d, "orders").select(n.cast("long").alias("id"), (F.col("o_custkey") % 9).cast("long").alias("g"), evaluate.download_outcome(status, kind, body).alias("outcome"))


def _sitemaps(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    block = F.concat(F.lit("<url><loc> "), "url", F.lit(" </loc><lastmod>"), "publication_date", F.when(F.col("seq") % 3 == 0, "T10:00:00Z").when(F.col("seq") % 3 == 1, "T10:00:00").otherwise("T10:00:00+02:00"), F.lit("</lastmod></url>"))
    xml = e.groupBy((F.col("seq") % 20).alias("k")).agg(F.array_join(F.collect_list(block), "\n").alias("xml"))
    return readers.sitemap_urls(xml).select("url", F.date_format("lastmod", "yyyy-MM-dd HH").alias("hour"))


def _log_with_rejects(s: SparkSession, d: str) -> DataFrame:
    """The events as a log of JSON lines, of which every 97th is broken off, every 89th has a value of another type; read back by day."""
    ev = load(s, d, "events").select(F.col("event_id").cast("long").alias("id"), F.col("ts").cast("timestamp").cast("string").alias("ts"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("kind"), F.lit("é\"x").alias("note"))
    path, whole = new_path(s, "log"), (F.col("id") % 97 > 0) & (F.col("id") % 89 > 0)
    if not writers.append_log(ev.filter(whole), path):
        raise OSError("the log was not written")
    line = F.to_json(F.struct("id", "ts", "kind", "note"))
    broken = F.when(F.col("id") % 97 == 0, F.substr(line, F.lit(1), F.length(line) - 4)).otherwise(F.concat(F.lit('{"id": "none", "ts": "'), "ts", F.lit('"}')))
    ev.filter(~whole).select(F.concat(broken, F.lit("\n  ")).alias("value")).write.mode("append").text(path)
    good, bad = readers.sorted_out(s, path, "id long, ts string, kind string, note string")
    day = F.left("ts", F.lit(10)).alias("day")
    counts = good.groupBy(day).agg(F.count("*").alias("n"), F.count("kind").alias("kinds"), F.sum("id").alias("ids"), F.count(F.when(F.col("note") == "é\"x", 1)).alias("notes"))
    thrown = bad.withColumn("ts", F.regexp_extract("line", r'"ts": ?"([^"]*)', 1)).groupBy(day).agg(F.count(F.when(F.col("reason") == "syntax", 1)).alias("syntax"), F.count(F.when(F.col("reason") == "type", 1)).alias("type"))
    return counts.join(thrown, "day", "full_outer").na.fill(0)


def _sitemap_index(s: SparkSession, d: str) -> DataFrame:
    """The days of all entries as sub-sitemaps, in twenty indexes; every third is of another kind."""
    name = F.concat(F.when(F.col("seq") % 3 == 0, "taxonomy").otherwise("post_type_post"), F.lit("_"), F.col("seq").cast("string"))
    entry = F.concat(F.lit("<sitemap>\n <loc> https://n.example/"), name, F.lit(".xml </loc><lastmod>"), "publication_date", F.lit("</lastmod></sitemap>"))
    xml = entries(s, d).groupBy((F.col("seq") % 20).alias("k")).agg(F.array_join(F.collect_list(entry), "\n").alias("xml"))
    return readers.sitemap_index(xml, "post_type_post")


def _feeds(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    item = F.struct("url", F.concat(F.lit("T"), F.col("seq").cast("string")).alias("title"), F.col("publication_date").alias("lastmod"))
    body = e.groupBy((F.col("seq") % 20).alias("k")).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.collect_list(item).alias("items"))).alias("body"))
    return readers.feed_items(body)


def _items(s: SparkSession, d: str, renumber: bool) -> DataFrame:
    r = results(s, d).filter("engine = 'bing'").withColumn("url", F.when(F.col("seq") % 4 == 0, "").otherwise(F.col("url")))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "url", "title", "snippet"))), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["snippet"].alias("snippet")))
    payload = r.groupBy("query_id").agg(F.to_json(F.struct(listed.alias("items"))).alias("payload"))
    return readers.search_items(payload, "items", 10, renumber=renumber)


def _proxies(s: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    line = F.concat(F.when(n % 2 == 0, "socks5://u:p@").otherwise(""), F.lit("10.0."), (n % 250).cast("string"), F.lit(".7:"), (n * 100).cast("string"), F.lit(" ok"))
    return readers.proxy_list(load(s, d, "customer").groupBy((n % 10).alias("k")).agg(F.array_join(F.collect_list(line), "\n").alias("body")), "http")


def _json_ld(s: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    article = F.to_json(F.struct(F.lit("NewsArticle").alias("@type"), F.concat(F.lit("<p>"), "url", F.lit("</p>")).alias("articleBody"), F.lit("2024-05-01").alias("datePublished")))
    block = F.when(n % 4 == 0, article).when(n % 4 == 1, F.concat(F.lit('{"@graph":[{"@type":"X"},'), article, F.lit("]}"))).when(n % 4 == 2, F.concat(F.lit("["), article, F.lit("]"))).otherwise("{broken")
    html = F.concat(F.lit('<script type="application/ld+json">{"@type":"Org"}</script><script type="application/ld+json">'), block, F.lit("</script>"), "html")
    return readers.json_ld_articles(load(s, d, "pages").withColumn("html", html))


def _titled(s: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    flat = F.regexp_replace("text", r"[\s#|\[\]!*_`()]+", " ")
    md = F.concat(F.lit("<!-- source: https://x/ -->\n[a](b)\n# Nav\n* [c](d)\n# Title "), n.cast("string"), F.lit("\n"), flat, F.lit("\n# Later\nend"))
    return load(s, d, "documents").select("doc_id", md.alias("md"), flat.alias("flat"))


def _pick_works(s: SparkSession, d: str) -> DataFrame:
    """Works with a title and a url, numbered by their place before that filter; cited ones say so."""
    n = F.col("doc_id")
    cited = n % 90
    url = F.coalesce(F.when(n % 3 == 0, F.concat(F.lit("arxiv"), n.cast("string"))), F.when(n % 3 == 1, F.concat(F.lit("doi"), n.cast("string"))), F.concat(F.lit("id"), n.cast("string")))
    date = F.coalesce(F.when(n % 2 == 0, F.lit("2020-01-02")), F.when(n % 5 > 0, F.lit("2019")))
    snippet = F.concat(F.lit("abstract"), F.when(cited > 50, F.concat(F.lit(" (Cited "), cited.cast("string"), F.lit("×)"))).otherwise(""))
    return load(s, d, "documents").filter(n % 7 > 0).select("doc_id", url.alias("url"), date.alias("date"), snippet.alias("snippet"), (n % 25 + 1).alias("position"))


def _frontier(s: SparkSession, d: str) -> DataFrame:
    nodes = results(s, d).select("url").distinct()
    return crawl.allowed(nodes, "site35.example.org", ["search"], ["nothing"]).unionByName(crawl.allowed(nodes, "site10.example.org", [], ["search"]))


def _method_scores(s: SparkSession, d: str) -> DataFrame:
    r = runs(s, d)
    return evaluate.methods(r.select(F.concat(F.lit("M"), (F.col("seq") % 5).cast("string")).alias("method"), F.when(F.col("seq") % 2 == 0, "general").otherwise("pdf").alias("mode"), (F.col("result_count") / 11).alias("jaccard"), F.col("search_ms").alias("ms")))


def _domains(s: SparkSession, d: str) -> DataFrame:
    return results(s, d).withColumn("domain", urls.domain(F.col("url")))


def _rank_matrix(s: SparkSession, d: str) -> DataFrame:
    a = ranking.overlap_ranking(fused._buckets(s, d)).select("query_id", "url", "rank", F.lit("overlap").alias("method"))
    b = ranking.rrf_ranking(fused._buckets(s, d)).select("query_id", "url", "rank", F.lit("rrf").alias("method"))
    return evaluate.rank_matrix(a.unionByName(b), ["overlap", "rrf"])


def _errors(s: SparkSession, d: str) -> DataFrame:
    n = F.col("seq")
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (n % k + 1).cast("int"))
    kind = evaluate.fetch_error(pick(["timeout", "proxy", "connection", "ssl", "odd"], 5), pick([0, 5, 52], 3), (n % 30).cast("double"), F.lit("Operation timed out"), 5.0, 20.0)
    status = evaluate.burst_status((n % 9 == 0).cast("int"), n % 12, n % 7, pick(["CAPTCHA detected", "Rate limited", "", "Google search failed"], 4))
    return runs(s, d).select("seq", kind.alias("kind"), status.alias("status"))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    md = F.concat(F.lit("<!-- source: https://x/ -->\nnav\n# T\nkeep "), F.col("doc_id").cast("string"), F.lit("\nEdit this page\n## See also\nlinks\n## More\nView for:\nWindows\nbody  \n\n\n\nCopyright 2024 x\nrest"))
    rules = [cleaners.Rules("a", footer="^Copyright", drop=("^Edit this page",), sections="See also", with_next="^View for:"), cleaners.Rules("b", footer="^## More")]
    name = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("doc_id") % 3 + 1).cast("int"))
    return load(s, d, "documents").select("doc_id", cleaners.by_rules(md, name, rules, r"(?i)^copyright\b").alias("body"))


QUERIES = {
    "s01_s02_log_with_rejects": _log_with_rejects,
    "s06_sitemap_index": _sitemap_index,
    "a14_shares": lambda s, d: fusion.shares(fusion.slot_counts(fused._buckets(s, d), fused.CLASSES), runs(s, d)),
    "a20_variant_domains": lambda s, d: evaluate.variant_domains(_domains(s, d).withColumn("variant", F.when(F.col("position") > 5, "free").when(F.col("position") > 2, "pdf").otherwise("base")), "base"),
    "a23_downloads": lambda s, d: evaluate.download_counts(_downloads(s, d), "g"),
    "a35_plateau": lambda s, d: evaluate.plateau(manifest(s, d).groupBy("run_id", F.floor("elapsed_s").alias("delay")).agg(F.max("char_count").alias("size")), "run_id"),
    "a36_configurations": lambda s, d: evaluate.configurations(_scored(s, d)),
    "a36_shape_medians": lambda s, d: evaluate.shape_medians(_scored(s, d)),
    "a39_methods": _method_scores,
    "v02_v09_errors": _errors,
    "v04_domain_frequency": lambda s, d: evaluate.domain_frequency(_domains(s, d)),
    "v05_missed_domains": lambda s, d: evaluate.missed_domains(_domains(s, d).withColumn("marks", urls.docs_marks(F.concat("url", F.when(F.col("query_id") + F.length("url") > 50, "docs/x").otherwise("x")))), 2),
    "v06_paths": lambda s, d: _domains(s, d).withColumn("path", evaluate.path_class(F.col("domain"), F.concat("url", F.when(F.col("position") == 1, "x.pdf").otherwise("")), ["site1.example.org"], ["site2.example.org", "site3.example.org"])).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries")),
    "v07_byte_reduction": lambda s, d: evaluate.byte_reduction(manifest(s, d).select(F.col("run_id").alias("grp"), (F.col("status") == "ok").alias("adopted"), F.when(F.col("seq") % 5 == 0, 0).otherwise(F.col("char_count")).alias("before"), (F.col("char_count") / 2).cast("int").alias("after"))),
    "v13_speedups": lambda s, d: evaluate.speedups(manifest(s, d).select(F.col("status").alias("strategy"), "elapsed_s"), "ok"),
    "v14_rank_matrix": _rank_matrix,
    "s07_sitemap_urls": _sitemaps,
    "s08_feed_items": _feeds,
    "s21_proxy_lists": _proxies,
    "t21_item_positions": lambda s, d: _items(s, d, False),
    "t21_items_renumbered": lambda s, d: _items(s, d, True),
    "t15_works": _pick_works,
    "c08_json_ld": _json_ld,
    "c14_title": lambda s, d: _titled(s, d).select("doc_id", cleaners.from_title(F.col("md")).alias("body")),
    "c19_rules": _cleaned,
    "p07_frontier": _frontier,
    "p33_entries": lambda s, d: evaluate.entry_rows(entries(s, d).select(F.when(F.col("seq") % 4 > 0, F.regexp_replace("url", "https://news.example.org", "")).alias("pathname"), F.lit("t").alias("title"), F.when(F.col("seq") % 5 > 0, F.concat("publication_date", F.lit("T11:22:33Z"))).otherwise("soon").alias("date")), "https://n.example"),
    "r10_external_scores": lambda s, d: ranking.scored_externally(fused._buckets(s, d), fused._bm25(s, d)).select("query_id", "url", "score", "rank"),
    "w12_hash_sample": lambda s, d: ingest.hash_sample(entries(s, d), "seq", 100).select("seq"),
    "t01_t03_t07_text": lambda s, d: load(s, d, "documents").select("doc_id", text.strip_bloat(F.concat(F.lit("&lt;b&gt; "), F.col("text"))).alias("s"), F.round(text.usefulness(F.col("text")), 4).alias("usefulness")),
    "t10_t11_html": lambda s, d: load(s, d, "documents").select("doc_id", text.strip_html(F.concat(F.lit("<p>A &amp;amp; "), F.col("text"), F.lit("</p>"))).alias("stripped"), text.unescape_all(F.lit("&amp;amp;lt;")).alias("all")),
    "c09_article_clean": lambda s, d: load(s, d, "documents").select("doc_id", pages.article_clean(F.concat(F.regexp_replace("text", r"\s+", " "), F.lit("\n© 2023 The Block. All Rights Reserved\n_subscribe to the x newsletter_\n[l](https://a/b)  \n\n\n\nend"))).alias("body")),
}

_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\.', '')"
_FLAT = r"regexp_replace(text, '[\s#|\[\]!*_`()]+', ' ', 'g')"

SQL = {
    "s01_s02_log_with_rejects": """SELECT left(ts::TIMESTAMP::VARCHAR, 10) AS day, count(*) FILTER (good) AS n, count(event_type) FILTER (good AND event_id % 5 > 0) AS kinds, (sum(event_id) FILTER (good))::BIGINT AS ids, count(*) FILTER (good) AS notes,
  count(*) FILTER (event_id % 97 = 0) AS syntax, count(*) FILTER (event_id % 97 > 0 AND event_id % 89 = 0) AS type FROM (SELECT *, event_id % 97 > 0 AND event_id % 89 > 0 AS good FROM events) e GROUP BY 1""",
    "s06_sitemap_index": sql("SELECT 'https://n.example/post_type_post_' || seq || '.xml' AS url FROM entries WHERE seq % 3 > 0"),
    "w12_hash_sample": sql("SELECT seq FROM entries ORDER BY md5('0:' || seq), seq LIMIT 100"),
    "a14_shares": sql("""SELECT engine, round(actual, 4) AS actual, round(uniform, 4) AS uniform, round(adjusted, 4) AS adjusted, round(actual - uniform, 4) AS vs_uniform, round(actual - adjusted, 4) AS vs_adjusted FROM (
  SELECT engine, 100 * total / sum(total) OVER () AS actual, 100.0::DOUBLE / count(*) OVER () AS uniform, 100 * ok / sum(ok) OVER () AS adjusted FROM (SELECT engine, count(*) AS total FROM by_engine GROUP BY engine) a LEFT JOIN (SELECT engine, count(*) FILTER (status = 'OK') AS ok FROM runs GROUP BY engine) b USING (engine)) x"""),
    "a20_variant_domains": sql(f"SELECT domain, count(*) AS n, count(*) FILTER (position <= 2) AS in_base, count(*) FILTER (position <= 2) = 0 AS new FROM (SELECT *, {_DOMAIN} AS domain FROM results) x GROUP BY domain ORDER BY n DESC, domain LIMIT 15"),
    "a23_downloads": sql("SELECT g, count(*) AS n, count(*) FILTER (id % 6 = 2) AS pdf, count(*) FILTER (id % 6 = 3) AS pdf_link, count(*) FILTER (id % 6 = 4) AS paywall, count(*) FILTER (id % 6 = 5) AS page, count(*) FILTER (id % 6 = 0) AS client_error, count(*) FILTER (id % 6 = 1) AS server_error, round(count(*) FILTER (id % 6 = 2) / count(*), 6) AS pdf_share FROM fetched GROUP BY g"),
    "a35_plateau": sql("SELECT run_id, coalesce(min(delay) FILTER (flat), max(delay)) AS delay FROM (SELECT *, size > 0 AND (lead(size) OVER (PARTITION BY run_id ORDER BY delay) - size) / size <= 0.05 AS flat FROM (SELECT run_id, floor(elapsed_s)::BIGINT AS delay, max(char_count) AS size FROM manifest GROUP BY ALL)) x GROUP BY run_id"),
    "a36_configurations": sql('SELECT config, round(median(f1), 6) AS median_f1, min(f1) AS min_f1, max(f1) AS max_f1, round(avg(recall), 6) AS mean_recall, round(avg("precision"), 6) AS mean_precision, trunc(median(byte_diff) FILTER (f1 IS NOT NULL))::INTEGER AS median_byte_diff, count(*) FILTER (status <> \'ok\') + count(*) FILTER (f1 < 0.3) AS failed, count(f1) AS scored, count(*) AS n FROM scored GROUP BY config'),
    "a36_shape_medians": sql("SELECT config, shape, round(median(f1), 6) AS median_f1 FROM scored WHERE f1 IS NOT NULL GROUP BY ALL"),
    "a39_methods": sql("SELECT 'M' || (seq % 5) AS method, CASE WHEN seq % 2 = 0 THEN 'general' ELSE 'pdf' END AS mode, count(*) AS n, round(avg(result_count / 11), 6) AS mean_jaccard, round(avg(search_ms), 4) AS mean_ms, list_sort(list(search_ms))[least(floor(count(*) * 90 / 100)::BIGINT, count(*) - 1) + 1] AS p90_ms FROM runs GROUP BY 1, 2"),
    "v02_v09_errors": sql("""SELECT seq, CASE WHEN seq % 5 = 0 THEN CASE WHEN seq % 30 <= 5.5 THEN 'connect_timeout' ELSE 'read_timeout' END WHEN seq % 3 = 1 THEN 'resolve_error' WHEN seq % 5 = 1 OR seq % 3 = 2 THEN 'proxy_handshake_error' WHEN seq % 5 = 2 THEN 'connection_refused' WHEN seq % 5 = 3 THEN 'tls_error' ELSE 'unknown' END AS kind,
  CASE WHEN seq % 9 = 0 THEN 'ERROR' WHEN seq % 12 >= 8 AND seq % 7 >= 5 THEN 'OK' WHEN seq % 12 > 0 THEN 'SUSPECT' ELSE (['CAPTCHA', 'RATE_LIMIT', 'EMPTY', 'ERROR'])[(seq % 4 + 1)::INTEGER] END AS status FROM runs"""),
    "v04_domain_frequency": sql(f"SELECT domain, count(*) AS n, count(DISTINCT engine) AS engines, count(DISTINCT query_id) AS queries FROM (SELECT *, {_DOMAIN} AS domain FROM results) x GROUP BY domain HAVING count(*) >= 2"),
    "v05_missed_domains": sql(f"SELECT domain, count(*) AS n, arg_min(url, seq) AS sample FROM (SELECT *, {_DOMAIN} AS domain FROM results) x GROUP BY domain HAVING NOT bool_or(query_id + length(url) > 50 AND contains(url || 'docs/x', '/docs/')) AND count(*) >= 2"),
    "v06_paths": sql(f"SELECT CASE WHEN domain = 'site1.example.org' THEN 'BLACKLIST' WHEN domain IN ('site2.example.org', 'site3.example.org') THEN 'TIER1' WHEN position = 1 THEN 'DIRECT' ELSE 'MULTI_STEP' END AS path, count(*) AS n, count(DISTINCT query_id) AS queries FROM (SELECT *, {_DOMAIN} AS domain FROM results) x GROUP BY 1"),
    "v07_byte_reduction": sql("SELECT run_id AS grp, count(*) AS n, count(*) FILTER (status = 'ok') AS adopted, round(count(*) FILTER (status = 'ok') / count(*), 6) AS share, round(avg(saved), 6) AS mean_saved, round(median(saved), 6) AS median_saved FROM (SELECT *, CASE WHEN seq % 5 > 0 AND char_count > 0 THEN (char_count - trunc(char_count / 2)) / char_count END AS saved FROM manifest) m GROUP BY run_id"),
    "v13_speedups": sql("SELECT status AS strategy, round(m, 6) AS mean_s, round((SELECT avg(elapsed_s) FROM manifest WHERE status = 'ok') / m, 6) AS speedup FROM (SELECT status, avg(elapsed_s) AS m FROM manifest GROUP BY status) x"),
    "v14_rank_matrix": sql("SELECT query_id, rank, l.url AS overlap, r.url AS rrf FROM listed l FULL JOIN rrf_listed r USING (query_id, rank)"),
    "s07_sitemap_urls": sql("SELECT url, publication_date || CASE WHEN seq % 3 = 2 THEN ' 08' ELSE ' 10' END AS hour FROM entries"),
    "s08_feed_items": sql("SELECT url, 'T' || seq AS title, publication_date AS date FROM entries"),
    "s21_proxy_lists": "SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN 'socks5' ELSE 'http' END || '://10.0.' || (c_custkey % 250) || '.7:' || (c_custkey * 100) AS key FROM customer WHERE c_custkey * 100 BETWEEN 1 AND 65535",
    "t21_item_positions": sql("SELECT query_id, url, title, snippet, position FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY seq))::INTEGER AS position FROM (SELECT query_id, seq, CASE WHEN seq % 4 = 0 THEN '' ELSE url END AS url, title, snippet FROM results WHERE engine = 'bing') b) x WHERE position <= 10 AND url <> ''"),
    "t21_items_renumbered": sql("SELECT query_id, url, title, snippet, (row_number() OVER (PARTITION BY query_id ORDER BY seq))::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY seq) AS n FROM (SELECT query_id, seq, CASE WHEN seq % 4 = 0 THEN '' ELSE url END AS url, title, snippet FROM results WHERE engine = 'bing') b) x WHERE n <= 10 AND url <> ''"),
    "t15_works": "SELECT doc_id, (['arxiv', 'doi', 'id'])[(doc_id % 3 + 1)::INTEGER] || doc_id AS url, CASE WHEN doc_id % 2 = 0 THEN '2020-01-02' WHEN doc_id % 5 > 0 THEN '2019' END AS date, 'abstract' || CASE WHEN doc_id % 90 > 50 THEN ' (Cited ' || (doc_id % 90) || '×)' ELSE '' END AS snippet, doc_id % 25 + 1 AS position FROM documents WHERE doc_id % 7 > 0",
    "c08_json_ld": "SELECT page_id, '<p>' || url || '</p>' AS body, '2024-05-01' AS date FROM pages WHERE page_id % 4 < 3",
    "c14_title": f"SELECT doc_id, '<!-- source: https://x/ -->' || chr(10) || chr(10) || CASE WHEN length(trim(flat)) >= 200 THEN '' ELSE '# Nav' || chr(10) || '* [c](d)' || chr(10) END || '# Title ' || doc_id || chr(10) || flat || chr(10) || '# Later' || chr(10) || 'end' AS body FROM (SELECT doc_id, {_FLAT} AS flat FROM documents) x",
    "c19_rules": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN s || '# T' || n || 'keep ' || doc_id || n || '## More' || n || 'body' WHEN 1 THEN s || '# T' || n || 'keep ' || doc_id || n || 'Edit this page' || n || '## See also' || n || 'links'
  ELSE '<!-- source: https://x/ -->' || n || 'nav' || n || '# T' || n || 'keep ' || doc_id || n || 'Edit this page' || n || '## See also' || n || 'links' || n || '## More' || n || 'View for:' || n || 'Windows' || n || 'body' END AS body FROM (SELECT doc_id, chr(10) AS n, '<!-- source: https://x/ -->' || chr(10) || chr(10) AS s FROM documents) x""",
    "p07_frontier": sql("SELECT DISTINCT url FROM results WHERE (url LIKE 'https://site35.example.org/%' AND url LIKE '%search%') OR (url LIKE 'https://site10.example.org/%' AND url NOT LIKE '%search%')"),
    "p33_entries": sql("SELECT 'https://n.example' || replace(url, 'https://news.example.org', '') AS url, publication_date || 'T00:00:00Z' AS lastmod, publication_date, 't' AS title FROM entries WHERE seq % 4 > 0 AND seq % 5 > 0"),
    "r10_external_scores": sql("SELECT query_id, url, score, rank FROM (SELECT b.query_id, b.url, m.score, row_number() OVER (PARTITION BY b.query_id ORDER BY m.score DESC, b.seq) AS rank FROM buckets b JOIN bm25 m USING (query_id, url)) x WHERE rank <= 10"),
    "t10_t11_html": r"SELECT doc_id, left(trim(regexp_replace('A &amp; ' || text, '\s+', ' ', 'g')), 500) AS stripped, '<' AS \"all\" FROM documents".replace('\\"', '"'),
    "c09_article_clean": r"SELECT doc_id, trim(trim(regexp_replace(text, '\s+', ' ', 'g')) || repeat(chr(10), 2) || 'l' || repeat(chr(10), 2) || 'end') AS body FROM documents",
}
