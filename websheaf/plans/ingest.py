"""Ingestion and crawl queries over entries, manifests and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.operators import crawl, ingest
from websheaf.plans.fixtures import DERIVED, attempts, edges, entries, load, manifest, sql

DERIVED |= {
    "listed_proxies": "SELECT (l_suppkey % 7)::BIGINT AS source, (l_partkey % 900)::BIGINT AS key, l_linenumber AS part FROM lineitem",
    "bfs": "SELECT node, min(depth) AS depth FROM reach GROUP BY node",
}


def _classified(s: SparkSession, d: str, keys: list[str]) -> DataFrame:
    e = entries(s, d).withColumn("hash", F.left(F.sha2("url", 256), F.lit(12)))
    return ingest.classified(e, e.filter("have_raw"), e.filter("excluded"), keys)


def _proxies(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "lineitem").select((F.col("l_suppkey") % 7).cast("long").alias("source"), (F.col("l_partkey") % 900).cast("long").alias("key"), F.col("l_linenumber").alias("part"))


def _checks(s: SparkSession, d: str) -> DataFrame:
    return attempts(s, d).select(F.col("proxy_key").alias("key"), "ts", "seq", F.col("ok").alias("alive"))


def _jobs(s: SparkSession, d: str) -> DataFrame:
    m = manifest(s, d)
    return m.withColumn("file", F.when(F.col("char_count") % 5 > 0, F.concat(F.lit("f"), F.col("seq").cast("string")))).withColumn("error", F.concat(F.lit("e"), F.col("status")))


def _story_entries(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    return e.select(F.concat(F.lit("https://news.example.org/story-"), (F.col("seq") % 4000).cast("string")).alias("url"), "publication_date", "seq")


def j18(s: SparkSession, d: str) -> DataFrame:
    e = load(s, d, "orders").select(F.concat(F.lit("https://news.example.org/story-"), (F.col("o_orderkey") % 4000).cast("string")).alias("url")).distinct()
    return ingest.ride_manifest(e, _jobs(s, d))


def s18(s: SparkSession, d: str) -> DataFrame:
    m = manifest(s, d).select(F.col("url").alias("hash"), "seq", "status", "char_count")
    first, second = m.filter(F.col("seq") % 2 == 0), m.filter(F.col("seq") % 2 == 1)
    old = ingest.last_per_key(first, ["hash"], "seq").select("hash", "seq", "status", "char_count")
    return ingest.upserted(old, second, "hash").select("hash", "status", "char_count", "from_new")


def s17(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    old = e.filter("have_raw").select(F.col("publication_date").alias("date"), "url")
    return ingest.merged_list(old, e.select(F.when(F.col("seq") % 9 == 0, "2020").otherwise(F.col("publication_date")).alias("lastmod"), "url"))


def s04(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).select(F.col("publication_date").alias("date"), "url", F.left("publication_date", F.lit(4)).cast("int").alias("year"))
    return ingest.in_date_range(e, "1995-03-01", "1996-02-29")


def s23(s: SparkSession, d: str) -> DataFrame:
    b = entries(s, d).groupBy((9999 - F.left("publication_date", F.lit(4)).cast("int")).alias("batch")).agg(F.min("publication_date").alias("oldest"), F.count("*").alias("n"))
    return ingest.pages_until(b, "1995-06-01")


def a32(s: SparkSession, d: str) -> DataFrame:
    m = manifest(s, d).select(F.col("run_id").alias("source"), F.when(F.col("status") == "ok", 1).otherwise(0).alias("ok"), F.when(F.col("status") == "ok", 0).otherwise(1).alias("fail"), F.col("char_count").alias("unique_n"), "seq")
    old = m.filter(F.col("seq") % 3 == 0).groupBy("source").agg(F.sum("ok").alias("ok"), F.sum("fail").alias("fail"), F.count("*").alias("runs"), F.lit(0).alias("unique_latest"), F.lit(-1).cast("long").alias("seq"))
    return ingest.scoreboard(old, m.filter(F.col("seq") % 3 > 0))


def w11(s: SparkSession, d: str) -> DataFrame:
    strata = entries(s, d).groupBy(F.left("publication_date", F.lit(4)).alias("stratum")).agg(F.count("*").alias("size"))
    return ingest.allocation(strata, 1000)


def _bfs(s: SparkSession, d: str) -> DataFrame:
    return crawl.breadth_first(edges(s, d), s.range(3).select((F.col("id") * 7).alias("node")), 3)


def c23_statuses(s: SparkSession, d: str) -> DataFrame:
    status = s.range(500).select(F.col("id").alias("node"), F.when(F.col("id") % 4 == 1, 429).when(F.col("id") % 4 == 2, 200).alias("status"))
    return crawl.breadth_first(edges(s, d), s.range(3).select((F.col("id") * 8).alias("node")), 2, fetched=status)


def j14(s: SparkSession, d: str) -> DataFrame:
    sample = load(s, d, "part").select((F.col("p_partkey") % 900).cast("long").alias("key")).distinct().withColumn("alive", F.col("key") % 3 == 0)
    return ingest.attribution(sample, _proxies(s, d))


def x06(s: SparkSession, d: str) -> DataFrame:
    pool = load(s, d, "lineitem").select((F.col("l_partkey") % 900).cast("long").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("seq"))
    held = load(s, d, "customer").filter("c_custkey % 5 = 0").select((F.col("c_custkey") % 900).cast("long").alias("key"))
    cooling = load(s, d, "supplier").select((F.col("s_suppkey") * 7 % 900).cast("long").alias("key"))
    return ingest.refill(pool, held, cooling, 400).select("key", "seq")


def x07(s: SparkSession, d: str) -> DataFrame:
    urls = load(s, d, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("url"), F.col("s_suppkey").alias("seq"))
    return ingest.assigned(urls, load(s, d, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_custkey").alias("seq")), F.expr("seq div 100"))


QUERIES = {
    "j01_dedup_counts": lambda s, d: ingest.state_counts(_classified(s, d, ["hash"])),
    "j02_dedup_by_date": lambda s, d: _classified(s, d, ["publication_date", "hash"]).select("url", "state"),
    "j04_with_dates": lambda s, d: ingest.with_dates(manifest(s, d).filter("status = 'ok'"), _story_entries(s, d)).select("seq", "url", "publication_date"),
    "j05_clean_with_manifest": lambda s, d: _story_entries(s, d).join(ingest.last_per_key(manifest(s, d).select("url", "seq", "status"), ["url"], "seq").select("url", "status"), "url").select("seq", "status"),
    "j09_recovered": lambda s, d: ingest.recovered(manifest(s, d).filter("status = 'ok' and run_id < 5"), manifest(s, d).filter("run_id >= 5"), manifest(s, d).filter("status = 'failed'")),
    "j10_filter_diff": lambda s, d: manifest(s, d).select("url").distinct().join(manifest(s, d).filter("status = 'ok'").select("url"), "url", "left_anti"),
    "j13_snapshot_diff": lambda s, d: ingest.snapshot_diff(_proxies(s, d).filter("part <= 2 and source <> 3"), _proxies(s, d).filter("part >= 6 and source <> 5")),
    "j14_attribution": j14,
    "j15_stale": lambda s, d: ingest.stale(load(s, d, "customer").select(F.col("c_custkey").cast("long").alias("key")), _checks(s, d).select("key", F.col("ts").alias("seen_at")), F.lit("2024-01-31 00:00:00").cast("timestamp"), 43200),
    "j17_manifest_states": lambda s, d: ingest.manifest_states(_story_entries(s, d), manifest(s, d).filter("status = 'ok' and run_id < 8"), manifest(s, d).filter("status = 'failed' and run_id < 20")).select("seq", "status"),
    "j18_ride_manifest": j18,
    "a30_pool_overlap": lambda s, d: ingest.pool_overlap(_proxies(s, d).withColumnRenamed("source", "bucket")),
    "a31_first_per_key": lambda s, d: ingest.first_per_key(manifest(s, d).select("url", "seq", "status"), ["url"], "seq"),
    "a32_scoreboard": a32,
    "a33_sightings": lambda s, d: ingest.sightings(_checks(s, d)),
    "s04_date_range": s04,
    "s05_known_urls": lambda s, d: entries(s, d).select("url").distinct(),
    "s15_raw_manifest": lambda s, d: ingest.with_dates(manifest(s, d), _story_entries(s, d)).filter("status = 'ok'").select(F.left(F.sha2("url", 256), F.lit(12)).alias("hash"), "url", "publication_date").distinct(),
    "s16_blocked_lists": lambda s, d: ingest.blocked_lists(manifest(s, d).filter("run_id < 3"), manifest(s, d), ["regwall", "failed"]),
    "s17_master_list": s17,
    "s18_upsert": s18,
    "s23_pages_until": s23,
    "w11_allocation": w11,
    "x06_refill": x06,
    "x07_assignment": x07,
    "p35_sitemaps": lambda s, d: ingest.numbered_sitemaps(load(s, d, "orders").select(F.concat(F.lit("https://x/post_type_post_"), (F.col("o_custkey") % 700).cast("string"), F.lit(".xml")).alias("url")).distinct(), between=(24, 26)).select("url", "n"),
    "c07_keep_first": lambda s, d: ingest.first_per_key(_story_entries(s, d).withColumn("key", F.regexp_replace("url", "/$", "")), ["key"], "seq").select("key", "seq"),
    "c23_breadth_first": lambda s, d: _bfs(s, d).select("node", "depth"),
    "c23_statuses": c23_statuses,
    "a37_crawl_stats": lambda s, d: crawl.crawl_stats(_bfs(s, d), edges(s, d)),
}


def _reach(seeds: str, depth: int, ok: str = "true") -> str:
    return f"""SELECT node, 0 AS depth FROM ({seeds}) s UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN edges e ON e.src = r.node WHERE r.depth < {depth} AND {ok}"""


def _recursive(body: str, **more: str) -> str:
    return sql(body, **more).replace("WITH ", "WITH RECURSIVE ", 1)


_STATE = """SELECT *, CASE WHEN excluded THEN 'excluded' WHEN have_raw THEN 'have' ELSE 'new' END AS state FROM entries"""
_STORIES = "SELECT 'https://news.example.org/story-' || (seq % 4000) AS url, publication_date, seq FROM entries"
_DATES = "SELECT url, arg_max(publication_date, seq) AS publication_date FROM stories GROUP BY url"

SQL = {
    "j01_dedup_counts": sql("SELECT state, count(*) AS n FROM states GROUP BY state", states=_STATE),
    "j02_dedup_by_date": sql("SELECT url, state FROM states", states=_STATE),
    "j04_with_dates": sql("SELECT m.seq, m.url, coalesce(d.publication_date, '') AS publication_date FROM manifest m LEFT JOIN dates d USING (url) WHERE status = 'ok'", stories=_STORIES, dates=_DATES),
    "j05_clean_with_manifest": sql("SELECT s.seq, m.status FROM stories s JOIN (SELECT url, arg_max(status, seq) AS status FROM manifest GROUP BY url) m USING (url)", stories=_STORIES),
    "j09_recovered": sql("SELECT url, url IN (SELECT url FROM manifest WHERE status = 'failed') AS in_gold FROM (SELECT DISTINCT url FROM manifest WHERE run_id >= 5 EXCEPT SELECT url FROM manifest WHERE status = 'ok' AND run_id < 5) x"),
    "j10_filter_diff": sql("SELECT DISTINCT url FROM manifest EXCEPT SELECT url FROM manifest WHERE status = 'ok'"),
    "j13_snapshot_diff": sql("""SELECT source, CASE WHEN count(o) = 0 THEN 0 ELSE count(*) FILTER (o IS NULL) END AS added, CASE WHEN count(o) = 0 THEN 0 ELSE count(*) FILTER (n IS NULL) END AS dropped FROM
  (SELECT DISTINCT source, key, 1 AS o FROM listed_proxies WHERE part <= 2 AND source <> 3) a FULL JOIN (SELECT DISTINCT source, key, 1 AS n FROM listed_proxies WHERE part >= 6 AND source <> 5) b USING (source, key) GROUP BY source HAVING count(n) > 0"""),
    "j14_attribution": sql("""SELECT source, count(*) AS seen, count(*) FILTER (key % 3 = 0) AS alive, count(*) FILTER (key % 3 = 0 AND k = 1) AS alone FROM (SELECT DISTINCT source, key FROM listed_proxies) a
  JOIN (SELECT key, count(DISTINCT source) AS k FROM listed_proxies GROUP BY key) c USING (key) WHERE key IN (SELECT p_partkey % 900 FROM part) GROUP BY source"""),
    "j15_stale": sql("SELECT key, t IS NULL OR epoch(TIMESTAMP '2024-01-31 00:00:00') - t >= 43200 AS \"check\" FROM (SELECT c_custkey::BIGINT AS key FROM customer) k LEFT JOIN (SELECT proxy_key AS key, epoch(max(ts)) AS t FROM attempts GROUP BY 1) a USING (key)"),
    "j17_manifest_states": sql("SELECT seq, CASE WHEN url IN (SELECT url FROM manifest WHERE status = 'ok' AND run_id < 8) THEN 'ok' WHEN url IN (SELECT url FROM manifest WHERE status = 'failed' AND run_id < 20) THEN 'dead' ELSE 'failed' END AS status FROM stories", stories=_STORIES),
    "j18_ride_manifest": sql("""SELECT url, CASE WHEN f IS NOT NULL THEN 'ok' ELSE 'failed' END AS status, f AS file, c AS char_count, CASE WHEN f IS NULL THEN coalesce(e, 'not fetched') END AS error FROM (SELECT DISTINCT 'https://news.example.org/story-' || (o_orderkey % 4000) AS url FROM orders) u
  LEFT JOIN (SELECT url, arg_max('f' || seq, seq) FILTER (status = 'ok' AND char_count % 5 > 0) AS f, arg_max(char_count, seq) FILTER (status = 'ok' AND char_count % 5 > 0) AS c, 'e' || arg_max(status, seq) AS e FROM manifest GROUP BY url) m USING (url)"""),
    "a30_pool_overlap": sql("SELECT sum(raw)::BIGINT AS raw, sum(u)::BIGINT AS per_bucket, any_value(o) AS overall, (sum(u) - any_value(o))::BIGINT AS overlap FROM (SELECT count(*) AS raw, count(DISTINCT key) AS u, (SELECT count(DISTINCT key) FROM listed_proxies) AS o FROM listed_proxies GROUP BY source) x"),
    "a31_first_per_key": sql("SELECT url, min(seq) AS seq, arg_min(status, seq) AS status FROM manifest GROUP BY url"),
    "a32_scoreboard": sql("SELECT run_id AS source, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status <> 'ok') AS fail, count(*) AS runs, coalesce(arg_max(char_count, seq) FILTER (seq % 3 > 0), 0) AS unique_latest FROM manifest GROUP BY run_id"),
    "a33_sightings": sql("SELECT proxy_key AS key, count(*) AS checks, count(*) FILTER (ok) AS alive, count(*) FILTER (NOT ok) AS dead, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(ok, seq) AS last_alive FROM attempts GROUP BY proxy_key"),
    "s04_date_range": sql("SELECT publication_date AS date, url, left(publication_date, 4)::INTEGER AS year FROM entries WHERE publication_date BETWEEN '1995-03-01' AND '1996-02-29'"),
    "s05_known_urls": sql("SELECT DISTINCT url FROM entries"),
    "s15_raw_manifest": sql("SELECT DISTINCT left(sha256(m.url), 12) AS hash, m.url, coalesce(d.publication_date, '') AS publication_date FROM manifest m LEFT JOIN dates d USING (url) WHERE status = 'ok'", stories=_STORIES, dates=_DATES),
    "s16_blocked_lists": sql("SELECT DISTINCT status, url FROM manifest WHERE run_id < 3 OR status IN ('regwall', 'failed')"),
    "s17_master_list": sql("SELECT publication_date AS date, url FROM entries WHERE have_raw OR seq % 9 <> 0"),
    "s18_upsert": sql("SELECT url AS hash, coalesce(arg_max(status, seq) FILTER (seq % 2 = 1), arg_max(status, seq)) AS status, coalesce(arg_max(char_count, seq) FILTER (seq % 2 = 1), arg_max(char_count, seq)) AS char_count, CASE WHEN count(*) FILTER (seq % 2 = 0) > 0 THEN 0 ELSE 1 END AS from_new FROM manifest GROUP BY url"),
    "s23_pages_until": sql("SELECT batch, oldest, n FROM (SELECT *, max((oldest < '1995-06-01')::INTEGER) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone FROM (SELECT 9999 - left(publication_date, 4)::INTEGER AS batch, min(publication_date) AS oldest, count(*) AS n FROM entries GROUP BY 1)) x WHERE coalesce(gone, 0) = 0"),
    "w11_allocation": sql("SELECT stratum, size, least(n + CASE WHEN row_number() OVER (ORDER BY size DESC, stratum) = 1 THEN greatest(1000 - sum(n) OVER (), 0) ELSE 0 END, size)::BIGINT AS take FROM (SELECT *, 5 + floor(greatest(1000 - 5 * count(*) OVER (), 0) * size / sum(size) OVER ())::BIGINT AS n FROM (SELECT left(publication_date, 4) AS stratum, count(*) AS size FROM entries GROUP BY 1)) x"),
    "x06_refill": """SELECT key, seq FROM (SELECT *, row_number() OVER (ORDER BY seq, key) AS n FROM (SELECT (l_partkey % 900)::BIGINT AS key, min(l_orderkey * 10 + l_linenumber)::BIGINT AS seq FROM lineitem GROUP BY 1) p
  WHERE key NOT IN (SELECT c_custkey % 900 FROM customer WHERE c_custkey % 5 = 0) AND key NOT IN (SELECT s_suppkey * 7 % 900 FROM supplier)) x WHERE n <= 400 - (SELECT count(DISTINCT c_custkey % 900) FROM customer WHERE c_custkey % 5 = 0)""",
    "x07_assignment": "SELECT key, 'u' || s_suppkey AS url, j FROM (SELECT c_custkey::BIGINT AS key, row_number() OVER (ORDER BY c_custkey) - 1 AS j FROM customer) k JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS i FROM supplier) u ON i = j % (SELECT count(*) FROM supplier)",
    "p35_sitemaps": "SELECT DISTINCT 'https://x/post_type_post_' || (o_custkey % 700) || '.xml' AS url, (o_custkey % 700)::INTEGER AS n FROM orders WHERE o_custkey % 700 BETWEEN 24 AND 26",
    "c07_keep_first": sql("SELECT url AS key, min(seq) AS seq FROM stories GROUP BY url", stories=_STORIES),
    "c23_breadth_first": _recursive("SELECT node, depth FROM bfs", reach=_reach("SELECT unnest([0, 7, 14]) AS node", 3)),
    "c23_statuses": _recursive("SELECT node, depth, node % 4 <> 1 AS found FROM bfs", reach=_reach("SELECT unnest([0, 8, 16]) AS node", 2, "r.node % 4 <> 1")),
    "a37_crawl_stats": _recursive("SELECT depth, count(*) AS nodes, coalesce(sum(hits), 0)::BIGINT AS links FROM bfs LEFT JOIN (SELECT dst AS node, count(*) AS hits FROM edges GROUP BY dst) h USING (node) GROUP BY depth", reach=_reach("SELECT unnest([0, 7, 14]) AS node", 3)),
}
