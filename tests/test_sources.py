"""Readers and writers over files made here."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from websheaf.sources import readers, writers


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_query_log_kinds_and_bad_lines(spark, tmp_path):
    run = {"status": "OK", "search_ms": 12, "result_count": 3}
    lines = [{"record_type": "engine_run", "ts": "t1", "engines": {"bing": run}}, {"ts": "t2", "query": "q", "search_key": "k", "total_wall_ms": 5}, {"record_type": "drilldown", "ts": "t3", "search_key": "k"}, {"record_type": "drilldown", "ts": "t4", "search_key": "z"}]
    path = put(tmp_path, "log.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n{broken\n")
    log = readers.query_log(spark, path)
    rows = log.collect()
    assert sum(r._corrupt is not None for r in rows) == 1
    assert {r.record_type for r in rows if r._corrupt is None} == {"engine_run", "workflow_summary", "drilldown"}
    assert readers.engine_rows(log).select("engine", "search_ms").collect() == [("bing", 12)]
    assert sorted((r.ts, r.searched) for r in readers.drilldowns(log).collect()) == [("t3", "q"), ("t4", None)]


def test_lists(spark, tmp_path):
    assert [r.url for r in readers.url_list(spark, put(tmp_path, "u.txt", " a \n\n\tb\n")).collect()] == ["a", "b"]
    rows = readers.dated_list(spark, put(tmp_path, "d.txt", "2024-05-01\thttps://x\nbad\n")).collect()
    assert [tuple(r) for r in rows] == [("2024-05-01", "https://x", 2024)]


def test_sitemaps(spark):
    index = spark.createDataFrame([("<loc> https://x/post_type_post_1.xml </loc><loc>https://x/page.xml</loc>",)], "xml string")
    assert [r.url for r in readers.sitemap_index(index, "post_type_post").collect()] == ["https://x/post_type_post_1.xml"]
    body = "<url><loc>a</loc><lastmod>2024-05-01T10:00:00Z</lastmod></url><url><loc>b</loc><lastmod>2024-05-01T10:00:00+02:00</lastmod></url><url><loc>c</loc><lastmod>2024-05-01T10:00:00</lastmod></url><url><loc>d</loc></url><url><loc>e</loc><lastmod>soon</lastmod></url>"
    found = readers.sitemap_urls(spark.createDataFrame([(body,)], "xml string")).select("url", F.date_format("lastmod", "HH").alias("h")).collect()
    assert [tuple(r) for r in found] == [("a", "10"), ("b", "08"), ("c", "10")]


def test_feed_takes_the_first_list_and_the_first_date(spark):
    bodies = [json.dumps({"n": 1, "empty": [], "items": [{"url": "a", "title": "A", "date": "d2", "published": "d1"}, {"pathname": "/b", "lastmod": "d3"}]}), json.dumps([{"url": "c", "displayDate": "d4"}]), "not json"]
    found = readers.feed_items(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert sorted((r.url, r.date) for r in found) == [("/b", "d3"), ("a", "d1"), ("c", "d4")]


def test_proxy_lists(spark):
    body = "1.2.3.4:080 alive\nsocks5://user:pw@5.6.7.8:1080\n9.9.9.9:70000\nnoise 1.2.3.4:80"
    found = readers.proxy_list(spark.createDataFrame([(body,)], "body string"), "http").collect()
    assert sorted(r.key for r in found) == ["http://1.2.3.4:80", "socks5://5.6.7.8:1080"]


def test_json_ld(spark):
    ld = lambda x: f'<script type="application/ld+json">{x}</script>'
    article = {"@type": "NewsArticle", "articleBody": "<p>b</p>", "datePublished": "2024"}
    pages = [(1, ld(json.dumps({"@type": "Organization"})) + ld("{bad") + ld(json.dumps(article))), (2, ld(json.dumps({"@graph": [{"@type": "X"}, article]}))), (3, ld(json.dumps([{"@type": ["Thing", "NewsArticle"], "articleBody": ""}]))), (4, "<p>none</p>")]
    found = {r.page_id: (r.body, r.date) for r in readers.json_ld_articles(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    assert found == {1: ("<p>b</p>", "2024"), 2: ("<p>b</p>", "2024"), 3: ("", None)}


def test_search_items_keep_or_renew_positions(spark):
    items = [{"url": "", "title": "x"}, {"url": "a", "title": "A", "snippet": "s"}, {"url": "b", "title": "B"}]
    payload = spark.createDataFrame([(1, json.dumps(items)), (2, json.dumps([{"url": f"u{i}"} for i in range(20)]))], "query_id long, payload string")
    kept = readers.search_items(payload, "", 5).collect()
    assert [(r.url, r.position) for r in kept if r.query_id == 1] == [("a", 2), ("b", 3)]
    assert sum(r.query_id == 2 for r in kept) == 5
    assert [(r.url, r.position) for r in readers.search_items(payload, "", 5, renumber=True).collect() if r.query_id == 1] == [("a", 1), ("b", 2)]
    nested = spark.createDataFrame([(1, json.dumps({"items": items}))], "query_id long, payload string")
    assert readers.search_items(nested, "items", 2).count() == 1


def test_cache_replaces_its_own_keys_and_expires(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = lambda *x: spark.createDataFrame(x, "search_key string, pools string, at double").select("search_key", "pools", F.timestamp_seconds("at").alias("written_at"))
    writers.write_cache(rows(("a", "1", 1000.0), ("b", "1", 1000.0)), path)
    writers.write_cache(rows(("a", "2", 2000.0)), path)
    cache = spark.read.parquet(path)
    hit = lambda key, now: [r.pools for r in readers.cache_hits(cache, key, F.timestamp_seconds(F.lit(now))).collect()]
    assert hit("a", 2000) == ["2"] and hit("b", 4600) == ["1"] and hit("b", 4601) == []


def test_written_texts(spark, tmp_path):
    lit = F.lit
    row = spark.range(1).select(
        writers.sidecar(lit("u"), lit("t"), lit("e"), lit("ok"), lit("h"), lit("body")).alias("s"), writers.sidecar(lit("u"), lit("t"), lit("e"), lit("ok"), lit("h"), lit(" ")).alias("empty"),
        writers.page_markdown(lit("u"), lit("# T[¶](#t)\n\n\n\nx ")).alias("m"), writers.facts(lit("u"), lit(200), lit("e"), lit(4), lit(None).cast("string")).alias("f"), writers.article_file(lit("s"), lit("d"), lit("h")).alias("a"),
    ).first()
    assert row.s.startswith("<!-- source: u -->") and row.s.endswith("\n\nbody") and row.s.count("<!--") == 5 and row.empty is None
    assert row.m == "<!-- source: u -->\n\n# T\n\nx" and row.f == "url: u\nstatus: 200\nengine: e\nchars: 4" and row.a == "s__d__h.md"
    put(tmp_path, "p.md", row.m)
    assert readers.markdown_folder(spark, str(tmp_path / "p.md")).first().source_url == "u"
    ledger = readers.sources_ledger(spark.createDataFrame([("a", "k")], "source string, key string"), ["a", "b"]).collect()
    assert sorted(map(tuple, ledger)) == [("a", True, 1), ("b", False, 0)]


def test_recent_files(spark, tmp_path):
    import os

    put(tmp_path, "new.txt", "x")
    os.utime(put(tmp_path, "old.txt", "x"), (1_000_000, 1_000_000))
    assert [r.path.rsplit("/", 1)[1] for r in readers.recent_files(spark, str(tmp_path), F.current_timestamp()).collect()] == ["new.txt"]


def test_appending_never_fails_the_job(spark, tmp_path, caplog):
    rows = spark.createDataFrame([(1, None, "é"), (2, "x", None)], "a int, b string, c string").withColumn("d", F.lit(None))
    path = str(tmp_path / "log")
    assert writers.append_log(rows, path) and writers.append_log(rows.limit(1), path)
    lines = sorted(p for f in (tmp_path / "log").glob("*.json") for p in f.read_text(encoding="utf-8").splitlines())
    assert lines == ['{"a":1,"b":null,"c":"é","d":null}'] * 2 + ['{"a":2,"b":"x","c":null,"d":null}']
    (tmp_path / "file").write_text("x")
    with caplog.at_level("WARNING"):
        assert not writers.append_log(rows, str(tmp_path / "file" / "log"))
        assert not writers.append_log(rows.select(F.raise_error(F.lit("row")).alias("x")), path)
    assert len(caplog.records) == 2
    assert spark.read.json(path).count() == 3


def test_lines_are_sorted_out(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\n  \n{"a": 2}\n{"a": "two"}\n{"a": 3\n[1]\nplain\n{"a": 4, "z": 0}\n')
    good, bad = readers.sorted_out(spark, str(tmp_path / "log.jsonl"), "a int, b string")
    assert sorted((r.a, r.b) for r in good.collect()) == [(1, "x"), (2, None), (4, None)]
    assert sorted((r.line, r.reason) for r in bad.collect()) == [("[1]", "syntax"), ("plain", "syntax"), ('{"a": "two"}', "type"), ('{"a": 3', "syntax")]
    assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"log.jsonl"}


def test_a_source_that_fails_stops_no_other(spark, tmp_path):
    (tmp_path / "a.txt").write_text("u1\nu2\n")
    (tmp_path / "b.txt").write_text("u3\n")
    read = lambda s, p: readers.url_list(s, p).select(F.when(F.col("url") == "u3", F.raise_error(F.lit("bad row"))).otherwise(F.col("url")).alias("url"))
    rows, ledger = readers.loaded(spark, {n: str(tmp_path / f"{n}.txt") for n in "abc"}, read)
    assert sorted((r.source, r.url) for r in rows.collect()) == [("a", "u1"), ("a", "u2")]
    assert [(r.source, r.ok, r["count"], bool(r.error)) for r in ledger.orderBy("source").collect()] == [("a", True, 2, False), ("b", False, 0, True), ("c", False, 0, True)]
    assert readers.loaded(spark, {"c": str(tmp_path / "c.txt")}, read)[0] is None
