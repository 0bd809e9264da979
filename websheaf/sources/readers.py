"""Readers: logs, lists, sitemaps, feeds, markdown folders, proxy lists and the search cache."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from websheaf.functions.pages import lines

_ENGINE = "struct<rate_wait_ms: int, search_ms: int, result_count: int, status: string, drop_reason: string>"
#: One row type for all kinds of query log lines; a line without record_type is a workflow summary.
QUERY_LOG = f"record_type string, ts string, query string, language string, engines map<string, {_ENGINE}>, total_wall_ms int, bottleneck_engine string, search_key string, engine string, cache_status string, urls array<string>, _corrupt string"
#: Attempts and pool events of one log.
ATTEMPT_LOG = "event string, ts string, proxy_key string, url string, result string, size int, ok boolean, count int, _corrupt string"
FEED_DATES = ["published", "publishedAt", "date", "lastmod", "displayDate"]


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a known schema; blank lines are skipped, lines that don't parse keep their text in `_corrupt`."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def sorted_out(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as rows of `schema`, and those that are none: (file, line, reason), reason being `syntax` for a text that is no JSON object
    and `type` for one whose values do not fit. Blank lines are neither. Files that cannot be read to their end give the rows
    before that (spark.sql.files.ignoreCorruptFiles decides)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    parsed = lines.withColumn("row", F.from_json("value", f"{schema}, `_bad` string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("row").isNull() | F.col("row._bad").isNotNull()
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))
    rejected = parsed.filter(bad).select("file", F.col("value").alias("line"), F.when(is_object, "type").otherwise("syntax").alias("reason"))
    return parsed.filter(~bad).select("row.*").drop("_bad"), rejected


def loaded(spark: SparkSession, paths: dict[str, str], read) -> tuple[DataFrame | None, DataFrame]:
    """The rows of several sources under their name in `source`, and a ledger (source, ok, count, error) with a row each.

    `read` makes of a session and a path the source's rows, all with the same columns. A source that is missing or cannot be
    read, or whose rows fail while they are counted, is a line of the ledger and stops no other.
    """
    rows, ledger = None, []
    for source, path in paths.items():
        try:
            own = read(spark, path).withColumn("source", F.lit(source))
            count, _ = own.agg(F.count("*"), F.bit_xor(F.xxhash64(F.to_json(F.struct(*own.columns))))).first()  # every value is made
            ledger.append((source, True, count, None))
            rows = own if rows is None else rows.unionByName(own)
        except Exception as error:  # noqa: BLE001  whatever it is, it is the source's
            ledger.append((source, False, 0, str(error).split("\n")[0][:500]))
    return rows, spark.createDataFrame(ledger, "source string, ok boolean, count long, error string")


def query_log(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, QUERY_LOG).withColumn("record_type", F.coalesce("record_type", F.lit("workflow_summary")))


def engine_rows(log: DataFrame) -> DataFrame:
    """One row per engine of each line that holds engines."""
    return log.select("record_type", "ts", "query", F.explode("engines").alias("engine", "run")).select("record_type", "ts", "query", "engine", "run.*")


def drilldowns(log: DataFrame) -> DataFrame:
    """Drilldown lines with the searches of the same key; a missing search is normal, several give several rows."""
    searches = log.filter("record_type = 'workflow_summary'").select("search_key", F.col("ts").alias("searched_at"), F.col("query").alias("searched"))
    return log.filter("record_type = 'drilldown'").join(searches, "search_key", "left")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("url")).filter("url <> ''")


def dated_list(spark: SparkSession, path: str) -> DataFrame:
    """(date, url, year) of `date<TAB>url` lines."""
    parts = F.split("value", "\t", 2)
    rows = spark.read.text(path).filter(F.col("value").contains("\t")).select(parts[0].alias("date"), parts[1].alias("url"))
    return rows.withColumn("year", F.left("date", F.lit(4)).cast("int"))


def sitemap_index(xml: DataFrame, mark: str) -> DataFrame:
    """Locations in sitemap indexes (xml) that hold a mark."""
    found = F.regexp_extract_all("xml", F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)
    return xml.select(F.explode(found).alias("url")).filter(F.col("url").contains(mark))


def sitemap_urls(xml: DataFrame) -> DataFrame:
    """(url, lastmod) of url blocks with both; Z and no zone mean UTC, rows with a bad time are dropped."""
    block = F.explode(F.regexp_extract_all("xml", F.lit("(?s)<url>(.*?)</url>"), 1)).alias("b")
    part = lambda tag: F.regexp_extract("b", rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>", 1)
    rows = xml.select(block).select(part("loc").alias("url"), part("lastmod").alias("stated"))
    zoned = F.when(F.col("stated").rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.col("stated")).otherwise(F.concat("stated", F.when(F.col("stated").contains("T"), "Z").otherwise("T00:00:00Z")))
    return rows.withColumn("lastmod", F.try_to_timestamp(zoned)).filter("url <> '' and stated <> '' and lastmod is not null").select("url", "lastmod")


def feed_items(bodies: DataFrame) -> DataFrame:
    """(url, title, date) of feed bodies (body): the root list, else the first value that is a non-empty list of objects;
    the date is the first of FEED_DATES that an item has."""
    root = F.try_parse_json("body")
    is_list = F.schema_of_variant(root).startswith("ARRAY")
    values = F.from_json("body", "map<string, string>")
    lists = F.filter(F.map_values(values), lambda v: v.rlike(r"^\s*\[\s*\{"))
    chosen = F.when(is_list, F.col("body")).otherwise(F.get(lists, 0))
    items = F.from_json(chosen, "array<map<string, string>>")
    flat = bodies.select(F.explode(items).alias("i"))
    date = F.coalesce(*[F.try_element_at("i", F.lit(k)) for k in FEED_DATES])
    url = F.coalesce(F.try_element_at("i", F.lit("url")), F.try_element_at("i", F.lit("pathname")))
    return flat.select(url.alias("url"), F.try_element_at("i", F.lit("title")).alias("title"), date.alias("date")).filter("url is not null")


def markdown_folder(spark: SparkSession, path: str) -> DataFrame:
    """(source_url, text) of files that name their source in a leading comment."""
    whole = spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "text")
    return whole.withColumn("source_url", F.regexp_extract("text", r"^<!-- source: (\S+) -->", 1)).filter("source_url <> ''").select("source_url", "text")


def proxy_list(bodies: DataFrame, protocol: str) -> DataFrame:
    """(key) of plain or decorated lists (body): every address with a port from 1 to 65535; users are dropped."""
    found = F.explode(F.regexp_extract_all("body", F.lit(r"(?:(\w+)://)?(?:[^\s@/]+@)?((?:\d{1,3}\.){3}\d{1,3}:\d{1,5})(?!\d)"), 0)).alias("m")
    rows = bodies.select(found)
    proto = F.regexp_extract("m", r"^(\w+)://", 1)
    address = F.regexp_extract("m", r"((?:\d{1,3}\.){3}\d{1,3}):0*(\d{1,5})$", 1)
    port = F.regexp_extract("m", r":0*(\d{1,5})$", 1).cast("int")
    return rows.select(F.concat(F.when(proto != "", proto).otherwise(protocol), F.lit("://"), address, F.lit(":"), port.cast("string")).alias("key"), port.alias("port")).filter("port between 1 and 65535").select("key").distinct()


def sources_ledger(rows: DataFrame, expected: list[str]) -> DataFrame:
    """(source, ok, count) of several loads (source, key); a source without rows failed and stops nothing."""
    counts = rows.groupBy("source").agg(F.count("*").alias("count"))
    frame = rows.sparkSession.createDataFrame([(s,) for s in expected], "source string")
    return frame.join(counts, "source", "left").select("source", F.col("count").isNotNull().alias("ok"), F.coalesce("count", F.lit(0)).alias("count"))


def cache_hits(cache: DataFrame, key: str, now: Column, ttl_s: int = 3600) -> DataFrame:
    """Entries of a key that are at most `ttl_s` old; the key prunes partitions."""
    age = now.cast("double") - F.col("written_at").cast("double")
    return cache.filter((F.col("search_key") == key) & (age <= ttl_s))


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _page_trees(data: pd.Series) -> pd.Series:
    """Of each JSON text, the hrefs that begin with a slash of every node that holds child pages or is one, in page order; with
    the number of nodes above. Texts that don't parse, or nest deeper than the parser goes, have none."""

    def walk(text: str | None) -> list[list[str]]:
        try:
            root = json.loads(text or "null")
        except (ValueError, RecursionError):
            return []
        found, open_nodes = [], [(root, 0, False)]
        while open_nodes:
            node, depth, is_page = open_nodes.pop()
            if isinstance(node, list):
                open_nodes += [(x, depth, is_page) for x in reversed(node)]
            elif isinstance(node, dict):
                pages = node.get("childPages")
                is_page = is_page or isinstance(pages, list)
                href = node.get("href")
                if is_page and isinstance(href, str) and href.startswith("/"):
                    found.append([href, str(depth)])
                later = [(x, depth + 1, True) for x in reversed(pages)] if isinstance(pages, list) else []
                if not is_page:
                    later += [(x, depth, False) for x in reversed(list(node.values()))]
                open_nodes += later
        return found

    return data.map(walk)


#: Fixed value: where a server-rendered page keeps its data.
_PAGE_DATA = r'(?s)<script id="__NEXT_DATA__" type="application/json">(.+?)</script>'


def embedded_links(pages: DataFrame, base: str = "") -> DataFrame:
    """(page_id, url, depth) of the page trees in a page's embedded data: `base` and each href that begins with a slash, of nodes
    with `childPages` and of those pages, however deep."""
    found = _page_trees(F.regexp_extract("html", _PAGE_DATA, 1))
    return pages.select("page_id", F.explode(found).alias("x")).select("page_id", F.concat(F.lit(base), F.col("x")[0]).alias("url"), F.col("x")[1].cast("int").alias("depth"))


def category_counts(links: DataFrame, prefix: str) -> DataFrame:
    """(category, n) of links (url): the first path segment behind `prefix`; urls that are the prefix alone are `?`."""
    rest = F.replace("url", F.lit(prefix), F.lit(""))
    return links.groupBy(F.when(rest == "", "?").otherwise(F.split_part(rest, F.lit("/"), F.lit(1))).alias("category")).agg(F.count("*").alias("n"))


#: How many results an engine gives at most.
MAX_RESULTS = {
    "google": 100, "duckduckgo": 10, "mojeek": 10, "lobsters": 20, "openalex": 200, "crossref": 200, "stack_exchange": 100, "semantic_scholar": 10,
    "open_library": 100, "startpage": 10, "brave": 10, "bing": 10, "yandex": 10, "marginalia": 10,
}


def capped_results(results: DataFrame, default: int = 10) -> DataFrame:
    """Rows (engine, position, ...) within their engine's MAX_RESULTS; other engines give `default` at most."""
    cap = F.coalesce(*[F.when(F.col("engine") == e, F.lit(n)) for e, n in MAX_RESULTS.items()], F.lit(default))
    return results.filter(F.col("position") <= cap)


def json_ld_articles(pages: DataFrame) -> DataFrame:
    """(page_id, body, date) of each page's first JSON-LD block with a NewsArticle, in an object, a list or a graph;
    blocks that don't parse are skipped."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]+type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), 1)
    blocks = pages.select("page_id", F.posexplode(found).alias("at", "raw")).withColumn("v", F.try_parse_json("raw")).filter("v is not null")
    graph = F.try_variant_get("v", "$['@graph']", "array<variant>")
    items = F.coalesce(graph, F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    flat = blocks.select("page_id", "at", F.posexplode(items).alias("nth", "i"))
    kind = F.coalesce(F.try_variant_get("i", "$['@type']", "array<string>"), F.array(F.try_variant_get("i", "$['@type']", "string")))
    rows = flat.filter(F.array_contains(kind, "NewsArticle")).select("page_id", "at", "nth", F.try_variant_get("i", "$.articleBody", "string").alias("body"), F.try_variant_get("i", "$.datePublished", "string").alias("date"))
    first = rows.groupBy("page_id").agg(F.min(F.struct("at", "nth", "body", "date")).alias("f"))
    return first.select("page_id", F.col("f.body").alias("body"), F.col("f.date").alias("date"))


def search_items(payloads: DataFrame, item: str, most: int, *, renumber: bool = False) -> DataFrame:
    """(query_id, url, title, snippet, position) of engines' item lists (query_id, payload): capped, items without a url
    skipped; positions count the list's places, or with `renumber` what is left."""
    fields = "array<struct<url: string, title: string, snippet: string>>" if item == "" else f"struct<{item}: array<struct<url: string, title: string, snippet: string>>>"
    parsed = F.from_json("payload", fields)
    items = parsed if item == "" else parsed[item]
    kept = F.slice(items, 1, most)
    if renumber:
        kept = F.filter(kept, lambda x: F.coalesce(x["url"], F.lit("")) != "")
    rows = payloads.select("query_id", F.posexplode(kept).alias("at", "i")).select("query_id", "i.url", "i.title", "i.snippet", (F.col("at") + 1).alias("position"))
    return rows.filter(F.coalesce("url", F.lit("")) != "")


def found_blocks(text: Column) -> Column:
    """Urls that a search tool printed, in order."""
    return F.filter(F.transform(lines(text), lambda s: F.regexp_extract(s, r"^\s*URL: (\S+)", 1)), lambda u: u != "")


def recent_files(spark: SparkSession, path: str, now: Column, days: int = 14) -> DataFrame:
    """(path, modificationTime) of the files that were changed within the last days; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "modificationTime")
    return files.filter(F.col("modificationTime") >= now - F.make_interval(days=F.lit(days)))
