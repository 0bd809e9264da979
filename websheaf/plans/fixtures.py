"""Web-research tables projected from the driver tables, as DataFrames and as the same SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the engine registry, in its order.
ENGINES = "google crossref duckduckgo mojeek lobsters openalex stack_exchange semantic_scholar open_library startpage brave bing yandex marginalia".split()

_STATUS = {"view": "OK", "click": "EMPTY_NO_RESULTS", "purchase": "TIMEOUT_WATCHDOG", "error": "ERROR_HTTP", "signup": "RATE_SKIP"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine_of(number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ENGINES)), (number % len(ENGINES) + 1).cast("int"))


def _engine_sql(number: str) -> str:
    return f"(['{"', '".join(ENGINES)}'])[({number} % {len(ENGINES)} + 1)::INTEGER]"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results: one row per query, engine, url and position; `seq` is the arrival order."""
    li = load(spark, sf_dir, "lineitem")
    seq = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    site = F.col("l_partkey") % 100
    return li.select(
        (F.col("l_orderkey") % 200).cast("long").alias("query_id"),
        engine_of(F.col("l_suppkey")).alias("engine"),
        F.concat(F.lit("https://site"), site.cast("string"), F.lit(".example.org/"), F.when(site % 7 == 0, F.lit("search/a?b=c")).when(site % 5 == 0, F.lit("a/b/c/d/e/f")).otherwise(F.lit(""))).alias("url"),
        F.col("l_linenumber").cast("int").alias("position"),
        F.concat(F.lit("title "), (F.col("l_partkey") % 13).cast("string")).alias("title"),
        F.when(F.col("l_suppkey") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("snippet "), F.col("l_suppkey").cast("string"), F.lit(" of "), site.cast("string"))).alias("snippet"),
        seq.cast("long").alias("seq"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine runs: one status, latency and result count per event, in log order `seq`."""
    ev = load(spark, sf_dir, "events")
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in _STATUS.items()])
    return ev.select(
        F.col("event_id").cast("long").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        engine_of(F.col("user_id")).alias("engine"),
        status.alias("status"),
        (F.col("value") * 10).cast("int").alias("search_ms"),
        (F.col("event_id") % 11).cast("int").alias("result_count"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts and pool refreshes in one log, in log order `seq`."""
    ev = load(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("long").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("long").alias("proxy_key"),
        (F.col("event_id") % 100).cast("long").alias("url"),
        (F.col("event_type") == "view").alias("ok"),
        F.when(F.col("event_type") == "signup", F.col("value").cast("int")).alias("size"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discovered entries with what is known of them."""
    o = load(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("https://news.example.org/"), F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/story-"), F.col("o_orderkey").cast("string")).alias("url"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        (F.col("o_orderstatus") == "F").alias("have_raw"),
        (F.col("o_orderpriority") == "1-URGENT").alias("excluded"),
        F.col("o_orderkey").cast("long").alias("seq"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scrape records: status, seconds and characters."""
    li = load(spark, sf_dir, "lineitem")
    seq = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey")
    status = F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "A", "failed").otherwise("regwall")
    return li.select(
        F.concat(F.lit("https://news.example.org/story-"), (F.col("l_orderkey") % 3000).cast("string")).alias("url"),
        status.alias("status"),
        F.round(F.col("l_tax") * 100, 2).cast("double").alias("elapsed_s"),
        F.col("l_extendedprice").cast("int").alias("char_count"),
        (F.col("l_orderkey") % 40).cast("long").alias("run_id"),
        seq.cast("long").alias("seq"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph with cycles: page numbers."""
    li = load(spark, sf_dir, "lineitem").filter("l_linenumber <= 2")
    return li.select((F.col("l_partkey") % 500).cast("long").alias("src"), ((F.col("l_suppkey") * 5 + F.col("l_partkey") % 7) % 500).cast("long").alias("dst")).distinct()


SQL = {
    "results": f"""SELECT (l_orderkey % 200)::BIGINT AS query_id, {_engine_sql("l_suppkey")} AS engine,
  'https://site' || (l_partkey % 100) || '.example.org/' || CASE WHEN (l_partkey % 100) % 7 = 0 THEN 'search/a?b=c' WHEN (l_partkey % 100) % 5 = 0 THEN 'a/b/c/d/e/f' ELSE '' END AS url,
  l_linenumber::INTEGER AS position, 'title ' || (l_partkey % 13) AS title,
  CASE WHEN l_suppkey % 9 = 0 THEN '' ELSE 'snippet ' || l_suppkey || ' of ' || (l_partkey % 100) END AS snippet,
  (((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey)::BIGINT AS seq FROM lineitem""",
    "runs": f"""SELECT event_id::BIGINT AS seq, ts, {_engine_sql("user_id")} AS engine,
  CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATUS.items())} END AS status,
  trunc(value * 10)::INTEGER AS search_ms, (event_id % 11)::INTEGER AS result_count FROM events""",
    "attempts": """SELECT event_id::BIGINT AS seq, ts, user_id::BIGINT AS proxy_key, (event_id % 100)::BIGINT AS url, event_type = 'view' AS ok,
  CASE WHEN event_type = 'signup' THEN trunc(value)::INTEGER END AS size FROM events""",
    "entries": """SELECT 'https://news.example.org/' || strftime(o_orderdate, '%Y/%m/%d') || '/story-' || o_orderkey AS url,
  strftime(o_orderdate, '%Y-%m-%d') AS publication_date, o_orderstatus = 'F' AS have_raw, o_orderpriority = '1-URGENT' AS excluded, o_orderkey::BIGINT AS seq FROM orders""",
    "manifest": """SELECT 'https://news.example.org/story-' || (l_orderkey % 3000) AS url,
  CASE l_returnflag WHEN 'N' THEN 'ok' WHEN 'A' THEN 'failed' ELSE 'regwall' END AS status, round(l_tax * 100, 2)::DOUBLE AS elapsed_s,
  trunc(l_extendedprice)::INTEGER AS char_count, (l_orderkey % 40)::BIGINT AS run_id,
  (((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey)::BIGINT AS seq FROM lineitem""",
    "edges": """SELECT DISTINCT (l_partkey % 500)::BIGINT AS src, ((l_suppkey * 5 + l_partkey % 7) % 500)::BIGINT AS dst FROM lineitem WHERE l_linenumber <= 2""",
}

#: Tables that later ones build on, in order; each names what it needs.
DERIVED: dict[str, str] = {}


def sql(body: str, **more: str) -> str:
    """`body` with a WITH clause of those projections that it names, directly or through another."""
    known = SQL | DERIVED | more
    need: list[str] = []

    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in seen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                seen.add(name)
                visit(known[name])
                need.append(name)

    visit(body)
    order = list(dict.fromkeys(need))
    return ("WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" if order else "") + body
