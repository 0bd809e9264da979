"""Breadth-first crawl over a link table: joins per level, the frontier and the visited set as written tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websheaf.operators.shared import written


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int, *, fetched: DataFrame | None = None) -> DataFrame:
    """(node, depth, found) of all nodes within `max_depth` links of the seeds, with the depth at which they are first met.

    `edges` holds (src, dst), `seeds` holds (node), `fetched` holds (node, status): a status of 429 or of 400 and more is
    not found and leads nowhere; a null one (the fetch failed) counts as found. Nodes at the last depth don't expand.
    Each level is one join and one anti join on tables that are written, so lineage stays one level long; a level is written
    once, and the visited nodes are the levels' tables read together.
    """
    def judged(nodes: DataFrame) -> DataFrame:
        if fetched is None:
            return nodes.withColumn("found", F.lit(True))
        status = fetched.groupBy("node").agg(F.max("status").alias("status"))
        return nodes.join(status, "node", "left").withColumn("found", F.coalesce(F.col("status") < 400, F.lit(True))).drop("status")

    levels = [written(judged(seeds.select("node").distinct().withColumn("depth", F.lit(0))), "level")]
    for depth in range(1, max_depth + 1):
        visited = reduce(DataFrame.unionByName, levels)
        sources = levels[-1].filter("found").select(F.col("node").alias("src"))
        fresh = edges.join(sources, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(visited.select("node"), "node", "left_anti")
        levels.append(written(judged(fresh.withColumn("depth", F.lit(depth))), "level"))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def crawl_stats(found: DataFrame, links: DataFrame) -> DataFrame:
    """Per depth: nodes, and of all links how many lead to them."""
    hits = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("hits"))
    return found.join(hits, "node", "left").groupBy("depth").agg(F.count("*").alias("nodes"), F.sum(F.coalesce("hits", F.lit(0))).alias("links"))


def allowed(nodes: DataFrame, host: str, include: list[str], exclude: list[str]) -> DataFrame:
    """Urls of one host over http, holding any of `include` (if given) and none of `exclude`."""
    url = F.col("url")
    ok = url.startswith("http") & (F.regexp_extract(url, "^https?://([^/?#]*)", 1) == host)
    for marks, wanted in ((include, True), (exclude, False)):
        if marks:
            hit = F.lit(False)
            for m in marks:
                hit = hit | url.contains(m)
            ok = ok & (hit if wanted else ~hit)
    return nodes.filter(ok)
