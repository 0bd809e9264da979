"""Connected components by alternating large-star and small-star steps, as plain joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from websheaf.llm.storage import dropped, met, written


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
    return met(both.filter("v > u"), least, ["u"], "n", 2 * total).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = written(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    moved = met(edges, least, ["a"], "n", total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    `edges` holds two long columns a, b. Stars shrink in O(log n) rounds; each round's edges are a written table, so
    lineage stays short and nothing but one checksum reaches the driver. Loops and repeated edges are harmless, and a star of
    any size meets its centre in many tasks.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    seen = None
    while True:
        sign = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(sign) == seen or not sign[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b"), F.col("b")).distinct()
            )
        seen = tuple(sign)
        stars = written(_large_star(edges, sign[0]), "stars")
        older, edges = edges, written(_small_star(stars, stars.count()), "edges")
        dropped(older)
        dropped(stars)
