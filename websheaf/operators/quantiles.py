"""The three quantile definitions that reports use, each under its own name.

`inclusive` is an aggregate. The others pick values by rank with `at_ranks`: equal values are counted, and the range that holds a
wanted rank is cut into BINS parts again and again, until it holds few values; only these are put in order. So no group is ever
one array or one sort, however its values lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websheaf.operators.shared import dropped, written

#: Parts into which a range of values is cut, and different values that are put in order at once.
BINS, INSIDE = 1024, 4096


def inclusive(value: Column, p: float) -> Column:
    """Linear interpolation between the smallest and the largest value; one value is every quantile, none is null."""
    return F.percentile(value, F.lit(p))


def at_ranks(rows: DataFrame, by: list[str], value: Column, ranks: dict[str, Column]) -> DataFrame:
    """(*by, n, and a column for each of `ranks`): the values of those ranks (from 1, as expressions of the group's number
    `n` of values that are not null) in ascending order. Groups without a value have no row."""
    counts = written(rows.select(*by, value.alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count("*").alias("c")), "counts")
    held = narrowed(counts, by, ranks)
    inside = counts.join(held, by).filter("v between low and high")
    reach = F.col("base") + F.sum("c").over(Window.partitionBy(*by, "name").orderBy("v"))
    found = inside.withColumn("reach", reach).filter("reach >= rank").groupBy(*by, "n", "name").agg(F.min("v").alias("v"))
    return found.groupBy(*by, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ranks])


def narrowed(counts: DataFrame, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """For every group of `counts` (*by, v, c) and rank: (*by, n, name, rank, base, low, high, size), a range of values that holds
    the rank, how many rows lie before it, and its different values, at most INSIDE of them.

    A round cuts the ranges that are still larger into BINS equal parts and keeps the part with the rank, from its least
    to its greatest value. One far value costs a round, and doubles have ranges of at most some two hundred rounds' halvings,
    of which a round makes ten; ranges, not values, go from round to round.
    """
    ends = counts.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("c").alias("n"), F.count("*").alias("size"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("long").alias("rank")) for k, r in ranks.items()])).alias("a")
    ranges = written(ends.select("*", asked).select(*by, "n", "a.name", "a.rank", F.lit(0).cast("long").alias("base"), "low", "high", "size"), "ranges")
    while not (large := ranges.filter(F.col("size") > INSIDE)).isEmpty():
        low, high = F.col("low").cast("double"), F.col("high").cast("double")
        # halves before the difference, as the ends may be as far apart as doubles go
        part = F.floor((F.col("v").cast("double") / 2 - low / 2) / F.greatest(high / 2 - low / 2, F.lit(1e-300)) * BINS)
        cut = counts.join(large, by).filter("v between low and high").withColumn("part", F.least(part, F.lit(BINS - 1)))
        fixed = [*by, "n", "name", "rank", "base"]
        parts = cut.groupBy(*fixed, "part").agg(F.sum("c").alias("own"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("size"))
        upto = F.sum("own").over(Window.partitionBy(*by, "name").orderBy("part"))  # at most BINS rows
        parts = parts.withColumn("upto", F.col("base") + upto).filter("rank > upto - own and rank <= upto")
        smaller = parts.select(*by, "n", "name", "rank", (F.col("upto") - F.col("own")).alias("base"), "low", "high", "size")
        older, ranges = ranges, written(ranges.filter(F.col("size") <= INSIDE).unionByName(smaller), "ranges")
        dropped(older)
    return ranges


def nearest_rank(rows: DataFrame, by: list[str], value: Column, percents: list[int]) -> DataFrame:
    """(*by, p50, ...): sorted[min(int(n * p / 100), n - 1)] with p in percent."""
    n = F.col("n")
    found = at_ranks(rows, by, value, {f"p{p}": F.least(F.floor(n * p / 100), n - 1) + 1 for p in percents})
    return found.select(*by, *[f"p{p}" for p in percents])


def exclusive(rows: DataFrame, by: list[str], value: Column, k: int, n: int, name: str) -> DataFrame:
    """(*by, name): the kth of n - 1 cut points at positions k * (m + 1) / n of m sorted values, interpolated, also beyond the
    ends' neighbours; one value is itself."""
    m = F.col("n")
    j = F.greatest(F.least(F.greatest(F.floor(F.lit(k) * (m + 1) / n), F.lit(1)), m - 1), F.lit(1))
    found = at_ranks(rows, by, value, {"lower": j, "upper": F.least(j + 1, m)})
    delta = F.lit(k) * (m + 1) - j * n
    between = (F.col("lower") * (n - delta) + F.col("upper") * delta) / n
    return found.select(*by, F.when(m == 1, F.col("lower")).otherwise(between).alias(name))
