"""Mixing sources to target weights: whole copies by rate, and one hash-seeded coin for the fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from websheaf.llm.storage import fresh, table, written

#: Sources in code point order (null last) weigh these in turn; no source is repeated more often than MAX_REPEATS.
WEIGHTS, MAX_REPEATS, SEED = (1, 2, 3), 3, "mix-1"
#: Fixed value: what a word is.
WORD = r"[^\x20\x09-\x0D]+"


def coin(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and the doc_id alone (on the text where that is null), so that reruns and
    retries agree."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    All sizes are shared by weight; a source stops at max_repeats times its size and the excess is shared by weight among
    the others until none is above. That fixed point is water filling: with sources in ascending order of size / weight,
    those before some place stop and the rest get one level times their weight; levels fall from that place on, so it is the
    largest level that keeps its own source under its stop. The windows span the sources only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    limit = (F.lit(max_repeats) * F.col("source_size")).cast("double")
    weighed = sizes.withColumn("w", weight.cast("double")).withColumn("stop", limit)
    by_ratio = Window.orderBy((F.col("stop") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    levels = weighed.withColumn("level", level)
    final = F.max(F.when(F.col("level") * F.col("w") <= F.col("stop"), F.col("level"))).over(everything)
    target = F.least("stop", F.coalesce(final, F.lit(0.0)) * F.col("w"))
    return levels.select("source", "source_size", F.round(target, 6).alias("target"))


def _goals(sized: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """A written table of (goal_of, source_size, target, rate), a row a source, from (source, size): Spark knows its size, so
    it is sent to the documents, or shuffled, as that size asks."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = source_targets(sizes, weights=weights, max_repeats=max_repeats)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return written(goals.select(F.col("source").alias("goal_of"), "source_size", "target", rate.alias("rate")), "goals")


def _copies(rate: Column, coin: Column) -> Column:
    return (F.floor(rate) + (coin < rate - F.floor(rate)).cast("int")).cast("int")


def mixed(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """One row per row of `docs` (doc_id, source, text; others are ignored): doc_id, source, size, source_size, target, copies.

    A document is taken floor(target / source_size) times, and once more if its coin is under the fraction. Size is the
    number of words (null and empty texts: 0). Nulls in source are one source, the last. An empty source's rate is 0.
    Texts are read once; sizes are summed per source with partial aggregation, so a large source never gathers in one task.
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text"), seed).alias("coin"))
    sized = written(sized, "sizes")
    goals = _goals(sized, weights, max_repeats)
    joined = sized.join(goals, sized["source"].eqNullSafe(goals["goal_of"]))
    return joined.select("doc_id", "source", "size", "source_size", "target", _copies(F.col("rate"), F.col("coin")).alias("copies"))


def mixture(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The documents of the mix, each as often as mixed() takes it, with the columns of `docs`, whatever their names."""
    goals = _goals(docs.select(F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size")), weights, max_repeats)
    joined = docs.join(goals, docs["source"].cast("string").eqNullSafe(goals["goal_of"]))
    times = _copies(goals["rate"], coin(docs["doc_id"], docs["text"], seed))
    again = fresh(docs, "again")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], F.explode(F.array_repeat(F.lit(True), times)).alias(again)).drop(again)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of `documents` and what the mix takes of it. Null and empty texts have size 0, null sources are the last
    source, null ids are told apart by text, rows that repeat an id share its coin; an empty table gives no rows."""
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, ''))) AS name FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS w, (3 * source_size)::DOUBLE AS stop FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY stop / w, source NULLS LAST)
), t AS (
  SELECT source, source_size, round(least(stop, coalesce(max(CASE WHEN level * w <= stop THEN level END) OVER (), 0) * w), 6) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         least(3.0::DOUBLE, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS rate,
         ('0x' || substr(md5('mix-1:' || d.name), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT) * size AS taken FROM r
"""
