"""Result fusion: pools, caps, buckets, breakdowns and rank-based comparisons.

Input rows are search results (query_id, engine, url, position, title, snippet, seq); `seq` is the arrival order and
decides every tie, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_POSITION = 999


def selected_engines(registry: list[str], wanted: str | None) -> list[str]:
    """Registry names in a comma list, trimmed and lower-cased, in registry order; None or empty selects all, unknown names
    select nothing."""
    if not wanted:
        return list(registry)
    names = {w.strip().lower() for w in wanted.split(",")}
    return [e for e in registry if e in names]


def engine_pools(results: DataFrame) -> DataFrame:
    """Each (query, url) belongs to the engine that ranks it best; ties go by engine name, then arrival.

    Keeps the winner's title and snippet, and of every engine the position of its last row. One shuffle by (query, url)
    serves both aggregations.
    """
    rows = results.repartition("query_id", "url")
    first = F.min(F.struct("position", "engine", "seq", "title", "snippet")).alias("first")
    last = F.max(F.struct("seq", "position"))["position"].alias("last")
    by_engine = rows.groupBy("query_id", "url", "engine").agg(first, last)
    pool = by_engine.groupBy("query_id", "url").agg(
        F.min("first").alias("w"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("engine", "last")))).alias("engine_positions")
    )
    return pool.select(
        "query_id", F.col("w.engine").alias("owner"), "url", F.col("w.position").alias("position"), F.col("w.title").alias("title"), F.col("w.snippet").alias("snippet"), F.col("w.seq").alias("seq"), "engine_positions"
    )


def pool_cap(pools: DataFrame, leader: str = "google", fallback: int = 10) -> DataFrame:
    """(query_id, cap): how many results the leading engine owns; the fallback where it owns none."""
    owned = F.sum((F.col("owner") == leader).cast("int"))
    return pools.groupBy("query_id").agg(owned.alias("n")).select("query_id", F.when(F.col("n") > 0, F.col("n")).otherwise(fallback).alias("cap"))


def capped_pools(pools: DataFrame, leader: str = "google", fallback: int = 10) -> DataFrame:
    """The first `cap` results of every owner, by position; `rank` counts within the owner's pool."""
    rank = F.row_number().over(Window.partitionBy("query_id", "owner").orderBy("position", "seq"))
    return pools.withColumn("rank", rank).join(pool_cap(pools, leader, fallback), "query_id").filter("rank <= cap")


def raw_cap(results: DataFrame, leader: str = "google", fallback: int = 10) -> DataFrame:
    """Results at positions up to the leading engine's row count (fallback where it has none), before any merging."""
    n = F.sum((F.col("engine") == leader).cast("int"))
    cap = results.groupBy("query_id").agg(n.alias("n")).select("query_id", F.when(F.col("n") > 0, F.col("n")).otherwise(fallback).alias("cap"))
    return results.join(cap, "query_id").filter("position <= cap")


def breakdown(pools: DataFrame, engines: list[str]) -> DataFrame:
    """(query_id, engine, n_urls) for every selected engine in its order `nth`, zeros included."""
    counts = pools.groupBy("query_id", F.col("owner").alias("engine")).agg(F.count("*").alias("n"))
    frame = pools.select("query_id").distinct().select("query_id", F.posexplode(F.array(*map(F.lit, engines))).alias("nth", "engine"))
    return frame.join(counts, ["query_id", "engine"], "left").select("query_id", "engine", "nth", F.coalesce("n", F.lit(0)).alias("n_urls"))


def bucket_pool(results: DataFrame) -> DataFrame:
    """One row per (query, url): first snippet, first non-empty title, engines in arrival order, each engine's last
    non-empty snippet, and the best position."""
    rows = results.repartition("query_id", "url")
    filled = F.when(F.col("snippet") != "", F.struct("seq", "snippet"))
    by_engine = rows.groupBy("query_id", "url", "engine").agg(
        F.min(F.struct("seq", "snippet")).alias("first"),
        F.min(F.when(F.col("title") != "", F.struct("seq", "title"))).alias("titled"),
        F.max(filled)["snippet"].alias("last_snippet"),
        F.min("position").alias("best"),
    )
    arrivals = F.sort_array(F.collect_list(F.struct(F.col("first.seq").alias("seq"), "engine", "last_snippet", "best")))
    out = by_engine.groupBy("query_id", "url").agg(F.min("first").alias("f"), F.min("titled").alias("t"), arrivals.alias("a"), F.min("best").alias("min_position"))
    kept = F.filter("a", lambda x: x["last_snippet"].isNotNull())
    return out.select(
        "query_id",
        "url",
        F.coalesce(F.col("t.title"), F.lit("")).alias("title"),
        F.col("f.snippet").alias("snippet"),
        F.transform("a", lambda x: x["engine"]).alias("engines"),
        F.map_from_entries(F.transform(kept, lambda x: F.struct(x["engine"], x["last_snippet"]))).alias("snippets"),
        F.map_from_entries(F.transform("a", lambda x: F.struct(x["engine"], x["best"]))).alias("positions"),
        "min_position",
        F.col("f.seq").alias("seq"),
    )


def without_engines(pool: DataFrame, dropped: list[str]) -> DataFrame:
    """A bucket pool without some engines: urls that no engine is left for go; the best position is taken anew, or kept
    where no position is left."""
    gone = F.array(*map(F.lit, dropped))
    left = pool.withColumn("engines", F.array_except("engines", gone)).filter(F.size("engines") > 0)
    left = left.withColumn("positions", F.map_filter("positions", lambda k, _: ~F.array_contains(gone, k)))
    return left.withColumn("min_position", F.coalesce(F.array_min(F.map_values("positions")), "min_position"))


def engine_positions(results: DataFrame) -> DataFrame:
    """The best position per (query, url, engine); NO_POSITION where it is unknown."""
    return results.groupBy("query_id", "url", "engine").agg(F.coalesce(F.min("position"), F.lit(NO_POSITION)).alias("position"))


def class_of(engines: Column, classes: list[tuple[str, list[str]]], default: str = "general") -> Column:
    """The first class whose engines meet the row's."""
    out = F.lit(default)
    for name, members in reversed(classes):
        out = F.when(F.arrays_overlap(engines, F.array(*map(F.lit, members))), F.lit(name)).otherwise(out)
    return out


def slot_counts(pool: DataFrame, classes: list[tuple[str, list[str]]]) -> DataFrame:
    """Per engine: slots, slots by class, slots it holds alone, slots it shares."""
    rows = pool.withColumn("cls", class_of(F.col("engines"), classes)).withColumn("alone", F.size("engines") == 1)
    flat = rows.select("cls", "alone", F.explode("engines").alias("engine"))
    names = [n for n, _ in classes] + ["general"]
    by_class = [F.sum((F.col("cls") == n).cast("long")).alias(n) for n in names]
    return flat.groupBy("engine").agg(F.count("*").alias("total"), *by_class, F.sum(F.col("alone").cast("long")).alias("solo"), F.sum((~F.col("alone")).cast("long")).alias("shared"))


def shares(counts: DataFrame, runs: DataFrame) -> DataFrame:
    """Actual, uniform and OK-adjusted shares in percent of slots per engine, and the differences; without any OK run the
    adjusted share is null. `counts` holds (engine, total), `runs` holds (engine, status)."""
    ok = runs.groupBy("engine").agg(F.sum((F.col("status") == "OK").cast("long")).alias("ok"))
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # registry-sized
    rows = counts.select("engine", "total").join(ok, "engine", "left").fillna(0, ["ok"])
    actual = 100 * F.col("total") / F.sum("total").over(every)
    uniform = F.lit(100.0) / F.count("*").over(every)
    adjusted = F.when(F.sum("ok").over(every) > 0, 100 * F.col("ok") / F.sum("ok").over(every))
    out = rows.select("engine", actual.alias("actual"), uniform.alias("uniform"), adjusted.alias("adjusted"))
    return out.select(
        "engine", F.round("actual", 4).alias("actual"), F.round("uniform", 4).alias("uniform"), F.round("adjusted", 4).alias("adjusted"),
        F.round(F.col("actual") - F.col("uniform"), 4).alias("vs_uniform"), F.round(F.col("actual") - F.col("adjusted"), 4).alias("vs_adjusted"),
    )


def co_occurrence(results: DataFrame) -> DataFrame:
    """(a, b, n): in how many (query, url) two different engines meet; symmetric. Engines of a url are few by nature."""
    pairs = results.select("query_id", "url", "engine").distinct()
    other = pairs.select("query_id", "url", F.col("engine").alias("b"))
    return pairs.withColumnRenamed("engine", "a").join(other, ["query_id", "url"]).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def pool_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per query over (query_id, url): common, all, new and removed urls, and the overlap in percent (one decimal)."""
    a = old.select("query_id", "url").distinct().withColumn("in_old", F.lit(1))
    b = new.select("query_id", "url").distinct().withColumn("in_new", F.lit(1))
    both = a.join(b, ["query_id", "url"], "full_outer").fillna(0, ["in_old", "in_new"])
    out = both.groupBy("query_id").agg(
        F.sum(F.col("in_old") * F.col("in_new")).alias("common"), F.count("*").alias("all_urls"),
        F.sum(F.col("in_new") * (1 - F.col("in_old"))).alias("added"), F.sum(F.col("in_old") * (1 - F.col("in_new"))).alias("removed"),
    )
    return out.withColumn("overlap_pct", F.bround(100 * F.col("common") / F.col("all_urls"), 1))


def jaccard(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Jaccard of the url sets of two list tables per key; 0 where both are empty."""
    left, right = a.select(*keys, "url").distinct().withColumn("x", F.lit(1)), b.select(*keys, "url").distinct().withColumn("y", F.lit(1))
    both = left.join(right, [*keys, "url"], "full_outer")
    common = F.sum((F.col("x").isNotNull() & F.col("y").isNotNull()).cast("int"))
    return both.groupBy(*keys).agg((common / F.count("*")).alias("jaccard"))


def gold_recall(found: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query: matched, missing, noise and recall in percent of the gold urls (0 without gold)."""
    f, g = found.select("query_id", "url").distinct().withColumn("f", F.lit(1)), gold.select("query_id", "url").distinct().withColumn("g", F.lit(1))
    both = f.join(g, ["query_id", "url"], "full_outer").fillna(0, ["f", "g"])
    out = both.groupBy("query_id").agg(F.sum(F.col("f") * F.col("g")).alias("matched"), F.sum(F.col("g") * (1 - F.col("f"))).alias("missing"), F.sum(F.col("f") * (1 - F.col("g"))).alias("noise"))
    gold_n = F.col("matched") + F.col("missing")
    return out.withColumn("recall_pct", F.when(gold_n > 0, F.bround(100 * F.col("matched") / gold_n, 1)).otherwise(0.0))


def cleaned_list(listed: DataFrame, kept: DataFrame, backfill: DataFrame) -> DataFrame:
    """Survivors of a ranked list (query_id, url, rank) in order, ranked anew, then the backfill in its order.

    Backfill urls that the list already held are skipped; `replaced` names, for the i-th backfilled url, the i-th that
    was lost.
    """
    alive = listed.join(kept.select("query_id", "url").distinct(), ["query_id", "url"], "left_semi")
    lost = listed.join(kept.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "url"))
    fresh = backfill.join(listed.select("query_id", "url"), ["query_id", "url"], "left_anti").withColumn("i", nth)
    lost = lost.withColumn("i", nth).select("query_id", "i", F.col("url").alias("replaced"))
    filled = fresh.join(lost, ["query_id", "i"]).select("query_id", "url", (F.col("i") + 1_000_000_000).alias("rank"), "replaced")
    every = alive.select("query_id", "url", F.col("rank").cast("long").alias("rank"), F.lit(None).cast("string").alias("replaced")).unionByName(filled)
    return every.withColumn("rank", nth)


def drilldown_text(pools: DataFrame) -> DataFrame:
    """The listing of each engine's pool: position, title, url and snippet of its results, by position."""
    item = F.concat(F.col("position").cast("string"), F.lit(". "), "title", F.lit("\n   URL: "), "url", F.when(F.col("snippet") != "", F.concat(F.lit("\n   Snippet: "), "snippet")).otherwise(""))
    lines = F.sort_array(F.collect_list(F.struct("position", "seq", item.alias("item"))))
    return pools.groupBy("query_id", "owner").agg(F.array_join(F.transform(lines, lambda x: x["item"]), "\n").alias("listing"))


def domain_counts(results: DataFrame, top: int = 15) -> DataFrame:
    """The `top` domains of each engine by rows, then name."""
    counts = results.withColumn("domain", F.regexp_extract("url", "^https?://(?:www\\.)?([^/]+)", 1)).groupBy("engine", "domain").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))
    rank = F.row_number().over(Window.partitionBy("engine").orderBy(F.desc("n"), "domain"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= top)
