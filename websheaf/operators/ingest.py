"""Ingestion state: dedup against what is known, upserts, manifests, url lists, pools and sightings. `seq` orders rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websheaf.operators.ordered import numbered
from websheaf.operators.shared import fresh


def classified(entries: DataFrame, existing: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `state`: excluded where the url is excluded, else have where the keys exist, else new.

    `keys` picks the mode: the hash alone (any date), or source, date and hash. The known sides are joined as distinct
    keys; Spark broadcasts them where their size allows.
    """
    gone = excluded.select("url").distinct().withColumn("__x", F.lit(True))
    have = existing.select(*keys).distinct().withColumn("__h", F.lit(True))
    out = entries.join(gone, "url", "left").join(have, keys, "left")
    return out.withColumn("state", F.when(F.col("__x"), "excluded").when(F.col("__h"), "have").otherwise("new")).drop("__x", "__h")


def state_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("state").agg(F.count("*").alias("n"))


def last_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key; `order` decides, whole rows travel as one struct through a partial aggregation."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def first_per_key(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return best.select(*keys, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]])


def with_dates(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """A manifest with its entries' publication dates, "" where there is none; of repeated entries the last counts."""
    dates = last_per_key(entries.select("url", "seq", "publication_date"), ["url"], "seq").select("url", "publication_date")
    return manifest.join(dates, "url", "left").withColumn("publication_date", F.coalesce("publication_date", F.lit("")))


def upserted(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """An index after rows were written to it: the last write of each key wins, its first place in the order stays.

    Both sides hold (key, seq, …); `first_seq` is the place.
    """
    both = index.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in index.columns if c not in (key, "seq")]
    out = both.groupBy(key).agg(F.max(F.struct("__new", "seq", *rest)).alias("w"), F.min(F.struct("__new", "seq")).alias("f"))
    return out.select(key, *[F.col(f"w.{c}").alias(c) for c in rest], F.col("f.__new").alias("from_new"), F.col("f.seq").alias("first_seq"))


def merged_list(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of (date, url) lines; rows with a short date or without a url are skipped."""
    lines = new.filter((F.length("lastmod") >= 10) & (F.col("url") != "")).select(F.left("lastmod", F.lit(10)).alias("date"), "url")
    return old.select("date", "url").union(lines).distinct()


def blocked_lists(old: DataFrame, manifest: DataFrame, statuses: list[str]) -> DataFrame:
    """(status, url): known blocked urls and the manifest's, without empty ones."""
    found = manifest.filter(F.col("status").isin(statuses)).select("status", "url")
    return old.select("status", "url").union(found).filter("url <> ''").distinct()


def in_date_range(shards: DataFrame, first: str | None, last: str | None) -> DataFrame:
    """Lines of a date range, both ends included; the year column prunes partitions."""
    out = shards
    if first:
        out = out.filter((F.col("date") >= first) & (F.col("year") >= int(first[:4])))
    if last:
        out = out.filter((F.col("date") <= last) & (F.col("year") <= int(last[:4])))
    return out


def pages_until(batches: DataFrame, floor: str) -> DataFrame:
    """Feed batches in order up to and including the first whose oldest item is before the floor. Batches are few rows."""
    before = F.max((F.col("oldest") < floor).cast("int")).over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    return batches.withColumn("__done", F.coalesce(before, F.lit(0))).filter("__done = 0").drop("__done")


def numbered_sitemaps(maps: DataFrame, *, newest: int | None = None, exact: int | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """Sub-sitemaps by their trailing number: the newest few, one number, or a range in descending order. A number or a
    range that selects nothing, or a range from high to low, is an error."""
    rows = maps.withColumn("n", F.regexp_extract("url", r"(\d+)\.xml$", 1).cast("int")).filter("n is not null")
    if newest is not None:
        return rows.orderBy(F.desc("n")).limit(newest)
    low, high = between if between else (exact, exact)
    if low > high:
        raise ValueError(f"the range {low} to {high} runs backwards")
    found = rows.filter(F.col("n").between(low, high)).orderBy(F.desc("n"))
    if found.isEmpty():
        raise ValueError(f"no sitemap from {low} to {high}")
    return found


def manifest_states(entries: DataFrame, done: DataFrame, dead: DataFrame) -> DataFrame:
    """Entries as ok (done wins), dead or failed."""
    a, b = done.select("url").distinct().withColumn("__d", F.lit(True)), dead.select("url").distinct().withColumn("__x", F.lit(True))
    state = F.when(F.col("__d"), "ok").when(F.col("__x"), "dead").otherwise("failed")
    return entries.join(a, "url", "left").join(b, "url", "left").withColumn("status", state).drop("__d", "__x")


def ride_manifest(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Entries with the outcome of their jobs (url, seq, status, file, char_count, error): ok with the last ok job's file,
    else failed with the last job's error, "not fetched" without any job."""
    ok = F.max(F.when((F.col("status") == "ok") & F.col("file").isNotNull(), F.struct("seq", "file", "char_count"))).alias("ok")
    last = F.max(F.struct("seq", "error")).alias("last")
    out = entries.select("url").join(jobs.groupBy("url").agg(ok, last), "url", "left")
    error = F.when(F.col("ok").isNull(), F.coalesce("last.error", F.lit("not fetched")))
    return out.select("url", F.when(F.col("ok").isNotNull(), "ok").otherwise("failed").alias("status"), F.col("ok.file").alias("file"), F.col("ok.char_count").alias("char_count"), error.alias("error"))


def recovered(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """Urls of b that a lacks, and whether they are in the gold set."""
    marks = gold.select("url").distinct().withColumn("g", F.lit(True))
    return b.select("url").distinct().join(a.select("url"), "url", "left_anti").join(marks, "url", "left").select("url", F.coalesce("g", F.lit(False)).alias("in_gold"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """New and dropped keys per source between two snapshots (source, key). A source that the old one lacks counts 0."""
    a, b = old.select("source", "key").distinct().withColumn("o", F.lit(1)), new.select("source", "key").distinct().withColumn("n", F.lit(1))
    both = a.join(b, ["source", "key"], "full_outer").groupBy("source").agg(F.count("o").alias("old_n"), F.count("n").alias("new_n"), F.sum((F.col("o").isNull()).cast("long")).alias("added"), F.sum((F.col("n").isNull()).cast("long")).alias("dropped"))
    counted = both.filter("new_n > 0")  # a source that answered nothing is skipped
    zero = F.col("old_n") == 0
    return counted.select("source", F.when(zero, 0).otherwise(F.col("added")).alias("added"), F.when(zero, 0).otherwise(F.col("dropped")).alias("dropped"))


def attribution(sample: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source over a sample (key, alive): keys seen, alive ones, and alive ones that no other source has."""
    listed = sources.select("source", "key").distinct()
    counts = listed.groupBy("key").agg(F.count("*").alias("k"))
    rows = listed.join(sample, "key").join(counts, "key")
    live = F.col("alive").cast("long")
    return rows.groupBy("source").agg(F.count("*").alias("seen"), F.sum(live).alias("alive"), F.sum(live * (F.col("k") == 1).cast("long")).alias("alone"))


def stale(keys: DataFrame, status: DataFrame, now: Column, window_s: int) -> DataFrame:
    """Keys with `check`: not known, or last seen at least `window_s` ago."""
    known = status.groupBy("key").agg(F.max("seen_at").alias("seen_at"))
    due = F.col("seen_at").isNull() | (now.cast("double") - F.col("seen_at").cast("double") >= window_s)
    return keys.select("key").distinct().join(known, "key", "left").select("key", due.alias("check"))


def pool_overlap(sources: DataFrame) -> DataFrame:
    """Raw rows, keys counted per bucket, different keys over all, and how many are counted more than once."""
    per = sources.groupBy("bucket").agg(F.count("*").alias("raw"), F.countDistinct("key").alias("unique"))
    total = per.agg(F.sum("raw").alias("raw"), F.sum("unique").alias("per_bucket"), F.lit(1).alias("__one"))  # one row each
    over = sources.agg(F.countDistinct("key").alias("overall"), F.lit(1).alias("__one"))
    return total.join(over, "__one").select("raw", "per_bucket", "overall", (F.col("per_bucket") - F.col("overall")).alias("overlap"))


def scoreboard(old: DataFrame, runs: DataFrame) -> DataFrame:
    """Per source: added counters, the number of runs, and the last run's unique count."""
    both = old.select("source", "ok", "fail", "runs", "unique_latest", "seq").unionByName(runs.select("source", "ok", "fail", F.lit(1).cast("long").alias("runs"), F.col("unique_n").alias("unique_latest"), "seq"))
    return both.groupBy("source").agg(F.sum("ok").alias("ok"), F.sum("fail").alias("fail"), F.sum("runs").alias("runs"), F.max(F.struct("seq", "unique_latest"))["unique_latest"].alias("unique_latest"))


def sightings(checks: DataFrame) -> DataFrame:
    """Per key over (key, ts, seq, alive): checks, alive and dead ones, first and last, and the last state."""
    return checks.groupBy("key").agg(
        F.count("*").alias("checks"), F.sum(F.col("alive").cast("long")).alias("alive"), F.sum((~F.col("alive")).cast("long")).alias("dead"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.max(F.struct("seq", "alive"))["alive"].alias("last_alive"),
    )


def refill(pool: DataFrame, held: DataFrame, cooling: DataFrame, size: int, bucket: Column | None = None) -> DataFrame:
    """The next keys for a buffer: in pool order, without those held or cooling, as many as are missing to `size`.

    One plan: free keys are numbered in order (`bucket`, a coarse monotonic function of seq, by default seq div 10000) and
    meet the one row that says how many are held."""
    free = first_per_key(pool, ["key"], "seq").join(held.select("key"), "key", "left_anti").join(cooling.select("key"), "key", "left_anti")
    nth, one, n = fresh(free, "nth"), fresh(free, "one"), fresh(free, "n_held")
    numbers = numbered(free, F.expr("seq div 10000") if bucket is None else bucket, ["seq", "key"], nth).withColumn(one, F.lit(1))
    taken = held.agg(F.countDistinct("key").alias(n), F.lit(1).alias(one))  # one row
    return numbers.join(taken, one).filter(F.col(nth) <= F.lit(size) - F.col(n)).select(*free.columns)


def assigned(urls: DataFrame, keys: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Urls dealt to keys in turn, both in the order of their seq; with more keys than urls the rest double up on urls from the first.

    Both sides are numbered inside buckets of seq (a coarse monotonic function, by default seq div 10000), so neither passes
    through one task, and meet on the number modulo the urls."""
    own = F.expr("seq div 10000") if bucket is None else bucket
    u = numbered(urls, own, ["seq"], "i").select("url", (F.col("i") - 1).alias("i"))
    k = numbered(keys, own, ["seq"], "j").select("key", (F.col("j") - 1).alias("j"), F.lit(1).alias("one"))
    n = urls.agg(F.count("*").alias("n"), F.lit(1).alias("one"))  # one row
    return k.join(n, "one").filter("n > 0").withColumn("i", F.col("j") % F.col("n")).join(u, "i").select("key", "url", "j")


def allocation(strata: DataFrame, total: int, floor: int = 5) -> DataFrame:
    """How many of each stratum (stratum, size) a sample of `total` takes: `floor` each, the rest in proportion and cut to
    whole numbers, what is left to the largest, never more than a stratum holds. Strata are few rows."""
    every = Window.partitionBy(F.lit(1))
    left = F.lit(total) - floor * F.count("*").over(every)
    share = F.floor(F.greatest(left, F.lit(0)) * F.col("size") / F.sum("size").over(every))
    rows = strata.withColumn("n", floor + share).withColumn("nth", F.row_number().over(every.orderBy(F.desc("size"), "stratum")))
    rest = F.greatest(F.lit(total) - F.sum("n").over(every), F.lit(0))
    n = F.col("n") + F.when(F.col("nth") == 1, rest).otherwise(0)
    return rows.select("stratum", "size", F.least(n, F.col("size")).alias("take"))


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows by the MD5 of a seed and their key: the same rows whatever the partitions."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.col(key)).limit(n)
