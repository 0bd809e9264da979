"""Analytics of run, attempt and job logs. `seq` is the order of the log's lines and decides every tie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from websheaf.operators.ordered import gaps, last_rows, numbered
from websheaf.operators.quantiles import exclusive, inclusive
from websheaf.operators.shared import fresh

#: Thresholds of the health classes.
MIN_SAMPLES, BROKEN_BELOW, DEGRADED_BELOW, SILENT_ABOVE = 5, 0.5, 0.8, 0.3
#: Health labels from worst to best, as a table lists them.
SEVERITY = [("BROKEN", 0), ("INSUFFICIENT", 1), ("DEGRADED", 2), ("SLOW", 3), ("RATE_LIMITED", 4)]
#: Cooldowns in seconds.
COOLDOWN_S, BACKOFF_CAP_S, BACKOFF_BASE_S = 3600, 3600, 300


def count_if(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def engine_health(runs: DataFrame) -> DataFrame:
    """Per engine over (engine, status, search_ms, result_count): counts by kind of status, rates, truncated mean
    latency of OK runs, mean of their non-zero results (one decimal), the most frequent kind of failure."""
    ok = F.col("status") == "OK"
    kinds = {"empty": F.col("status").startswith("EMPTY"), "timeout": F.col("status").startswith("TIMEOUT"), "error": F.col("status").startswith("ERROR"), "rate_skip": F.col("status") == "RATE_SKIP"}
    subs = ["EMPTY_NO_CONTAINER", "EMPTY_BLOCK", "EMPTY_NO_RESULTS", "TIMEOUT_NONCOOP"]
    out = runs.groupBy("engine").agg(
        F.count("*").alias("total"), count_if(ok).alias("ok"), *[count_if(c).alias(k) for k, c in kinds.items()],
        *[count_if(F.col("status") == s).alias(s.lower()) for s in subs],
        F.coalesce(F.floor(F.avg(F.when(ok, F.col("search_ms")))), F.lit(0)).alias("avg_ms"),
        F.coalesce(F.bround(F.avg(F.when(ok & (F.col("result_count") > 0), F.col("result_count"))), 1), F.lit(0.0)).alias("avg_results"),
    )
    most = F.greatest(*kinds)
    first = F.coalesce(*[F.when(F.col(k) == most, F.lit(k.upper())) for k in kinds])
    rates = out.withColumn("success_rate", F.col("ok") / F.col("total")).withColumn("silent_rate", (F.col("total") - F.col("ok")) / F.col("total"))
    return rates.withColumn("main_failure", F.when(F.col("total") > F.col("ok"), first))


def health_class(h: DataFrame) -> DataFrame:
    """Adds `health`, the first rule that fires, and `severity` for listing."""
    c = F.col
    empty_share = lambda s: c(s) / c("empty")
    many_empty, silent = c("empty") >= MIN_SAMPLES, c("silent_rate") > SILENT_ABOVE
    slow, limited = silent & (c("main_failure") == "TIMEOUT"), silent & (c("main_failure") == "RATE_SKIP")
    degraded = c("success_rate") < DEGRADED_BELOW
    label = (
        F.when(c("total") < MIN_SAMPLES, "INSUFFICIENT")
        .when(many_empty & (empty_share("empty_no_container") > 0.5), "BROKEN (DOM-DRIFT)")
        .when(many_empty & (empty_share("empty_block") > 0.3), "DEGRADED (ANTI-BOT)")
        .when(many_empty & (empty_share("empty_no_results") > 0.7) & ~degraded, "HEALTHY-EMPTY")
        .when((c("timeout") >= 3) & (c("timeout_noncoop") / c("timeout") > 0.1), "FLAG (CANCEL-LEAK)")
        .when(c("success_rate") < BROKEN_BELOW, "BROKEN")
        .when(degraded & slow, "DEGRADED (SLOW)")
        .when(degraded & limited, "DEGRADED (RATE_LIMITED)")
        .when(degraded, "DEGRADED")
        .when(slow, "SLOW")
        .when(limited, "RATE_LIMITED")
        .otherwise("OK")
    )
    out = h.withColumn("health", label)
    rank = F.coalesce(*[F.when(c("health").startswith(k), F.lit(v)) for k, v in SEVERITY], F.when(c("health").startswith("FLAG"), F.lit(9)), F.lit(5))
    return out.withColumn("severity", rank)


def select_log(runs: DataFrame, *, last: int | None = None, since: str | None = None, engine: str | None = None) -> DataFrame:
    """The last lines of the log, of these the ones since a time, of these an engine's: in this order."""
    out = last_rows(runs, F.col("seq"), ["seq"], last) if last else runs
    if since:
        out = out.filter(F.col("ts") >= F.lit(since).cast("timestamp"))
    return out.filter(F.col("engine") == engine) if engine else out


def bottlenecks(runs: DataFrame, by: str) -> DataFrame:
    """Each group's slowest engine; of equals the first in the log."""
    slow = F.min(F.struct((-F.col("search_ms")).alias("neg"), "seq", "engine")).alias("s")
    return runs.groupBy(by).agg(slow).select(by, F.col("s.engine").alias("engine"), (-F.col("s.neg")).alias("search_ms"))


def wall_summary(totals: DataFrame) -> DataFrame:
    """Least, floored mean and most of total_ms."""
    return totals.agg(F.count("*").alias("n"), F.min("total_ms").alias("min_ms"), F.floor(F.avg("total_ms")).alias("mean_ms"), F.max("total_ms").alias("max_ms"))


def top_counts(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def engine_summary(runs: DataFrame, modes: list[str]) -> DataFrame:
    """Per engine: runs, OK runs, urls, shares of EMPTY, BLOCK, TIMEOUT and ERROR in whole percent, the most frequent
    status that isn't OK (of equals the first by name), and OK runs by mode."""
    s = F.col("status")
    groups = {"empty_pct": s.startswith("EMPTY") & (s != "EMPTY_BLOCK"), "block_pct": s == "EMPTY_BLOCK", "timeout_pct": s.startswith("TIMEOUT"), "error_pct": s.startswith("ERROR")}
    out = runs.groupBy("engine").agg(
        F.count("*").alias("n"), count_if(s == "OK").alias("ok"), F.sum("result_count").alias("urls"), F.bround(F.avg("result_count"), 1).alias("mean_urls"),
        *[F.bround(100 * count_if(c) / F.count("*")).alias(k) for k, c in groups.items()],
        *[count_if((s == "OK") & (F.col("mode") == m)).alias(f"ok_{m}") for m in modes],
    )
    counts = runs.filter(s != "OK").groupBy("engine", "status").agg(F.count("*").alias("k"))
    main = counts.groupBy("engine").agg(F.min(F.struct((-F.col("k")).alias("neg"), "status")).alias("m")).select("engine", F.col("m.status").alias("main_failure"))
    return out.join(main, "engine", "left")


def reliability(runs: DataFrame, known: list[str]) -> DataFrame:
    """Per engine: whole percent of runs by status (unknown ones count as ERROR_OTHER), rounded mean and exclusive 95 %
    quantile of OK latencies."""
    status = F.when(F.col("status").isin(known), F.col("status")).otherwise("ERROR_OTHER")
    rows = runs.withColumn("k", status)
    ms = F.when(F.col("status") == "OK", F.col("search_ms"))
    counted = rows.groupBy("engine").agg(F.count("*").alias("n"), *[F.bround(100 * count_if(F.col("k") == k) / F.count("*")).alias(k.lower()) for k in known], F.bround(F.avg(ms)).alias("mean_ms"))
    return counted.join(exclusive(rows, ["engine"], ms, 19, 20, "p95"), "engine", "left").withColumn("p95_ms", F.bround("p95")).drop("p95")


def timing_ablation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per engine over (query_id, engine, search_ms) of two settings: pairs, means and the mean difference b - a."""
    pairs = a.select("query_id", "engine", F.col("search_ms").alias("x")).join(b.select("query_id", "engine", F.col("search_ms").alias("y")), ["query_id", "engine"])
    return pairs.groupBy("engine").agg(F.count("*").alias("pairs"), F.round(F.avg("x"), 4).alias("mean_a"), F.round(F.avg("y"), 4).alias("mean_b"), F.round(F.avg(F.col("y") - F.col("x")), 4).alias("delta"))


def timeout_status(error: Column, ms: Column, timeout_s: float) -> Column:
    """Sub-status of a failed run: a timeout that was cut off in time or not, or the kind of exception."""
    watchdog = F.when(ms < 1.2 * timeout_s * 1000, "TIMEOUT_WATCHDOG").otherwise("TIMEOUT_NONCOOP")
    return (
        F.when(error == "timeout", watchdog).when(error == "http_timeout", "TIMEOUT_HTTPX").when(error == "http", "ERROR_HTTP")
        .when(error == "browser", "ERROR_BROWSER").when(error == "parse", "ERROR_PARSE").otherwise("ERROR_OTHER")
    )


def empty_diagnosis(marker: Column, ready_state: Column) -> Column:
    """Why a page gave nothing: a block marker, a page that isn't complete, or no container."""
    return F.when(marker, "EMPTY_BLOCK").when(F.coalesce(ready_state, F.lit("")) != "complete", "EMPTY_CONCURRENT_RACE").otherwise("EMPTY_NO_CONTAINER")


def rate_waits(runs: DataFrame, limit: int = 10, window_s: int = 60) -> DataFrame:
    """Seconds that a sliding window of `limit` runs per `window_s` would have made each run of an engine wait, and
    whether it would have been skipped (longer than the window)."""
    w = Window.partitionBy("engine").orderBy("ts", "seq")
    oldest = F.lag("ts", limit).over(w)
    wait = F.greatest(F.lit(0.0), window_s - (F.col("ts").cast("double") - oldest.cast("double")))
    out = runs.withColumn("wait_s", F.coalesce(F.round(wait, 3), F.lit(0.0)))
    return out.withColumn("skipped", F.col("wait_s") > window_s)


def attempt_windows(log: DataFrame, width_s: int = 3600) -> DataFrame:
    """Windows anchored at the log's first event, empty ones included: proxies tried, proxies with a success, urls,
    attempts, and the size of the last refresh (in log order) of this or an earlier window.

    `log` holds (seq, ts, proxy_key, url, ok, size); rows with a size are refreshes, the others attempts. Rows are
    counted per window; only windows, a row each, are ordered.
    """
    anchor = log.agg(F.min("ts").alias("t0")).first()["t0"]
    k = F.floor((F.col("ts").cast("double") - F.lit(anchor).cast("timestamp").cast("double")) / width_s)
    rows = log.withColumn("win", k)
    tried = rows.filter("size is null").groupBy("win").agg(
        F.countDistinct("proxy_key").alias("tried"), F.countDistinct(F.when(F.col("ok"), F.col("proxy_key"))).alias("succeeded"),
        F.countDistinct("url").alias("urls"), F.count("*").alias("attempts"),
    )
    refreshed = rows.filter("size is not null").groupBy("win").agg(F.max(F.struct("seq", "size")).alias("r"))
    frame = tried.agg(F.max("win").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("win"))
    sofar = Window.orderBy("win").rowsBetween(Window.unboundedPreceding, 0)  # over windows
    # A refresh before its window's first attempt, or past the last window, still orders among windows.
    filled = frame.join(tried, "win", "full_outer").join(refreshed, "win", "full_outer").withColumn("pool_size", F.max("r").over(sofar)["size"])
    return filled.join(frame, "win", "left_semi").select("win", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tried", "succeeded", "urls", "attempts")], "pool_size")


def sample_windows(samples: DataFrame, width_s: int = 600) -> DataFrame:
    """(window_min, least, rounded mean, most) of (elapsed_s, n); windows without samples are left out."""
    rows = samples.withColumn("win", F.floor(F.col("elapsed_s") / width_s))
    out = rows.groupBy("win").agg(F.min("n").alias("least"), F.bround(F.avg("n")).alias("mean"), F.max("n").alias("most"))
    return out.select((F.col("win") * (width_s // 60)).alias("window_min"), "least", "mean", "most")


def hit_gaps(log: DataFrame) -> DataFrame:
    """Mean and median seconds between successive successes."""
    hits = gaps(log.filter("ok"), F.to_date("ts"), "ts", ["ts", "seq"])
    return hits.agg(F.count("gap_s").alias("n"), F.round(F.avg("gap_s"), 6).alias("mean_s"), F.round(F.median("gap_s"), 6).alias("median_s"))


def cumulative_hits(log: DataFrame) -> DataFrame:
    """(seq, ts, hits): the number of successes up to each success."""
    return numbered(log.filter("ok"), F.to_date("ts"), ["ts", "seq"], "hits").select("seq", "ts", "hits")


def refresh_batches(log: DataFrame) -> DataFrame:
    """Other rows under the latest refresh before them in the log, as its number; rows before the first are dropped."""
    is_refresh = F.col("size").isNotNull().cast("long")
    rows = numbered(log, F.floor(F.col("seq") / 10_000), ["seq"], "batch", is_refresh)
    return rows.filter("size is null and batch > 0")


def rolling_mean(bins: DataFrame, width: int) -> DataFrame:
    """Mean of each bin's n and its neighbours up to width // 2 away; edges take what there is. Bins are few rows."""
    half = width // 2
    return bins.withColumn("rolling", F.round(F.avg("n").over(Window.orderBy("bin").rowsBetween(-half, half)), 6))


def rate_bins(log: DataFrame, width_s: int) -> DataFrame:
    """(bin, n): rows per fixed bin from the first to the last event, empty bins included."""
    t0 = log.agg(F.min("ts").alias("t0")).first()["t0"]
    at = F.floor((F.col("ts").cast("double") - F.lit(t0).cast("timestamp").cast("double")) / width_s)
    counts = log.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    frame = counts.agg(F.max("bin").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"))).alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def rate_stats(log: DataFrame, width_s: int) -> DataFrame:
    """Bins, empty bins, mean and median of the non-empty ones, and the longest gap between events and when it began."""
    bins = rate_bins(log, width_s).agg(
        F.count("*").alias("bins"), count_if(F.col("n") == 0).alias("empty_bins"),
        F.round(F.avg(F.when(F.col("n") > 0, F.col("n"))), 6).alias("mean_n"), F.median(F.when(F.col("n") > 0, F.col("n"))).cast("double").alias("median_n"),
    )
    spaced = gaps(log, F.to_date("ts"), "ts", ["ts", "seq"]).filter("gap_s is not null")
    longest = spaced.agg(F.min(F.struct((-F.col("gap_s")).alias("neg"), "seq")).alias("g"))
    one = F.lit(1).alias("__one")  # both sides are one row
    return bins.select("*", one).join(longest.select(one, F.round(-F.col("g.neg"), 6).alias("longest_gap_s"), F.col("g.seq").alias("gap_ends_at_seq")), "__one").drop("__one")


def job_stats(jobs: DataFrame, by: list[str]) -> DataFrame:
    """Per group: counts by status, mean and median seconds, inclusive quantiles of the OK rows' characters."""
    chars = F.when(F.col("status") == "ok", F.col("char_count"))
    return jobs.groupBy(*by).agg(
        F.count("*").alias("n"), *[count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "regwall", "failed")],
        F.round(F.avg("elapsed_s"), 6).alias("mean_s"), F.round(F.median("elapsed_s"), 6).alias("median_s"),
        *[F.round(inclusive(chars, p / 100), 4).alias(f"p{p}") for p in (10, 25, 50, 75, 90, 95)],
    )


def time_quantiles(jobs: DataFrame, column: str, by: list[str]) -> DataFrame:
    """p50, p90, p95, p99, most and count of a group's seconds, to three decimals; groups under two rows give nulls."""
    enough = F.count(column) >= 2
    quantiles = [F.when(enough, F.bround(inclusive(F.col(column), p / 100), 3)).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return jobs.groupBy(*by).agg(*quantiles, F.when(enough, F.bround(F.max(column), 3)).alias("most"), F.count(column).alias("n"))


def guard(jobs: DataFrame, by: list[str], share: float = 0.2) -> DataFrame:
    """Per group the share of regwalled rows, and whether it stops the job."""
    out = jobs.groupBy(*by).agg(F.count("*").alias("n"), count_if(F.col("status") == "regwall").alias("regwalled"))
    return out.withColumn("stops", F.col("regwalled") / F.col("n") >= share)


def until_stop(jobs: DataFrame, size: int = 200, share: float = 0.2, *, bucket: Column | None = None) -> DataFrame:
    """Chunks of `size` rows in log order, up to and including the first that stops the job, with running totals.

    `bucket` is a coarse, monotonic function of `seq` with some thousand rows a value, by default seq div 10000 (line numbers)."""
    rows = numbered(jobs, F.expr("seq div 10000") if bucket is None else bucket, ["seq"]).withColumn("chunk", F.floor((F.col("nth") - 1) / size))
    chunks = guard(rows, ["chunk"], share)
    first = chunks.agg(F.min(F.when(F.col("stops"), F.col("chunk"))).alias("first"), F.lit(1).alias("__one"))  # one row
    kept = chunks.withColumn("__one", F.lit(1)).join(first, "__one").filter("first is null or chunk <= first")
    return numbered(kept.drop("first", "__one"), F.expr("chunk div 10000"), ["chunk"], "total", F.col("n")).select("chunk", "n", "regwalled", "stops", "total")


def retry_outcomes(jobs: DataFrame) -> DataFrame:
    """Among urls that met a regwall: how many ended ok and how many not, by the last row; and the regwalled share."""
    last = F.max(F.struct("seq", "status"))["status"].alias("last")
    urls = jobs.groupBy("url").agg(last, F.max((F.col("status") == "regwall").cast("int")).alias("met"), F.count("*").alias("n"), count_if(F.col("status") == "regwall").alias("walls"))
    met = F.col("met") == 1
    return urls.agg(count_if(met & (F.col("last") == "ok")).alias("ended_ok"), count_if(met & (F.col("last") != "ok")).alias("ended_failed"), F.round(F.sum("walls") / F.sum("n"), 6).alias("wasted"))


def cooling(burns: DataFrame, now: Column, cooldown_s: int = COOLDOWN_S) -> DataFrame:
    """Per proxy over (proxy_key, ts): the last burn, and whether the proxy may be used at `now`."""
    last = burns.groupBy("proxy_key").agg(F.max("ts").alias("burned_at"))
    return last.withColumn("eligible", now.cast("double") - F.col("burned_at").cast("double") >= cooldown_s)


def backoff_bounds(burns: DataFrame) -> DataFrame:
    """Upper bound of each burn's exponential cooldown: doubles from burn to burn, and starts anew where the ride that
    ended in the burn had a success (`ride_ok` >= 1). The actual wait is drawn below the bound."""
    w = Window.partitionBy("proxy_key").orderBy("seq")
    since = fresh(burns, "since")
    rows = burns.withColumn(since, F.sum((F.col("ride_ok") >= 1).cast("int")).over(w))
    nth = F.row_number().over(Window.partitionBy("proxy_key", since).orderBy("seq")) - 1
    return rows.withColumn("failures", nth).withColumn("bound_s", F.least(F.lit(float(BACKOFF_CAP_S)), BACKOFF_BASE_S * F.pow(F.lit(2.0), F.least("failures", F.lit(30))))).drop(since)


def burns(log: DataFrame, after: int = 2) -> DataFrame:
    """Attempts that burn their proxy: every `after`th failure in a row, counted in log order; a success starts anew."""
    w = Window.partitionBy("proxy_key").orderBy("seq")
    runs = log.withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    nth = F.row_number().over(Window.partitionBy("proxy_key", "run", "ok").orderBy("seq"))
    return runs.withColumn("nth", nth).filter(~F.col("ok") & (F.col("nth") % after == 0)).drop("run", "nth")


def stalls(log: DataFrame, limit_s: float) -> DataFrame:
    """Successes that came only after a pause of at least `limit_s`: where a job would have stopped."""
    return gaps(log.filter("ok"), F.to_date("ts"), "ts", ["ts", "seq"]).filter(F.col("gap_s") >= limit_s)


def pacing(log: DataFrame, by: str) -> DataFrame:
    """Seconds between successive requests of a group: least, mean, count under half a second."""
    w = Window.partitionBy(by).orderBy("ts", "seq")
    rows = log.withColumn("gap", F.col("ts").cast("double") - F.lag("ts").over(w).cast("double")).filter("gap is not null")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.min("gap"), 6).alias("least_s"), F.round(F.avg("gap"), 6).alias("mean_s"), count_if(F.col("gap") < 0.5).alias("too_soon"))


def retained(log: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Lines whose time is known and not older than `days`."""
    return log.filter(F.col("ts").isNotNull() & (F.col("ts") >= now - F.make_interval(days=F.lit(days))))
