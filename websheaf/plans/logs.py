"""Log queries over the projected engine runs, fetch attempts and scrape records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websheaf.operators import logs, rides
from websheaf.operators.ordered import as_of, numbered
from websheaf.operators.quantiles import exclusive, nearest_rank
from websheaf.plans.fixtures import DERIVED, attempts, load, manifest, runs, sql

MODES = ["general", "pdf"]
KNOWN = ["OK", "EMPTY_NO_RESULTS", "TIMEOUT_WATCHDOG", "ERROR_OTHER", "RATE_SKIP"]
_NOW = "2024-02-01 00:00:00"

DERIVED |= {
    "counted": """SELECT engine, count(*) AS total, count(*) FILTER (status = 'OK') AS ok, count(*) FILTER (status LIKE 'EMPTY%') AS empty, count(*) FILTER (status LIKE 'TIMEOUT%') AS timeout,
    count(*) FILTER (status LIKE 'ERROR%') AS error, count(*) FILTER (status = 'RATE_SKIP') AS rate_skip, count(*) FILTER (status = 'EMPTY_NO_CONTAINER') AS empty_no_container,
    count(*) FILTER (status = 'EMPTY_BLOCK') AS empty_block, count(*) FILTER (status = 'EMPTY_NO_RESULTS') AS empty_no_results, count(*) FILTER (status = 'TIMEOUT_NONCOOP') AS timeout_noncoop,
    coalesce(floor(avg(search_ms) FILTER (status = 'OK')), 0)::BIGINT AS avg_ms, coalesce(round_even(avg(result_count) FILTER (status = 'OK' AND result_count > 0), 1), 0)::DOUBLE AS avg_results FROM runs GROUP BY engine""",
    "health": """SELECT *, ok / total AS success_rate, (total - ok) / total AS silent_rate, CASE WHEN total > ok THEN CASE greatest(empty, timeout, error, rate_skip) WHEN empty THEN 'EMPTY' WHEN timeout THEN 'TIMEOUT'
    WHEN error THEN 'ERROR' ELSE 'RATE_SKIP' END END AS main_failure FROM counted""",
    "tries": "SELECT * FROM attempts WHERE size IS NULL",
    "t0": "SELECT min(epoch(ts)) AS t0 FROM attempts",
    "hits": "SELECT seq, epoch(ts) AS t, row_number() OVER (ORDER BY ts, seq) AS nth, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts, seq) AS gap FROM attempts WHERE ok",
    "bins": "SELECT b AS bin, count(a.seq) AS n FROM (SELECT unnest(range(0, (SELECT max(floor((epoch(ts) - t0) / 7200)) FROM attempts CROSS JOIN t0)::BIGINT + 1)) AS b) f LEFT JOIN (SELECT seq, floor((epoch(ts) - t0) / 7200)::BIGINT AS b FROM attempts CROSS JOIN t0) a USING (b) GROUP BY b",
    "all_gaps": "SELECT seq, epoch(ts) - lag(epoch(ts)) OVER (ORDER BY ts, seq) AS gap FROM attempts",
}


def _health(s: SparkSession, d: str) -> DataFrame:
    return logs.engine_health(runs(s, d))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _with_mode(s: SparkSession, d: str) -> DataFrame:
    return runs(s, d).withColumn("mode", F.when(F.col("seq") % 2 == 0, "general").otherwise("pdf"))


def _burns(s: SparkSession, d: str) -> DataFrame:
    return logs.burns(attempts(s, d).filter("size is null"))


def _statuses(s: SparkSession, d: str) -> DataFrame:
    """Attempts by proxy with what came of them."""
    kinds = {"view": "ok", "click": "regwall", "purchase": "connect_fail", "error": "empty"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()])
    return load(s, d, "events").filter("event_type <> 'signup'").select(F.col("user_id").cast("long").alias("proxy_key"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


def _last_refresh(s: SparkSession, d: str) -> DataFrame:
    """Each attempt with the last pool refresh of its tenth of the proxies."""
    log = attempts(s, d).withColumn("pool", F.col("proxy_key") % 10)
    refreshed = log.filter("size is not null").select("pool", "ts", "size", F.col("seq").alias("refresh_seq"))
    return as_of(log.filter("size is null").select("seq", "pool", "ts"), refreshed, ["pool"], "ts", F.to_date, ["size", "refresh_seq"], "refresh_seq").select("seq", "pool", "size", "refresh_seq")


def _tens(s: SparkSession, d: str, low: int) -> DataFrame:
    r = runs(s, d).withColumn("query_id", F.floor(F.col("seq") / 14))
    return r.filter(F.col("seq") % 2 == low).groupBy("query_id", "engine").agg(F.max("search_ms").alias("search_ms"))


def _now() -> F.Column:
    return F.lit(_NOW).cast("timestamp")


def p40(s: SparkSession, d: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ["timeout", "http_timeout", "http", "browser", "parse", "other"])), (F.col("seq") % 6 + 1).cast("int"))
    return runs(s, d).select("seq", logs.timeout_status(kinds, F.col("search_ms"), 3.0).alias("status"))


def p41(s: SparkSession, d: str) -> DataFrame:
    ready = F.when(F.col("seq") % 3 == 0, "loading").when(F.col("seq") % 3 == 1, "complete")
    return runs(s, d).select("seq", logs.empty_diagnosis(F.col("seq") % 5 == 0, ready).alias("diagnosis"))


def w03b(s: SparkSession, d: str) -> DataFrame:
    n = numbered(attempts(s, d), F.floor(F.col("seq") / 1000), ["seq"])
    return n.filter(F.col("nth") % 97 == 1).select("seq", "nth")


def _page_metrics(s: SparkSession, d: str) -> DataFrame:
    m = manifest(s, d)
    rest = m.groupBy("status").agg(F.max("char_count").alias("most"), F.floor(F.stddev_samp("elapsed_s") * 1000).alias("std_ms"), F.count("*").alias("n"))
    return nearest_rank(m, ["status"], F.col("char_count"), [50, 95, 99]).join(rest, "status")


QUERIES = {
    "x10_rides": lambda s, d: rides.rides(_statuses(s, d), chunk=F.expr("seq div 500")),
    "x10_rides_of_three": lambda s, d: rides.rides(_statuses(s, d), burn_after=3, fail_after=1),
    "j12_last_refresh": _last_refresh,
    "a08_bottleneck": lambda s, d: logs.bottlenecks(runs(s, d).withColumn("query_id", F.floor(F.col("seq") / 14)), "query_id"),
    "a09_engine_health": lambda s, d: _rounded(_health(s, d), "success_rate", "silent_rate"),
    "a10_health_class": lambda s, d: logs.health_class(_health(s, d)).select("engine", "health", "severity"),
    "a11_log_selection": lambda s, d: logs.select_log(runs(s, d), last=4000, since="2024-01-10 00:00:00", engine="bing").select("seq", "status", "search_ms"),
    "a12_wall_summary": lambda s, d: logs.wall_summary(runs(s, d).groupBy(F.floor(F.col("seq") / 14).alias("q")).agg(F.sum("search_ms").alias("total_ms"))),
    "a12_top_skips": lambda s, d: logs.top_counts(runs(s, d).filter("status = 'RATE_SKIP'"), "engine"),
    "a25_job_stats": lambda s, d: logs.job_stats(manifest(s, d), ["run_id"]),
    "a26_regwall_guard": lambda s, d: _rounded(logs.guard(manifest(s, d), ["run_id"], 0.25).withColumn("share", F.col("regwalled") / F.col("n")), "share"),
    "a27_until_stop": lambda s, d: logs.until_stop(manifest(s, d), 200, 0.35, bucket=F.expr("seq div 10000000000000")),
    "a28_retry_outcomes": lambda s, d: logs.retry_outcomes(manifest(s, d)),
    "a29_time_quantiles": lambda s, d: logs.time_quantiles(manifest(s, d), "elapsed_s", ["run_id"]),
    "a34_page_metrics": _page_metrics,
    "a38_write_rate": lambda s, d: logs.rate_stats(attempts(s, d), 7200),
    "p40_timeout_status": p40,
    "p41_empty_diagnosis": p41,
    "p42_rate_waits": lambda s, d: logs.rate_waits(runs(s, d), 10, 3600).groupBy("engine").agg(F.count("*").alias("n"), logs.count_if(F.col("wait_s") > 0).alias("waited"), F.round(F.max("wait_s"), 2).alias("longest")),
    "v01_engine_summary": lambda s, d: logs.engine_summary(_with_mode(s, d), MODES),
    "v10_reliability": lambda s, d: logs.reliability(runs(s, d), KNOWN),
    "v10_exclusive_p90": lambda s, d: exclusive(manifest(s, d), ["run_id"], F.col("char_count"), 9, 10, "p90").withColumn("p90", F.round("p90", 4)),
    "v11_timing_ablation": lambda s, d: logs.timing_ablation(_tens(s, d, 0), _tens(s, d, 1)),
    "w01_attempt_windows": lambda s, d: logs.attempt_windows(attempts(s, d)),
    "w02_sample_windows": lambda s, d: logs.sample_windows(runs(s, d).select((F.col("seq") * 7.5).alias("elapsed_s"), F.col("result_count").alias("n"))),
    "w03_hit_gaps": lambda s, d: logs.hit_gaps(attempts(s, d)),
    "w04_cumulative_hits": lambda s, d: logs.cumulative_hits(attempts(s, d)).select("seq", "hits"),
    "w05_rolling_mean": lambda s, d: logs.rolling_mean(logs.rate_bins(attempts(s, d), 7200), 5),
    "w06_refresh_batches": lambda s, d: logs.refresh_batches(attempts(s, d)).groupBy("batch").agg(F.count("*").alias("n")),
    "w10_systematic_sample": w03b,
    "w13_health_order": lambda s, d: logs.health_class(_health(s, d)).orderBy("severity", "engine").select("engine", "severity"),
    "x01_retention": lambda s, d: logs.retained(runs(s, d), _now()).select("seq"),
    "x03_cooldown": lambda s, d: logs.cooling(_burns(s, d), F.lit("2024-01-30 12:00:00").cast("timestamp"), 86400).select("proxy_key", "eligible"),
    "x04_backoff": lambda s, d: logs.backoff_bounds(_burns(s, d).withColumn("ride_ok", (F.col("seq") % 4 == 0).cast("int"))).select("seq", "proxy_key", "failures", "bound_s"),
    "x05_burns": lambda s, d: _burns(s, d).select("seq", "proxy_key"),
    "x08_stalls": lambda s, d: logs.stalls(attempts(s, d), 3600.0).select("seq", F.round("gap_s", 3).alias("gap_s")),
    "x09_pacing": lambda s, d: logs.pacing(attempts(s, d), "url"),
}

_CASES = """CASE WHEN total < 5 THEN 'INSUFFICIENT' WHEN empty >= 5 AND empty_no_container / empty > 0.5 THEN 'BROKEN (DOM-DRIFT)' WHEN empty >= 5 AND empty_block / empty > 0.3 THEN 'DEGRADED (ANTI-BOT)'
 WHEN empty >= 5 AND empty_no_results / empty > 0.7 AND success_rate >= 0.8 THEN 'HEALTHY-EMPTY' WHEN timeout >= 3 AND timeout_noncoop / timeout > 0.1 THEN 'FLAG (CANCEL-LEAK)' WHEN success_rate < 0.5 THEN 'BROKEN'
 WHEN success_rate < 0.8 AND silent_rate > 0.3 AND main_failure = 'TIMEOUT' THEN 'DEGRADED (SLOW)' WHEN success_rate < 0.8 AND silent_rate > 0.3 AND main_failure = 'RATE_SKIP' THEN 'DEGRADED (RATE_LIMITED)'
 WHEN success_rate < 0.8 THEN 'DEGRADED' WHEN silent_rate > 0.3 AND main_failure = 'TIMEOUT' THEN 'SLOW' WHEN silent_rate > 0.3 AND main_failure = 'RATE_SKIP' THEN 'RATE_LIMITED' ELSE 'OK' END"""
_SEVERITY = "CASE WHEN health LIKE 'BROKEN%' THEN 0 WHEN health LIKE 'INSUFF%' THEN 1 WHEN health LIKE 'DEGRADED%' THEN 2 WHEN health LIKE 'SLOW%' THEN 3 WHEN health LIKE 'RATE%' THEN 4 WHEN health LIKE 'FLAG%' THEN 9 ELSE 5 END"
_BURNS = """SELECT seq, ts, proxy_key FROM (SELECT *, row_number() OVER (PARTITION BY proxy_key, run, ok ORDER BY seq) AS nth FROM (SELECT *, sum(ok::INTEGER) OVER (PARTITION BY proxy_key ORDER BY seq) AS run FROM tries)) WHERE NOT ok AND nth % 2 = 0"""


def _pct(condition: str) -> str:
    return f"round_even(100 * count(*) FILTER ({condition}) / count(*), 0)::DOUBLE"


def _nearest(p: int) -> str:
    return f"list_sort(list(char_count))[least(floor(count(*) * {p} / 100)::BIGINT, count(*) - 1) + 1] AS p{p}"


_EXCLUSIVE = "CASE WHEN m = 1 THEN v[1] WHEN m > 1 THEN (v[j] * ({n} - ({k} * (m + 1) - j * {n})) + v[j + 1] * ({k} * (m + 1) - j * {n})) / {n} END"


def _exclusive_sql(value: str, table: str, by: str, k: int, n: int, where: str = "true") -> str:
    return f"""SELECT {by}, {_EXCLUSIVE.format(k=k, n=n)} AS q FROM (SELECT *, least(greatest(floor({k} * (m + 1) / {n}), 1), m - 1)::BIGINT AS j FROM (SELECT {by}, list_sort(list({value}::DOUBLE)) AS v, count(*) AS m FROM {table} WHERE {where} GROUP BY {by}))"""


def _rides_sql(burn_after: int, fail_after: int) -> str:
    """Attempt by attempt, all proxies in step."""
    return f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT user_id::BIGINT AS proxy_key, event_id::BIGINT AS seq, CASE event_type WHEN 'view' THEN 'ok' WHEN 'click' THEN 'regwall' WHEN 'purchase' THEN 'connect_fail' ELSE 'failed' END AS status,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type <> 'signup'
), w AS (
  SELECT *, 1::BIGINT AS ride, (status = 'regwall')::INTEGER AS walls, (status = 'failed')::INTEGER AS fails FROM e WHERE n = 1
  UNION ALL SELECT e.*, ride + o, CASE WHEN o = 1 THEN 0 ELSE walls END + (e.status = 'regwall')::INTEGER, CASE WHEN o = 1 THEN 0 ELSE fails END + (e.status = 'failed')::INTEGER
  FROM (SELECT *, (status = 'connect_fail' OR walls >= {burn_after} OR fails >= {fail_after})::INTEGER AS o FROM w) w JOIN e ON e.proxy_key = w.proxy_key AND e.n = w.n + 1
)
SELECT proxy_key, ride, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, count(*) FILTER (status = 'ok') AS ride_ok, count(*) FILTER (status = 'regwall') AS n_regwall, count(*) FILTER (status = 'connect_fail') AS n_connect_fail,
  count(*) FILTER (status = 'failed') AS n_failed, CASE WHEN count(*) FILTER (status = 'connect_fail') > 0 THEN 'connect' WHEN max(walls) >= {burn_after} THEN 'burned' WHEN max(fails) >= {fail_after} THEN 'failures' ELSE 'open' END AS cause
FROM w GROUP BY proxy_key, ride"""


SQL = {
    "x10_rides": _rides_sql(2, 2),
    "x10_rides_of_three": _rides_sql(3, 1),
    "j12_last_refresh": sql("SELECT a.seq, a.pool, r.size, r.seq AS refresh_seq FROM (SELECT *, proxy_key % 10 AS pool FROM attempts WHERE size IS NULL) a ASOF LEFT JOIN (SELECT *, proxy_key % 10 AS pool FROM attempts WHERE size IS NOT NULL) r ON a.pool = r.pool AND a.ts >= r.ts"),
    "a08_bottleneck": sql("SELECT (seq // 14)::BIGINT AS query_id, engine, search_ms FROM runs QUALIFY row_number() OVER (PARTITION BY seq // 14 ORDER BY search_ms DESC, seq) = 1"),
    "a09_engine_health": sql("SELECT * REPLACE (round(success_rate, 6) AS success_rate, round(silent_rate, 6) AS silent_rate) FROM health"),
    "a10_health_class": sql(f"SELECT engine, health, {_SEVERITY} AS severity FROM (SELECT engine, {_CASES} AS health FROM health) h"),
    "a11_log_selection": sql("SELECT seq, status, search_ms FROM (SELECT * FROM runs ORDER BY seq DESC LIMIT 4000) l WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND engine = 'bing'"),
    "a12_wall_summary": sql("SELECT count(*) AS n, min(t)::BIGINT AS min_ms, floor(avg(t))::BIGINT AS mean_ms, max(t)::BIGINT AS max_ms FROM (SELECT sum(search_ms) AS t FROM runs GROUP BY seq // 14) x"),
    "a12_top_skips": sql("SELECT engine, count(*) AS n FROM runs WHERE status = 'RATE_SKIP' GROUP BY engine ORDER BY n DESC, engine LIMIT 5"),
    "a25_job_stats": sql("SELECT run_id, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'regwall') AS n_regwall, count(*) FILTER (status = 'failed') AS n_failed, round(avg(elapsed_s), 6) AS mean_s, round(median(elapsed_s), 6) AS median_s, "
        + ", ".join(f"round(quantile_cont(char_count, {p / 100}) FILTER (status = 'ok'), 4)::DOUBLE AS p{p}" for p in (10, 25, 50, 75, 90, 95)) + " FROM manifest GROUP BY run_id"),
    "a26_regwall_guard": sql("SELECT run_id, n, regwalled, regwalled / n >= 0.25 AS stops, round(regwalled / n, 6) AS share FROM (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'regwall') AS regwalled FROM manifest GROUP BY run_id) g"),
    "a27_until_stop": sql("SELECT chunk, n, regwalled, stops, (sum(n) OVER (ORDER BY chunk))::BIGINT AS total FROM chunks WHERE (SELECT min(chunk) FROM chunks WHERE stops) IS NULL OR chunk <= (SELECT min(chunk) FROM chunks WHERE stops)",
        chunks="SELECT chunk, count(*) AS n, count(*) FILTER (status = 'regwall') AS regwalled, count(*) FILTER (status = 'regwall') / count(*) >= 0.35 AS stops FROM (SELECT status, (row_number() OVER (ORDER BY seq) - 1) // 200 AS chunk FROM manifest) c GROUP BY chunk"),
    "a28_retry_outcomes": sql("SELECT count(*) FILTER (met AND last = 'ok') AS ended_ok, count(*) FILTER (met AND last <> 'ok') AS ended_failed, round(sum(walls) / sum(n), 6) AS wasted FROM (SELECT url, arg_max(status, seq) AS last, bool_or(status = 'regwall') AS met, count(*) AS n, count(*) FILTER (status = 'regwall') AS walls FROM manifest GROUP BY url) u"),
    "a29_time_quantiles": sql("SELECT run_id, " + ", ".join(f"CASE WHEN count(*) >= 2 THEN round_even(quantile_cont(elapsed_s, {p / 100}), 3) END AS p{p}" for p in (50, 90, 95, 99)) + ", CASE WHEN count(*) >= 2 THEN round_even(max(elapsed_s), 3) END AS most, count(*) AS n FROM manifest GROUP BY run_id"),
    "a34_page_metrics": sql(f"SELECT status, {_nearest(50)}, {_nearest(95)}, {_nearest(99)}, max(char_count) AS most, floor(stddev_samp(elapsed_s) * 1000)::BIGINT AS std_ms, count(*) AS n FROM manifest GROUP BY status"),
    "a38_write_rate": sql("""SELECT b.*, round(g.gap, 6) AS longest_gap_s, g.seq AS gap_ends_at_seq FROM (SELECT count(*) AS bins, count(*) FILTER (n = 0) AS empty_bins, round(avg(n) FILTER (n > 0), 6) AS mean_n, median(n) FILTER (n > 0)::DOUBLE AS median_n FROM bins) b,
  (SELECT * FROM all_gaps WHERE gap IS NOT NULL ORDER BY gap DESC, seq LIMIT 1) g"""),
    "p40_timeout_status": sql("SELECT seq, CASE seq % 6 WHEN 0 THEN CASE WHEN search_ms < 3600 THEN 'TIMEOUT_WATCHDOG' ELSE 'TIMEOUT_NONCOOP' END WHEN 1 THEN 'TIMEOUT_HTTPX' WHEN 2 THEN 'ERROR_HTTP' WHEN 3 THEN 'ERROR_BROWSER' WHEN 4 THEN 'ERROR_PARSE' ELSE 'ERROR_OTHER' END AS status FROM runs"),
    "p41_empty_diagnosis": sql("SELECT seq, CASE WHEN seq % 5 = 0 THEN 'EMPTY_BLOCK' WHEN seq % 3 = 1 THEN 'EMPTY_NO_CONTAINER' ELSE 'EMPTY_CONCURRENT_RACE' END AS diagnosis FROM runs"),
    "p42_rate_waits": sql("SELECT engine, count(*) AS n, count(*) FILTER (w > 0) AS waited, round(max(w), 2) AS longest FROM (SELECT engine, coalesce(round(greatest(0, 3600 - (epoch(ts) - lag(epoch(ts), 10) OVER (PARTITION BY engine ORDER BY ts, seq))), 3), 0) AS w FROM runs) x GROUP BY engine"),
    "v01_engine_summary": sql(f"""SELECT r.*, f.main_failure FROM (SELECT engine, count(*) AS n, count(*) FILTER (status = 'OK') AS ok, sum(result_count)::BIGINT AS urls, round_even(avg(result_count), 1) AS mean_urls, {_pct("status LIKE 'EMPTY%' AND status <> 'EMPTY_BLOCK'")} AS empty_pct,
  {_pct("status = 'EMPTY_BLOCK'")} AS block_pct, {_pct("status LIKE 'TIMEOUT%'")} AS timeout_pct, {_pct("status LIKE 'ERROR%'")} AS error_pct, count(*) FILTER (status = 'OK' AND seq % 2 = 0) AS ok_general, count(*) FILTER (status = 'OK' AND seq % 2 = 1) AS ok_pdf FROM runs GROUP BY engine) r
  LEFT JOIN (SELECT engine, status AS main_failure FROM (SELECT engine, status, count(*) AS k FROM runs WHERE status <> 'OK' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY engine ORDER BY k DESC, status) = 1) f USING (engine)"""),
    "v10_reliability": sql(f"""SELECT engine, n, "ok", empty_no_results, timeout_watchdog, error_other, rate_skip, mean_ms, round_even(q, 0)::DOUBLE AS p95_ms FROM (SELECT engine, count(*) AS n, {_pct("status = 'OK'")} AS "ok", {_pct("status = 'EMPTY_NO_RESULTS'")} AS empty_no_results,
  {_pct("status = 'TIMEOUT_WATCHDOG'")} AS timeout_watchdog, {_pct("status NOT IN ('OK', 'EMPTY_NO_RESULTS', 'TIMEOUT_WATCHDOG', 'RATE_SKIP')")} AS error_other, {_pct("status = 'RATE_SKIP'")} AS rate_skip, round_even(avg(search_ms) FILTER (status = 'OK'), 0)::DOUBLE AS mean_ms FROM runs GROUP BY engine) a
  LEFT JOIN ({_exclusive_sql("search_ms", "runs", "engine", 19, 20, "status = 'OK'")}) b USING (engine)"""),
    "v10_exclusive_p90": sql(f"SELECT run_id, round(q, 4) AS p90 FROM ({_exclusive_sql('char_count', 'manifest', 'run_id', 9, 10)}) e"),
    "v11_timing_ablation": sql("""SELECT engine, count(*) AS pairs, round(avg(x), 4) AS mean_a, round(avg(y), 4) AS mean_b, round(avg(y - x), 4) AS delta FROM (SELECT seq // 14 AS q, engine, max(search_ms) AS x FROM runs WHERE seq % 2 = 0 GROUP BY ALL) a
  JOIN (SELECT seq // 14 AS q, engine, max(search_ms) AS y FROM runs WHERE seq % 2 = 1 GROUP BY ALL) b USING (q, engine) GROUP BY engine"""),
    "w01_attempt_windows": sql("""SELECT w AS win, coalesce(tried, 0) AS tried, coalesce(succeeded, 0) AS succeeded, coalesce(urls, 0) AS urls, coalesce(attempts, 0) AS attempts, (SELECT arg_max(size, seq) FROM ref r WHERE r.k <= w) AS pool_size
  FROM (SELECT unnest(range(0, (SELECT max(k) FROM wins) + 1)) AS w) f LEFT JOIN wins ON wins.k = w""",
        wins="SELECT k, count(DISTINCT proxy_key) AS tried, count(DISTINCT proxy_key) FILTER (ok) AS succeeded, count(DISTINCT url) AS urls, count(*) AS attempts FROM (SELECT *, floor((epoch(ts) - t0) / 3600)::BIGINT AS k FROM tries CROSS JOIN t0) x GROUP BY k",
        ref="SELECT seq, size, floor((epoch(ts) - t0) / 3600)::BIGINT AS k FROM attempts CROSS JOIN t0 WHERE size IS NOT NULL"),
    "w02_sample_windows": sql("SELECT (floor(seq * 7.5 / 600) * 10)::BIGINT AS window_min, min(result_count) AS least, round_even(avg(result_count), 0)::DOUBLE AS mean, max(result_count) AS most FROM runs GROUP BY 1"),
    "w03_hit_gaps": sql("SELECT count(gap) AS n, round(avg(gap), 6) AS mean_s, round(median(gap), 6) AS median_s FROM hits"),
    "w04_cumulative_hits": sql("SELECT seq, nth AS hits FROM hits"),
    "w05_rolling_mean": sql("SELECT bin, n, round(avg(n) OVER (ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS rolling FROM bins"),
    "w06_refresh_batches": sql("SELECT batch, count(*) AS n FROM (SELECT size, (sum((size IS NOT NULL)::INTEGER) OVER (ORDER BY seq))::BIGINT AS batch FROM attempts) b WHERE size IS NULL AND batch > 0 GROUP BY batch"),
    "w10_systematic_sample": sql("SELECT seq, nth FROM (SELECT seq, row_number() OVER (ORDER BY seq) AS nth FROM attempts) n WHERE nth % 97 = 1"),
    "w13_health_order": sql(f"SELECT engine, {_SEVERITY} AS severity FROM (SELECT engine, {_CASES} AS health FROM health) h"),
    "x01_retention": sql(f"SELECT seq FROM runs WHERE ts >= TIMESTAMP '{_NOW}' - INTERVAL 14 DAY"),
    "x03_cooldown": sql("SELECT proxy_key, epoch(TIMESTAMP '2024-01-30 12:00:00') - epoch(max(ts)) >= 86400 AS eligible FROM burned GROUP BY proxy_key", burned=_BURNS),
    "x04_backoff": sql("""SELECT seq, proxy_key, failures, least(3600, 300 * pow(2, least(failures, 30)))::DOUBLE AS bound_s FROM (SELECT *, row_number() OVER (PARTITION BY proxy_key, ride ORDER BY seq) - 1 AS failures FROM (
  SELECT *, sum((seq % 4 = 0)::INTEGER) OVER (PARTITION BY proxy_key ORDER BY seq) AS ride FROM burned))""", burned=_BURNS),
    "x05_burns": sql("SELECT seq, proxy_key FROM burned", burned=_BURNS),
    "x08_stalls": sql("SELECT seq, round(gap, 3) AS gap_s FROM hits WHERE gap >= 3600"),
    "x09_pacing": sql("SELECT url, count(*) AS n, round(min(g), 6) AS least_s, round(avg(g), 6) AS mean_s, count(*) FILTER (g < 0.5) AS too_soon FROM (SELECT url, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY url ORDER BY ts, seq) AS g FROM attempts) x WHERE g IS NOT NULL GROUP BY url"),
}
