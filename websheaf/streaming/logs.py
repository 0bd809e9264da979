"""The log rules on unbounded logs: windowed health, first sightings, burns with state; rides and upserts are in cooldowns and merge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RETENTION = "14 days"
_RUNS = "ts timestamp, engine string, status string, search_ms int, result_count int"
_ATTEMPTS = "ts timestamp, seq long, proxy_key string, ok boolean"


def run_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(_RUNS).json(path)


def attempt_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(_ATTEMPTS).json(path)


def windowed_health(runs: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Runs, OK runs and mean OK latency per engine and window; a window ends once the watermark passes it."""
    ok = F.col("status") == "OK"
    rows = runs.withWatermark("ts", late).groupBy(F.window("ts", width), "engine")
    out = rows.agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("ok"), F.avg(F.when(ok, F.col("search_ms"))).alias("mean_ms"))
    return out.select(F.col("window.start").alias("start"), "engine", "n", "ok", "mean_ms")


def deduplicated(runs: DataFrame, keys: list[str]) -> DataFrame:
    """First sightings of keys, remembered for the retention of the logs."""
    return runs.withWatermark("ts", RETENTION).dropDuplicatesWithinWatermark(keys)


def burn_stream(attempts: DataFrame, after: int = 2) -> DataFrame:
    """(proxy_key, seq, ts) of attempts that burn their proxy: every `after`th failure in a row. State is one number a
    proxy; within a batch attempts are taken in log order."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("seq")
        failures = state.get[0] if state.exists else 0
        burned = []
        for ok, seq, ts in zip(rows["ok"], rows["seq"], rows["ts"]):
            failures = 0 if ok else failures + 1
            if failures == after:
                burned.append((key[0], seq, ts))
                failures = 0
        state.update((failures,))
        yield pd.DataFrame(burned, columns=["proxy_key", "seq", "ts"])

    return attempts.groupBy("proxy_key").applyInPandasWithState(step, "proxy_key string, seq long, ts timestamp", "failures int", "append", GroupStateTimeout.NoTimeout)
