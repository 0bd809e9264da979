"""Streams with timers and merged tables against their batch forms, also over restarts."""

from __future__ import annotations

import json
import os
import random
from pathlib import Path

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from websheaf.operators import logs, rides
from websheaf.streaming import cooldowns, merge

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, old)


def put(folder: Path, name: str, rows: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))
    at = 1_700_000_000 + len(list(folder.iterdir()))  # files come in the order of their times
    os.utime(folder / name, (at, at))


def attempts(seed: int, n: int, proxies: int, step_s: int) -> list[dict]:
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = i * step_s
        out.append({"ts": f"2024-01-{1 + s // 86400:02d}T{s // 3600 % 24:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z", "seq": i, "proxy_key": f"p{r.randrange(proxies)}", "status": r.choice(["ok", "ok", "regwall", "connect_fail", "empty", "failed"])})
    return out


def drained(spark, source: Path, out: Path, checkpoint: Path, **options):
    """Everything that is there, in batches of a file, into files; then again as often as it is called."""
    stream = spark.readStream.schema(cooldowns.ATTEMPTS).option("maxFilesPerTrigger", 1).json(str(source))
    events = cooldowns.ride_events(stream, **options)
    events.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start().awaitTermination()


@pytest.mark.parametrize("policy", ["fixed", "exponential"])
def test_rides_and_cooldowns_match_the_batch_forms_over_a_restart(rocks, tmp_path, policy):
    spark, source = rocks, tmp_path / "in"
    rows = attempts(3, 240, 4, 97)
    for k in range(2):
        put(source, f"{k}.json", rows[k * 60 : k * 60 + 60])
    drained(spark, source, tmp_path / "out", tmp_path / "check", policy=policy, cooldown_s=1800)
    for k in range(2, 4):
        put(source, f"{k}.json", rows[k * 60 : k * 60 + 60])
    put(source, "9.json", [{"ts": "2024-01-03T00:00:00Z", "seq": 900, "proxy_key": "other", "status": "ok"}])  # moves the watermark on
    drained(spark, source, tmp_path / "out", tmp_path / "check", policy=policy, cooldown_s=1800)
    put(source, "99.json", [{"ts": "2024-01-03T00:00:01Z", "seq": 901, "proxy_key": "other", "status": "ok"}])
    drained(spark, source, tmp_path / "out", tmp_path / "check", policy=policy, cooldown_s=1800)
    found = spark.read.parquet(str(tmp_path / "out"))

    log = spark.createDataFrame([(r["proxy_key"], r["seq"], r["status"], r["ts"]) for r in rows], "proxy_key string, seq long, status string, ts string").withColumn("ts", F.to_timestamp("ts"))
    ended = rides.rides(log, chunk=F.expr("seq div 50")).filter("cause <> 'open'")
    bounds = logs.backoff_bounds(ended.select("proxy_key", F.col("last_seq").alias("seq"), "ride", "cause", F.col("ride_ok").cast("int").alias("ride_ok")))
    bound = F.col("bound_s") if policy == "exponential" else F.lit(1800.0)
    want = bounds.join(log.select("seq", F.col("ts").alias("at")), "seq").select("proxy_key", "ride", "seq", "at", "cause", "ride_ok", "failures", bound.alias("bound_s"))
    got = found.filter("event = 'ride'").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    assert found.filter("event = 'ride' and not (wait_s >= 0 and wait_s <= bound_s)").count() == 0

    w = Window.partitionBy("proxy_key").orderBy("seq")
    until = found.filter("event = 'ride'").select("proxy_key", "ride", "seq", F.expr("timestamp_millis(unix_millis(at) + cast(round(wait_s * 1000) as bigint))").alias("until"), "at").withColumn("next", F.lead("at").over(w))
    free = until.filter("next is null or until <= next").select("proxy_key", "ride", "until")
    eligible = found.filter("event = 'eligible'").select("proxy_key", "ride", F.col("at").alias("until"))
    assert sorted(map(tuple, eligible.collect())) == sorted(map(tuple, free.collect())) and eligible.count() > 5


def test_streamed_cooldown_says_who_is_eligible(rocks, tmp_path):
    """At any time of the log, a proxy is eligible by its last event exactly if the batch rule says so."""
    spark = rocks
    put(tmp_path / "in", "0.json", [{"ts": f"2024-01-01T00:{m:02d}:00Z", "seq": m, "proxy_key": p, "status": "connect_fail"} for m, p in ((0, "a"), (20, "b"), (59, "c"))])
    put(tmp_path / "in", "1.json", [{"ts": "2024-01-01T01:30:00Z", "seq": 90, "proxy_key": "z", "status": "ok"}])
    put(tmp_path / "in", "2.json", [{"ts": "2024-01-01T01:30:01Z", "seq": 91, "proxy_key": "z", "status": "ok"}])
    drained(spark, tmp_path / "in", tmp_path / "out", tmp_path / "check", late="0 seconds")
    found = spark.read.parquet(str(tmp_path / "out"))
    last = {r.proxy_key: r.event == "eligible" for r in found.groupBy("proxy_key").agg(F.max(F.struct("at", "event"))["event"].alias("event")).collect()}
    burns = found.filter("event = 'ride'").select("proxy_key", F.col("at").alias("ts"))
    now = F.lit("2024-01-01 01:30:00").cast("timestamp")
    assert last == {r.proxy_key: r.eligible for r in logs.cooling(burns, now).collect()} == {"a": True, "b": True, "c": False}


def test_policy_names():
    with pytest.raises(ValueError):
        cooldowns.ride_events(None, policy="other")


def files(path: Path) -> set[str]:
    return {str(p.relative_to(path)) for p in path.rglob("part-*.parquet")}


def test_merge_writes_the_touched_parts_only(spark, tmp_path):
    out = tmp_path / "table"
    merge_batch = merge.merge_into(str(out), ["k"], "at", buckets=16, first=("born",))
    frame = lambda rows: spark.createDataFrame(rows, "k long, at long, born long, v string")
    merge_batch(frame([(i, 1, 1, f"a{i}") for i in range(400)]), 0)
    before = files(out)
    merge_batch(frame([(7, 2, 2, "b7"), (7, 3, 3, "c7"), (1000, 3, 3, "new"), (8, 0, 0, "older")]), 1)
    new = files(out) - before
    assert 1 <= len({x.split("_bucket=")[1].split("/")[0] for x in new}) <= 3
    want = {i: (1, 1, f"a{i}") for i in range(400)} | {7: (3, 1, "c7"), 1000: (3, 3, "new"), 8: (1, 0, "a8")}
    read = lambda: {r.k: (r["at"], r.born, r.v) for r in merge.current(spark, str(out)).collect()}
    assert read() == want
    now = files(out)
    merge_batch(frame([(7, 9, 9, "again")]), 1)  # a batch id that is done
    assert read() == want and files(out) == now
    (out / "versions" / "1.json").unlink()  # as if the last step had not been reached
    assert read() == {i: (1, 1, f"a{i}") for i in range(400)}
    merge_batch(frame([(7, 2, 2, "b7"), (7, 3, 3, "c7"), (1000, 3, 3, "new"), (8, 0, 0, "older")]), 1)
    assert read() == want
    assert merge.vacuumed(spark, str(out), keep=1) > 0 and read() == want
    assert merge.vacuumed(spark, str(out), keep=1) == 0


def test_merge_from_a_stream_over_a_restart(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "table"
    schema = "url string, lastmod string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        stream.writeStream.foreachBatch(merge.merge_into(str(out), ["url"], "lastmod", buckets=4)).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    put(source, "0.json", [{"url": f"u{i}", "lastmod": "2024-01-01"} for i in range(20)])
    put(source, "1.json", [{"url": "u3", "lastmod": "2024-02-01"}, {"url": None, "lastmod": "2024-02-01"}])
    run()
    put(source, "2.json", [{"url": "u3", "lastmod": "2023-01-01"}, {"url": "u9", "lastmod": "2024-03-01"}])
    run()
    found = {r.url: r.lastmod for r in merge.current(spark, str(out)).collect()}
    assert len(found) == 21 and (found["u3"], found["u9"], found[None]) == ("2024-02-01", "2024-03-01", "2024-02-01")
    with pytest.raises(FileNotFoundError):
        merge.current(spark, str(tmp_path / "none"))


def test_retention_removes_days_and_repeats_nothing(spark, tmp_path):
    out = str(tmp_path / "log")
    write = merge.retained_in(out, days=14)
    frame = lambda rows: spark.createDataFrame(rows, "d string, n long").select(F.to_timestamp("d").alias("ts"), "n")
    days = [f"2024-01-{d:02d} 12:00:00" for d in range(1, 29)]
    batches = [frame([(d, i * 10 + j) for j in range(3)] + [(None, -1)]) for i, d in enumerate(days)]
    for k, b in enumerate(batches):
        write(b, k)
    write(batches[-1], len(batches) - 1)
    write(frame([("2024-01-02 00:00:00", 999), ("2024-01-14 12:00:00", 5), ("2024-01-14 11:59:59", 6)]), 28)
    everything = batches[0]
    for b in batches[1:]:
        everything = everything.union(b)
    now = F.lit("2024-01-28 12:00:00").cast("timestamp")
    want = sorted(r.n for r in logs.retained(everything, now).collect()) + [5]
    assert sorted(r.n for r in merge.retained(spark, out, "ts timestamp, n long").collect()) == sorted(want)
    assert min(p.name for p in Path(out).rglob("_day=*")) == "_day=2024-01-14"
