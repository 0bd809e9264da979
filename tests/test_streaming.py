"""Streaming queries give what their batch forms give."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from websheaf.operators import logs
from websheaf.streaming import logs as streaming
from websheaf.streaming import merge


def put(folder, name, rows):
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def drained(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("maxFilesPerTrigger", 1).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_windowed_health(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T{h:02d}:{m:02d}:00Z", "engine": e, "status": "OK" if m % 20 else "EMPTY_BLOCK", "search_ms": m, "result_count": 1} for h in range(3) for m in range(0, 60, 10) for e in ("a", "b")]
    put(tmp_path, "1.json", rows[:18])
    put(tmp_path, "2.json", rows[18:])
    found = drained(streaming.windowed_health(streaming.run_stream(spark, str(tmp_path))), "health", "complete").collect()
    assert len(found) == 6 and {(r.n, r.ok, r.mean_ms) for r in found} == {(6, 3, 30.0)}


def test_burns_match_the_batch_form(spark, tmp_path):
    import random

    r = random.Random(1)
    rows = [{"ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", "seq": i, "proxy_key": f"p{r.randrange(5)}", "ok": r.random() < 0.4} for i in range(600)]
    source = tmp_path / "in"
    source.mkdir()
    for k in range(3):
        put(source, f"{k}.json", rows[k * 200 : k * 200 + 200])
    stream = spark.readStream.schema(streaming._ATTEMPTS).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    live = {x.seq for x in drained(streaming.burn_stream(stream), "burns", "append").collect()}
    batch = spark.read.schema(streaming._ATTEMPTS).json(str(source))
    assert live == {x.seq for x in logs.burns(batch).collect()} and live


def test_upserts_keep_the_last_row(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    put(source, "1.json", [{"ts": "2024-01-01T00:00:00Z", "seq": i, "proxy_key": f"p{i % 3}", "ok": True} for i in range(9)])
    stream = streaming.attempt_stream(spark, str(source))
    query = stream.writeStream.foreachBatch(merge.merge_into(out, ["proxy_key"], "seq")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    put(source, "2.json", [{"ts": "2024-01-01T00:00:01Z", "seq": 20, "proxy_key": "p1", "ok": False}])
    query = stream.writeStream.foreachBatch(merge.merge_into(out, ["proxy_key"], "seq")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.proxy_key, r.seq) for r in merge.current(spark, out).collect()) == [("p0", 6), ("p1", 20), ("p2", 8)]


def test_batch_rules_by_hand(spark):
    log = spark.createDataFrame([("p", i, ok) for i, ok in enumerate([False, False, False, True, False, False])], "proxy_key string, seq long, ok boolean")
    assert sorted(r.seq for r in logs.burns(log).collect()) == [1, 5]
    burned = spark.createDataFrame([("p", 0, 0), ("p", 1, 0), ("p", 2, 3), ("p", 3, 0)], "proxy_key string, seq long, ride_ok int")
    assert [r.bound_s for r in logs.backoff_bounds(burned).orderBy("seq").collect()] == [300.0, 600.0, 300.0, 600.0]
    now = F.timestamp_seconds(F.lit(7200))
    burns = spark.createDataFrame([("a", 3600.0), ("b", 3601.0)], "proxy_key string, at double").select("proxy_key", F.timestamp_seconds("at").alias("ts"))
    assert {r.proxy_key: r.eligible for r in logs.cooling(burns, now).collect()} == {"a": True, "b": False}
