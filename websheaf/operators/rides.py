"""Rides: what a proxy's attempts fall into when a ride ends with a refused connection, enough registration walls or enough failures.

A ride's counters make a small automaton. Each chunk of a proxy's log is a function from the state before it to the state
after it; functions of chunks are composed in two levels, so that every chunk learns its own first state without any task
reading a whole proxy's log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from websheaf.operators.shared import written

#: Walls, and other failures, that end a ride.
BURN_AFTER, FAIL_AFTER = 2, 2
#: Chunks whose functions are composed at once.
CHUNKS = 1000
#: Why a ride ended, by the status of its last attempt.
CAUSES = {"regwall": "burned", "connect_fail": "connect", "failed": "failures"}


def kind(status: Column) -> Column:
    """ok, regwall and connect_fail by name; anything else (an empty page, an error, null) is failed."""
    return F.when(status.isin("ok", "regwall", "connect_fail"), status).otherwise("failed")


def _step(state: Column, status: Column, burn_after: int, fail_after: int) -> Column:
    """The next state, walls * fail_after + failures; -1 where the ride ends."""
    wall = F.when(state >= (burn_after - 1) * fail_after, -1).otherwise(state + fail_after)
    failure = F.when(state % fail_after == fail_after - 1, -1).otherwise(state + 1)
    return F.when(status == "ok", state).when(status == "regwall", wall).when(status == "connect_fail", -1).otherwise(failure).cast("int")


def _after(a: Column, b: Column) -> Column:
    """The function a, then b: per first state the last one and the rides that ended."""
    return F.transform(a, lambda x: F.struct(F.get(b, x["state"])["state"].alias("state"), (x["ends"] + F.get(b, x["state"])["ends"]).alias("ends")))


def _composed(rows: DataFrame, by: list[str], at: str, states: int) -> DataFrame:
    """Per group the whole function `f`, and in `parts` for each element the function of what comes before it."""
    identity = F.array(*[F.struct(F.lit(s).alias("state"), F.lit(0).cast("long").alias("ends")) for s in range(states)])
    function = "array<struct<state:int,ends:bigint>>"
    acc = f"struct<f:{function},parts:array<struct<at:bigint,before:{function}>>>"
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("at"), "f"))).alias("list"))
    empty = F.array().cast(f"array<struct<at:bigint,before:{function}>>")
    fold = F.aggregate(
        "list", F.struct(identity.alias("f"), empty.alias("parts")).cast(acc),
        lambda s, c: F.struct(_after(s["f"], c["f"]).alias("f"), F.array_append(s["parts"], F.struct(c["at"].alias("at"), s["f"].alias("before"))).alias("parts")).cast(acc),
    )
    return listed.withColumn("done", fold).select(*by, "done.f", "done.parts")


def ride_rows(log: DataFrame, *, burn_after: int = BURN_AFTER, fail_after: int = FAIL_AFTER, chunk: Column | None = None) -> DataFrame:
    """(proxy_key, seq, status, ride, ends) of a log (proxy_key, seq, status), whose other columns are ignored: the proxy's ride
    that the attempt belongs to, from 1, and whether it ends it.

    A ride ends with its first connect_fail, its `burn_after`th regwall or its `fail_after`th other failure; walls and
    failures count over the whole ride, a success does not reset them. `chunk` is a coarse, monotonic function of seq with at most
    some thousand rows a value, by default seq div 1000 (line numbers). Null proxy keys are one proxy.
    """
    states = burn_after * fail_after
    rows = log.select("proxy_key", F.col("seq").cast("long").alias("seq"), kind(F.col("status")).alias("status"), (F.expr("seq div 1000") if chunk is None else chunk).cast("long").alias("chunk"))
    chunks = written(rows.groupBy("proxy_key", "chunk").agg(F.sort_array(F.collect_list(F.struct("seq", "status"))).alias("rows")), "ride-chunks")

    def moved(s: Column, status: Column) -> Column:
        to = _step(s["state"], status, burn_after, fail_after)
        return F.struct(F.greatest(to, F.lit(0)).alias("state"), (s["ends"] + (to < 0).cast("long")).alias("ends"))

    start = lambda s: F.struct(s.cast("int").alias("state"), F.lit(0).cast("long").alias("ends"))
    functions = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: F.aggregate("rows", start(s), lambda acc, r: moved(acc, r["status"])))
    above = F.expr(f"chunk div {CHUNKS}")
    inner = written(_composed(chunks.select("proxy_key", above.alias("above"), "chunk", functions.alias("f")), ["proxy_key", "above"], "chunk", states), "ride-functions")
    outer = _composed(inner.select("proxy_key", "above", "f"), ["proxy_key"], "above", states)
    first = outer.select("proxy_key", F.explode("parts").alias("p")).select(F.col("proxy_key").alias("key"), F.col("p.at").alias("at"), F.get("p.before", F.lit(0)).alias("start"))
    placed = inner.join(first, inner["proxy_key"].eqNullSafe(first["key"]) & (inner["above"] == first["at"]))
    inside = placed.select("proxy_key", "start", F.explode("parts").alias("p")).select(
        F.col("proxy_key").alias("key"), F.col("p.at").alias("at"), F.get("p.before", F.col("start.state"))["state"].alias("state"), (F.col("start.ends") + F.get("p.before", F.col("start.state"))["ends"]).alias("ends")
    )
    known = chunks.join(inside, chunks["proxy_key"].eqNullSafe(inside["key"]) & (chunks["chunk"] == inside["at"]))
    out = "array<struct<seq:bigint,status:string,ride:bigint,ends:boolean>>"
    acc = f"struct<state:int,ends:bigint,out:{out}>"

    def row(s: Column, r: Column) -> Column:
        to = moved(s, r["status"])
        done = F.struct(r["seq"].alias("seq"), r["status"].alias("status"), (s["ends"] + 1).alias("ride"), (to["ends"] > s["ends"]).alias("ends"))
        return F.struct(to["state"].alias("state"), to["ends"].alias("ends"), F.array_append(s["out"], done).alias("out")).cast(acc)

    whole = F.aggregate("rows", F.struct(F.col("state"), F.col("ends"), F.array().cast(out).alias("out")).cast(acc), row)["out"]
    return known.select("proxy_key", F.explode(whole).alias("r")).select("proxy_key", "r.*")


def rides(log: DataFrame, *, burn_after: int = BURN_AFTER, fail_after: int = FAIL_AFTER, chunk: Column | None = None) -> DataFrame:
    """One row a ride: (proxy_key, ride, first_seq, last_seq, n, ride_ok, n_regwall, n_connect_fail, n_failed, cause); cause is
    burned, connect or failures, and `open` for a proxy's last ride if nothing ended it."""
    rows = ride_rows(log, burn_after=burn_after, fail_after=fail_after, chunk=chunk)
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(n) for s, n in (("ok", "ride_ok"), ("regwall", "n_regwall"), ("connect_fail", "n_connect_fail"), ("failed", "n_failed"))]
    end = F.max(F.when(F.col("ends"), F.col("status")))
    cause = F.coalesce(*[F.when(end == s, F.lit(c)) for s, c in CAUSES.items()], F.lit("open"))
    return rows.groupBy("proxy_key", "ride").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"), *counts, cause.alias("cause"))
