"""Rides and cooldowns on an unbounded log of attempts: keyed state with event-time timers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from websheaf.operators.logs import BACKOFF_BASE_S, BACKOFF_CAP_S, COOLDOWN_S
from websheaf.operators.rides import BURN_AFTER, CAUSES, FAIL_AFTER

ATTEMPTS = "ts timestamp, seq long, proxy_key string, status string"
EVENTS = "proxy_key string, event string, ride long, seq long, at timestamp, cause string, ride_ok int, failures int, bound_s double, wait_s double"
_STATE = "ride long, walls int, fails int, ok int, failures int, until_ms long, seen_ms long"
_RETENTION_MS = 14 * 24 * 3600 * 1000


def share(key: str, seq: int) -> float:
    """The part of its bound that a burned proxy waits, in [0, 1): a draw that depends on proxy and attempt alone, so that a
    batch which runs again draws the same."""
    return int(hashlib.sha256(f"wait:{key}:{seq}".encode()).hexdigest()[:12], 16) / 16**12


def bound(failures: int) -> float:
    return float(min(BACKOFF_CAP_S, BACKOFF_BASE_S * 2 ** min(failures, 30)))


class Rides(StatefulProcessor):
    """State of a proxy: its ride's counters, the burns since a ride with a success, and until when it cools.

    A ride that ends sets a timer to the end of the cooldown, and takes an older one back; the timer, or an attempt after
    that time, gives the event `eligible`. A proxy that nothing is heard of for 14 days after that is forgotten.
    """

    def __init__(self, policy: str, burn_after: int, fail_after: int, cooldown_s: float):
        self.policy, self.burn_after, self.fail_after, self.cooldown_s = policy, burn_after, fail_after, cooldown_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("ride", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old = self.state.get() if self.state.exists() else None
        ride, walls, fails, ok, failures, until, seen = tuple(old) if old else (1, 0, 0, 0, 0, -1, -1)
        timers = {t for t in (until, seen + _RETENTION_MS if seen >= 0 else -1) if t >= 0}
        out = []
        for row in sorted(rows, key=lambda r: r.seq):
            ms = row.ms
            seen = max(seen, ms)
            if 0 <= until <= ms:
                out.append(self._eligible(key, ride - 1, until))
                until = -1
            status = row.status if row.status in ("ok", "regwall", "connect_fail") else "failed"
            ok, walls, fails = ok + (status == "ok"), walls + (status == "regwall"), fails + (status == "failed")
            if status == "connect_fail" or walls >= self.burn_after or fails >= self.fail_after:
                failures = 0 if ok else failures
                most = bound(failures) if self.policy == "exponential" else float(self.cooldown_s)
                wait = most * share(key[0], row.seq) if self.policy == "exponential" else most
                out.append(Row(proxy_key=key[0], event="ride", ride=ride, seq=row.seq, at=row.ts, cause=CAUSES[status], ride_ok=ok, failures=failures, bound_s=most, wait_s=wait))
                until = ms + round(wait * 1000)
                ride, walls, fails, ok, failures = ride + 1, 0, 0, 0, failures + 1
        self.state.update((ride, walls, fails, ok, failures, until, seen))
        self._set_timers(timers, {t for t in (until, seen + _RETENTION_MS) if t >= 0})
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.state.exists():
            return
        ride, walls, fails, ok, failures, until, seen = tuple(self.state.get())
        at = expiredTimerInfo.getExpiryTimeInMs()
        if 0 <= until <= at:
            self.state.update((ride, walls, fails, ok, failures, -1, seen))
            yield self._eligible(key, ride - 1, until)
        if at >= seen + _RETENTION_MS:
            self.state.clear()

    def _set_timers(self, old: set[int], new: set[int]) -> None:
        for t in old - new:
            self.handle.deleteTimer(t)
        for t in new - old:
            self.handle.registerTimer(t)

    @staticmethod
    def _eligible(key, ride: int, ms: int) -> Row:
        import datetime

        at = datetime.datetime.fromtimestamp(ms / 1000, datetime.timezone.utc)
        return Row(proxy_key=key[0], event="eligible", ride=ride, seq=None, at=at, cause=None, ride_ok=None, failures=None, bound_s=None, wait_s=None)

    def close(self) -> None:
        pass


def ride_events(attempts: DataFrame, *, policy: str = "fixed", burn_after: int = BURN_AFTER, fail_after: int = FAIL_AFTER, cooldown_s: float = COOLDOWN_S, late: str = "10 minutes") -> DataFrame:
    """A stream of ATTEMPTS as EVENTS: `ride` for each ride that ends, with its cause, its successes and the cooldown that it
    brings, and `eligible` once that cooldown is over, unless the proxy burned again before.

    `fixed` cools for cooldown_s, `exponential` for a draw under a bound that doubles from burn to burn and starts anew after
    a ride with a success. Rides are those of operators.rides, in log order within a micro-batch. Attempts without a time
    are dropped. The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    if policy not in ("fixed", "exponential"):
        raise ValueError("policy is fixed or exponential")
    rows = attempts.filter("ts is not null").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return rows.groupBy("proxy_key").transformWithState(Rides(policy, burn_after, fail_after, cooldown_s), EVENTS, "Append", "EventTime")
