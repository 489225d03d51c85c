"""Jobs as one stateful stream: events of clients and workers go in, what they lead to comes out.

The state of a job (status, attempt, token and end of its lease) is keyed state of the stream, kept by the RocksDB state store and
part of the checkpoint, so it survives a restart. A claim starts a lease with a processing-time timer, a heartbeat of the lease's
token moves it, its end makes the job pending again or, without an attempt left, failed. Events with another token change
nothing and are reported as stale. State goes after its time to live without an event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.streaming.jobs import ATTEMPTS, LEASE_SECONDS

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "id string, event string, token string, failure_code string, at timestamp"
STATES = "id string, event string, result string, status string, attempt int, lease_token string, failure_code string"
_STATE = "status string, attempt int, token string, until long"


class JobProcessor(StatefulProcessor):
    """One job. Results: enqueued, claimed, renewed, completed, failed, expired; stale (another token), refused (not from this
    state)."""

    def __init__(self, lease_ms: int, attempts: int, ttl_ms: int | None):
        self.lease_ms, self.attempts, self.ttl_ms = lease_ms, attempts, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE, self.ttl_ms) if self.ttl_ms else handle.getValueState("job", _STATE)

    def _lease(self, now: int, before: int | None) -> int:
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(now + self.lease_ms)
        return now + self.lease_ms

    def _rows(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[f.split()[0] for f in STATES.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        status, attempt, token, until = self.job.get() if self.job.exists() else (None, 0, None, None)
        out = []
        for e in sorted((r for df in rows for r in df.itertuples(index=False)), key=lambda r: r.at):
            code, held = None, status == "processing" and e.token == token
            if e.event == "enqueue":
                result = "enqueued" if status in (None, "failed") else "refused"
                if result == "enqueued":
                    status, attempt = "pending", 0
            elif e.event == "claim":
                result = "claimed" if status == "pending" else "refused"
                if result == "claimed":
                    status, attempt, token = "processing", attempt + 1, e.token
                    until = self._lease(now, None)
            elif not held:
                result = "stale"
            elif e.event == "heartbeat":
                result, until = "renewed", self._lease(now, until)
            else:
                result = status = "completed" if e.event == "complete" else "failed"
                code = e.failure_code if e.event == "fail" else None
                self.handle.deleteTimer(until)
                token = until = None
            out.append((e.event, result, status, attempt, token, code))
        if status is not None:
            self.job.update((status, attempt, token, until))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempt, _, until = self.job.get() if self.job.exists() else (None, 0, None, None)
        if status != "processing" or until is None or expiredTimerInfo.getExpiryTimeInMs() < until:
            return
        dead = attempt >= self.attempts
        status, code = ("failed", "interrupted_repeatedly") if dead else ("pending", None)
        self.job.update((status, attempt, None, None))
        yield self._rows(key, [("timer", "expired", status, attempt, None, code)])


class WrongStateStore(RuntimeError):
    """Timers and keyed state need the RocksDB state store."""


def job_states(events: DataFrame, lease: float = LEASE_SECONDS, attempts: int = ATTEMPTS, ttl: float | None = None) -> DataFrame:
    """A stream of EVENTS -> a stream of STATES, one row for each event and each lease that runs out. ttl: seconds without an
    event after which a job is forgotten."""
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_STORE:
        raise WrongStateStore(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    processor = JobProcessor(int(lease * 1000), attempts, None if ttl is None else int(ttl * 1000))
    return events.groupBy("id").transformWithStateInPandas(processor, STATES, "Update", "ProcessingTime")
