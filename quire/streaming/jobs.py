"""Ingestion jobs: a queue as an event log, folded to the latest state, and file-triggered ingestion.

States: pending -> processing -> completed or failed; a processing job whose lease has run out may be claimed again while it
has attempts left. Every change appends one row; the state of a job is its newest row. A change that carries a stale fencing token
is dropped by a comparison. Several workers may claim and enqueue at once: a claim, or a new job, is theirs who first takes its
name (job, attempt, state) in the shared folder, see won() and sources.names."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.operators import relational as R
from quire.sources.schemas import JOBS

LEASE_SECONDS, ATTEMPTS, RUNNING, WAITING = 90, 3, 2, 6


class InvalidTransition(RuntimeError):
    """A job can't make this step from its state."""


class Busy(RuntimeError):
    """Too many questions run and wait."""


def claimable(now: Column) -> Column:
    return (F.col("status") == "pending") | ((F.col("status") == "processing") & (F.col("lease_expires_at") < now))


def exhausted() -> Column:
    return F.col("attempt") >= F.col("max_attempts")


#: State of the jobs of a document that was deleted: they are none any more.
DELETED = "deleted"


def newest_rows(jobs: DataFrame) -> DataFrame:
    return R.latest_per_key(jobs, "id", "updated_at", "attempt")


def latest(jobs: DataFrame) -> DataFrame:
    """The state of each job; those of deleted documents are left out."""
    return newest_rows(jobs).where(F.col("status") != DELETED)


def removed(jobs: DataFrame, document_id: str, now: Column) -> DataFrame:
    """Rows to append: the jobs of a document go with it."""
    gone = {"status": F.lit(DELETED), "lease_token": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp"), "updated_at": now}
    return latest(jobs).where(F.col("document_id") == document_id).withColumns(gone)


def won(rows: DataFrame, take: Callable[[str], bool]) -> DataFrame:
    """Of the rows that several writers may be about to append, those whose name (job, attempt, state) this one takes first. As
    many names as jobs of a batch."""
    names = [(r.id, r.attempt, r.status) for r in rows.select("id", "attempt", "status").collect()]
    mine = [r[0] for r in names if take("-".join(map(str, r)))]
    return R.semi_lookup(rows, rows.sparkSession.createDataFrame([(i,) for i in mine], "id string"), "id")


def _fields(schema: str) -> list[str]:
    """Fields of a flat schema whose types may hold commas in brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [f.strip() for f in out]


def enqueue(documents: DataFrame, jobs: DataFrame, now: Column, attempts: int = ATTEMPTS, correlation_id: str | None = None) -> DataFrame:
    """New jobs for documents (id) without an active one, one each; correlation_id ties them to the request that asked."""
    active = latest(jobs).where("status <> 'failed'").select(F.col("document_id").alias("_d"))
    fresh = documents.select(F.col("id").alias("document_id")).distinct().join(active, F.col("document_id") == F.col("_d"), "left_anti")
    tries = newest_rows(jobs).groupBy(F.col("document_id").alias("_d")).agg(F.count("*").alias("_n"))
    fresh = fresh.join(tries, F.col("document_id") == F.col("_d"), "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    job_id = I.uuid5(F.concat_ws(":", F.lit("job"), "document_id", F.col("_n").cast("string")))
    known = {"id": job_id, "document_id": F.col("document_id"), "status": F.lit("pending"), "pages_done": F.lit(0), "attempt": F.lit(0), "max_attempts": F.lit(attempts), "correlation_id": F.lit(correlation_id), "created_at": now, "updated_at": now}
    fields = [f.split(" ", 1) for f in _fields(JOBS)]
    return fresh.select(*(known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields))


def claim(jobs: DataFrame, now: Column, limit: int = 1, lease: int = LEASE_SECONDS) -> DataFrame:
    """Rows to append: the oldest claimable jobs under a fresh lease, and those without an attempt left as failed."""
    open_jobs = latest(jobs).where(claimable(now))
    dead = open_jobs.where(exhausted()).withColumns({"status": F.lit("failed"), "failure_code": F.lit("interrupted_repeatedly"), "lease_token": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp"), "updated_at": now})
    taken = open_jobs.where(~exhausted()).orderBy("created_at", "id").limit(limit)
    token = I.uuid5(F.concat_ws(":", F.lit("lease"), "id", F.col("attempt").cast("string"), now.cast("string")))
    if "started_at" in jobs.columns:
        taken = taken.withColumn("started_at", F.coalesce("started_at", now))
    taken = taken.withColumns({"lease_token": token, "status": F.lit("processing"), "attempt": F.col("attempt") + 1, "lease_expires_at": now + F.make_dt_interval(secs=F.lit(lease)), "updated_at": now})
    return taken.unionByName(dead)


#: Event -> (states it may come in, state after it).
STEPS = {"heartbeat": (("processing",), "processing"), "advance": (("processing",), "processing"), "complete": (("processing",), "completed"), "fail": (("pending", "processing"), "failed")}


#: What an event may bring beside its kind, taken over where both tables have the column.
PROGRESS = ("stage", "pages_total", "pages_done", "failure_reason", "summary")


def fenced(jobs: DataFrame, events: DataFrame, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """events(id, event, token, failure_code, and any of PROGRESS) -> rows to append: changes whose token is that of the job's
    lease and that its state allows; stale ones change nothing."""
    more = [c for c in PROGRESS if c in events.columns and c in jobs.columns]
    e = events.select("id", "event", "token", F.col("failure_code").alias("_code"), *(F.col(c).alias(f"_{c}") for c in more))
    held = latest(jobs).join(e, "id").where(F.col("lease_token") == F.col("token"))
    allowed, after = F.lit(False), F.col("status")
    for event, (states, to) in STEPS.items():
        allowed = allowed | ((F.col("event") == event) & F.col("status").isin(*states))
        after = F.when(F.col("event") == event, to).otherwise(after)
    done = F.col("event").isin("complete", "fail")
    changed = {c: F.coalesce(f"_{c}", c) for c in more} | {"status": after, "lease_token": F.when(~done, F.col("lease_token")), "lease_expires_at": F.when(~done, now + F.make_dt_interval(secs=F.lit(lease))), "failure_code": F.when(F.col("event") == "fail", F.coalesce("_code", F.lit("internal_error"))), "updated_at": now}
    if "finished_at" in jobs.columns:
        changed["finished_at"] = F.when(done, now)
    return held.where(allowed).withColumns(changed).select(*jobs.columns)


def ingest_stream(source: DataFrame, register: str, checkpoint: str, process: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None):
    """A stream of documents (id, sha256, ...) into a register keyed by fingerprint. Which fingerprints are known is keyed state
    of the stream, so a micro-batch looks up only its own and never reads the register. Each micro-batch writes its new rows into
    a folder named after the batch, so a batch that runs again after a failure replaces its own output; `process` gets these
    rows. trigger: that of the stream, by default what is there now."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{register}/batch={number}")
        if process is not None:
            process(rows.sparkSession.read.schema(rows.schema).parquet(f"{register}/batch={number}"), number)

    return source.dropDuplicates(["sha256"]).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def until_terminal(state: Callable[[], str | None], every: float = 1.0, most: float = 600.0) -> str | None:
    """Ask for a job's status until it is terminal or the time is over: the last status."""
    began = time.monotonic()
    while (status := state()) not in ("completed", "failed", None) and time.monotonic() - began < most:
        time.sleep(every)
    return status


def lease_states(events: DataFrame, lease: int = LEASE_SECONDS) -> DataFrame:
    """A stream of job events (id, event, at) -> state changes, with a timer that reports an expired lease as pending again."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key, batches, state: GroupState):
        (job,) = key
        status, attempt = state.get if state.exists else ("pending", 0)
        if state.hasTimedOut:
            status = "pending"
            state.update((status, attempt))
            yield pd.DataFrame({"id": [job], "status": [status], "attempt": [attempt]})
            return
        for b in batches:
            for event in b.sort_values("at")["event"]:
                if event == "claim" and status == "pending":
                    status, attempt = "processing", attempt + 1
                elif event in STEPS and status in STEPS[event][0]:
                    status = STEPS[event][1]
        state.update((status, attempt))
        if status == "processing":
            state.setTimeoutDuration(lease * 1000)
        yield pd.DataFrame({"id": [job], "status": [status], "attempt": [attempt]})

    return events.groupBy("id").applyInPandasWithState(fold, "id string, status string, attempt int", "status string, attempt int", "update", GroupStateTimeout.ProcessingTimeTimeout)


class Slots:
    """Admission of questions: some run, some wait, more are refused."""

    def __init__(self, running: int = RUNNING, waiting: int = WAITING):
        self._run, self._all = threading.Semaphore(running), threading.Semaphore(running + waiting)

    @contextmanager
    def admit(self, timeout: float | None = None):
        if not self._all.acquire(blocking=False):
            raise Busy("too many questions")
        try:
            if not self._run.acquire(timeout=timeout):
                raise TimeoutError("no place became free in time")
            try:
                yield
            finally:
                self._run.release()
        finally:
            self._all.release()


class Gone(RuntimeError):
    """Whoever asked is not there any more."""


def within(spark: SparkSession, seconds: float, action: Callable, alive: Callable[[], bool] | None = None, every: float = 0.25):
    """The result of an action that runs in a thread of its own, its Spark jobs under a tag. When the time is over (TimeoutError)
    or alive(), asked all the while, is false (Gone), the caller is free at once and Spark is told to cancel the tag's jobs."""
    tag, done, result = f"quire-{uuid.uuid4().hex}", threading.Event(), []

    def run():
        spark.addTag(tag)
        try:
            result.append((action(), None))
        except BaseException as e:
            result.append((None, e))
        finally:
            spark.removeTag(tag)
            done.set()

    threading.Thread(target=run, daemon=True).start()
    end = time.monotonic() + seconds
    while not done.wait(min(every, max(end - time.monotonic(), 0))):
        over = time.monotonic() >= end
        if over or (alive is not None and not alive()):
            threading.Thread(target=spark.interruptTag, args=(tag,), daemon=True).start()
            raise TimeoutError(f"not done within {seconds} s") if over else Gone("nobody waits for it")
    value, error = result[0]
    if error is not None:
        raise error
    return value
