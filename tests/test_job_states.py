"""Jobs as a stateful stream: claims, stale tokens, leases that run out, attempts used up, a restart from the checkpoint."""

import time
from datetime import datetime, timedelta

import pytest

from quire.streaming import job_states as J

BEGAN = datetime(2024, 1, 1)


def test_jobs_as_one_stream(spark, tmp_path):
    with pytest.raises(J.WrongStateStore):
        J.job_states(spark.readStream.schema(J.EVENTS).parquet(str(tmp_path)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", J.STATE_STORE)
    try:
        run(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, tmp_path):
    source, sink, marks = str(tmp_path / "events"), str(tmp_path / "out"), str(tmp_path / "marks")
    serial = iter(range(10_000))

    def send(*events):
        rows = [(i, e, t, c, BEGAN + timedelta(seconds=next(serial))) for i, e, t, c in events]
        spark.createDataFrame(rows, J.EVENTS).coalesce(1).write.mode("append").parquet(source)

    def start():
        states = J.job_states(spark.readStream.schema(J.EVENTS).parquet(source), lease=4, attempts=2)
        batch = lambda df, n: df.write.mode("overwrite").parquet(f"{sink}/n={n}")
        return states.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", marks).trigger(processingTime="500 milliseconds").start()

    def results():
        try:
            return sorted((r.id, r.result, r.status, r.attempt, r.failure_code) for r in spark.read.schema(J.STATES).option("recursiveFileLookup", True).parquet(sink).collect())
        except Exception:
            return []

    def until(*wanted, most=60):
        end = time.monotonic() + most
        while time.monotonic() < end:
            if set(wanted) <= set(results()):
                return
            time.sleep(0.5)
        raise AssertionError(f"{wanted} not in {results()}")

    send(("a", "enqueue", None, None), ("a", "enqueue", None, None), ("a", "claim", "t1", None), ("a", "complete", "t0", None), ("b", "enqueue", None, None), ("b", "claim", "u1", None), ("b", "fail", "u1", "corrupt_document"))
    query = start()
    try:
        until(("a", "enqueued", "pending", 0, None), ("a", "refused", "pending", 0, None), ("a", "claimed", "processing", 1, None), ("a", "stale", "processing", 1, None), ("b", "failed", "failed", 1, "corrupt_document"))
        until(("a", "expired", "pending", 1, None))  # nobody kept the lease
        send(("a", "heartbeat", "t1", None), ("a", "claim", "t2", None))
        until(("a", "stale", "pending", 1, None), ("a", "claimed", "processing", 2, None))
    finally:
        query.stop()
    query = start()  # the state and the timer come from the checkpoint
    try:
        until(("a", "expired", "failed", 2, "interrupted_repeatedly"))
        send(("a", "enqueue", None, None), ("a", "claim", "t3", None), ("a", "heartbeat", "t3", None), ("a", "complete", "t3", None))
        until(("a", "renewed", "processing", 1, None), ("a", "completed", "completed", 1, None))
    finally:
        query.stop()
