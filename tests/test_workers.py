"""Several writers at once, documents that come again after their deletion, documents that fail alone, questions that end."""

import threading
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quire.operators import ingestion as N
from quire.operators import relational as R
from quire.operators import service as S
from quire.sources import items as It
from quire.sources.names import Names
from quire.streaming import jobs as J
from tests.test_service import parse, pdf


@pytest.fixture
def library(spark, tmp_path):
    return S.Library(spark, str(tmp_path / "library"), lambda files: It.extract(files, parse))


def test_a_name_is_taken_once(spark, tmp_path):
    names = Names(spark, str(tmp_path / "names"))
    with ThreadPoolExecutor(10) as pool:
        assert sum(pool.map(lambda _: names.take("a/b"), range(40))) == 1
    assert names.take("a/c") and not names.take("a/c") and names.take("a/c", stale=-1)


def test_ten_threads_enqueue_one_document_and_four_workers_share_the_jobs(spark, tmp_path):
    log = N.JobLog(spark, str(tmp_path / "jobs"))
    one, many = spark.createDataFrame([("d",)], "id string"), spark.createDataFrame([(f"d{i}",) for i in range(12)], "id string")
    with ThreadPoolExecutor(10) as pool:
        list(pool.map(lambda _: log.win(J.enqueue(one, log.rows(), F.current_timestamp())), range(10)))
    assert log.rows().count() == 1
    log.win(J.enqueue(many, log.rows(), F.current_timestamp()))
    seen, folders, lock = [], [], threading.Lock()

    def run(jobs, attempt, batch):
        rows = [r.document_id for r in jobs.collect()]
        with lock:
            seen.extend(rows)
            folders.append(batch)
        return jobs.select("document_id", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("failure_code"), F.lit(None).cast("string").alias("failure_reason"), F.col("summary"))

    workers = [N.Worker(log, run, batch=2) for _ in range(4)]
    with ThreadPoolExecutor(4) as pool:
        taken = sum(pool.map(lambda w: w.work(), workers))
    for w in workers[:1]:
        taken += w.work()
    assert taken == len(seen) == len(set(seen)) == 13 and len(folders) == len(set(folders))
    assert {r.status for r in J.latest(log.rows()).collect()} == {"completed"}


def test_a_deleted_document_comes_again(spark, library):
    one = library.submit("a.pdf", [pdf("# T\nSome words here.")])
    assert library.worker().work() == 1 and library.store.read("units").count() == 1
    library.delete(one.document_id)
    with pytest.raises(R.NotFound):
        library.job(one.job_id)
    again = library.submit("a.pdf", [pdf("# T\nSome words here.")])
    assert (again.decision, again.document_id) == ("new_job", one.document_id) and again.job_id != one.job_id
    assert library.worker().work() == 1 and library.store.read("units").count() == 1
    assert library.get(one.document_id).job.status == "completed" and len(library.list()[0]) == 1
    library.delete(one.document_id)
    assert library.submit("a.pdf", [pdf("# T\nSome words here.")]).decision == "new_job"


def test_one_document_that_raises_fails_alone(spark, library, tmp_path):
    ids = {n: library.submit(f"{n}.pdf", [pdf(f"Some {n} words here.")]) for n in ("one", "two", "bad", "four")}
    process, bad = library.process, ids["bad"].document_id

    def run(jobs, attempt, batch):
        if not jobs.where(F.col("document_id") == bad).isEmpty():
            raise RuntimeError("poisoned")
        return process(jobs, attempt, batch)

    assert N.Worker(library.log, run).work() == 4
    assert {n: library.job(x.job_id).status for n, x in ids.items()} == {"one": "completed", "two": "completed", "bad": "failed", "four": "completed"}
    assert library.job(ids["bad"].job_id).failure_code == "internal_error" and library.store.read("units").select("document_id").distinct().count() == 3
    with pytest.raises(S.Refused, match="document_not_ready"):
        library.elements(bad)
    for call in (lambda: library.elements("unknown"), lambda: library.figure("unknown", "e"), lambda: library.page_image("unknown", 1)):
        with pytest.raises(R.NotFound):
            call()


def test_a_stale_worker_shows_nothing(spark, library):
    one = library.submit("a.pdf", [pdf("Some words here.")])
    first = library.log.win(J.claim(library.log.rows(), F.current_timestamp(), 1, 0))
    time.sleep(0.1)
    second = library.log.win(J.claim(library.log.rows(), F.current_timestamp(), 1, 90))
    assert (first.first().attempt, second.first().attempt) == (1, 2)
    library.process(second, 2, second.first().lease_token).collect()
    shown = library.store.pointers().collect()
    library.process(first, 1, first.first().lease_token).collect()
    stale = spark.createDataFrame([(one.job_id, "complete", first.first().lease_token, None)], "id string, event string, token string, failure_code string")
    assert library.store.pointers().collect() == shown and shown[0].batch == second.first().lease_token and J.fenced(library.log.rows(), stale, F.current_timestamp()).count() == 0


def test_questions_are_admitted_and_end(spark, library):
    def slow():
        return spark.range(1, 2, 1, 1).select(F.expr("reflect('java.lang.Thread', 'sleep', cast(id * 20000 as bigint))")).collect()

    library._answer = lambda text, documents, **how: slow()
    library.deadline = 1.0
    began = time.monotonic()
    with pytest.raises(S.Refused, match="deadline_exceeded"):
        library.question("x")
    library.deadline = 30.0
    with pytest.raises(S.Refused, match="client_gone"):
        library.question("x", alive=lambda: False)
    assert time.monotonic() - began < 15
    library.slots = J.Slots(0, 0)
    with pytest.raises(S.Refused, match="too_many_questions"):
        library.question("x")


def test_scratch_tables_of_a_worker_go(spark, library):
    from quire.sources import scratch

    library.submit("a.pdf", [pdf("Some words here.")])
    library.worker().work()
    import os

    assert not [f for f in os.listdir(scratch.shared_dir(spark)) if "-scope-" in f]
