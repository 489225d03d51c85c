"""The nine business operations over a store: submit, job, list, get, delete, elements, figure, page image, question. Each is a
plain function call; what it returns is a DataFrame, or a page of rows with the cursor of the next one. An HTTP layer would
map errors by their `code`."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable, Iterable
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.operators import answering as A
from quire.operators import ingestion as N
from quire.operators import relational as R
from quire.sources import files as Fi
from quire.sources import schemas
from quire.sources.scratch import materialize, scope
from quire.sources.store import Store
from quire.streaming import jobs as J


#: Seconds that a question may take.
DEADLINE = 90.0


class Refused(ValueError):
    """An operation that the state of the library does not allow; code is stable for callers."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def stage_upload(blobs: Fi.Blobs, chunks: Iterable[bytes], most: int = Fi.MAX_BYTES) -> tuple[str, int, str]:
    """Write an upload chunk by chunk under a staging key, with a running hash and a stop at the size limit, and move it to the
    key of its fingerprint: (sha256, size, key). Nothing is left of an upload that is refused."""
    digest, size, staged = hashlib.sha256(), 0, f"staging/{uuid.uuid4().hex}"

    def checked():
        nonlocal size
        for chunk in chunks:
            size += len(chunk)
            if size > most:
                raise Refused("file_too_large", f"more than {most} bytes")
            digest.update(chunk)
            yield chunk

    try:
        blobs.save_stream(staged, checked())
        if not size:
            raise Refused("empty_file")
    except Refused:
        blobs.delete(staged)
        raise
    key = f"documents/{digest.hexdigest()}.pdf"
    if blobs.exists(key):
        blobs.delete(staged)
    else:
        blobs.move(staged, key)
    return digest.hexdigest(), size, key


class Library:
    """Documents, jobs, stored datasets and blobs below one root folder."""

    def __init__(self, spark: SparkSession, root: str, extract: Callable[[DataFrame], DataFrame], slots: J.Slots | None = None, deadline: float = DEADLINE, **ingest):
        """extract: files(document_id, content) -> items, as sources.items.extract() with a parser; slots: how many questions
        run and wait; deadline: seconds that a question may take; ingest: how to ingest."""
        self.spark, self.root, self.extract, self.how = spark, root.rstrip("/"), extract, ingest
        self.store, self.blobs = Store(spark, f"{self.root}/store"), Fi.Blobs(spark, f"{self.root}/blobs")
        N.create(self.store)
        self.log = N.JobLog(spark, f"{self.root}/jobs")
        self.register = N.AppendLog(spark, f"{self.root}/documents", f"{schemas.DOCUMENTS}, deleted boolean")
        self.slots, self.deadline = slots or J.Slots(), deadline

    def documents(self) -> DataFrame:
        """Documents that are not deleted, by the newest row of each."""
        return R.latest_per_key(self.register.rows(), "id", "created_at").where("not deleted").drop("deleted")

    def _register(self, rows: DataFrame, deleted: bool) -> None:
        self.register.append(rows.withColumns({"deleted": F.lit(deleted), "created_at": F.current_timestamp()}))

    def submit(self, file_name: str, chunks: Iterable[bytes], correlation_id: str | None = None) -> Row:
        """One upload: (document_id, decision, job_id). A file that is known gives its document, and a new job only where the
        last one failed. correlation_id goes with the job, so its rows can be told from those of other requests."""
        sha256, size, key = stage_upload(self.blobs, chunks)
        one = self.spark.createDataFrame([(file_name, sha256, size, key, bytearray(self.blobs.read(key)))], "path string, sha256 string, size_bytes bigint, blob_key string, content binary")
        checked = Fi.inspect_pdf(one.withColumn("file_name", Fi.T.base_name(F.col("path")))).withColumn("problem", Fi.upload_problem()).first()
        if checked.problem:
            if not self.documents().where(F.col("sha256") == sha256).head(1):
                self.blobs.delete(key)
            raise Refused(checked.problem, file_name)
        document = one.select(I.uuid5(F.concat(F.lit("document:"), "sha256")).alias("id"), "sha256", F.lit(checked.file_name).alias("file_name"), "size_bytes", F.lit(checked.page_count).cast("int").alias("page_count"), "blob_key", F.current_timestamp().alias("created_at"))
        fresh = materialize(R.register_by_fingerprint(document, self.documents()), "fresh")
        if not fresh.isEmpty():
            self._register(fresh, False)
        decision = R.submission(materialize(document, "submitted"), J.latest(self.log.rows())).first()
        if decision.decision == "new_job":
            self.log.win(J.enqueue(document.select("id"), self.log.rows(), F.current_timestamp(), correlation_id=correlation_id))
        job = self.job_of(decision.id)
        return Row(document_id=decision.id, decision=decision.decision, job_id=job.id)

    def job_of(self, document_id: str) -> Row:
        found = J.latest(self.log.rows().where(F.col("document_id") == document_id)).orderBy(F.col("created_at").desc()).first()
        if found is None:
            raise R.NotFound(document_id)
        return found

    def job(self, job_id: str) -> Row:
        found = J.latest(self.log.rows().where(F.col("id") == job_id)).first()
        if found is None:
            raise R.NotFound(job_id)
        return found

    def list(self, limit: int | None = None, cursor: str | None = None) -> tuple[list[Row], str | None]:
        """Documents, newest first, each with its latest job's status."""
        latest = R.latest_per_key(J.latest(self.log.rows()), "document_id", "created_at", "id").select(F.col("document_id").alias("_d"), "status", F.col("id").alias("job_id"))
        rows, more = R.page_of(self.documents(), ["created_at", "id"], limit, cursor, (datetime.fromisoformat, str), descending=True)
        if not rows:
            return [], None
        page = self.spark.createDataFrame(rows, self.documents().schema)
        shown = R.with_latest(page, latest, "id", "_d").withColumn("status", R.display_status(F.col("status"))).drop("_d")
        return shown.orderBy(F.col("created_at").desc(), F.col("id").desc()).collect(), more

    def get(self, document_id: str) -> Row:
        found = self.documents().where(F.col("id") == document_id).first()
        if found is None:
            raise R.NotFound(document_id)
        return Row(document=found, job=self.job_of(document_id))

    def delete(self, document_id: str) -> None:
        """Index, then blobs, then rows, so that a deletion that stops half way can be done again; refused while a job is at
        work. A document that is not there is not found, its remains are no error."""
        document = self.documents().where(F.col("id") == document_id).first()
        if document is None:
            raise R.NotFound(document_id)
        if self.job_of(document_id).status in ("pending", "processing"):
            raise Refused("document_busy", document_id)
        self.store.delete_documents(self.spark.createDataFrame([(document_id,)], "document_id string"))
        for tree in (f"figures/{document_id}", f"pages/{document_id}", document.blob_key):
            self.blobs.delete_tree(tree)
        self.log.append(J.removed(self.log.rows(), document_id, F.current_timestamp()))
        self._register(self.spark.createDataFrame([document], self.documents().schema), True)

    def _completed(self, document_id: str) -> None:
        """Not found if the document is unknown, refused if it is not ingested."""
        if self.documents().where(F.col("id") == document_id).isEmpty():
            raise R.NotFound(document_id)
        if (status := self.job_of(document_id).status) != "completed":
            raise Refused("document_not_ready", f"{document_id} is {status}")

    def elements(self, document_id: str, limit: int | None = None, cursor: str | None = None, kind: str | None = None, page: int | None = None) -> tuple[list[Row], str | None]:
        """Elements of a completed document in reading order, each with its edges."""
        self._completed(document_id)
        rows = R.filtered(self.store.read("elements", [document_id]), kind=kind, page=page)
        got, more = R.page_of(rows, ["reading_order"], limit, cursor, (int,))
        if not got:
            return [], None
        page_rows = self.spark.createDataFrame(got, rows.schema)
        edges = R.edges_touching(self.store.read("edges", [document_id]), page_rows.select("id"))
        return R.nest_edges(page_rows, edges).orderBy("reading_order").collect(), more

    def figure(self, document_id: str, element_id: str) -> bytes:
        self._completed(document_id)
        found = self.store.read("elements", [document_id]).where((F.col("id") == element_id) & F.col("image_key").isNotNull()).first()
        if found is None or not self.blobs.exists(found.image_key):
            raise R.NotFound(element_id)
        return self.blobs.read(found.image_key)

    def page_image(self, document_id: str, page: int) -> bytes:
        self._completed(document_id)
        key = f"pages/{document_id}/{page}.png"
        if not self.blobs.exists(key):
            raise R.NotFound(key)
        return self.blobs.read(key)

    def question(self, text: str, documents: list[str] | None = None, alive: Callable[[], bool] | None = None, **how) -> Row:
        """One answer. Refused as busy if too many wait, after the deadline, or when alive() says that the asker is gone: the
        Spark jobs of the question are then cancelled."""

        def action():
            with scope(self.spark):
                return self._answer(text, documents, **how)

        end = time.monotonic() + self.deadline
        try:
            with self.slots.admit(self.deadline):
                return J.within(self.spark, end - time.monotonic(), action, alive)
        except J.Busy as e:
            raise Refused("too_many_questions", str(e)) from None
        except TimeoutError as e:
            raise Refused("deadline_exceeded", str(e)) from None
        except J.Gone as e:
            raise Refused("client_gone", str(e)) from None

    def _answer(self, text: str, documents: list[str] | None, **how) -> Row:
        names = self.documents().select(F.col("id").alias("document_id"), F.col("file_name").alias("document_name"))
        units = self.store.read("units").withColumnRenamed("id", "unit_id").join(names, "document_id")
        completed = R.completed_only(self.documents(), J.latest(self.log.rows()))
        return A.ask(self.spark, text, units, self.documents(), completed, documents, elements=self.store.read("elements"), links=self.store.read("edges"), names=names, **how).first()

    def process(self, jobs: DataFrame, attempt: int, batch: str) -> DataFrame:
        """The run of a worker: the files of these jobs, extracted and ingested."""
        documents = materialize(self.documents().join(jobs.select(F.col("document_id").alias("id")), "id", "left_semi"), "documents")
        keys = documents.select(F.concat(F.lit(f"{self.root}/blobs/"), "blob_key").alias("path"), "id")
        paths = [r.path for r in keys.toLocalIterator()]
        contents = self.spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", r"documents/([0-9a-f]{64})\.pdf$", 1).alias("sha256"), "content")
        files = contents.join(documents.select("sha256", F.col("id").alias("document_id")), "sha256").select("document_id", "content")
        leases = materialize(jobs.select(F.col("lease_token").alias("_token")), "leases")

        def held(done: DataFrame) -> DataFrame:
            """Of the documents to show, those whose lease is still this run's."""
            mine = J.latest(self.log.rows()).join(leases, F.col("lease_token") == F.col("_token"), "left_semi")
            return R.semi_lookup(done, mine.select("document_id"), "document_id")

        generation = self.store.next_generation(documents.select(F.col("id").alias("document_id")), attempt)
        return N.ingest(self.store, documents, self.extract(files), generation, batch, held=held, **self.how)

    def worker(self, **how) -> N.Worker:
        return N.Worker(self.log, self.process, **how)
