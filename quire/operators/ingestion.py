"""From extracted items to published units: one run over any number of documents, and the worker that takes jobs to it."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids as I
from quire.functions import text as T
from quire.operators import layout as Y
from quire.sources import items as It
from quire.sources import models as M
from quire.sources import schemas
from quire.sources.names import Names
from quire.sources.scratch import materialize, scope
from quire.sources.store import Store
from quire.streaming import jobs as J

DATASETS = {"elements": schemas.ELEMENTS, "edges": schemas.EDGES, "units": schemas.UNITS}
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def table_rows(markdown):
    """Cells of a Markdown table, without its separator line."""
    lines = F.filter(F.split(markdown, r"\r\n|\r|\n"), lambda x: ~x.rlike(T.SEPARATOR) & (F.trim(x) != ""))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def to_elements(items: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """items of documents that did not fail -> elements, with item and caption_of of the extractor kept beside."""
    placed = It.numbered(It.fragments(It.owned(It.kinds(items))))
    kind, image, table = F.col("kind"), F.col("kind") == "image", F.col("kind") == "table"
    fixed = {
        "id": I.uuid5(F.concat_ws(":", F.lit("element"), "document_id", F.col("reading_order").cast("string"))),
        "origin": F.lit("text_layer"),
        "heading_level": F.when(kind == "heading", F.coalesce(T.section_level(F.col("text")), F.lit(1))),
        "text": F.when(~image, F.col("text")),
        "table_rows": F.when(table, table_rows(F.coalesce("text", F.lit("")))),
        "image_key": F.when(image, F.concat(F.lit("figures/"), "document_id", F.lit("/"), F.col("reading_order").cast("string"), F.lit(".png"))),
        "unverified_identifiers": F.array().cast("array<string>"),
        "is_decorative": F.lit(False),
    }
    fixed |= {f"bbox_{s}": F.col(f"box.{s}") for s in ("left", "top", "right", "bottom")}
    placed = placed.withColumns(fixed)
    for field in schemas.ELEMENTS.replace(", ", ",\n").split(",\n"):
        name, dtype = field.split(" ", 1)
        placed = placed.withColumn(name, (F.col(name) if name in placed.columns else F.lit(None)).cast(dtype))
    if outline is not None:
        levels = Y.heading_levels(placed.where("kind = 'heading'").select("document_id", "id", "text", "page"), outline)
        placed = placed.join(levels.select("id", F.col("level").alias("_level")), "id", "left").withColumn("heading_level", F.coalesce("_level", "heading_level")).drop("_level")
    names = [f.split(" ")[0] for f in schemas.ELEMENTS.replace("array<array<string>>", "x").split(", ")]
    return placed.select(*names, "item", "caption_of")


def with_descriptions(elements: DataFrame, links: DataFrame, model: Callable[[str, str, str], str], **how) -> DataFrame:
    """elements with to_describe -> elements whose figures are described, as far as the model could be reached."""
    context = Y.description_context(elements, links).withColumnRenamed("image_id", "id").drop("document_id")
    wanted = elements.where("to_describe").select("id", "image_key", "labels").join(context, "id", "left")
    found = materialize(M.describe_figures(wanted, model, **how), "descriptions")
    found = found.join(wanted.select("id", "caption", "labels"), "id")
    unverified = T.unverified_identifiers(F.col("description"), F.col("labels"), F.col("caption"))
    told = found.select("id", F.col("description").alias("_d"), F.col("description_status").alias("_s"), F.when(F.col("description").isNotNull(), unverified).alias("_u"))
    joined = elements.join(told, "id", "left")
    return joined.withColumns({"description": F.coalesce("_d", "description"), "description_status": F.coalesce("_s", "description_status"), "unverified_identifiers": F.coalesce("_u", "unverified_identifiers")}).drop("_d", "_s", "_u")


def create(store: Store) -> None:
    for name, schema in DATASETS.items():
        store.create(name, schema)


def ingest(
    store: Store,
    documents: DataFrame,
    items: DataFrame,
    generation: int,
    batch: str = "0",
    page_sizes: DataFrame | None = None,
    crops: Callable[[DataFrame], DataFrame] | None = None,
    outline: DataFrame | None = None,
    describe: Callable[[str, str, str], str] | None = None,
    embed=M.embed,
    max_tokens: int = Y.MAX_TOKENS,
    held: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """documents(id, sha256, file_name), items(document_id, ..., error) as extract() gives them -> document_id, status,
    failure_code, failure_reason, summary. crops: elements -> (element_id, sha256) of the figures whose crop was stored. held: the
    documents (document_id) that this run may still show, asked just before it shows them.

    A document that fails (corrupt, or without text) ends there, the others go on: elements, triage, descriptions, links, units,
    vectors. All is stored hidden and shown by one pointer a document at the very end, so a run that dies leaves nothing to
    see, and a repeated one replaces what it had written."""
    create(store)
    items = materialize(items, "items")
    failed = materialize(It.failures(items), "failures")
    extracted = materialize(to_elements(It.succeeded(items), outline), "extracted")
    sizes = page_sizes if page_sizes is not None else extracted.select("document_id", "page").distinct().withColumns({"width": F.lit(PAGE_WIDTH), "height": F.lit(PAGE_HEIGHT)})
    hashes = crops(extracted) if crops is not None else extracted.select(F.col("id").alias("element_id"), F.lit("").alias("sha256")).limit(0)
    totals = sizes.groupBy("document_id").agg(F.count("*").alias("total"))
    known = materialize(It.caption_links(extracted), "known-links")
    triaged = materialize(Y.triage(extracted.drop("item", "caption_of"), hashes, sizes, totals, describe is not None), "triaged")
    links = materialize(Y.link_elements(triaged, known, sizes), "links")
    # without a model the elements are what is written already
    elements = materialize(with_descriptions(triaged, links, describe).drop("to_describe"), "elements") if describe is not None else triaged.drop("to_describe")
    units = Y.identified(Y.build_units(elements, links, max_tokens), documents)
    units = materialize(units.withColumns({"visible": F.lit(True), "dense": embed(T.embedding_text(F.col("heading_path"), F.col("text")))}), "units")
    for name, rows in (("elements", elements), ("edges", links), ("units", units)):
        store.write(name, rows, generation, batch)
    done = extracted.select("document_id").distinct().join(failed.select("document_id"), "document_id", "left_anti")
    store.publish(held(done) if held is not None else done, generation, batch)
    made = Y.job_summary(elements, links, units)
    fields = [f.split(":")[0] for f in schemas.SUMMARY[len("struct<") : -1].split(",")]
    summary = made.select("document_id", F.struct(*(F.col(f).cast("bigint").alias(f) for f in fields)).alias("summary"))
    outcome = documents.select(F.col("id").alias("document_id")).join(failed.withColumnRenamed("reason", "failure_reason"), "document_id", "left").join(summary, "document_id", "left")
    lost = F.col("failure_code").isNull() & F.col("summary").isNull()  # no item at all
    code = F.when(lost, "no_extractable_text").otherwise(F.col("failure_code"))
    return outcome.select("document_id", F.when(code.isNull(), "completed").otherwise("failed").alias("status"), code.alias("failure_code"), "failure_reason", "summary")


# Worker ---------------------------------------------------------------------------------------------------------------


class AppendLog:
    """Rows in a folder that several writers append to at once: each append is a folder of its own, complete or not there."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.append(spark.createDataFrame([], schema))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)

    def append(self, rows: DataFrame) -> DataFrame:
        """Append rows; returns them as they were written, so that what follows sees the same tokens and times."""
        at = f"{self.path}/{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows.select(*self.spark.createDataFrame([], self.schema).columns).coalesce(1).write.parquet(at)
        return self.spark.read.schema(self.schema).parquet(at)


class JobLog(AppendLog):
    """The event log of jobs: every change appends rows; the state of a job is its newest row. A claim and a new job are theirs
    who take their name first."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, f"{path.rstrip('/')}/events", schemas.JOBS)
        self.names = Names(spark, f"{path.rstrip('/')}/names")

    def win(self, rows: DataFrame) -> DataFrame:
        """Append those of the rows (claims, new jobs) that no other writer was faster to take."""
        return self.append(J.won(materialize(rows, "wanted"), self.names.take))


class Worker:
    """Takes claimable jobs, a batch at a time, to the run that processes them. While a batch runs, a heartbeat keeps its
    leases. If the run raises, the batch is halved until the document that does it stands alone; only that one's job fails, with
    a code. Several workers may share a log. Scratch tables of a batch go with it."""

    def __init__(self, log: JobLog, run: Callable[[DataFrame, int, str], DataFrame], batch: int = 64, lease: int = J.LEASE_SECONDS, budget: int = 20):
        self.log, self.run, self.batch, self.lease, self.budget = log, run, batch, lease, budget
        #: What went wrong in heartbeats.
        self.missed: list[str] = []

    def _events(self, jobs: DataFrame, event: str) -> DataFrame:
        return jobs.select("id", F.lit(event).alias("event"), F.col("lease_token").alias("token"), F.lit(None).cast("string").alias("failure_code"))

    def step(self) -> int:
        """One batch: the number of jobs taken."""
        with scope(self.log.spark):
            return self._step()

    def _processed(self, jobs: DataFrame) -> DataFrame:
        """The outcome of each document. What is raised by one document ends that one alone."""
        try:
            first = jobs.agg(F.max("attempt").alias("attempt"), F.min("lease_token").alias("name")).first()
            return materialize(self.run(jobs, first["attempt"], first["name"]), "outcome")
        except Exception as e:
            ids = sorted(r.id for r in jobs.select("id").collect())
            if len(ids) > 1:
                halves = (ids[: len(ids) // 2], ids[len(ids) // 2 :])
                one, two = (self._processed(materialize(jobs.where(F.col("id").isin(half)), "half")) for half in halves)
                return one.unionByName(two)
            code = "provider_unavailable" if isinstance(e, M.Unavailable) or f"{M.__name__}.{M.Unavailable.__name__}" in str(e) else "internal_error"
            return jobs.select("document_id", F.lit("failed").alias("status"), F.lit(code).alias("failure_code"), F.lit(str(e)[:500]).alias("failure_reason"), F.lit(None).cast(schemas.SUMMARY).alias("summary"))

    def _step(self) -> int:
        now = F.current_timestamp()
        jobs = self.log.win(J.claim(self.log.rows(), now, self.batch, self.lease)).where("status = 'processing'")
        taken = jobs.count()
        if not taken:
            return 0
        done = threading.Event()

        def beat():
            while not done.wait(self.lease / 3):
                try:
                    with scope(self.log.spark):
                        self.log.append(J.fenced(self.log.rows(), self._events(jobs, "heartbeat"), F.current_timestamp(), self.lease))
                except Exception as e:  # the next beat tries again; a lease that runs out is seen by the fence
                    self.missed.append(str(e)[:500])

        pulse = threading.Thread(target=beat, daemon=True)
        pulse.start()
        try:
            outcome = self._processed(jobs)
        finally:
            done.set()
            pulse.join()
        ended = jobs.select("id", "document_id", F.col("lease_token").alias("token")).join(outcome, "document_id")
        events = ended.select("id", F.when(F.col("status") == "completed", "complete").otherwise("fail").alias("event"), "token", "failure_code", "failure_reason", "summary")
        self.log.append(J.fenced(self.log.rows(), materialize(events, "events"), F.current_timestamp(), self.lease))
        return taken

    def work(self) -> int:
        """Batches until no job can be claimed or the budget of batches is used up: the number of jobs taken."""
        every = 0
        for _ in range(self.budget):
            taken = self.step()
            if not taken:
                break
            every += taken
        return every
