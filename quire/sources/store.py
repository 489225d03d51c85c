"""Stored datasets of elements, edges and units, and the protocol that makes a document visible all at once.

Parquet has no transactions. Rows are written by generation and batch into a folder of their own, in hash buckets of the
document's id; writing the same generation and batch again replaces that folder, so a repeated write is harmless and readers
need not drop repeats. A small pointer table names the generation and batch that count for each document, and whether they
show. Readers join the pointers, so they see all of the old rows or all of the new ones. Several writers may write at once,
each under a batch name of its own; a fence (the generation) keeps a stale writer from publishing.

A dataset lives in a version folder that the file CURRENT names; compaction writes the next version and then moves that one
file, so a reader finds a whole dataset at any time. Pointers fold in the same way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import relational as R
from quire.sources.scratch import materialize, sized_broadcast

BUCKETS = 64
POINTERS = "document_id string, generation int, batch string, visible boolean, deleted boolean, version bigint"


class StaleWriter(RuntimeError):
    """A newer attempt has written this document."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._schemas: dict[str, str] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _version(self, name: str) -> int:
        p, fs = self._fs(f"{self.root}/{name}/CURRENT")
        stream = fs.open(p)
        try:
            return int(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def _at(self, name: str, version: int | None = None) -> str:
        return f"{self.root}/{name}/v{self._version(name) if version is None else version}"

    def _switch(self, name: str, version: int) -> None:
        """Let CURRENT name a version: written beside it and moved over it in one step."""
        jvm = self.spark._jvm
        part, fs = self._fs(f"{self.root}/{name}/CURRENT.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(str(version).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fs.makeQualified(part), fs.makeQualified(self._fs(f"{self.root}/{name}/CURRENT")[0]), options)

    def create(self, name: str, schema: str) -> None:
        """An empty dataset, unless there is one. The schema is kept with it."""
        if not self._exists(f"{self.root}/{name}/CURRENT"):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.root}/{name}/schema")
            self._switch(name, 0)
        if name != "pointers":
            self.create("pointers", POINTERS)

    def _schema(self, name: str):
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(f"{self.root}/{name}/schema").schema
        return self._schemas[name]

    def raw(self, name: str) -> DataFrame:
        """All rows of all generations."""
        at = self._at(name)
        if not self._exists(at):
            return self.spark.createDataFrame([], self._schema(name)).selectExpr("*", "0 as generation", "'' as batch", "0 as bucket")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self._schema(name))
        return self.spark.read.schema(f"{schema}, generation int, batch string, bucket int").parquet(at)

    def write(self, name: str, rows: DataFrame, generation: int, batch: str = "0") -> None:
        """Rows of a generation of their documents, hidden until published."""
        bucket = F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).cast("int")
        placed = rows.select(*self._schema(name).names).withColumn("bucket", bucket)
        placed.repartition("bucket").sortWithinPartitions("document_id").write.partitionBy("bucket").mode("overwrite").parquet(f"{self._at(name)}/generation={generation}/batch={batch}")

    def _pointer_rows(self) -> DataFrame:
        at = self._at("pointers")
        return self.spark.read.schema(POINTERS).option("recursiveFileLookup", True).parquet(at) if self._exists(at) else self.spark.createDataFrame([], POINTERS)

    def pointers(self) -> DataFrame:
        """The latest pointer of each document."""
        return R.latest_per_key(self._pointer_rows(), "document_id", "version")

    def _point(self, documents: DataFrame) -> None:
        documents.select(*(f.split()[0] for f in POINTERS.split(", "))).coalesce(1).write.parquet(f"{self._at('pointers')}/{uuid.uuid4().hex}")  # a folder each, as several may write

    def next_generation(self, documents: DataFrame, attempt: int) -> int:
        """A generation above those that the documents (document_id) have, deleted ones too; of two runs the one of the greater
        attempt has the greater."""
        held = self.pointers().join(documents.select("document_id").distinct(), "document_id", "left_semi").agg(F.max("generation")).first()[0]
        return (held or 0) + attempt

    def publish(self, documents: DataFrame, generation: int, batch: str = "0") -> None:
        """Make a generation of documents (document_id) the visible one. Fails if any of them has a newer one."""
        held = self.pointers().select("document_id", F.col("generation").alias("held"), "version")
        now = materialize(documents.select("document_id").distinct().join(held, "document_id", "left"), "publish")
        if not now.where(F.col("held") > generation).isEmpty():
            raise StaleWriter(f"generation {generation}")
        self._point(now.select("document_id", F.lit(generation).alias("generation"), F.lit(batch).alias("batch"), F.lit(True).alias("visible"), F.lit(False).alias("deleted"), (F.coalesce("version", F.lit(0)) + 1).alias("version")))

    def unpublish(self, documents: DataFrame) -> None:
        """Hide documents; their rows stay and may be published again."""
        self._mark(documents, False)

    def delete_documents(self, documents: DataFrame) -> None:
        """Hide documents for good: their rows go at the next compaction. One that is not there is no error."""
        self._mark(documents, True)

    def _mark(self, documents: DataFrame, deleted: bool) -> None:
        known = self.pointers().join(documents.select("document_id").distinct(), "document_id", "left_semi")
        self._point(materialize(known.withColumns({"visible": F.lit(False), "deleted": F.lit(deleted), "version": F.col("version") + 1}), "hide"))

    def _live(self) -> DataFrame:
        return self.pointers().where("visible").select("document_id", "generation", "batch")

    def read(self, name: str, documents: list[str] | None = None) -> DataFrame:
        """Visible rows, of these documents only if given (which prunes to their buckets). The rows stay where they are if the
        pointers are few enough to be sent to them."""
        rows, live = self.raw(name), self._live()
        if documents is not None:
            ids = self.spark.createDataFrame([(d,) for d in documents], "document_id string")
            buckets = [r.b for r in ids.select(F.pmod(F.xxhash64("document_id"), F.lit(self.buckets)).alias("b")).distinct().collect()]
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("document_id").isin(documents))
            live = live.where(F.col("document_id").isin(documents))
        return rows.join(sized_broadcast(materialize(live, "live")), ["document_id", "generation", "batch"], "left_semi").select(*self._schema(name).names)

    def compact(self, name: str) -> None:
        """The next version of a dataset, without the rows of deleted documents and of generations before the one that counts.
        Rows that are written and not published yet stay."""
        held = materialize(self.pointers().select("document_id", F.col("generation").alias("held"), F.col("batch").alias("held_batch"), "deleted"), "held")
        rows = self.raw(name).join(held, "document_id", "left")
        old = F.col("deleted") | (F.col("generation") < F.col("held")) | ((F.col("generation") == F.col("held")) & (F.col("batch") != F.col("held_batch")))
        version = self._version(name)
        kept = rows.where(~F.coalesce(old, F.lit(False))).select(*self._schema(name).names, "generation", "batch", "bucket")
        kept.repartition("bucket").sortWithinPartitions("document_id").write.partitionBy("generation", "batch", "bucket").mode("overwrite").parquet(self._at(name, version + 1))
        self._switch(name, version + 1)

    def fold_pointers(self) -> None:
        """One pointer a document, in the next version of the pointer table."""
        version = self._version("pointers")
        self.pointers().coalesce(1).write.mode("overwrite").parquet(self._at("pointers", version + 1))
        self._switch("pointers", version + 1)
