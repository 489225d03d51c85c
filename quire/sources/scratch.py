"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import itertools
import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_serial, SESSION = itertools.count(), uuid.uuid4().hex[:12]
_scopes = threading.local()

#: A table is broadcast only if it has no more rows and no more bytes than these.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


class NoSharedFolder(RuntimeError):
    """spark.checkpoint.dir is not set, and executors are on other machines."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A session whose executors are threads of the driver may do without: it has
    a temporary folder of its own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "quire-shared")


def scratch(spark: SparkSession) -> str:
    """The folder of this process's scratch tables, within a scope that of the scope."""
    return getattr(_scopes, "at", None) or f"{shared_dir(spark)}/quire-{SESSION}"


@contextmanager
def scope(spark: SparkSession):
    """Scratch tables that this thread writes within go when it ends: for workers that run for long. What is read of them must
    be read or written elsewhere before."""
    before = getattr(_scopes, "at", None)
    _scopes.at = f"{shared_dir(spark)}/quire-{SESSION}-scope-{next(_serial)}"
    try:
        yield
    finally:
        clean(spark)
        _scopes.at = before


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors, gives both
    sides of a later join exchanges of their own, so that adaptive execution can split a skewed key. options: of the writer."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{next(_serial)}-{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, written as by materialize(); the scratch tables that make() wrote on its way go, as nothing reads them
    any more."""
    path = f"{scratch(spark)}/{next(_serial)}-{name}"
    with scope(spark):
        df = make()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def index_dir(spark: SparkSession) -> str:
    """The folder of this process's stored indexes."""
    return f"{shared_dir(spark)}/quire-index-{SESSION}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clean(spark: SparkSession, indexes: bool = False) -> None:
    """Delete this process's scratch tables, and its stored indexes if asked. Results that were not written elsewhere can no
    longer be read."""
    for place in (scratch(spark), index_dir(spark))[: 2 if indexes else 1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast, by its counted rows and the bytes that the optimizer reads off its files."""
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > size:
        return False
    return df.limit(rows + 1).count() <= rows


def sized_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table only if it is small; else Spark plans an ordinary join. The rows are the same either way."""
    return F.broadcast(df) if is_small(df, rows) else df


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Batches of at most so many rows for what runs within, both those that the Parquet reader unpacks at once and those that go
    to Python: a row may be a whole block, and 4,096 of them are a whole file. The session's own bounds return."""
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        for name in names:
            spark.conf.set(name, before[name])
