"""What the operators of this subpackage share: table access, scratch tables, Arrow batch bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import materialize, settled, shared_dir, sized_broadcast

__all__ = ["materialize", "settled", "shared_dir", "shuffle_partitions", "sized_broadcast", "small_batches", "table", "utf8", "worker_cache"]

#: Rows that one Arrow batch carries to a Python worker; texts may be long, so batches stay small.
BATCH_ROWS = 512

_held: dict = {}


def worker_cache(key: tuple, make):
    """What a Python worker keeps between tasks: the tables of one operator at a time. Workers are reused, so the tables of
    an earlier stage would else stay in memory."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound what one Python worker holds at once: a batch has at most this many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(text: Column) -> Column:
    """The text's bytes; a null text is an empty one."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
