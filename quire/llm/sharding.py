"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 by (doc_id, checksum, size) without a single-task sort: a range partitioning, the place within a
sorted partition, and the counts of the partitions before. The number is split as (l, r) in base a = ceil(sqrt(n)); each
round maps (l, r) to (r, l + f(round, r) mod a) with a keyed hash f; a result of n or more (at most about 2 sqrt(n) of the
a * a values) is permuted again until it is below n. Shard and slot are the remainder and quotient by the number of shards:
counts of shards differ by one at most and slots have no gap. DataFrame and SQL functions only.

Nulls and odd input: a null text is an empty one; a null doc_id sorts first; repeated rows are numbered each (any order
among them gives the same rows); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions, table

SHARDS, ROUNDS, KEY = 24, 6, "quire"
#: Most times that one row is permuted again. The chance that this is too few is below 1e-70 for n > 1000; for smaller n no
#: walk is longer. A row that still lies outside fails the query rather than being placed wrongly.
WALK = 64


def row_numbers(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds n (number in the order of the named columns, from 0) and rows (how many there are)."""
    at = 1 << 33  # monotonically_increasing_id is partition * 2**33 + place
    kept = materialize(rows, "rows").withColumn("_tie", F.monotonically_increasing_id())
    order = [*order, "_tie"]
    dealt = kept.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("_tie")
    placed = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), "placed").withColumns({"_part": F.floor(F.col("_at") / at), "_at": F.col("_at") % at})
    # one row for each partition: as many as there are tasks, whatever the input
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(W.partitionBy()).alias("rows"))
    return placed.join(F.broadcast(before), "_part").withColumn("n", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def feistel(number: str, side: str, rounds: int = ROUNDS, key: str = KEY) -> str:
    """SQL: the permutation of 0..side*side-1."""
    f = f"cast(conv(substring(md5(concat('{key}:', i, ':', s.r)), 1, 15), 16, 10) as bigint)"
    return f"aggregate(sequence(1, {rounds}), struct({number} div {side} as l, {number} % {side} as r), (s, i) -> struct(s.r as l, (s.l + {f}) % {side} as r), s -> s.l * {side} + s.r)"


def permuted(number: str, rows: str, side: str, **how) -> str:
    """SQL: the place of a row number in the permutation of 0..rows-1."""
    return f"aggregate(sequence(1, {WALK}), {feistel(number, side, **how)}, (x, k) -> if(x < {rows}, x, {feistel('x', side, **how)}))"


def shard_rows(docs: DataFrame, shards: int = SHARDS, **how) -> DataFrame:
    """docs(doc_id, text) -> doc_id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    numbered = row_numbers(slim, ["doc_id", "text_crc32", "size"]).withColumn("side", F.ceil(F.sqrt("rows")).cast("long"))
    placed = numbered.withColumn("place", F.expr(permuted("n", "rows", "side", **how)))
    held = placed.withColumn("place", F.when(F.col("place") < F.col("rows"), F.col("place")).otherwise(F.raise_error(F.lit("a walk did not end")).cast("long")))
    return held.select("doc_id", "size", "text_crc32", F.col("n").alias("row_number"), (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_rows(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
