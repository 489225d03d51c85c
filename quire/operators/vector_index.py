"""A stored vector index with exact answers: blocks of near vectors, visited only while their bound can reach the k-th best.

Vectors are dealt to the centre they are most similar to; a block is a bounded part of a cluster, one row with its ids, its
vectors, the centre and the least and greatest angle between the centre and a member. By the triangle inequality on angles no
member of a block is nearer to a question than its centre's angle leaves open, so that angle bounds the similarity. A question
first scores the few blocks of the highest bounds; then only those whose bound reaches the k-th similarity found. Bounds are
computed where the blocks lie, from centres alone, and only pairs that must be scored leave a task.

Centres are learnt on at most SAMPLE vectors, chosen by a hash of their id; every vector is indexed. A vector of no length is
similar to nothing (0) and lies in a cluster of its own that is always visited; a unit without a vector is no hit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import search as S
from quire.sources.scratch import batch_rows, materialize, sized_broadcast

#: Vectors that centres are learnt on, most centres, vectors of a block, questions of a block, blocks scored before any is left out.
SAMPLE, CENTRES, BLOCK, QUESTIONS, FIRST = 65_536, 4096, 2048, 1024, 2
#: Folders of clusters, rounds of learning, slack of a bound against rounding.
FOLDERS, ROUNDS, MARGIN = 64, 8, 1e-6
#: Rows of a batch where a row holds a block of vectors or a group of questions.
ROWS = 8


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def centres_of(x: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 3) -> np.ndarray:
    """Spherical k-means: unit centres."""
    x = unit(x)
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, x.shape[1]))
    held = x[np.random.default_rng(seed).permutation(len(x))[:count]]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ held.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(held)
        np.add.at(sums, near, x)
        moved = unit(sums)
        held = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, held)
    return held


class VectorIndex:
    """A written index: blocks(folder, block, centre, low, high, ids, vectors)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.blocks = spark.read.schema(spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/blocks")

    @staticmethod
    def build(units: DataFrame, path: str, centres: int | None = None, block: int = BLOCK) -> VectorIndex:
        """Index units(unit_id, dense). centres: the root of the number of vectors, if not given."""
        spark, path = units.sparkSession, path.rstrip("/")
        held = units.where("dense is not null").select("unit_id", F.col("dense").cast("array<float>").alias("dense"))
        n = held.count()
        count = min(centres or max(1, int(np.sqrt(n))), CENTRES)
        sample = [r["dense"] for r in held.orderBy(F.xxhash64("unit_id"), "unit_id").limit(SAMPLE).collect()]
        learnt = centres_of(np.array(sample, np.float64), count) if sample else np.zeros((0, 0))
        id_type = held.schema["unit_id"].dataType.simpleString()

        def dealt(batches):
            for b in batches:
                x = unit(matrix(b.column("dense")))
                likeness = x @ learnt.T if len(learnt) else np.zeros((len(x), 1))
                near = np.where(np.linalg.norm(x, axis=1) > 0, likeness.argmax(axis=1), -1) if len(x) else np.zeros(0, int)
                angle = np.arccos(np.clip(likeness.max(axis=1), -1, 1)) if len(x) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("unit_id"), b.column("dense"), pa.array(near, pa.int64()), pa.array(angle, pa.float64())], ["unit_id", "dense", "cluster", "angle"])

        rows = materialize(held.mapInArrow(dealt, f"unit_id {id_type}, dense array<float>, cluster long, angle double"), "dealt")
        sizes = rows.groupBy(F.col("cluster").alias("_c")).agg(F.ceil(F.count("*") / block).alias("_parts"))  # a row a centre
        rows = rows.join(F.broadcast(sizes), F.col("cluster") == F.col("_c")).withColumn("part", F.pmod(F.xxhash64("unit_id"), F.col("_parts")))
        cells = rows.groupBy("cluster", "part").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.sort_array(F.collect_list(F.struct("unit_id", "dense"))).alias("m"))
        named = F.concat_ws(":", F.col("cluster").cast("string"), F.col("part").cast("string")).alias("block")
        cells = cells.select(F.pmod("cluster", F.lit(FOLDERS)).cast("int").alias("folder"), named, "cluster", "low", "high", F.col("m.unit_id").alias("ids"), F.flatten("m.dense").alias("vectors"))

        def centred(batches):
            for b in batches:
                of = [learnt[c].astype(np.float64).tolist() if c >= 0 else [] for c in b.column("cluster").to_pylist()]
                yield b.append_column("centre", pa.array(of, pa.list_(pa.float64()))).drop_columns(["cluster"])

        schema = f"folder int, block string, low double, high double, ids array<{id_type}>, vectors array<float>, centre array<double>"
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/schema")
        with batch_rows(spark, ROWS):
            cells.mapInArrow(centred, schema).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
        return VectorIndex(spark, path)

    def asked(self, questions: DataFrame) -> DataFrame:
        """group, asking (array<struct<question_id, dense>>): questions(question_id, dense) in bounded groups. Written."""
        q = questions.where("dense is not null").select("question_id", F.col("dense").cast("array<float>").alias("dense"))
        groups = max(1, -(-q.count() // QUESTIONS))
        return materialize(q.groupBy(F.pmod(F.xxhash64("question_id"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("question_id", "dense")).alias("asking")), "asking")

    def candidates(self, asked: DataFrame, first: int, floors: DataFrame | None = None) -> DataFrame:
        """question_id, block, bound of the blocks to score: without floors the `first` best ones of each question in each task,
        with floors(question_id, floor) all those that reach the floor of their question. A stated set of questions, in groups,
        against the heads of all blocks."""
        if floors is not None:
            of = asked.select("group", F.inline("asking")).join(floors, "question_id", "left").groupBy("group")
            asked = materialize(of.agg(F.collect_list(F.struct("question_id", "dense", "floor")).alias("asking")), "asking-floors")
        heads = self.blocks.select("block", "low", "high", "centre").crossJoin(asked)
        id_type = asked.schema["asking"].dataType.elementType["question_id"].dataType.simpleString()

        floored = floors is not None

        def run(batches):
            held: dict[int, tuple] = {}
            best: dict[tuple, list] = {}
            for b in batches:
                groups = b.column("group").to_pylist()
                for i, group in enumerate(groups):
                    if group not in held:
                        asking = b.column("asking")[i].as_py()
                        held[group] = ([q["question_id"] for q in asking], unit(np.array([q["dense"] for q in asking], np.float64)), np.array([q.get("floor") if q.get("floor") is not None else -2.0 for q in asking]))
                    names, x, floor = held[group]
                    centre = np.array(b.column("centre")[i].as_py())
                    block, low, high = (b.column(c)[i].as_py() for c in ("block", "low", "high"))
                    if len(centre):
                        angle = np.arccos(np.clip(x @ centre, -1, 1))
                        bound = np.cos(np.maximum(np.maximum(angle - high, low - angle), 0))
                        bound = np.where(np.linalg.norm(x, axis=1) > 0, bound, 0)
                    else:
                        bound = np.full(len(names), 1.0)
                    if floored:
                        for j in np.flatnonzero(bound >= floor - MARGIN):
                            best.setdefault((group, j), []).append((bound[j], block))
                    else:
                        for j in range(len(names)):
                            kept = best.setdefault((group, j), [])
                            kept.append((bound[j], block))
                            if len(kept) > 4 * first:
                                kept.sort(reverse=True)
                                del kept[first:]
            out = [(held[g][0][j], block, float(s)) for (g, j), kept in best.items() for s, block in (kept if floored else sorted(kept, reverse=True)[:first])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 3, (kind, pa.string(), pa.float64()))], ["question_id", "block", "bound"])

        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(asked.schema["asking"].dataType.elementType["question_id"].dataType)
        with batch_rows(self.spark, ROWS):  # each row carries its group of questions
            return materialize(heads.mapInArrow(run, f"question_id {id_type}, block string, bound double"), "bounded")

    def scored(self, pairs: DataFrame, questions: DataFrame, k: int) -> DataFrame:
        """pairs(question_id, block) -> the k best of each block for its questions: question_id, unit_id, similarity."""
        q = questions.where("dense is not null").select("question_id", F.col("dense").cast("array<float>").alias("dense"))
        asks = pairs.join(q, "question_id").groupBy("block", F.pmod(F.xxhash64("question_id"), F.lit(max(1, -(-q.count() // QUESTIONS)))).alias("group"))
        asks = materialize(asks.agg(F.collect_list(F.struct("question_id", "dense")).alias("asking")), "asks").drop("group")
        rows = self.blocks.select("block", "ids", "vectors").join(sized_broadcast(asks), "block")
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = f"question_id {pairs.schema['question_id'].dataType.simpleString()}, unit_id {self.blocks.schema['ids'].dataType.elementType.simpleString()}, similarity double"
        schema = to_arrow_schema(self.spark.createDataFrame([], kinds).schema)

        def run(batches):
            for b in batches:
                for i in range(b.num_rows):
                    names, asking = b.column("ids")[i].as_py(), b.column("asking")[i].as_py()
                    x = np.asarray(b.column("vectors")[i].values.to_numpy(zero_copy_only=False), np.float64).reshape(len(names), -1)
                    a = np.array([q["dense"] for q in asking], np.float64)
                    scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(x, axis=1)
                    best = S.Best(len(asking), k)
                    best.add(np.divide(a @ x.T, scale, out=np.zeros(scale.shape), where=scale > 0), np.array(names, object))
                    yield best.batch([q["question_id"] for q in asking], schema)

        with batch_rows(self.spark, ROWS):
            return materialize(rows.mapInArrow(run, kinds), "scored")

    def top(self, questions: DataFrame, k: int, first: int = FIRST) -> DataFrame:
        """questions(question_id, dense) -> question_id, unit_id, similarity, pos: the k most similar units by exact cosine."""
        asked = self.asked(questions)
        begun = S.top(self.candidates(asked, first), "question_id", first, F.col("bound").desc(), F.col("block"), name="place")
        begun = materialize(begun.select("question_id", "block"), "first-blocks")
        found = self.scored(begun, questions, k)
        floors = S.top(found, "question_id", k, F.col("similarity").desc(), F.col("unit_id")).where(F.col("pos") == k).select("question_id", F.col("similarity").alias("floor"))
        rest = self.candidates(asked, first, floors).select("question_id", "block").join(begun, ["question_id", "block"], "left_anti")
        every = found.unionByName(self.scored(materialize(rest, "other-blocks"), questions, k))
        return S.top(every, "question_id", k, F.round("similarity", 9).desc(), F.col("unit_id"))
