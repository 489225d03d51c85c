"""Connected components of a distributed edge list: alternating large-star and small-star contraction.

Each step is a partial aggregation (the minimum neighbour of each node) and a join of two written tables, so a node with
very many neighbours is an ordinary skewed join key that adaptive execution splits. Nothing is gathered on the driver but
one count and one checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize


def _star(arcs: DataFrame, name: str) -> DataFrame:
    """arcs(u, v): link every v beyond u, and u itself, to the least of u and its neighbours."""
    arcs = materialize(arcs, f"{name}-arcs")
    least = materialize(arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
    return arcs.join(least, "u").select(F.col("u"), F.col("v"), F.col("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long), any direction, repeats and self-links allowed -> (node long, root long) for every node with
    an edge to another node but the roots themselves; root is the least node that can be reached. No edges: no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    seen = None
    for _ in range(rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, "large").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), "small")
        small = down.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("a"), F.col("m").alias("b"))
        e = materialize(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
