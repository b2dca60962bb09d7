"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.session import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long); root is the smallest node reachable.

    Each round links all neighbours of a node to the smallest of them: first the larger ones, then the smaller ones. It ends with stars, after about log(n) rounds.
    Every round is two aggregations and joins whose tables are written to the shared folder, so a lost executor repeats one round at most. The smallest
    neighbour comes from a partial aggregate; the join back has one row per node on one side, so Spark can split a node of very many neighbours.
    """
    current = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        current = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        current = cut_lineage(current)
        least = current.groupBy("a").agg(F.min("b").alias("m"))
        joined = current.join(least, "a")
        current = cut_lineage(joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        before, state = state, _state(current)
        if state == before:
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first())
