"""Connected components over an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import Workspace


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """node, root for every node of edges (a, b: long, not null); root is the least node of its component.

    In each round a node moves to the neighbour (or itself) of least random
    rank, and from there once more; edges are carried over and those within one
    node go. Ranks are drawn anew each round, so chains shrink by a constant
    factor as well as stars do. Least ranks are map-side aggregates, and edges
    meet them in sort-merge joins, so a node with very many edges is no one
    task's burden. Each round is a written table. No edges, no rows.
    """
    left = work.save(edges.select("a", "b").where("a <> b").distinct(), f"{name}_edges0")
    labels = None
    turn = 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("rank"), F.col(c).alias("node"))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("n")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("n"))["node"].alias("to"))
        near = work.save(near, f"{name}_near{turn}")
        onward = near.select(F.col("node").alias("via"), F.col("to").alias("end"))
        step = work.save(near.join(onward, F.col("to") == F.col("via")).select("node", F.col("end").alias("to")), f"{name}_step{turn}")
        if labels is None:
            labels = step.select("node", F.col("to").alias("label"))
        else:
            moved = step.select(F.col("node").alias("from"), "to")
            labels = labels.join(moved, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = work.save(labels, f"{name}_labels{turn}")
        at_a, at_b = step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        carried = left.join(at_a, "a").join(at_b, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        turn += 1
        left = work.save(carried.where("a <> b").distinct(), f"{name}_edges{turn}")
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    least = labels.groupBy("label").agg(F.min("node").alias("root"))
    return work.save(labels.join(least, "label").select("node", "root"), f"{name}_roots")
