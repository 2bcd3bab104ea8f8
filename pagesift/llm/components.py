"""Connected components of an edge table, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_enough, written


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of an edge (``a``, ``b``); one root per component.

    In each round every node moves to the least node next to it, in an order
    drawn anew by hashing, and the edges follow; a component shrinks by a
    constant factor however it is shaped, so a long chain takes few rounds.
    Every round is written to the shared folder.  Edges with a null end and from
    a node to itself count for nothing; repeated ones count once.
    """
    rounds: list[DataFrame] = []
    edges = written(edges.where("a != b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(len(rounds))).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        moved = written(near.select(F.col("a").alias("node"), F.least("near", order("a"))["to"].alias("to")), "moved")
        rounds.append(moved)
        to = small_enough(moved)  # beyond that a shuffled join, whose hot nodes Spark splits
        left = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
        ends = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b").where("x != y")
        edges = written(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds.pop().withColumnRenamed("to", "root")
    while rounds:
        after = found.select(F.col("node").alias("to"), "root")
        found = rounds.pop().join(after, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return found
