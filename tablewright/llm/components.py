"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges(a bigint, b bigint)``; the root is the smallest node reachable.

    Each round points the neighbours of a node at its smallest neighbour, larger ones
    first, then smaller ones, until nothing changes: a logarithmic number of rounds.
    Smallest neighbours are found by partial sums, so a node with very many
    neighbours is no more than one hot key of a join that can be split. Loops are
    dropped, repeated edges count once, NULLs must not occur.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while (state := _state(edges)) != seen:
        seen = state
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        edges = _pointed(both, both.filter("b > a"), keep=False)
        edges = _pointed(edges, edges, keep=True)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _pointed(neighbours: DataFrame, moved: DataFrame, keep: bool) -> DataFrame:
    """Edges from each ``moved`` neighbour, and with ``keep`` from each node, to the node's smallest."""
    least = neighbours.groupBy("a").agg(F.min("b").alias("least"))
    least = stored(least.withColumn("least", F.least("a", "least")), "least")
    edges = moved.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    if keep:
        edges = edges.unionAll(least.select("a", F.col("least").alias("b")))
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return stored(edges.distinct(), "edges")
