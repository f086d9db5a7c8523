"""Connected components of an edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelf.scratch import materialize


def _toward_least_neighbour(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's least neighbour."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).where("u != v").distinct()


def _toward_least_smaller(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the component of every node with an edge, named by its least node.

    Two groupings per round, a number of rounds that grows with the logarithm of the
    graph, no group ever collected.
    """
    now = edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).select("u", "v").where("u != v")
    mark = None
    while True:
        now = materialize(_toward_least_smaller(_toward_least_neighbour(now)), "stars")
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return leaves.union(roots)
