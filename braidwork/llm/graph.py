"""Connected components by alternating large and small stars, all in joins and sums that spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a"))
    least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    return both.where("y > x").join(least, "x").select(F.col("m").alias("a"), F.col("y").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("b").alias("x"), F.col("a").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    rest = down.join(least, "x").where("y <> m").select(F.col("m").alias("a"), F.col("y").alias("b"))
    return rest.union(least.select(F.col("m").alias("a"), F.col("x").alias("b")))


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the component's smallest node.

    Self-loops and repeated edges do no harm; no edges give no rows. Each round is written to the shared folder, so no
    lost executor brings back earlier rounds. Minima are summed before the shuffle and joins on a node of many edges can
    be split, so that a component of any size is spread over tasks. The rounds end when the edges no longer change.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = _digest(edges)
    while seen[0]:
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct(), "edges")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
