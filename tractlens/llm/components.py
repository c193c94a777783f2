"""Connected components of an edge table, as Spark jobs; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractlens.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge table (a, b): the smallest node reachable.

    Large-star and small-star steps in turn: each hangs neighbours on the smallest node of a
    neighbourhood, so path lengths shrink geometrically. A step writes its edges to the shared
    folder, which cuts the lineage; the loop ends when every node hangs on one root, which is then the
    smallest of its component. Minima are aggregated before they are joined, so a node with many
    neighbours is no single task's work.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    current = settled(pairs)
    while not _is_star_forest(current):
        current = settled(_small_star(_large_star(current)))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _is_star_forest(pairs: DataFrame) -> bool:
    """Whether every node hangs on one node only, and on none that hangs itself."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(
        pairs.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return nodes.agg(F.count_if((F.col("hangs") > 1) | (F.col("hangs") + F.col("holds") > 1))).first()[0] == 0


def _large_star(pairs: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the smallest of its neighbourhood."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u")
    return larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    hung = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
