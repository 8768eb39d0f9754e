"""Connected components of many small graphs at once, by alternating large and small stars.

A large star links a node's greater neighbours to the least node it knows, a small star its lesser
ones.  Components become stars in rounds that grow with the logarithm of their size, not with their diameter.
Each round's edges are checkpointed, so that plans stay small and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

_BY = ["scope", "a"]


def _large(edges: DataFrame) -> DataFrame:
    ways = edges.unionByName(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    least = ways.groupBy(_BY).agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = ways.join(least, _BY).where("b > a").select("scope", F.col("b").alias("a"), F.col("m").alias("b"))
    # a node that is the least it knows has been left out above; its edge is kept by those who know it
    return moved.where("a != b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select("scope", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy(_BY).agg(F.min("b").alias("m"))
    moved = down.join(least, _BY).where("b != m").select("scope", F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("scope", "a", F.col("m").alias("b"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge upwards, to a node that has none."""
    ends = edges.select("scope", "a", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select("scope", F.col("b").alias("a"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy(_BY).agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(scope, node, component) of the nodes that have an edge: the least node of each node's component.

    edges: scope, a and b, none null; a component never leaves its scope.
    """
    stage = cut(_small(edges.where("a != b").select("scope", "a", "b")))
    while not _is_stars(stage):
        stage = cut(_small(_large(stage)))
    roots = stage.select("scope", F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stage.select("scope", F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
