"""Connected components of large graphs by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcraft.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the component is its least node.

    Each pass ties every node's larger neighbours to its least one (large star), then its smaller neighbours and itself (small
    star), until nothing changes. A node's minimum combines before the shuffle, and a hub's edges are joined to its one
    minimum, which Spark splits if they are many; no neighbourhood is gathered. Passes are written to the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = materialize(edges, "component-edges")
    before = None
    while (state := edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) != before:
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = materialize(large, "component-edges")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", "least"))
        edges = materialize(small.where("a <> b").distinct(), "component-edges")
    roots = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("b", "b"))
