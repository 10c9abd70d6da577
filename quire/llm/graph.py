"""Connected components of a link table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, written


def _least(edges: DataFrame) -> DataFrame:
    """Edges with the least neighbour of their first end (itself included); aggregated and joined, so that a hub's edges may be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the ends of links (a, b); the component is its smallest id.

    Alternating stars: each node's larger neighbours, then its smaller ones, are linked to its least neighbour, until
    all edges point at the least node of their component. The number of rounds grows with the logarithm of the
    longest chain. Self links and repeated links change nothing; ends must not be null.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        near = _least(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        new = written(small.where("u != v").distinct(), "edges")
        if new.exceptAll(edges).isEmpty() and new.count() == edges.count():
            forget(edges)
            return new.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(new.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        forget(edges)
        edges = new
