"""The object graph: references, ancestors, the page tree, reachability.

Keys that are null match nothing; repeated rows are each answered; empty tables give empty ones. Columns that the operators
add must not be there already.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import shared_dir


def _kept(written: Callable[[DataFrame], DataFrame] | None, like: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How frames are materialised between rounds: by default a reliable checkpoint in the shared folder."""
    if written is None:
        shared_dir(like.sparkSession)
    return written or (lambda df: df.checkpoint())


def resolve(references: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """References with their targets; one that dangles, or has a null key, keeps nulls. A target given twice answers twice."""
    return references.join(objects, on, "left")


def dangling(references: DataFrame, objects: DataFrame, on: list[str]) -> DataFrame:
    """References without a target, those with null keys among them."""
    return references.join(objects.select(*on), on, "left_anti")


def rewrite(references: DataFrame, remap: DataFrame, target: str, old: str = "old", new: str = "new", on: Sequence[str] = ()) -> DataFrame:
    """References with replaced targets swapped for their successors; null successors replace nothing. `on` are keys that both
    frames share, such as the document."""
    swapped = remap.select(*on, F.col(old).alias("_old"), F.col(new).alias("_new"))
    both = references.join(swapped.withColumnsRenamed({c: f"_on_{c}" for c in on}), reduce(lambda a, b: a & b, [F.col(target) == F.col("_old"), *[F.col(c) == F.col(f"_on_{c}") for c in on]]), "left")
    return both.withColumn(target, F.coalesce("_new", target)).drop("_old", "_new", *[f"_on_{c}" for c in on])


def ordered_tree(nodes: DataFrame, root: Column | str, node: str = "node", parent: str = "parent", ord: str = "ord", by: Sequence[str] = (), written: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(by, node, level, path, ways) of the nodes below those that meet `root`: ordinals and ids on the way to each, so that
    the order of paths is the pre-order. `by` are columns that tell one tree from another, such as the document.

    A level is found from the one above it, so there is no limit to the depth, and as many rounds as levels. Nodes met again
    on their own way are cut off; null ids have no children; of equal ordinals the order is open.
    """
    keep, by = _kept(written, nodes), list(by)
    at, way = F.col(ord).cast("long"), F.col(node)
    level = keep(nodes.where(root).select(*by, way.alias("node"), F.lit(0).alias("level"), F.array(at).alias("path"), F.array(way).alias("ways")))
    levels = []
    below = nodes.select(*[F.col(c).alias(f"_by_{c}") for c in by], way.alias("_node"), F.col(parent).alias("_parent"), at.alias("_ord"))
    while not level.isEmpty():
        levels.append(level)
        met = reduce(lambda a, b: a & b, [F.col("node") == F.col("_parent"), *[F.col(c) == F.col(f"_by_{c}") for c in by]])
        found = level.join(below, met).where(~F.array_contains("ways", F.col("_node")))
        level = keep(found.select(*by, F.col("_node").alias("node"), (F.col("level") + 1).alias("level"), F.concat("path", F.array("_ord")).alias("path"), F.concat("ways", F.array("_node")).alias("ways")))
    return reduce(DataFrame.unionByName, levels) if levels else level


def nearest(own: Column | str, *ancestors: Column | str) -> Column:
    """An inherited attribute where the ancestors are columns already: the first that is set."""
    return F.coalesce(own, *ancestors)


def inherited(tree: DataFrame, nodes: DataFrame, attribute: str, node: str = "node", by: Sequence[str] = ()) -> DataFrame:
    """(by, node, attribute): each node's own value, or that of its nearest ancestor that has one. `tree` is an ordered_tree().

    A node without one has null; of a node given twice the larger value counts.
    """
    by = list(by)
    way = tree.select(*by, F.col("node").alias("_leaf"), F.posexplode("ways").alias("_up", "_on"))
    held = nodes.where(F.col(attribute).isNotNull()).select(*by, F.col(node).alias("_on"), attribute)
    found = way.join(held, [*by, "_on"]).groupBy(*by, "_leaf").agg(F.max(F.struct("_up", attribute))[attribute].alias(attribute))
    return tree.select(*by, "node").join(found.withColumnRenamed("_leaf", "node"), [*by, "node"], "left")


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", written: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All nodes that roots lead to, each once, over any graph: new nodes only go on, so loops end the search.

    Rounds are as many as the longest shortest path. `written` materialises a frame between rounds (by default a reliable
    checkpoint), so that the plan doesn't grow and lost executors cost one round at most. Null ends lead nowhere.
    """
    keep = _kept(written, edges)
    seen = keep(roots.select(F.col(roots.columns[0]).alias("node")).where("node IS NOT NULL").distinct())
    front = seen
    while True:
        front = keep(edges.join(front, edges[src] == front["node"], "left_semi").select(F.col(dst).alias("node")).where("node IS NOT NULL").distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = keep(seen.unionByName(front))


def found_objects(objects: DataFrame, types: list[str | None], subtypes: list[str | None], kind: str = "type", subkind: str = "subtype") -> DataFrame:
    """Objects of given types and subtypes; None stands for objects without one. sources.pdf.found() searches files for them."""
    hit = lambda c, given: F.col(c).isin([x for x in given if x]) | (F.col(c).isNull() & F.lit(None in given))
    return objects.where(hit(kind, types) & hit(subkind, subtypes))
