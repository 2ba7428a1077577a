"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.storage import Scratch, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); a component is its smallest node."""
    with Scratch(edges.sparkSession, "contraction") as scratch:
        return saved(_contracted(edges, scratch.saved), "components")


def _contracted(edges: DataFrame, saved: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The components, by contraction.

    Each round hooks a node to its smallest neighbour below it and to where that
    one is hooked, and keeps only the distinct edges between what is left, until
    none is.  Edges shrink every round; the rounds' maps are then composed.
    All of it stays distributed and is written to the shared folder.
    """
    left = saved(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    maps = []
    while not maps or not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = saved(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("up")), "hooks")
        tops = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        labels = saved(hooks.join(tops, "up").select("node", F.col("top").alias("component")), "labels")
        maps.append(labels)
        side = lambda n: labels.select(F.col("node").alias(n), F.col("component").alias(f"c{n}"))  # noqa: E731, B023
        apart = left.join(side("a"), "a").join(side("b"), "b").filter("ca <> cb")
        left = saved(apart.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    out = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("node").alias("component"), F.col("component").alias("far"))
        out = out.join(later, "component", "left").select("node", F.coalesce("far", "component").alias("component"))
    return out
