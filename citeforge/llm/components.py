"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeforge.llm import shared


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round maps every node to the smallest among itself and its neighbours, twice over, then
    replaces the edges' ends by what they map to and drops what became equal. A node maps within
    its component and the smallest node never moves, so no link is lost, and edges shrink by a
    factor in each round. Rounds are cut by written tables, and what nodes map to is broadcast where
    it is small; else nothing but counts reaches the driver. ``rows`` is a bound on the edges, if known.
    """
    edges = shared.materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges", rows)
    found, nodes = None, 0
    while n := edges.count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = shared.materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "hooks", 2 * n)
        fits = F.broadcast if shared.is_small(near) else (lambda side: side)
        jump = near.select(F.col("node").alias("to"), F.col("to").alias("over"))
        hooked = shared.materialize(near.join(fits(jump), "to").select("node", F.col("over").alias("to")), "hooks", 2 * n)
        end = lambda c: fits(hooked.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")))  # noqa: B023, E731
        moved = edges.join(end("a"), "a").join(end("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = shared.materialize(moved.where("a < b").distinct(), "edges", n)
        if found is None:
            found, nodes = hooked.withColumnRenamed("to", "component"), 2 * n
        else:
            step = hooked.select(F.col("node").alias("component"), "to")
            found = found.join(fits(step), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            found = shared.materialize(found, "components", nodes)
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return found
