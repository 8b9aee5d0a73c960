"""Connected components of an edge table by contraction: each round every node joins its least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rondo.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its least node.

    A round maps each node to the least of itself and its neighbours, follows these links to their ends by
    doubling and contracts the edges; the rounds end when no edge is left. Only edges and nodes are shuffled, each round cut by a
    written table.
    """
    left = cut(edges.select("a", "b").where("a <> b").distinct())
    found = None
    while True:
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up"))
        parent, moved = cut(parent), True
        while moved:
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = cut(parent.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
            parent, moved = jumped.drop("moved"), not jumped.where("moved").isEmpty()
        if found is None:
            found = parent.withColumnRenamed("up", "component")
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            found = cut(found.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")))
        top = parent.select(F.col("node").alias("a"), F.col("up").alias("ta"))
        left = left.join(top, "a").join(top.select(F.col("a").alias("b"), F.col("ta").alias("tb")), "b")
        left = cut(left.select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct())
        if left.isEmpty():
            return found
