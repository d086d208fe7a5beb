"""Connected components of an edge table by hooking to the smallest neighbour and jumping over parents."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable, for each node of ``edges (a, b)`` (longs; loops and repeats allowed).

    Nodes without edges aren't listed. Edges point from the larger to the smaller node. In each round a node keeps the
    edge to its smallest neighbour, its parent, and hands the others on to that parent; all edges then skip over the
    parent of their lower end, so paths halve. Rounds go on until every edge ends in a root. A round is two shuffles of
    the edges; the many edges that end in one root are parted by adaptive execution.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    while True:
        w = e.select("a", "b").repartition("a").distinct().withColumn("p", F.min("b").over(Window.partitionBy("a")))
        parent = w.where("b = p").select(F.col("a").alias("y"), F.col("p").alias("up"))
        own = F.col("b") == F.col("p")
        hooked = w.select(F.when(own, F.col("a")).otherwise(F.col("b")).alias("x"), F.col("p").alias("y"), (~own).alias("moved"))
        e = hooked.join(parent, "y", "left").select(F.col("x").alias("a"), F.coalesce("up", "y").alias("b"), (F.col("moved") | F.col("up").isNotNull()).alias("moved"))
        e = cut(e, "edges")
        if e.where("moved").isEmpty():
            break
    hung = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return hung.union(e.select("b", "b").distinct())
