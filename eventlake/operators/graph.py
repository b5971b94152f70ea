"""Graphs as edge frames: components and topological layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.operators.staged import staged


def layers(edges: DataFrame, src: str = "src", dst: str = "dst", most: int = 1000) -> DataFrame:
    """(node, layer): a node's layer is the longest path to it; raises on a cycle.

    Each round takes the nodes without open predecessors out; rounds are staged, so the plan does
    not grow.
    """
    nodes = edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct()
    left, out = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")), None
    for k in range(most):
        ready = staged(nodes.join(left.select(F.col("d").alias("node")).distinct(), "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        layer = ready.withColumn("layer", F.lit(k).cast("bigint"))
        out = layer if out is None else out.unionByName(layer)
        nodes = staged(nodes.join(ready, "node", "left_anti"))
        left = staged(left.join(ready.select(F.col("node").alias("s")), "s", "left_anti"))
        if nodes.isEmpty():
            return out
    raise ValueError(f"more than {most} layers")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 100) -> DataFrame:
    """(node, component): the least node reachable, by min-label propagation with pointer jumping."""
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).union(edges.select(F.col(dst).alias("a"), F.col(src).alias("b"))).distinct()
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        hooked = labels.join(near, "node").select("node", F.least("component", "c").alias("component"))
        jumped = hooked.join(hooked.select(F.col("node").alias("component"), F.col("component").alias("up")), "component").select("node", F.least("component", "up").alias("component"))
        jumped = staged(jumped)
        if jumped.join(labels, ["node", "component"], "left_anti").isEmpty():
            return jumped
        labels = jumped
    raise ValueError(f"labels still change after {rounds} rounds")
