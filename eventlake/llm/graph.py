"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.scratch import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the least node of its component.

    Every step is an aggregation with map-side combine and an equi-join, so a node with many
    edges is no burden for one task. Loops and nulls are ignored.
    """
    now = written(_oriented(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))))
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node move to the least of its neighbourhood
        least = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least"))
        moved = both.join(least, F.col("u") == F.col("n")).filter("v > u").select("v", F.least("least", "u").alias("u"))
        large = _oriented(moved)
        # small star: a node and its lower neighbours move to the least of them
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("least"))
        below = large.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("least").alias("v"))
        following = written(_oriented(below.unionByName(low.select(F.col("n").alias("u"), F.col("least").alias("v")))))
        last, mark, now = mark, _mark(following), following
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _oriented(edges: DataFrame) -> DataFrame:
    """Distinct edges from the greater node u to the lesser node v."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
