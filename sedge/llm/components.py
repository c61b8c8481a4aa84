"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """Row per node of an edge: node, component (the smallest node that it reaches).

    edges has longs a and b; loops and repeated edges do no harm. Each round points nodes at
    smaller ones and needs only minima by node, so a node with very many edges costs one
    partial minimum a task. Rounds grow with the logarithm of the longest chain.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = C.checkpointed(edges.distinct())
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: larger neighbours go to the smallest one around
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        # small star: smaller neighbours and the node itself go to the smallest of them
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").union(small_low.select("a", F.col("m").alias("b"))).distinct()
        new = C.checkpointed(small)
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() or edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not changed:
            break
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
