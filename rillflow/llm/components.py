"""Connected components of a distributed edge list by contraction: least neighbour, one jump, relabel, again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that edges (u, v) reach from node.

    Nodes without an edge to another node are not in the result; null ends and loops are ignored.
    Every round at least halves the nodes, so there are O(log n) rounds; a node of very many edges is
    pre-aggregated, and nothing is gathered at the driver but whether edges are left.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = written(least, "least")
        jump = least.alias("a").join(least.select(F.col("u").alias("k"), F.col("m").alias("mm")), F.col("a.m") == F.col("k"), "left")
        jump = written(jump.select("u", F.coalesce("mm", "m").alias("m")), "jump")
        left = jump.select("u", F.col("m").alias("mu"))
        right = jump.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        rest = edges.join(left, "u").join(right, "v").where("mu <> mv")
        rest = rest.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct()
        if found is None:
            found = jump
        else:
            step = jump.select(F.col("u").alias("k"), F.col("m").alias("mm"))
            found = found.join(step, found.m == step.k, "left").select("u", F.coalesce("mm", "m").alias("m"))
        old, edges = edges, written(rest, "edges")
        drop_written(old)
        drop_written(least)
    drop_written(edges)
    if found is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    return found.select(F.col("u").alias("node"), F.col("m").alias("component"))
