"""Connected components of a graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm._store import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for the nodes of the edges ``u, v``: the smallest node reachable.

    Each round maps every node to its smallest neighbour (or itself) and contracts the edges; the smallest node of a
    component only ever maps to itself, so it is what remains. Rounds grow with the logarithm of the longest path;
    each one's tables are written to the shared folder, and nothing is gathered at the driver. Null ends and loops
    link nothing; without links the result is empty.
    """
    ends = edges.where("u <> v")
    left = written(ends.select("u", "v").union(ends.select("v", "u")).distinct(), "links")
    labels = None
    while not left.isEmpty():
        to = written(left.groupBy("u").agg(F.least("u", F.min("v")).alias("to")), "links-to")
        if labels is None:
            labels = to.select(F.col("u").alias("node"), F.col("to").alias("component"))
        else:
            labels = written(labels.join(to, F.col("component") == F.col("u"), "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        again = left.join(to, "u").select("v", F.col("to").alias("a")).join(to.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        left = written(again.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    return labels if labels is not None else left.select(F.col("u").alias("node"), F.col("v").alias("component"))
