"""Connected components of an edge table that may be larger than any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for all nodes of ``edges`` (``a``, ``b``: longs).

    Rounds of contraction: each node points to its smallest neighbour if that is smaller, pointers are followed twice, and
    edges are rewritten between what the pointers reach. Edges inside a contracted group vanish, so the table shrinks
    fast; each round is written to the shared folder. Loops, repeated edges and edges with a null end are harmless.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        low = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("low")), "pointers")
        for _ in range(2):
            low = low.alias("x").join(low.select(F.col("node").alias("_n"), F.col("low").alias("_l")), F.col("low") == F.col("_n"), "left").select("node", F.coalesce("_l", "low").alias("low"))
        low = materialize(low, "pointers")
        labels = materialize(labels.join(low.withColumnRenamed("node", "_n"), F.col("component") == F.col("_n"), "left").select("node", F.coalesce("low", "component").alias("component")), "labels")
        a = low.select(F.col("node").alias("a"), F.col("low").alias("la"))
        b = low.select(F.col("node").alias("b"), F.col("low").alias("lb"))
        edges = materialize(edges.join(a, "a").join(b, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).filter("a < b").distinct(), "edges")
    return labels
