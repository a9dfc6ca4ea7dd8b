"""Sparse matrices of relations as tables (``k``, ``i``, ``j``, ``value``): i receives from j."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import EdgeGraph, Graph
from ..scratch import written
from .degrees import degree_list, related
from .lookup import within

#: Numbers of dense matrices that the driver takes.
DENSE = 100_000_000


def adjacency_matrices(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], dims: Iterable[int] | None = None, src_weights: DataFrame | None = None, dst_weights: DataFrame | None = None) -> DataFrame:
    """A matrix for each distance, then for each relative dimension, in the order of the lists; a repeated entry gives a matrix again.

    Rows and columns are places within ``dims``; weights (``pos``, ``weight``) multiply by source or destination.
    """
    dists, rel_dims = list(dists), list(rel_dims)
    places = within(graph, dims)
    asked = [("n", d) for d in dists] + [("i", r) for r in rel_dims]
    spark = graph.spark
    order = F.broadcast(spark.createDataFrame([(c, v, k) for k, (c, v) in enumerate(asked)], "kind string, v int, n int"))  # the lists' entries
    found = related(graph, dists, rel_dims, places).withColumnRenamed("k", "v").join(order, ["kind", "v"])
    if isinstance(graph, EdgeGraph) and dims is not None and list(dims) == [0] and not rel_dims:  # a vertex's place is its number, and nothing else is reached
        out = found.select(F.col("n").alias("k"), F.col("dst").alias("i"), F.col("src").alias("j"), F.lit(1.0).alias("value"))
    else:
        a, b = places.select(F.col("nid").alias("src"), F.col("pos").alias("j")), places.select(F.col("nid").alias("dst"), F.col("pos").alias("i"))
        out = found.join(a, "src").join(b, "dst").select(F.col("n").alias("k"), "i", "j", F.lit(1.0).alias("value"))
    for weights, place in ((src_weights, "j"), (dst_weights, "i")):
        if weights is not None:
            out = out.join(weights.select(F.col("pos").alias(place), "weight"), place).select("k", "i", "j", (F.col("value") * F.col("weight")).alias("value"))
    return out.select("k", "i", "j", "value")


def adjacency_matrix(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], dims: Iterable[int] | None = None, src_weights: DataFrame | None = None, dst_weights: DataFrame | None = None) -> DataFrame:
    """The sum of adjacency_matrices(); IndexError if there is none to add."""
    dists, rel_dims = list(dists), list(rel_dims)
    if not dists and not rel_dims:
        raise IndexError("there is no matrix to add")
    return summed(adjacency_matrices(graph, dists, rel_dims, dims, src_weights, dst_weights))


def summed(matrices: DataFrame) -> DataFrame:
    """The sum over all k: ``i``, ``j``, ``value``."""
    return matrices.groupBy("i", "j").agg(F.sum("value").alias("value"))


def tile(matrices: DataFrame, first: int, rows: int) -> DataFrame:
    return matrices.filter((F.col("i") >= first) & (F.col("i") < first + rows))


def tiles(matrices: DataFrame, n: int, rows: int) -> Iterator[DataFrame]:
    """Tiles of ``rows`` destination rows each, in turn; ValueError for none or fewer rows."""
    if rows <= 0:
        raise ValueError("a tile has a row at least")
    rows = min(rows, max(n, 1))
    return (tile(matrices, first, rows) for first in range(0, n, rows))


def tiled(matrices: DataFrame, rows: int) -> DataFrame:
    """All tiles at once: the number of each entry's tile beside it."""
    if rows <= 0:
        raise ValueError("a tile has a row at least")
    return matrices.withColumn("tile", F.floor(F.col("i") / rows).cast("bigint"))


def stacked(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Matrices of several tables (each with its number of matrices) one after the other."""
    out, base = None, 0
    for df, count in parts:
        moved = df.withColumn("k", F.col("k") + base)
        out, base = moved if out is None else out.unionByName(moved), base + count
    if out is None:
        raise ValueError("there is nothing to stack")
    return out


def concat_tiles(*sources: tuple[Iterator[DataFrame], int]) -> Iterator[DataFrame]:
    """Tiles of several generators, stacked in step; ends with the first that ends."""
    iterators = [iter(s) for s, _ in sources]
    counts = [c for _, c in sources]
    for group in zip(*iterators):  # noqa: B905
        yield stacked(list(zip(group, counts, strict=True)))


def dense(matrices: DataFrame, count: int, n: int) -> np.ndarray:
    """A small matrix table as float32 array (k, i, j), on the driver. ValueError for more than DENSE numbers."""
    if count * n * n > DENSE:
        raise ValueError(f"{count} dense matrices of {n} x {n} are too many numbers for the driver")
    out = np.zeros((count, n, n), np.float32)
    for r in matrices.collect():
        out[r["k"], r["i"], r["j"]] += r["value"]
    return out


def mean_operator(graph: Graph, most: int, dims: Iterable[int] | None = (0,)) -> DataFrame:
    """For each distance k from 1: (neighbours at k, and the node itself) over 1 + degree at k."""
    places = within(graph, dims)
    ks = list(range(1, most + 1))
    own = places.select(F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k"), "pos")  # the diagonal: so many entries a node
    near = written(adjacency_matrices(graph, ks, [], dims).select((F.col("k") + 1).alias("k"), "i", "j"), "near")  # searched once, read twice
    entries = near.union(own.select("k", F.col("pos").alias("i"), F.col("pos").alias("j")))
    # a node that some node reaches at k has itself a column there: degrees are counted by where relations begin
    degrees = entries.groupBy("k", F.col("j").alias("i")).agg((1.0 / F.count(F.lit(1))).alias("degree"))
    return entries.join(degrees, ["k", "i"]).select("k", "i", "j", F.col("degree").alias("value"))


def symmetric_norm(graph: Graph, dists: Iterable[int] = (0, 1), dims: Iterable[int] | None = (0,)) -> DataFrame:
    """Summed relations, each entry over the roots of both ends' degrees."""
    dists = list(dists)
    places = within(graph, dims)
    weights = degree_list(graph, dists, [], places, power=-0.5).join(places, "nid").select("pos", F.col("degree").alias("weight"))
    return summed(adjacency_matrices(graph, dists, [], dims, weights, weights))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sparse by sparse, matrix by matrix (equal k)."""
    right = b.select("k", F.col("i").alias("m"), F.col("j").alias("n"), F.col("value").alias("w"))
    return a.withColumnRenamed("j", "m").join(right, ["k", "m"]).groupBy("k", "i", F.col("n").alias("j")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))
