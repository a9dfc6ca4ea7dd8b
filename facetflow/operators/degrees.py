"""Degrees over chosen distances and relative dimensions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from .relations import incidence_relations, neighbor_relations


def powered(degree: Column, power: float) -> Column:
    """A degree of none stays none, whatever the power."""
    return F.when(degree != 0, F.pow(degree, F.lit(float(power)))).otherwise(F.lit(0.0))


def related(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], sources: DataFrame | None = None) -> DataFrame:
    """``src``, ``dst``, ``kind`` (n or i), ``k`` of all asked relations; repeated entries of a list count once here."""
    dists, rel_dims = list(dists), list(rel_dims)
    near = neighbor_relations(graph, dists, sources).select("src", "dst", F.lit("n").alias("kind"), F.col("dist").alias("k"))
    if not rel_dims:
        return near
    return near.union(incidence_relations(graph, rel_dims, sources).select("src", "dst", F.lit("i").alias("kind"), F.col("rel_dim").alias("k")))


def degree_list(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], sources: DataFrame | None = None, power: float = 1.0, add: float = 0.0) -> DataFrame:
    """``nid``, ``degree``: (add + number of related nodes) to a power."""
    start = (graph.nodes if sources is None else sources).select("nid")
    counts = related(graph, dists, rel_dims, sources).groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    return start.join(counts, F.col("nid") == F.col("src"), "left").select("nid", powered(F.coalesce("n", F.lit(0)) + F.lit(float(add)), power).alias("degree"))


def degree_lists(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], sources: DataFrame | None = None, power: float = 1.0, add: float = 0.0) -> DataFrame:
    """``nid``, ``kind``, ``k``, ``degree``: the same for each distance (n) and relative dimension (i)."""
    start = (graph.nodes if sources is None else sources).select("nid")
    kinds = F.array(*(F.struct(F.lit(c).alias("kind"), F.lit(k).alias("k")) for c, ks in (("n", dists), ("i", rel_dims)) for k in dict.fromkeys(ks)))
    full = start.select("nid", F.explode(kinds).alias("q")).select("nid", "q.kind", "q.k")
    counts = related(graph, dists, rel_dims, sources).groupBy(F.col("src").alias("nid"), "kind", "k").agg(F.count(F.lit(1)).alias("n"))
    return full.join(counts, ["nid", "kind", "k"], "left").select("nid", "kind", "k", powered(F.coalesce("n", F.lit(0)) + F.lit(float(add)), power).alias("degree"))
