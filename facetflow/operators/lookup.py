"""Point lookups, projections, counts."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import key_of
from ..graph import EdgeGraph, Graph, checked_vertices


def node(graph: Graph, vertices) -> DataFrame:
    """The one row of a node; KeyError if it isn't there."""
    key = checked_vertices(vertices)
    found = graph.nodes.filter(F.col("vertices") == F.array(*map(F.lit, key)).cast("array<bigint>"))
    if found.isEmpty():
        raise KeyError(tuple(key))
    return found


def get(graph: Graph, vertices) -> Any:
    return node(graph, vertices).first()["data"]


def get_many(graph: Graph, requests: DataFrame) -> DataFrame:
    """``pos``, ``data`` for requests (``pos``, ``vertices``); KeyError if any is missing. Order by ``pos`` to read them in turn."""
    joined = requests.select("pos", F.array_sort("vertices").alias("vertices")).join(graph.nodes.select("vertices", "data", F.lit(True).alias("_there")), "vertices", "left")
    missing = joined.filter("_there is null").first()
    if missing:
        raise KeyError(tuple(missing["vertices"]))
    return joined.select("pos", "data")


def contains(graph: Graph, vertices) -> bool:
    try:
        node(graph, vertices)
    except (KeyError, TypeError, ValueError, IndexError):
        return False
    return True


def node_list(graph: Graph, dims: Iterable[int] | None = None, simplex_only: bool = False) -> DataFrame:
    """``vertices``, ``dim``; without ``dims`` those above vertices."""
    out = graph.nodes.filter(F.col("dim") >= 1 if dims is None else F.col("dim").isin(list(dims)))
    return (out.filter("is_simplex") if simplex_only else out).select("vertices", "dim")


def all_nodes(graph: Graph) -> DataFrame:
    return graph.nodes.select("vertices", "dim")


def scan(graph: Graph, dim: int = 0, idx: int = 0, size: int | None = None) -> DataFrame:
    """Nodes in order from a place on; negative places count from the end."""
    counts = shape(graph)
    if dim < 0:
        dim += len(counts)
    if idx < 0:
        idx += counts[dim] if 0 <= dim < len(counts) else 0
    out = graph.nodes.filter((F.col("dim") > dim) | ((F.col("dim") == dim) & (F.col("idx") >= idx))).orderBy("nid")
    return out if size is None else out.limit(size)


def shape(graph: Graph) -> list[int]:
    """Nodes of each dimension; an empty graph has [0]."""
    found = {r["dim"]: r["count"] for r in graph.nodes.groupBy("dim").count().collect()}  # a row for each dimension
    return [found.get(d, 0) for d in range(max(found, default=0) + 1)]


def size(graph: Graph, dim: int | None = None) -> int:
    if dim is None:
        return graph.nodes.count()
    if isinstance(dim, bool) or not isinstance(dim, int):
        raise TypeError("a dimension is an integer")
    if dim < 0:
        raise IndexError("dimensions aren't negative")
    return graph.nodes.filter(F.col("dim") == dim).count()


def offsets(graph: Graph, dims: Iterable[int] | None = None) -> DataFrame:
    """``dim``, ``offset``: nodes of lower dimensions, those left out counting nothing."""
    rows = graph.nodes if dims is None else graph.nodes.filter(F.col("dim").isin(list(dims)))
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))  # a row for each dimension
    return counts.select("dim", F.coalesce(F.sum("n").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))


def within(graph: Graph, dims: Iterable[int] | None = None) -> DataFrame:
    """``nid``, ``dim``, ``pos``: places among the nodes of the selected dimensions; dimensions that don't exist are skipped."""
    dims = None if dims is None else list(dims)
    if isinstance(graph, EdgeGraph) and dims == [0]:
        return graph.vertices()
    return graph.nodes.join(F.broadcast(offsets(graph, dims)), "dim").select("nid", "dim", (F.col("offset") + F.col("idx")).alias("pos"))


def shown(graph: Graph) -> DataFrame:
    return graph.nodes.select(F.format_string("(%s): %s", F.replace(key_of("vertices"), F.lit("-"), F.lit(", ")), F.coalesce(F.col("data").cast("string"), F.lit("None"))).alias("text"))
