"""Graphs from tables, generators, and storage."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import subset, subset_numbers
from ..graph import EdgeGraph, Graph, check_keys, dense_index
from ..scratch import written


def empty(spark: SparkSession, data_type: str = "double") -> Graph:
    """No nodes at all."""
    return Graph.assembled(spark.createDataFrame([], f"vertices array<bigint>, data {data_type}"), fill=False)


def keyed_edges(edges: DataFrame, src: str = "src", dst: str = "dst", data: str | None = None, seq: str | None = None) -> DataFrame:
    """``vertices`` and ``data`` of each edge, both directions as one; loops and null ends are left out; the last row (by ``seq``) gives the data."""
    return _merged(_arc_rows(edges, src, dst, data, seq))


def _arc_rows(edges: DataFrame, src: str, dst: str, data: str | None, seq: str | None) -> DataFrame:
    return edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(F.col(src).cast("bigint").alias("s"), F.col(dst).cast("bigint").alias("t"), (F.col(data) if data else F.lit(None).cast("double")).alias("data"), (F.col(seq) if seq else F.lit(0)).alias("seq"))


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.array_sort(F.array("s", "t")).alias("vertices")).agg(F.max_by("data", "seq").alias("data"))


def from_edges(edges: DataFrame, src: str = "src", dst: str = "dst", data: str | None = None, directed: bool = False, seq: str | None = None, vertices: DataFrame | None = None) -> Graph:
    """Edges, undirected or as directed arcs; loops are left out; the last row (by ``seq``) of an edge gives its data.

    ``vertices`` (``id``, ``data``) may name more vertices and their data. The source is read once: its rows are written.
    """
    rows = written(_arc_rows(edges, src, dst, data, seq), "arcs")
    own = None if vertices is None else written(vertices.select(F.col("id").cast("bigint").alias("id"), "data"), "vertices")
    ids = rows.select(F.least("s", "t").alias("low"), F.greatest("s", "t").alias("high"))
    if own is not None:
        ids = ids.union(own.select("id", "id"))
    found = ids.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count_if(F.col("low").isNull()).alias("nulls")).first()
    if found["nulls"]:
        raise ValueError("a node has a vertex at least, and no null ones")
    if found["low"] is not None and found["low"] < 0:
        raise IndexError("vertices aren't negative")
    return EdgeGraph(rows, found["high"], directed, lambda: _numbered(rows, own, directed))


def _numbered(rows: DataFrame, own: DataFrame | None, directed: bool) -> Graph:
    """All nodes and links of arcs."""
    ends = rows.select(F.explode(F.array("s", "t")).alias("v")).distinct().select(F.array("v").alias("vertices"))
    if own is not None:
        ends = ends.join(own.select(F.array("id").alias("vertices"), "data"), "vertices", "full")
    nodes = _merged(rows).unionByName(ends, allowMissingColumns=True)
    if not directed:
        return Graph.assembled(nodes)
    pair = F.array_sort(F.array("s", "t"))
    up = rows.select(F.array("s").alias("lower"), pair.alias("upper"), F.lit(True).alias("is_in"), F.lit(False).alias("is_out"))
    down = rows.select(F.array("t").alias("lower"), pair.alias("upper"), F.lit(False).alias("is_in"), F.lit(True).alias("is_out"))
    return Graph.assembled(nodes, up.union(down))


def closure(simplices: DataFrame, value: str | None = None, update: Column | None = None) -> DataFrame:
    """All faces (``vertices``) of simplices. With ``value``: each face's ``data`` is the sum over the simplices that hold it, or ``update``.

    Faces are exploded from numbers of subsets, in two steps for large simplices, so no row holds them all.
    """
    rows = simplices.select(F.array_sort("vertices").alias("own"), *([F.col(value).alias("_value")] if value else []))
    each = each_face(rows).drop("own")
    if not value:
        return each.distinct()
    return each.groupBy("vertices").agg((update if update is not None else F.sum("_value")).alias("data"))


def each_face(rows: DataFrame) -> DataFrame:
    """``rows`` (``own``: sorted vertices, and other columns) once for each face, which is in ``vertices``."""
    kept = rows.columns
    high, low = subset_numbers(F.size("own"))
    parts = rows.select(*kept, F.explode(high).alias("_high"))
    each = parts.select(*kept, F.explode(F.transform(low, lambda k: k + F.col("_high"))).alias("_number")).filter("_number > 0")
    return each.select(*kept, subset(F.col("own"), F.col("_number")).alias("vertices"))


def from_simplices(simplices: DataFrame, value: str | None = None, spread: bool = False, seq: str | None = None) -> Graph:
    """Simplices with all their faces. ``value`` stays with the simplex itself (the last by ``seq``), or is summed over all its faces with ``spread``."""
    columns = [F.array_sort("vertices").alias("vertices"), (F.col(value) if value else F.lit(None).cast("double")).alias("value"), (F.col(seq) if seq else F.lit(0)).alias("seq")]
    rows = written(simplices.select(*columns), "simplices")
    check_keys(rows)  # before anything is expanded
    if spread:
        return Graph.assembled(closure(rows, "value"))
    own = rows.groupBy("vertices").agg(F.max_by(F.struct(F.col("value").alias("data")), F.col("seq"))["data"].alias("data"))
    faces = closure(own.select("vertices")).join(own.select("vertices"), "vertices", "left_anti")
    return Graph.assembled(own.unionByName(faces, allowMissingColumns=True))


def from_collaborations(papers: DataFrame, least_citations: int = 5, most_authors: int = 10, share: float = 1.0, seed: int = 0) -> Graph:
    """Papers (``authors`` array<bigint>, ``citations``) as simplices over densely numbered authors; every face holds the citations of all papers around it.

    Papers with few citations, no authors or too many authors are left out; null and repeated authors are dropped; ``share``
    keeps that part of the papers, chosen by a hash.
    """
    authors = F.array_distinct(F.filter("authors", lambda a: a.isNotNull()))
    kept = papers.filter(F.col("citations") > least_citations).select(authors.alias("authors"), "citations").filter((F.size("authors") > 0) & (F.size("authors") <= most_authors))
    if share < 1:
        kept = kept.filter(F.pmod(F.xxhash64("authors", F.lit(seed)), F.lit(1_000_000)) < share * 1_000_000)
    kept = written(kept.withColumn("paper", F.monotonically_increasing_id()), "papers")
    flat = kept.select("paper", "citations", F.explode("authors").alias("author"))
    ids = dense_index(flat.select("author").distinct(), ["author"], "v")
    return from_simplices(flat.join(ids, "author").groupBy("paper").agg(F.array_sort(F.collect_list("v")).alias("vertices"), F.max("citations").alias("w")), "w", spread=True)


def road_network(nodes: DataFrame, arcs: DataFrame, directed: bool = True, seq: str | None = None) -> Graph:
    """Road tables: nodes (``osm_id``, ``x``, ``y``) are numbered densely and hold no data of their own type here; arcs (``u``, ``v``, ``length``) become edges, the last one (by ``seq``) telling the length of both directions. ``positions()`` gives the coordinates."""
    ids = dense_index(nodes.select("osm_id"), ["osm_id"], "v").select("osm_id", "v")
    a, b = (ids.select(F.col("osm_id").alias(c), F.col("v").alias(f"{c}_v")) for c in "uv")
    named = arcs.join(a, "u").join(b, "v").select(F.col("u_v").alias("src"), F.col("v_v").alias("dst"), F.col("length").cast("double").alias("length"), (F.col(seq) if seq else F.lit(0)).alias("seq"))
    points = ids.select(F.col("v").alias("id"), F.lit(None).cast("double").alias("data"))
    return from_edges(named, data="length", directed=directed, seq="seq", vertices=points)


def positions(nodes: DataFrame) -> DataFrame:
    """``v`` and ``point`` (x, y as floats) in the numbering of road_network()."""
    return dense_index(nodes, ["osm_id"], "v").select("v", F.array(F.col("x").cast("float"), F.col("y").cast("float")).alias("point"))


def grid_edges(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """``src``, ``dst``, ``w`` of a rows x cols grid of four neighbours; the vertex at (r, c) is r * cols + c."""
    cell = spark.range(rows * cols).select("id", F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    right = F.when(F.col("c") < cols - 1, F.col("id") + 1)
    below = F.when(F.col("r") < rows - 1, F.col("id") + cols)
    return cell.select(F.col("id").alias("src"), F.explode(F.array(right, below)).alias("dst")).filter("dst is not null").withColumn("w", F.lit(1).cast("bigint"))


def grid(spark: SparkSession, rows: int, cols: int):
    """The grid as graph, the index of (r, c), and the way back. A grid of one cell has its one vertex."""
    if rows < 1 or cols < 1:
        raise ValueError("a grid has a row and a column at least")
    points = spark.range(rows * cols).select("id", F.lit(None).cast("bigint").alias("data"))
    graph = from_edges(grid_edges(spark, rows, cols), data="w", vertices=points)
    return graph, (lambda r, c: r * cols + c), (lambda i: (i // cols, i % cols))


def euclidean(p: Column, q: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(p, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def plane(spark: SparkSession, v: int, e: int, d: int = 2, low: float = 0.0, high: float = 1.0, var: float = 0.0, connected: bool = True, seed: int = 0, metric: Callable[[Column, Column], Column] = euclidean) -> tuple[Graph, DataFrame]:
    """A random geometric graph of ``v`` points and ``e`` edges; an edge's length is the distance of its ends (by ``metric``, of two arrays) plus the size of a normal error.

    A connected one has a random tree (each point holds on to an earlier one). Returns the graph and the points.
    """
    if e > v * (v - 1) // 2 or (connected and e < v - 1):
        raise ValueError("there is no such graph")
    points = written(spark.range(v).select("id", F.array(*((F.rand(seed + k) * (high - low) + low) for k in range(d))).alias("data")), "points")
    tree = spark.range(1, v).select(F.floor(F.rand(seed + 100) * F.col("id")).cast("bigint").alias("src"), F.col("id").alias("dst")) if connected else spark.range(0).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    tree = written(tree, "tree")
    rest = e - (v - 1 if connected else 0)
    # pairs are numbered; numbers are drawn by a hash until there are enough, without listing all pairs
    total = v * (v - 1) // 2
    drawn, factor = None, 2
    while rest > 0:
        k = spark.range(min(total, rest * factor)) if rest * factor >= total else spark.range(rest * factor).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("id")).distinct()
        b = F.floor((1 + F.sqrt(1 + 8 * F.col("id").cast("double"))) / 2).cast("bigint")
        b = F.when(b * (b - 1) / 2 > F.col("id"), b - 1).when((b + 1) * b / 2 <= F.col("id"), b + 1).otherwise(b)
        pairs = k.select((F.col("id") - (b * (b - 1) / 2).cast("bigint")).alias("src"), b.alias("dst"))
        drawn = written(pairs.join(tree, ["src", "dst"], "left_anti").orderBy(F.xxhash64("src", "dst", F.lit(seed))).limit(rest), "drawn")
        if drawn.count() == rest:
            break
        factor *= 4
    pairs = tree.union(drawn) if drawn is not None else tree
    a, b = (points.select(F.col("id").alias(c), F.col("data").alias(f"p_{c}")) for c in ("src", "dst"))
    gap = metric(F.col("p_src"), F.col("p_dst"))
    edges = pairs.join(a, "src").join(b, "dst").select("src", "dst", gap.alias("gap")).withColumn("w", F.col("gap") + F.abs(F.randn(seed + 7) * F.col("gap") * var))
    return from_edges(written(edges, "edges"), data="w", vertices=points.select("id", F.lit(math.nan).alias("data"))), points


def save(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").partitionBy("dim").parquet(f"{path}/nodes")
    graph.links.write.mode("overwrite").partitionBy("lower_dim").parquet(f"{path}/links")


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/links"))
