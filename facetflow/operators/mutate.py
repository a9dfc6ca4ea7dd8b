"""Batches of changes: each gives a new graph."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import facets, no_bits
from ..graph import Graph, check_keys, checked_vertices, renumbered, with_masks
from ..scratch import written
from ..sources.builders import closure
from .lookup import node
from .relations import incidence_relations, neighbor_relations


def keyed_links(graph: Graph) -> DataFrame:
    """Links by vertices: ``lower``, ``upper``, ``is_in``, ``is_out``."""
    a, b = (graph.nodes.select(F.col("nid").alias(f"{c}_nid"), F.col("vertices").alias(c)) for c in ("lower", "upper"))
    return graph.links.join(a, "lower_nid").join(b, "upper_nid").select("lower", "upper", "is_in", "is_out")


def put_simplices(graph: Graph, rows: DataFrame) -> Graph:
    """Upserts (``vertices``, ``data``, ``seq``): the last one of a node counts, and overwrites its data even by null; faces are made as needed."""
    check_keys(rows)
    last = rows.groupBy(F.array_sort("vertices").alias("vertices")).agg(F.max_by(F.struct("data"), "seq")["data"].alias("data"))
    faces = written(closure(last.select("vertices")), "faces")
    made = faces.join(last, "vertices", "left").withColumn("put", F.lit(True))
    put = last.select("vertices", F.lit(True).alias("direct"))
    old = graph.nodes.select("vertices", F.col("data").alias("old"), F.col("is_simplex").alias("given"))
    nodes = old.join(made, "vertices", "full").join(put, "vertices", "left").select("vertices", F.when(F.col("direct"), F.col("data")).otherwise(F.col("old")).alias("data"), F.coalesce("put", "given", F.lit(False)).alias("given"))
    both = faces.filter(F.size("vertices") > 1).select("vertices", F.explode(facets(F.col("vertices"))).alias("f")).select(F.col("f.face").alias("lower"), F.col("vertices").alias("upper"), F.lit(True).alias("is_in"), F.lit(True).alias("is_out"))
    return Graph.assembled(nodes, keyed_links(graph).unionByName(both))


def put_relation(graph: Graph, sources: Iterable, targets: Iterable | None = None, data=None) -> Graph:
    """One node over facets that exist: up from ``sources``, down to ``targets`` (both ways without targets). ValueError or KeyError for what doesn't fit."""
    src = [checked_vertices(x) for x in sources]
    dst = [checked_vertices(x) for x in targets] if targets is not None else src
    every = [*src, *dst]
    if not every or len({len(x) for x in every}) != 1:
        raise ValueError("facets of one dimension are needed")
    upper = sorted({v for x in every for v in x})
    if len(upper) != len(every[0]) + 1:
        raise ValueError("the facets don't make a node one dimension higher")
    for x in every:
        node(graph, x)
    spark = graph.spark
    rows = [(x, upper, x in src, x in dst) for x in map(list, dict.fromkeys(map(tuple, every)))]
    links = spark.createDataFrame(rows, "lower array<bigint>, upper array<bigint>, is_in boolean, is_out boolean")
    kind = graph.nodes.schema["data"].dataType
    made = spark.createDataFrame([(upper,)], "vertices array<bigint>").select("vertices", F.lit(data).cast(kind).alias("data"), F.lit(True).alias("new"))
    nodes = graph.nodes.select("vertices", F.col("data").alias("old"), F.col("is_simplex").alias("given")).join(made, "vertices", "full").select("vertices", F.when(F.col("new"), F.col("data")).otherwise(F.col("old")).alias("data"), F.coalesce("given", F.lit(False)).alias("given"))
    return Graph.assembled(nodes, keyed_links(graph).unionByName(links))


def put_relations(graph: Graph, rows: DataFrame) -> Graph:
    """A table of links (``lower``, ``upper``, ``is_in``, ``is_out``): upper nodes are made, lower ones have to be there (KeyError)."""
    if not rows.join(graph.nodes, F.col("lower") == F.col("vertices"), "left_anti").isEmpty():
        raise KeyError("a facet is missing")
    if not rows.filter((F.size("upper") != F.size("lower") + 1) | (F.size(F.array_except("lower", "upper")) > 0)).isEmpty():
        raise ValueError("a facet doesn't fit its node")
    made = rows.select(F.col("upper").alias("vertices")).distinct().join(graph.nodes.select("vertices"), "vertices", "left_anti")
    nodes = graph.nodes.select("vertices", "data", F.col("is_simplex").alias("given")).unionByName(made, allowMissingColumns=True)
    return Graph.assembled(nodes.withColumn("given", F.coalesce("given", F.lit(False))), keyed_links(graph).unionByName(rows.select("lower", "upper", "is_in", "is_out")))


def set_item(graph: Graph, rows: DataFrame) -> Graph:
    """Data of nodes that exist; others are put as simplices."""
    last = rows.groupBy(F.array_sort("vertices").alias("vertices")).agg(F.max_by(F.struct("data"), "seq")["data"].alias("data"))
    new = last.join(graph.nodes.select("vertices"), "vertices", "left_anti")
    given = last.select("vertices", F.col("data").alias("_d"), F.lit(True).alias("_hit"))
    nodes = graph.nodes.join(given, "vertices", "left").withColumn("data", F.when(F.col("_hit"), F.col("_d")).otherwise(F.col("data")))
    changed = Graph(written(nodes.drop("_d", "_hit"), "set"), graph.links)
    return changed if new.isEmpty() else put_simplices(changed, new.withColumn("seq", F.lit(0)))


def remove_nodes(graph: Graph, keys: DataFrame, with_cofaces: bool = False) -> Graph:
    """Nodes (``vertices``) go, with all nodes above them if asked; else those above stop being simplices. ValueError if one is missing. The others are numbered anew, without holes."""
    keys = keys.select(F.array_sort("vertices").alias("vertices")).distinct()
    if not keys.join(graph.nodes, "vertices", "left_anti").isEmpty():
        raise ValueError("a node to remove isn't there")
    gone = graph.nodes.join(keys, "vertices", "left_semi").select("nid")
    if with_cofaces:
        level, step = gone, graph.links.select(F.col("lower_nid").alias("nid"), "upper_nid")
        top = graph.nodes.agg(F.max("dim")).first()[0] or 0
        for _ in range(top):
            level = level.join(step, "nid").select(F.col("upper_nid").alias("nid")).distinct()
            gone = gone.union(level)
    gone = written(gone.distinct(), "gone")
    nodes = graph.nodes.join(gone, "nid", "left_anti")
    links = graph.links.join(gone.select(F.col("nid").alias("lower_nid")), "lower_nid", "left_anti").join(gone.select(F.col("nid").alias("upper_nid")), "upper_nid", "left_anti")
    nodes, links = renumbered(nodes.withColumn("given", F.col("is_simplex")), links.select(graph.links.columns))
    return Graph(*with_masks(nodes, links))


def remove_relation(graph: Graph, one, other, dir_in: bool | None = None) -> Graph:
    """The link between two nodes goes, or one direction of it; a node that keeps none goes too. ValueError if they aren't linked or aren't a dimension apart."""
    a, b = checked_vertices(one), checked_vertices(other)
    if abs(len(a) - len(b)) != 1:
        raise ValueError("linked nodes are one dimension apart")
    lower, upper = (a, b) if len(a) < len(b) else (b, a)
    try:
        lo, up = node(graph, lower).first()["nid"], node(graph, upper).first()["nid"]
    except KeyError as e:
        raise ValueError("a node isn't there") from e
    hit = (F.col("lower_nid") == lo) & (F.col("upper_nid") == up)
    if graph.links.filter(hit).isEmpty():
        raise ValueError("the nodes aren't linked")
    links = graph.links
    if dir_in in (None, True):
        links = links.withColumn("is_in", F.col("is_in") & ~hit)
    if dir_in in (None, False):
        links = links.withColumn("is_out", F.col("is_out") & ~hit)
    links = written(links.filter("is_in or is_out"), "links")
    changed = Graph(*with_masks(graph.nodes.withColumn("given", F.col("is_simplex")), links))
    bare = changed.nodes.filter((F.col("dim") > 0) & no_bits("in_mask") & no_bits("out_mask")).select("vertices")
    return changed if bare.isEmpty() else remove_nodes(changed, bare)


def related_nodes(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], sources: DataFrame) -> DataFrame:
    """``src``, ``dst`` with repeats: a node that is related in two of the lists comes twice."""
    near = neighbor_relations(graph, list(dists), sources).select("src", "dst")
    return near.unionAll(incidence_relations(graph, list(rel_dims), sources).select("src", "dst"))


def generalize_data(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], func: Column, sources: DataFrame | None = None) -> DataFrame:
    """``nid``, ``data``: an aggregate ``func`` over the ``data`` of related nodes, null for nodes that have none."""
    start = graph.nodes if sources is None else sources
    values = related_nodes(graph, dists, rel_dims, start).join(graph.nodes.select(F.col("nid").alias("dst"), "data"), "dst")
    return start.select("nid").join(values.groupBy(F.col("src").alias("nid")).agg(func.alias("data")), "nid", "left")


def gathered(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], func: Callable[[list], object], returns: str, sources: DataFrame | None = None) -> DataFrame:
    """``nid``, ``data``: ``func`` of the list of related nodes' data, in the order of node numbers, nulls included; a value of the type ``returns``.

    For functions that no aggregate expresses: a node's list is in one task, as the function wants it whole. A node without
    related nodes has func([]); a node related in two of the lists is in the list twice.
    """
    start = graph.nodes if sources is None else sources
    values = related_nodes(graph, dists, rel_dims, start).join(graph.nodes.select(F.col("nid").alias("dst"), "data"), "dst")

    @F.arrow_udf(returns)
    def of(order: pa.Array, data: pa.Array) -> object:
        return func(data.take(pc.sort_indices(order)).to_pylist())

    found = written(start.select("nid").join(values.groupBy(F.col("src").alias("nid")).agg(of("dst", "data").alias("data"), F.lit(True).alias("any")), "nid", "left"), "gathered")
    if found.filter("any is null").isEmpty():
        return found.drop("any")
    return found.select("nid", F.when(F.col("any"), F.col("data")).otherwise(F.lit(func([])).cast(returns)).alias("data"))


def generalized(graph: Graph, dists: Iterable[int], rel_dims: Iterable[int], func: Column, sources: DataFrame | None = None) -> Graph:
    """generalize_data() stored in the graph: the nodes asked for (all without ``sources``) get the aggregate as their data, those without related nodes null."""
    got = generalize_data(graph, dists, rel_dims, func, sources).select(F.col("nid").alias("_n"), F.col("data").alias("_v"))
    kind = graph.nodes.schema["data"].dataType
    nodes = graph.nodes.join(got, F.col("nid") == F.col("_n"), "left").withColumn("data", F.when(F.col("_n").isNotNull(), F.col("_v").cast(kind)).otherwise(F.col("data")))
    return Graph(written(nodes.drop("_n", "_v"), "generalized"), graph.links)


def propagate_data(graph: Graph, updates: DataFrame, dists: Iterable[int], rel_dims: Iterable[int], add: bool = False, update: Callable[[Column, Column], Column] | None = None) -> Graph:
    """Updates (``vertices``, ``data``, ``seq``) reach all related nodes: summed to what is there with ``add``, else the last one replaces it. KeyError if a node is missing.

    ``update`` (old data, update's data) gives the new data instead: it is applied to a node once for each update that
    reaches it, in the order of ``seq``; one that reaches it several times is applied so often.
    """
    at = updates.select(F.array_sort("vertices").alias("vertices"), F.col("data").alias("value"), "seq").join(graph.nodes.select("vertices", "nid"), "vertices", "left")
    if not at.filter("nid is null").isEmpty():
        raise KeyError("a node isn't there")
    pairs = related_nodes(graph, dists, rel_dims, at.select("nid").distinct())
    hits = pairs.join(at, F.col("src") == F.col("nid")).select("dst", "value", "seq")
    kind = graph.nodes.schema["data"].dataType
    if update is not None:
        # the updates of one node only: as many as it has related nodes
        got = hits.groupBy("dst").agg(F.array_sort(F.collect_list(F.struct("seq", "value"))).alias("_v"))
        new = F.when(F.col("_v").isNull(), F.col("data")).otherwise(F.aggregate("_v", F.col("data"), lambda old, x: update(old, x["value"]).cast(kind)))
    elif add:
        got = hits.groupBy("dst").agg(F.sum("value").alias("_v"))
        new = F.when(F.col("_v").isNull(), F.col("data")).otherwise(F.coalesce("data", F.lit(0)) + F.col("_v"))
    else:
        got = hits.groupBy("dst").agg(F.max_by(F.struct("value"), "seq").alias("_v"))
        new = F.when(F.col("_v").isNull(), F.col("data")).otherwise(F.col("_v.value"))
    return Graph(graph.nodes.join(got, F.col("nid") == F.col("dst"), "left").withColumn("data", new.cast(kind)), graph.links)


def completions(nodes: DataFrame, dim: int) -> DataFrame:
    """``vertices`` of sets one dimension higher whose facets are all there, and which aren't there yet.

    Pairs of nodes that share all but the last vertex are joined, then all facets are looked up: no larger candidate set arises.
    """
    own = nodes.filter(F.col("dim") == dim).select("vertices")
    part = own.select(F.slice("vertices", 1, dim).alias("head"), F.element_at("vertices", -1).alias("last"))
    pairs = part.join(part.select("head", F.col("last").alias("next")), "head").filter("last < next")
    wide = pairs.select(F.concat("head", F.array("last", "next")).alias("wide"))
    if dim == 1:
        rest = wide.select("wide", F.slice("wide", 2, 2).alias("vertices"))
        full = rest.join(own, "vertices", "left_semi").select(F.col("wide").alias("vertices"))
    else:
        # the two facets that were joined lack the last two vertices; the others are looked up
        each = wide.select("wide", F.explode(facets(F.col("wide"))).alias("f")).filter(F.col("f.pos") < dim).select("wide", F.col("f.face").alias("vertices"))
        full = each.join(own, "vertices", "left_semi").groupBy("wide").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == dim).select(F.col("wide").alias("vertices"))
    return full.join(nodes.filter(F.col("is_simplex")).select("vertices"), "vertices", "left_anti")


def generalize(graph: Graph, dims: int | Iterable[int] | None = None) -> Graph:
    """Clique completion at dimensions (all from 1 on without ``dims``, those that arise included). Data of nodes that exist stays."""
    top = graph.nodes.agg(F.max("dim")).first()[0] or 0
    if dims is None:
        todo, d = None, 1
    else:
        if isinstance(dims, (str, bool)) or not isinstance(dims, (int, Iterable)):
            raise TypeError("dimensions are integers")
        todo = [dims] if isinstance(dims, int) else list(dims)
        if any(isinstance(x, bool) or not isinstance(x, int) for x in todo):
            raise TypeError("dimensions are integers")
        if any(not 0 <= x <= top for x in todo):
            raise IndexError("there is no such dimension")
        todo = sorted(x for x in todo if x)
    while True:
        if todo is not None:
            if not todo:
                return graph
            d = todo.pop(0)
        elif d > (graph.nodes.agg(F.max("dim")).first()[0] or 0):
            return graph
        new = written(completions(graph.nodes, d), "completed")
        if not new.isEmpty():
            kept = new.join(graph.nodes.select("vertices", "data"), "vertices", "left").select("vertices", "data", F.lit(0).alias("seq"))
            graph = put_simplices(graph, kept)
        d += 1
