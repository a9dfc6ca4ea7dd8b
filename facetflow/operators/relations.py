"""Neighbour and incidence relations: the two traversals that the other operators build on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import EdgeGraph, Graph
from ..scratch import written


def as_list(values: int | Iterable[int]) -> list[int]:
    return [values] if isinstance(values, int) else list(values)


#: Parts that the nodes of a dimension are dealt into where each is held against all: one key would mean one task.
SPREAD = 64
#: Nodes of a block; rows that a task gives where all pairs are the result; keys that each of such tasks has, so that hashing deals them evenly.
BLOCK, ROWS, KEYS = 1024, 1 << 21, 4


def dims_of(graph: Graph, sources: DataFrame) -> list[int]:
    if isinstance(graph, EdgeGraph) and sources is graph.vertices():
        return [0]
    own = sources if "dim" in sources.columns else sources.join(graph.nodes.select("nid", "dim"), "nid")
    return [r["dim"] for r in own.select("dim").distinct().collect()]  # a row for each dimension


def hops(graph: Graph, dims: Iterable[int] | None = None) -> DataFrame:
    """``src``, ``dst``: nodes of one dimension (of ``dims``) with a node above that leads from one to the other."""
    if isinstance(graph, EdgeGraph) and dims is not None and set(dims) <= {0}:
        return graph.steps()
    links = graph.links if dims is None else graph.links.filter(F.col("lower_dim").isin(list(dims)))
    up = links.filter("is_in").select(F.col("lower_nid").alias("src"), F.col("upper_nid").alias("mid"))
    down = links.filter("is_out").select(F.col("upper_nid").alias("mid"), F.col("lower_nid").alias("dst"))
    return up.join(down, "mid").filter("src <> dst").select("src", "dst").distinct()


def distances(hop: DataFrame, nodes: DataFrame, wanted: int | Iterable[int]) -> DataFrame:
    """``src``, ``dst``, ``dist``: exact hop counts among ``wanted``, from each of ``nodes`` (``src``).

    One breadth-first pass serves all distances: the frontier moves by a join, and pairs reached before drop out by an
    anti-join. Each round is written, so plans stay short.
    """
    wanted = sorted(set(as_list(wanted)))
    if any(d < 0 for d in wanted):
        raise ValueError("distances aren't negative")
    seen = nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("dist"))
    if not wanted or wanted[-1] == 0:
        return seen.filter(F.col("dist").isin(wanted))
    step = hop.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    if wanted[-1] > 1:
        step = written(step, "hops")  # read in every round
    frontier, parts = seen, [seen]
    for dist in range(1, wanted[-1] + 1):
        reached = frontier.join(step, F.col("dst") == F.col("_s")).select("src", F.col("_d").alias("dst")).distinct()
        done = parts[0]
        for p in parts[1:]:
            done = done.union(p)
        old = done.select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
        new = reached.join(old, (F.col("src") == F.col("_a")) & (F.col("dst") == F.col("_b")), "left_anti")
        frontier = new.withColumn("dist", F.lit(dist))
        if dist < wanted[-1]:
            frontier = written(frontier, "frontier")
        parts.append(frontier)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.filter(F.col("dist").isin(wanted))


def neighbor_relations(graph: Graph, dist: int | Iterable[int] = 1, sources: DataFrame | None = None) -> DataFrame:
    """``src``, ``dst``, ``dist`` by node number; ``sources`` (``nid``) restricts where it starts."""
    start = (graph.nodes if sources is None else sources).select(F.col("nid").alias("src"))
    return distances(hops(graph, None if sources is None else dims_of(graph, sources)), start, dist)


def incidence_relations(graph: Graph, rel_dim: int | Iterable[int] = 1, sources: DataFrame | None = None) -> DataFrame:
    """``src``, ``dst``, ``rel_dim``: nodes that many dimensions higher (by upward links only) or lower (downward only)."""
    wanted = sorted(set(as_list(rel_dim)))
    start = (graph.nodes if sources is None else sources).select(F.col("nid").alias("src"))
    own = start.withColumn("dst", F.col("src"))
    out = own.withColumn("rel_dim", F.lit(0)).filter(F.lit(0 in wanted))
    for sign, links in ((1, graph.up), (-1, graph.down)):
        step, level = links.select(F.col("src").alias("_s"), F.col("dst").alias("_d")), own
        for r in range(1, max([0, *(sign * w for w in wanted)]) + 1):
            level = level.join(step, F.col("dst") == F.col("_s")).select("src", F.col("_d").alias("dst")).distinct()
            if sign * r in wanted:
                out = out.union(level.withColumn("rel_dim", F.lit(sign * r)))
    return out


def _found(graph: Graph, vertices) -> DataFrame:
    from .lookup import node

    return node(graph, vertices)


def neighbors(graph: Graph, vertices, dist: int = 1) -> DataFrame:
    """``vertices`` of the nodes at exactly ``dist``. KeyError if the node isn't there."""
    if dist < 0:
        raise ValueError("distances aren't negative")
    found = neighbor_relations(graph, dist, _found(graph, vertices))
    return found.join(graph.nodes, F.col("dst") == F.col("nid")).select("vertices")


def incidence_neighbors(graph: Graph, vertices, rel_dim: int = 1) -> DataFrame:
    found = incidence_relations(graph, rel_dim, _found(graph, vertices))
    return found.join(graph.nodes, F.col("dst") == F.col("nid")).select("vertices")


def non_adjacency(graph: Graph, rel_dim: int = 0, sources: DataFrame | None = None, include_self: bool = False, label: Column | None = None) -> DataFrame:
    """``src``, ``dst``: nodes ``rel_dim`` dimensions away that are not related; at 0 those that are no neighbours. With ``label`` (a column of node columns) that stands for the nodes' numbers.

    The result is by nature all pairs but a few, so name the ``sources`` (``nid``, ``dim``) on large graphs. Nodes are dealt in
    blocks by their numbers. What is shuffled is a row for each source and block, with the few related nodes of that block; it meets the
    block's nodes and becomes rows of the result there.
    """
    start = graph.nodes if sources is None else sources
    plain = rel_dim == 0 and label is None and isinstance(graph, EdgeGraph) and start is graph.vertices()
    nodes = graph.vertices() if plain else graph.nodes
    place = lambda c: F.floor(F.col(c) / BLOCK)
    own = F.col("nid") if label is None else F.struct("nid", label.alias("shown"))
    blocks = written(nodes.groupBy(F.col("dim").alias("d"), place("nid").alias("block")).agg(F.array_sort(F.collect_list(own)).alias("own")), "blocks")
    spans = blocks.groupBy("d").agg(F.min("block").alias("first"), F.max("block").alias("last"), F.count(F.lit(1)).alias("blocks"), F.sum(F.size("own")).alias("n"))
    spans = {r["d"]: r for r in spans.collect()}  # a row for each dimension
    asked = {r["d"]: r["count"] for r in start.groupBy((F.col("dim") + rel_dim).alias("d")).count().collect() if r["d"] in spans}  # the same
    tasks = -(-sum(n * spans[d]["n"] for d, n in asked.items()) // ROWS) or 1
    parts = -(-KEYS * tasks // (sum(spans[d]["blocks"] for d in asked) or 1))

    ends = F.array(*(F.struct(F.lit(d), F.lit(spans[d]["first"]), F.lit(spans[d]["last"])) for d in asked)).cast("array<struct<d:int,first:bigint,last:bigint>>")
    ends = F.broadcast(graph.spark.range(1, numPartitions=1).select(F.inline(ends)))  # a row for each dimension; a list of Python's would start Python on the executors
    source = start.select(F.col("nid").alias("src"), (F.col("dim") + rel_dim).alias("d"))
    source = source.withColumn("src_shown", F.col("src")) if label is None else source.join(nodes.select(F.col("nid").alias("src"), label.alias("src_shown")), "src")
    each = source.join(ends, "d").select("src", "src_shown", "d", F.explode(F.sequence("first", "last")).alias("block"), F.pmod(F.xxhash64("src"), F.lit(parts)).cast("int").alias("part"))
    related = (neighbor_relations(graph, 1, start) if rel_dim == 0 else incidence_relations(graph, rel_dim, start)).select("src", "dst")
    if not include_self and not rel_dim:
        related = related.union(start.select("nid", "nid"))
    without = related.groupBy("src", place("dst").alias("block")).agg(F.collect_set("dst").alias("without"))
    dealt = each.join(without, ["src", "block"], "left").repartition(tasks, "d", "block", "part")
    met = dealt.join(blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["d", "block", "part"])
    each = met.select(F.col("src_shown").alias("src"), "without", F.explode("own").alias("dst"))
    nid, dst = (F.col("dst"), F.col("dst")) if label is None else (F.col("dst.nid"), F.col("dst.shown"))
    return each.filter(F.col("without").isNull() | ~F.array_contains("without", nid)).select("src", dst.alias("dst"))


def adjacency_list(graph: Graph, rel: int = 1, incidence: bool = False, sources: DataFrame | None = None, as_vertices: bool = False) -> DataFrame:
    """``src``, ``dst`` of a relation, as node numbers or as vertex arrays."""
    found = incidence_relations(graph, rel, sources) if incidence else neighbor_relations(graph, rel, sources)
    found = found.select("src", "dst")
    if not as_vertices:
        return found
    a, b = (graph.nodes.select(F.col("nid").alias(c), F.col("vertices").alias(f"_{c}")) for c in ("src", "dst"))
    return found.join(a, "src").join(b, "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def adjacency_lists(graph: Graph, rel: int = 1, incidence: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """``src``, ``offset`` (entries of all earlier nodes' lists), ``targets``: a sorted list for each node, empty where nothing is related. By nature a node's list is one row."""
    start = (graph.nodes if sources is None else sources).select(F.col("nid").alias("src"))
    lists = adjacency_list(graph, rel, incidence, sources).groupBy(F.col("src").alias("_s")).agg(F.array_sort(F.collect_list("dst")).alias("targets"))
    every = start.join(lists, F.col("src") == F.col("_s"), "left").select("src", F.coalesce("targets", F.array().cast("array<bigint>")).alias("targets"))
    return running_offsets(every, "src", F.size("targets"))


def running_offsets(df: DataFrame, order: str, size) -> DataFrame:
    """Adds ``offset``: the sum of sizes before each row in an order; by ranges, so that no task sees all rows."""
    dealt = written(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).withColumn("_size", size.cast("bigint")), "ranges")
    sums = dealt.groupBy("_part").agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sums.select("_part", before.alias("_start")))  # a row for each partition
    own = F.coalesce(F.sum("_size").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_before", own).join(starts, "_part").withColumn("offset", F.col("_start") + F.col("_before")).drop("_part", "_size", "_before", "_start")
