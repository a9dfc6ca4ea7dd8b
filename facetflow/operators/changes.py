"""Changes to a graph at the cost of the change.

A changed graph is its base, read as it is, and two small tables: rows of nodes and links that take the place of the base's or
come on top. A batch reads the base by semi-joins with the keys it touches, which are sent to all tasks if they are few enough;
nothing of the base is shuffled, renumbered or written. New nodes get the numbers after the last one, and places after
the last of their dimension. ``compacted`` numbers all nodes anew, by dimension and vertices, once changes have piled up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import facets, full_mask, no_bits
from ..graph import LINK_COLUMNS, NODE_COLUMNS, Graph, check_keys, dense_index, flagged, masked, whole_masks
from ..scratch import written
from ..sources.builders import closure
from .mutate import keyed_links, remove_nodes

#: Keys that are sent to all tasks at most; more are joined by a shuffle.
SENT = 1_000_000


def _few(df: DataFrame) -> DataFrame:
    """A written table as the small side of a join, if it is small."""
    return F.broadcast(df) if df.count() <= SENT else df


class ChangedGraph(Graph):
    """``base`` with ``own_nodes`` and ``own_links`` in place of its rows of the same numbers; ``counts``: nodes by dimension, ``last``: numbers given so far."""

    def __init__(self, base: Graph, own_nodes: DataFrame, own_links: DataFrame, counts: dict[int, int], last: int):
        self.base, self.own_nodes, self.own_links, self.counts, self.last = base, own_nodes, own_links, counts, last
        nodes = base.nodes.join(_few(own_nodes.select("nid")), "nid", "left_anti").select(*NODE_COLUMNS).unionByName(own_nodes.select(*NODE_COLUMNS))
        ends = ["lower_nid", "upper_nid"]
        links = base.links.join(_few(own_links.select(*ends)), ends, "left_anti").select(*LINK_COLUMNS).unionByName(own_links.select(*LINK_COLUMNS))
        super().__init__(nodes, links.filter("is_in or is_out"))


def compacted(graph: Graph) -> Graph:
    """The same graph, numbered by dimension and vertices, with no base behind it."""
    rows = graph.nodes.select("vertices", "data", F.col("is_simplex").alias("given"))
    return Graph.assembled(rows, keyed_links(graph))


def append_simplices(graph: Graph, rows: DataFrame) -> ChangedGraph:
    """Upserts as put_simplices() makes them: ``vertices``, ``data``, ``seq``."""
    check_keys(rows)
    last = rows.groupBy(F.array_sort("vertices").alias("vertices")).agg(F.max_by(F.struct("data"), "seq")["data"].alias("data"))
    faces = written(closure(last.select("vertices")).join(last.withColumn("direct", F.lit(True)), "vertices", "left"), "faces")
    both = faces.filter(F.size("vertices") > 1).select("vertices", F.explode(facets(F.col("vertices"))).alias("f"))
    links = both.select(F.col("f.face").alias("lower"), F.col("vertices").alias("upper"), F.lit(True).alias("is_in"), F.lit(True).alias("is_out"))
    return _changed(graph, faces.select("vertices", F.lit(True).alias("put"), F.coalesce("direct", F.lit(False)).alias("direct"), "data"), links)


def append_relations(graph: Graph, rows: DataFrame) -> ChangedGraph:
    """Links as put_relations() makes them: ``lower``, ``upper``, ``is_in``, ``is_out``; upper nodes are made, lower ones have to be there (KeyError)."""
    rows = written(rows.select("lower", "upper", "is_in", "is_out"), "links")
    if not rows.filter((F.size("upper") != F.size("lower") + 1) | (F.size(F.array_except("lower", "upper")) > 0)).isEmpty():
        raise ValueError("a facet doesn't fit its node")
    lower = written(rows.select(F.col("lower").alias("vertices")).distinct(), "facets")
    if graph.nodes.join(_few(lower), "vertices", "left_semi").count() < lower.count():
        raise KeyError("a facet is missing")
    on = lambda c: F.when(F.col(c), F.lit(True)).alias(c)  # noqa: E731  a link that is there stays
    return _changed(graph, _named(graph, rows), rows.select("lower", "upper", on("is_in"), on("is_out")))


def drop_relations(graph: Graph, rows: DataFrame) -> Graph:
    """Links (``lower``, ``upper``) lose the directions ``is_in`` and ``is_out`` that are true in a row. ValueError if two nodes aren't linked. Nodes that keep no link go, which numbers all others anew."""
    rows = written(rows.select("lower", "upper", "is_in", "is_out").distinct(), "links")
    named = keyed_links(_around(graph, rows))
    if not rows.join(named.select("lower", "upper"), ["lower", "upper"], "left_anti").isEmpty():
        raise ValueError("the nodes aren't linked")
    off = lambda c: F.when(F.bool_or(c), F.lit(False)).alias(c)
    changed = _changed(graph, _named(graph, rows), rows.groupBy("lower", "upper").agg(off("is_in"), off("is_out")))
    bare = written(changed.own_nodes.filter((F.col("dim") > 0) & no_bits("in_mask") & no_bits("out_mask")).select("vertices"), "bare")
    return changed if bare.isEmpty() else remove_nodes(changed, bare)


def _around(graph: Graph, rows: DataFrame) -> Graph:
    """The part of a graph that the nodes of links make up."""
    keys = written(rows.select(F.explode(F.array("lower", "upper")).alias("vertices")).distinct(), "keys")
    nodes = written(graph.nodes.join(_few(keys), "vertices", "left_semi").select(*NODE_COLUMNS), "around")
    return Graph(nodes, graph.links.join(_few(nodes.select(F.col("nid").alias("upper_nid"))), "upper_nid", "left_semi"))


def _named(graph: Graph, rows: DataFrame) -> DataFrame:
    """The nodes of links as rows to touch, without data of their own."""
    kind = graph.nodes.schema["data"].dataType
    ends = rows.select(F.explode(F.array("lower", "upper")).alias("vertices")).distinct()
    return ends.select("vertices", F.lit(False).alias("put"), F.lit(False).alias("direct"), F.lit(None).cast(kind).alias("data"))


def _changed(graph: Graph, touched: DataFrame, updates: DataFrame) -> ChangedGraph:
    """Nodes (``vertices``, ``put``, ``direct``, ``data``) and links (``lower``, ``upper``, ``is_in``, ``is_out``: null stays as it is) on top of a graph."""
    grown = graph if isinstance(graph, ChangedGraph) else None
    counts = dict(grown.counts) if grown else {r["dim"]: r["count"] for r in graph.nodes.groupBy("dim").count().collect()}  # a row for each dimension
    last = grown.last if grown else sum(counts.values())
    kind = graph.nodes.schema["data"].dataType
    touched = written(touched.withColumn("data", F.col("data").cast(kind)), "touched")
    known = written(graph.nodes.join(_few(touched.select("vertices")), "vertices", "left_semi").select(*NODE_COLUMNS), "known")
    new = touched.join(known.select("vertices"), "vertices", "left_anti")
    top = new.agg(F.max(F.array_max("vertices"))).first()[0]
    if top is not None and top >= counts.get(0, 0):
        gaps = graph.spark.range(counts.get(0, 0), top + 1).select(F.array("id").alias("vertices")).join(touched.select("vertices"), "vertices", "left_anti")
        new = new.unionByName(gaps.withColumns({"put": F.lit(False), "direct": F.lit(False), "data": F.lit(None).cast(kind)}))
    new = written(dense_index(new.withColumn("dim", (F.size("vertices") - 1).cast("int")), ["dim", "vertices"], "_n"), "new")
    sizes = {r["dim"]: (r["first"], r["n"]) for r in new.groupBy("dim").agg(F.min("_n").alias("first"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each dimension
    place = F.col("_n")
    for d, (first, _) in sizes.items():
        place = F.when(F.col("dim") == d, F.col("_n") - first + counts.get(d, 0)).otherwise(place)
    blank = F.transform(full_mask(F.col("dim")), lambda w: F.lit(0).cast("bigint"))
    made = new.select("vertices", "dim", place.cast("bigint").alias("idx"), (F.col("_n") + last).cast("bigint").alias("nid"), "data", ((F.col("dim") == 0) & F.col("put")).alias("is_simplex"), blank.alias("in_mask"), blank.alias("out_mask"))
    toggled = known.filter("dim = 0 and not is_simplex").join(touched.filter("put").select("vertices"), "vertices", "left_semi").select("nid")
    said = touched.select("vertices", "put", "direct", F.col("data").alias("_data"))
    kept = known.join(said, "vertices").withColumn("data", F.when(F.col("direct"), F.col("_data")).otherwise(F.col("data"))).withColumn("is_simplex", F.col("is_simplex") | ((F.col("dim") == 0) & F.col("put")))
    rows = written(kept.select(*NODE_COLUMNS).unionByName(made), "rows")
    for d, (_, n) in sizes.items():
        counts[d] = counts.get(d, 0) + n
    last += sum(n for _, n in sizes.values())

    names = rows.select("vertices", "nid")
    missing = F.array_position(F.transform("upper", lambda v: F.array_contains("lower", v)), F.lit(False)) - 1
    merged = updates.groupBy("lower", "upper").agg(F.bool_or("is_in").alias("_in"), F.bool_or("is_out").alias("_out"))
    by = merged.join(names.select(F.col("vertices").alias("lower"), F.col("nid").alias("lower_nid")), "lower").join(names.select(F.col("vertices").alias("upper"), F.col("nid").alias("upper_nid")), "upper")
    asked = written(by.select("lower_nid", "upper_nid", (F.size("lower") - 1).cast("int").alias("_dim"), missing.cast("int").alias("_pos"), "_in", "_out"), "asked")
    uppers = written(asked.select("upper_nid").distinct(), "uppers")
    around = graph.links.join(_few(uppers), "upper_nid", "left_semi").select(*LINK_COLUMNS)
    ends = ["lower_nid", "upper_nid"]
    links = around.join(asked, ends, "full").select(*ends, F.coalesce("lower_dim", "_dim").alias("lower_dim"), F.coalesce("missing_pos", "_pos").alias("missing_pos"), F.coalesce("_in", "is_in", F.lit(False)).alias("is_in"), F.coalesce("_out", "is_out", F.lit(False)).alias("is_out"))
    links = written(links, "links")
    own_links = links if grown is None else written(grown.own_links.join(links.select(*ends), ends, "left_anti").select(*LINK_COLUMNS).unionByName(links), "links")
    before = None if grown is None else grown.own_nodes
    whole = ChangedGraph(graph.base if grown else graph, _over(rows, before), own_links, counts, last)
    moved = uppers.select(F.col("upper_nid").alias("nid")).union(toggled).distinct()
    now = _flagged(whole, rows.select("nid"), written(moved, "moved"))
    return ChangedGraph(whole.base, written(_over(now, before), "nodes"), own_links, counts, last)


def _over(rows: DataFrame, before: DataFrame | None) -> DataFrame:
    """Rows in place of earlier ones of the same numbers."""
    return rows.select(*NODE_COLUMNS) if before is None else before.join(rows.select("nid"), "nid", "left_anti").select(*NODE_COLUMNS).unionByName(rows.select(*NODE_COLUMNS))


def _flagged(graph: Graph, touched: DataFrame, moved: DataFrame) -> DataFrame:
    """Touched nodes and all above those whose links or flag ``moved`` (each ``nid``), with masks by all their links and the simplex flag."""
    ids, level = written(touched, "affected"), moved
    while True:  # as often as there are dimensions above at most
        above = graph.links.join(_few(level.withColumnRenamed("nid", "lower_nid")), "lower_nid", "left_semi").select(F.col("upper_nid").alias("nid")).distinct()
        level = written(above.join(ids, "nid", "left_anti"), "above")
        if level.isEmpty():
            break
        ids = written(ids.union(level), "affected")
    sent = _few(ids)
    nodes = graph.nodes.join(sent, "nid", "left_semi").select(*NODE_COLUMNS)
    held = written(graph.links.join(_few(ids.withColumnRenamed("nid", "upper_nid")), "upper_nid", "left_semi").select(*LINK_COLUMNS), "held")
    plain = masked(nodes, held).select(*NODE_COLUMNS)
    plain = written(plain.withColumn("is_simplex", F.when(F.col("dim") == 0, F.col("is_simplex")).otherwise(whole_masks())), "masked")
    below = written(held.select(F.col("lower_nid").alias("nid")).distinct().join(ids, "nid", "left_anti"), "below")
    fixed = written(graph.nodes.join(_few(below), "nid", "left_semi").select("nid", "is_simplex"), "fixed")  # whose flags stay
    return flagged(plain, held, fixed)
