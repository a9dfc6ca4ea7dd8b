"""The graph: a table of nodes and a table of incidence links. Every operation gives a new graph or a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions.arrays import MASK_BITS, facets, full_mask
from .scratch import written

NODE_COLUMNS = ["vertices", "dim", "idx", "nid", "data", "is_simplex", "in_mask", "out_mask"]
LINK_COLUMNS = ["lower_nid", "upper_nid", "lower_dim", "missing_pos", "is_in", "is_out"]


def checked_vertices(vertices: int | Iterable[int]) -> list[int]:
    """A node's key: sorted; TypeError, ValueError or IndexError for what is no vertex, empty or negative."""
    if isinstance(vertices, bool):
        raise TypeError("a vertex is an integer")
    if isinstance(vertices, int):
        vertices = [vertices]
    if isinstance(vertices, str) or not isinstance(vertices, Iterable):
        raise TypeError("vertices are an integer or several integers")
    out = list(vertices)
    if any(isinstance(v, bool) or not isinstance(v, int) for v in out):
        raise TypeError("a vertex is an integer")
    if not out:
        raise ValueError("a node has a vertex at least")
    if min(out) < 0:
        raise IndexError("vertices aren't negative")
    return sorted(out)


def check_keys(df: DataFrame, column: str = "vertices") -> int | None:
    """One aggregate over a whole table of vertex arrays; raises what checked_vertices() would, and ValueError for a repeated vertex. Gives the largest vertex."""
    v = F.col(column)
    bad = df.agg(
        F.max(v.isNull() | (F.size(v) == 0) | F.exists(v, lambda x: x.isNull())).alias("empty"),
        F.max(F.exists(v, lambda x: x < 0)).alias("negative"),
        F.max(F.size(F.array_distinct(v)) < F.size(v)).alias("repeated"),
        F.max(F.array_max(v)).alias("top"),
    ).first()
    if bad["empty"]:
        raise ValueError("a node has a vertex at least, and no null ones")
    if bad["negative"]:
        raise IndexError("vertices aren't negative")
    if bad["repeated"]:
        raise ValueError("a vertex stands twice in a node")
    return bad["top"]


def dense_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 0, 1, ... in the order of columns, by ranges, sorts within them and the sizes of ranges: no single task sees all rows."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "indexed")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))  # a row for each partition
    return dealt.join(starts, "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


class Graph:
    """``nodes`` (vertices, dim, idx, nid, data, is_simplex, in_mask, out_mask) and ``links`` between neighbouring dimensions.

    Masks are arrays of words (see ``full_mask``), a bit for each facet that is linked. A link with ``is_in`` is walked upwards, one with ``is_out`` downwards. ``nid`` numbers nodes by dimension, then by vertices,
    without holes; a vertex's own number is its ``nid`` as long as none has been removed.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame):
        self.nodes, self.links = nodes.select(*NODE_COLUMNS), links.select(*LINK_COLUMNS)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @property
    def up(self) -> DataFrame:
        """``src`` to ``dst`` one dimension higher."""
        return self.links.filter("is_in").select(F.col("lower_nid").alias("src"), F.col("upper_nid").alias("dst"))

    @property
    def down(self) -> DataFrame:
        return self.links.filter("is_out").select(F.col("upper_nid").alias("src"), F.col("lower_nid").alias("dst"))

    @classmethod
    def assembled(cls, rows: DataFrame, relations: DataFrame | None = None, fill: bool = True) -> Graph:
        """From keyed rows (``vertices``, ``data``) and relations (``lower``, ``upper``: vertices; ``is_in``, ``is_out``).

        Without relations every node is linked both ways with all its facets, which have to be rows too. Vertices up to the
        largest one are filled in, without data and not as simplices.
        """
        rows = written(rows.withColumn("given", F.lit(True)) if "given" not in rows.columns else rows, "rows")
        top = check_keys(rows)
        if fill:
            if top is not None:
                gaps = rows.sparkSession.range(top + 1).select(F.array("id").alias("vertices")).join(rows.select("vertices"), "vertices", "left_anti")
                rows = rows.unionByName(gaps.withColumn("given", F.lit(False)), allowMissingColumns=True)
        rows = rows.withColumn("dim", (F.size("vertices") - 1).cast("int"))
        nodes = dense_index(rows.select("vertices", "dim", "data", "given"), ["dim", "vertices"], "nid")
        nodes = with_idx(nodes)
        named = nodes.select("vertices", "nid")
        if relations is None:
            pairs = nodes.filter("dim > 0").select("nid", "dim", F.explode(facets(F.col("vertices"))).alias("f")).select(F.col("nid").alias("upper_nid"), (F.col("dim") - 1).alias("lower_dim"), F.col("f.pos").alias("missing_pos"), F.col("f.face").alias("vertices"))
            links = pairs.join(named, "vertices").select(F.col("nid").alias("lower_nid"), "upper_nid", "lower_dim", "missing_pos", F.lit(True).alias("is_in"), F.lit(True).alias("is_out"))
            whole = full_mask(F.col("dim"))
            nodes = nodes.withColumn("in_mask", whole).withColumn("out_mask", whole).withColumn("is_simplex", F.col("given"))
            return cls(nodes, links)
        merged = relations.groupBy("lower", "upper").agg(F.bool_or("is_in").alias("is_in"), F.bool_or("is_out").alias("is_out"))
        missing = F.array_position(F.transform("upper", lambda v: F.array_contains("lower", v)), F.lit(False)) - 1
        links = merged.join(named.select(F.col("vertices").alias("lower"), F.col("nid").alias("lower_nid")), "lower").join(named.select(F.col("vertices").alias("upper"), F.col("nid").alias("upper_nid")), "upper")
        links = written(links.select("lower_nid", "upper_nid", (F.size("lower") - 1).cast("int").alias("lower_dim"), missing.cast("int").alias("missing_pos"), "is_in", "is_out"), "links")
        return cls(*with_masks(nodes, links))


class EdgeGraph(Graph):
    """A graph of edges that is numbered only when its nodes or links are asked for.

    What concerns vertices alone needs no numbering: a vertex's number is the vertex itself, and its neighbours at distance 1
    are the ends of its arcs. ``arcs``: ``s``, ``t``, ``data``, ``seq`` as given; ``top`` the largest vertex (None: no vertices).
    """

    def __init__(self, arcs: DataFrame, top: int | None, directed: bool, build: Callable[[], Graph]):
        self.arcs, self.top, self.directed, self._build = arcs, top, directed, build
        self._whole: Graph | None = None
        self._vertices: DataFrame | None = None

    def whole(self) -> Graph:
        if self._whole is None:
            self._whole = self._build()
        return self._whole

    @property
    def nodes(self) -> DataFrame:
        return self.whole().nodes

    @property
    def links(self) -> DataFrame:
        return self.whole().links

    @property
    def spark(self) -> SparkSession:
        return self.arcs.sparkSession

    def vertices(self) -> DataFrame:
        """``nid``, ``dim``, ``pos``: all vertices up to the largest one."""
        if self._vertices is None:
            ids = self.spark.range(0 if self.top is None else self.top + 1)
            self._vertices = ids.select(F.col("id").alias("nid"), F.lit(0).alias("dim"), F.col("id").alias("pos"))
        return self._vertices

    def steps(self) -> DataFrame:
        """``src``, ``dst``: where one walks from each vertex."""
        there = self.arcs.select(F.col("s").alias("src"), F.col("t").alias("dst"))
        return (there if self.directed else there.union(there.select("dst", "src"))).distinct()

    def weighted_steps(self) -> DataFrame:
        """``src``, ``dst``, ``w``: the same with the edge's data; both directions of an edge share them."""
        edges = self.arcs.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.max_by("data", "seq").cast("double").alias("w"), F.max(F.col("s") < F.col("t")).alias("up"), F.max(F.col("s") > F.col("t")).alias("down"))
        ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        walked = F.array(ends("a", "b"), ends("b", "a"))
        if self.directed:
            walked = F.array_compact(F.array(F.when(F.col("up"), ends("a", "b")), F.when(F.col("down"), ends("b", "a"))))
        return edges.select("w", F.explode(walked).alias("e")).select("e.src", "e.dst", "w")


def with_idx(nodes: DataFrame) -> DataFrame:
    """``idx`` from ``nid``: numbers within a dimension."""
    firsts = F.broadcast(nodes.groupBy("dim").agg(F.min("nid").alias("_first")))  # a row for each dimension
    return nodes.join(firsts, "dim").withColumn("idx", F.col("nid") - F.col("_first")).drop("_first")


def renumbered(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers without holes, after nodes have gone."""
    fresh = dense_index(nodes.drop("idx").withColumnRenamed("nid", "_old"), ["dim", "vertices"], "nid")
    names = fresh.select("_old", "nid")
    for end in ("lower_nid", "upper_nid"):
        links = links.join(names.select(F.col("_old").alias(end), F.col("nid").alias(f"_{end}")), end).drop(end).withColumnRenamed(f"_{end}", end)
    return with_idx(fresh.drop("_old")), written(links, "links")


def masked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes with ``in_mask`` and ``out_mask`` as links tell them."""
    place = F.col("lower_dim") + 1 - F.col("missing_pos")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % MASK_BITS)
    widest = links.agg(F.max("lower_dim")).first()[0] or 0
    words = (widest + 1) // MASK_BITS + 1  # one, but for nodes of more vertices than a word has bits
    flag = {"in_mask": "is_in", "out_mask": "is_out"}
    each = [F.bit_or(F.when(F.col(f) & (F.floor(place / MASK_BITS) == w), bit).otherwise(F.lit(0).cast("bigint"))).alias(f"_{m}{w}") for m, f in flag.items() for w in range(words)]
    masks = links.groupBy(F.col("upper_nid").alias("_u")).agg(*each)
    plain = nodes.drop("in_mask", "out_mask").join(masks, F.col("nid") == F.col("_u"), "left")
    own = F.floor(F.col("dim") / MASK_BITS).cast("int") + 1
    for m in flag:
        every = F.array(*(F.coalesce(f"_{m}{w}", F.lit(0)) for w in range(words)))
        plain = plain.withColumn(m, F.slice(every, 1, F.least(own, F.lit(words))))
    return plain.drop("_u", *(f"_{m}{w}" for m in flag for w in range(words)))


def flagged(plain: DataFrame, links: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """``is_simplex`` from what masks alone say, dimension by dimension: all facets have to be simplices too. ``fixed`` (``nid``, ``is_simplex``) are facets that aren't among the nodes."""
    for d in sorted(r["dim"] for r in plain.filter("dim > 1").select("dim").distinct().collect()):  # a row for each dimension
        lower = plain.filter(F.col("dim") == d - 1).select("nid", "is_simplex")
        lower = (lower if fixed is None else lower.unionByName(fixed)).select(F.col("nid").alias("lower_nid"), F.col("is_simplex").alias("_s"))
        ok = links.filter(F.col("lower_dim") == d - 1).join(lower, "lower_nid").groupBy(F.col("upper_nid").alias("_u")).agg(F.bool_and("_s").alias("_all"))
        plain = plain.join(ok, F.col("nid") == F.col("_u"), "left").withColumn("is_simplex", F.when(F.col("dim") == d, F.col("is_simplex") & F.coalesce("_all", F.lit(False))).otherwise(F.col("is_simplex"))).drop("_u", "_all")
        plain = written(plain, "flags")
    return plain


def whole_masks() -> Column:
    return (F.col("in_mask") == full_mask(F.col("dim"))) & (F.col("out_mask") == full_mask(F.col("dim")))


def with_masks(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masks from links, and the simplex flag: all facets linked both ways, and all of them simplices."""
    plain = masked(nodes.drop("is_simplex"), links)
    given = F.col("given") if "given" in nodes.columns else F.lit(True)
    plain = written(plain.withColumn("is_simplex", F.when(F.col("dim") == 0, given).otherwise(whole_masks())), "masked")
    return flagged(plain, links), links
