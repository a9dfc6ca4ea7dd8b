"""Simplices and links that arrive as a stream.

Faces' sums are appended batch by batch. A growing graph is a stateful aggregate: the state has a row for each node, with the
last data put and the facets it is linked with, so repeated rows change nothing, and batches may come in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.arrays import facets
from ..graph import Graph
from ..sources.builders import closure, each_face


def stream_faces(simplices: DataFrame, path: str, checkpoint: str, value: str = "w") -> StreamingQuery:
    """Appends each batch's partial sums (``vertices``, ``data``, ``batch``) to a table; a batch that runs again replaces its own rows."""

    def put(batch: DataFrame, number: int) -> None:
        closure(batch, value).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return simplices.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_faces(spark: SparkSession, path: str) -> DataFrame:
    """``vertices``, ``data`` summed over all batches so far."""
    return spark.read.parquet(path).groupBy("vertices").agg(F.sum("data").alias("data"))


def facts(simplices: DataFrame | None, links: DataFrame | None) -> DataFrame:
    """What rows say about nodes: ``vertices``, ``put`` (seq and data, where the node itself is put), ``link`` (missing place, is_in, is_out)."""
    parts = []
    if simplices is not None:
        kind = simplices.schema["data"].dataType.simpleString()
        rows = simplices.select(F.array_sort("vertices").alias("own"), F.struct(F.col("seq").cast("bigint").alias("seq"), "data").alias("put"))
        faces = each_face(rows)
        both = F.transform(facets(F.col("vertices")), lambda f: F.struct(f["pos"].alias("pos"), F.lit(True).alias("is_in"), F.lit(True).alias("is_out")))
        linked = faces.select("vertices", F.when(F.col("vertices") == F.col("own"), F.col("put")).alias("put"), F.explode_outer(both).alias("link"))
        parts.append(linked)
    if links is not None:
        kind = "double" if simplices is None else kind
        missing = F.array_position(F.transform("upper", lambda v: F.array_contains("lower", v)), F.lit(False)) - 1
        link = F.struct(missing.cast("int").alias("pos"), F.col("is_in").alias("is_in"), F.col("is_out").alias("is_out"))
        parts.append(links.select(F.col("upper").alias("vertices"), F.lit(None).cast(f"struct<seq:bigint,data:{kind}>").alias("put"), link.alias("link")))
    if not parts:
        raise ValueError("there is nothing to put")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def stream_graph(path: str, checkpoint: str, simplices: DataFrame | None = None, links: DataFrame | None = None) -> StreamingQuery:
    """Keeps a graph from streams of simplices (``vertices``, ``data``, ``seq``) and of links (``lower``, ``upper``, ``is_in``, ``is_out``).

    The last data by ``seq`` counts (the larger of equal ones), whatever the order of arrival. The state has a row for each node; each batch writes the rows
    that it changed, and one that runs again replaces its own. streamed_graph() reads them. Vertices are distinct in a simplex.
    """
    state = facts(simplices, links).groupBy("vertices").agg(F.max("put").alias("put"), F.collect_set("link").alias("links"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return state.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def streamed_graph(spark: SparkSession, path: str) -> Graph:
    """The graph as of the last batch. A link counts as soon as both its ends are there."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("vertices").agg(F.max_by(F.struct("put", "links"), "batch").alias("row")).select("vertices", "row.put", "row.links")
    nodes = last.select("vertices", F.col("put.data").alias("data"), F.lit(True).alias("given"))
    each = last.select("vertices", F.explode("links").alias("l"))
    lower = F.filter("vertices", lambda v, i: i != F.col("l.pos"))
    links = each.select(lower.alias("lower"), F.col("vertices").alias("upper"), F.col("l.is_in").alias("is_in"), F.col("l.is_out").alias("is_out"))
    return Graph.assembled(nodes, links)
