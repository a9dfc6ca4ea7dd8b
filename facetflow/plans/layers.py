"""Message passing over several relation matrices.

Matrices are tables (``k``, ``i``, ``j``, ``value``), features and messages arrays of doubles. Vector sums are sums of columns: one
partial aggregate for each feature, so sums start before the shuffle and stay in generated code.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import linear, plus, relu, scaled, times
from ..operators.matrices import product

#: Numbers of a weight matrix that are written into a plan at most.
LITERALS = 4096
#: Widest features whose sums are columns; wider ones are summed entry by entry.
WIDE = 128


class PartialForwardError(Exception):
    """A layer got more, fewer or other rows than it needs."""


def width_of(features: DataFrame, column: str = "features") -> int:
    row = features.select(F.size(column).alias("n")).first()
    return row["n"] if row else 0


def vector_sum(df: DataFrame, keys: list[str], column: str, width: int) -> DataFrame:
    """Sums of arrays by keys."""
    if width <= WIDE:
        sums = [F.sum(F.col(column)[d]).alias(f"_{d}") for d in range(width)]
        return df.groupBy(*keys).agg(*sums).select(*keys, F.array(*(f"_{d}" for d in range(width))).alias(column))
    each = df.select(*keys, F.posexplode(column).alias("d", "v")).groupBy(*keys, "d").agg(F.sum("v").alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "v"))), lambda x: x["v"]).alias(column))


def sparse_vertex_agg(matrices: DataFrame, features: DataFrame, width: int | None = None) -> DataFrame:
    """``k``, ``node``, ``features``: each matrix times the features (``node``, ``features``); nodes without entries have no row."""
    width = width or width_of(features)
    if not width:
        raise ValueError("there are no features")
    joined = matrices.join(features.withColumnRenamed("node", "j"), "j").select("k", F.col("i").alias("node"), scaled(F.col("features"), F.col("value")).alias("features"))
    return vector_sum(joined, ["k", "node"], "features", width)


def max_vertex_agg(matrices: DataFrame, features: DataFrame, width: int | None = None) -> DataFrame:
    """As sparse_vertex_agg(), with the largest of the weighted entries instead of their sum."""
    joined = _weighted(matrices, features)
    width = width_of(features) if width is None else width
    tops = [F.max(F.col("features")[d]).alias(f"_{d}") for d in range(width)]
    return joined.groupBy("k", "node").agg(*tops).select("k", "node", F.array(*(f"_{d}" for d in range(width))).alias("features"))


def softmax_vertex_agg(matrices: DataFrame, features: DataFrame, width: int | None = None) -> DataFrame:
    """Neighbours' features weighted by the softmax of the matrix entries of a node's row. Two passes, each aggregated before it is shuffled: the row's largest entry, then the sums of the weighted features and of the weights."""
    width = width_of(features) if width is None else width
    tops = matrices.groupBy("k", "i").agg(F.max("value").alias("_top"))
    weighed = matrices.join(tops, ["k", "i"]).select("k", "i", "j", F.exp(F.col("value") - F.col("_top")).alias("value"))
    sums = vector_sum(_weighted(weighed, features, True), ["k", "node"], "features", width + 1)
    return sums.select("k", "node", F.transform(F.slice("features", 1, width), lambda x: x / F.col("features")[width]).alias("features"))


def _weighted(matrices: DataFrame, features: DataFrame, keep_weight: bool = False) -> DataFrame:
    """``k``, ``node``, ``features`` of each entry of matrices, times its value, which may follow as a further entry."""
    joined = matrices.join(features.withColumnRenamed("node", "j"), "j")
    made = scaled(F.col("features"), F.col("value"))
    return joined.select("k", F.col("i").alias("node"), (F.concat(made, F.array("value")) if keep_weight else made).alias("features"))


def largest(x: Column) -> Column:
    """Of an array with a number for each matrix; for ``agg_func``, as the following ones."""
    return F.array_max(x)


def average(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def softmax_weighted(x: Column) -> Column:
    """Mean weighted by the softmax of the numbers themselves."""
    top = F.array_max(x)
    weights = F.transform(x, lambda v: F.exp(v - top))
    return F.aggregate(times(x, weights), F.lit(0.0), lambda s, v: s + v) / F.aggregate(weights, F.lit(0.0), lambda s, v: s + v)


def stacked_by_node(messages: DataFrame, count: int, width: int) -> DataFrame:
    """``node``, ``_0``, ``_1``, ...: the message of each matrix beside those of the others, zeros where there is none."""
    none = F.array_repeat(F.lit(0.0), width)
    by = messages.groupBy("node").agg(*(F.max(F.when(F.col("k") == q, F.col("features"))).alias(f"_{q}") for q in range(count)))
    return by.select("node", *(F.coalesce(f"_{q}", none).alias(f"_{q}") for q in range(count)))


def reduced(stacked: DataFrame, count: int, width: int, agg_func: Callable[[Column], Column]) -> DataFrame:
    """``node``, ``features``: ``agg_func`` of the array that has a number for each matrix, entry by entry."""
    across = F.array(*(f"_{q}" for q in range(count)))
    each = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: agg_func(F.transform(across, lambda row: F.get(row, d))))
    return stacked.select("node", each.alias("features"))


def default_graph_agg(messages: DataFrame, width: int) -> DataFrame:
    """relu of the sum over matrices."""
    return vector_sum(messages, ["node"], "features", width).select("node", relu(F.col("features")).alias("features"))


def default_update(features: DataFrame, messages: DataFrame) -> DataFrame:
    """relu of the mean of a node's features and message; no message counts as zeros."""
    m = messages.withColumnRenamed("features", "_m")
    zero = F.transform("features", lambda v: F.lit(0.0))
    return features.join(m, "node", "left").select("node", relu(scaled(plus(F.col("features"), F.coalesce("_m", zero)), 0.5)).alias("features"))


class MultiGraphLayer:
    """output(update(t, graph_agg(vertex_agg(adj(A), t)))) with t = transform(features); each part can be replaced."""

    def __init__(self, vertex_agg: Callable | None = None, graph_agg: Callable | None = None, update: Callable | None = None, transform: Callable | None = None, adj_transform: Callable | None = None, output: Callable | None = None):
        same = lambda x: x
        self.vertex_agg, self.graph_agg, self.update = vertex_agg or sparse_vertex_agg, graph_agg or default_graph_agg, update or default_update
        self.transform, self.adj_transform, self.output = transform or same, adj_transform or same, output or same
        self.reset_forward()

    def reset_forward(self) -> None:
        self._parts: list[DataFrame] = []
        self._rows = self._hasty = 0

    def messages(self, features: DataFrame, matrices: DataFrame, width: int) -> DataFrame:
        return self.graph_agg(self.vertex_agg(self.adj_transform(matrices), features, width), width)

    def __call__(self, features: DataFrame, matrices: DataFrame) -> DataFrame:
        t = self.transform(features)
        return self.output(self.update(t, self.messages(t, matrices, width_of(t))))

    def partial(self, features: DataFrame, tile: DataFrame, rows: int, n: int) -> tuple[DataFrame | None, bool]:
        """One tile of ``rows`` destination rows; the result comes with the last of ``n`` rows, None before."""
        if rows <= 0 or self._rows + rows > n:
            total = self._rows + rows
            self.reset_forward()
            raise PartialForwardError(f"{total} rows of {n}")
        t = self.transform(features)
        self._parts.append(self.messages(t, tile, width_of(t)))
        self._rows += rows
        if self._rows < n:
            return None, False
        parts = reduce(DataFrame.unionByName, self._parts)
        self.reset_forward()
        return self.output(self.update(t, parts)), True

    def hasty(self, features: DataFrame, tile: DataFrame, rows: DataFrame, n: int | None = None) -> DataFrame | tuple[DataFrame, bool]:
        """The rows (``node``) of a tile at once; matrix columns are restricted to these rows.

        With ``n`` the rows of all tiles so far are counted, and the result comes with whether they are n, after which the
        count begins anew. PartialForwardError if they are more; the count then is what is over.
        """
        own = features.join(rows, "node", "left_semi")
        out = self(own, tile.join(rows.withColumnRenamed("node", "j"), "j", "left_semi"))
        if n is None:
            return out
        total = self._hasty + rows.count()
        self._hasty = total % n
        if total > n:
            raise PartialForwardError(f"{total} rows of {n}")
        return out, self._hasty == 0


class PartialForward:
    """Layers in turn; a layer that needs more tiles makes the whole return None until then."""

    def __init__(self, *layers: MultiGraphLayer):
        self.layers, self.at = layers, 0

    def __call__(self, features: DataFrame, tiles: Callable[[], Iterator[tuple[DataFrame, int]]], n: int) -> DataFrame:
        """Runs all layers, each over all tiles (matrix table, number of rows)."""
        x = features
        for self.at, layer in enumerate(self.layers):
            done = False
            for tile, rows in tiles():
                out, done = layer.partial(x, tile, rows, n)
            if not done:
                layer.reset_forward()
                raise PartialForwardError("the tiles ended early")
            x = out
        self.at = 0
        return x


def weighted_graph_agg(messages: DataFrame, weights: DataFrame, width: int, activation: Callable[[Column], Column] | None = relu) -> DataFrame:
    """Sum over matrices of weight (``k``, ``node``, ``weight`` array) times message."""
    joined = messages.join(weights, ["k", "node"]).select("node", times(F.col("features"), F.col("weight")).alias("features"))
    out = vector_sum(joined, ["node"], "features", width)
    return out.select("node", (activation or (lambda x: x))(F.col("features")).alias("features"))


def projected(df: DataFrame, column: str, weights: list[list[float]], bias: list[float] | None, name: str) -> DataFrame:
    """``df`` with ``name``: arrays of ``column`` times a weight matrix (rows: inputs), plus a bias.

    Small matrices are part of the plan. Larger ones would make it huge: they go to the tasks once and are multiplied by
    the batch. A null array gives null; arrays of another length raise ValueError.
    """
    if len(weights) * len(weights[0]) <= LITERALS:
        return df.withColumn(name, F.when(F.col(column).isNotNull(), linear(F.col(column), weights, bias)))
    shared = df.sparkSession.sparkContext.broadcast((np.array(weights, float), np.array(bias if bias else 0.0, float)))
    kept = [c for c in df.columns if c != name]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            lists = batch.column(column)
            there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(there), -1) @ w + b if len(there) else np.zeros((0, w.shape[1]))
            sizes = np.zeros(batch.num_rows, np.int64)
            sizes[there] = w.shape[1]
            made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32(), mask=np.append(sizes == 0, False)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], schema.names)

    return df.mapInArrow(run, schema)


def linear_graph_agg(messages: DataFrame, weights: list[list[list[float]]], bias: list[list[float]] | None = None, activation: Callable[[Column], Column] | None = relu, agg_func: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sum over matrices of message times a weight matrix for each k, plus a bias, through an activation.

    ``agg_func`` takes the place of the sum: from the array of one number for each matrix (of a zero message, where a node
    has none there) it makes the number that counts, such as ``largest``, ``average`` or ``softmax_weighted``.
    """
    if agg_func is not None:
        made = stacked_by_node(messages, len(weights), len(weights[0]))
        for k, w in enumerate(weights):
            made = projected(made, f"_{k}", w, bias[k] if bias else None, f"_{k}")
        out = reduced(made, len(weights), len(weights[0][0]), agg_func)
        return out.select("node", (activation or (lambda v: v))(F.col("features")).alias("features"))
    parts = [projected(messages.filter(F.col("k") == k), "features", w, bias[k] if bias else None, "made") for k, w in enumerate(weights)]
    made = reduce(DataFrame.unionByName, parts).select("node", F.col("made").alias("features"))
    out = vector_sum(made, ["node"], "features", len(weights[0][0]))
    return out.select("node", (activation or (lambda v: v))(F.col("features")).alias("features"))


def linear_update(features: DataFrame, messages: DataFrame, graph_weights: list[list[float]] | None, message_weights: list[list[float]], graph_bias: list[float] | None = None, message_bias: list[float] | None = None, activation: Callable[[Column], Column] | None = relu) -> DataFrame:
    """activation(features times weights plus message times weights); without graph weights the features count for nothing."""
    zero = F.array_repeat(F.lit(0.0), len(message_weights))
    joined = features.join(messages.withColumnRenamed("features", "_m"), "node", "left").withColumn("_m", F.coalesce("_m", zero))
    joined = projected(joined, "_m", message_weights, message_bias, "_out")
    if graph_weights:
        joined = projected(joined, "features", graph_weights, graph_bias, "_own").withColumn("_out", plus(F.col("_own"), F.col("_out")))
    return joined.select("node", (activation or (lambda v: v))(F.col("_out")).alias("features"))


def adjacency_scale(matrices: DataFrame, before: DataFrame | None = None, after: DataFrame | None = None) -> DataFrame:
    """before * A * after, each a matrix table of its own; either may be left out."""
    out = matrices
    if before is not None:
        out = product(before, out)
    return out if after is None else product(out, after)


def diagonal(nodes: DataFrame, count: int, value: float) -> DataFrame:
    """``count`` diagonal matrices over nodes (``node``)."""
    ks = F.array(*map(F.lit, range(count)))
    return nodes.select(F.explode(ks).alias("k"), F.col("node").alias("i"), F.col("node").alias("j"), F.lit(float(value)).alias("value"))


def embedding_table(nodes: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """Seeded features of nodes, uniform within plus and minus the root of 1 / (nodes * width)."""
    r = float(np.sqrt(1 / max(1, nodes.count() * width)))
    draw = [((F.pmod(F.xxhash64("node", F.lit(seed * 1000 + d)), F.lit(1 << 30)) / float(1 << 30)) * 2 - 1) * r for d in range(width)]
    return nodes.select("node", F.array(*draw).alias("features"))


def uniform_weights(*shape: int, seed: int = 0) -> list:
    """Small weights, uniform within plus and minus the root of 1 / (product of the shape)."""
    r = float(np.sqrt(1 / np.prod(shape)))
    return np.random.default_rng(seed).uniform(-r, r, shape).tolist()
