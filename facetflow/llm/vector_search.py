"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

Vectors fall into cells around pivots (a bounded sample), and cells are cut into shards of bounded size. A cell's ball (pivot
and largest distance) tells which queries may find something in it: the pivots themselves bound a query's k-th distance
from above, and a query goes only to shards whose ball reaches so far.

Within a shard, a node of the tree splits its vectors at the median distance from a vantage point. A query descends into its
own side first and into the other if the triangle inequality, tightened by ``factor``, can't rule it out; with a factor of
one nothing nearer is ever missed. All queries of a block descend together. Leaves are compared by matrix products, and whatever
could be near enough is measured again, component by component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Vectors of a shard and of a leaf, queries that descend together, and the default factor: exact.
SHARD, LEAF, TOGETHER, FACTOR = 4096, 256, 512, 1.0
#: Pivots at most: they go to all tasks.
PIVOTS = 1024
#: Of a node's vectors, the part that its smaller side has to hold; else the node is a leaf (such as of copies, or where all are equally far).
BALANCE = 0.125


class Tree:
    """``computed`` counts the distances that were computed, in the tree and in its leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 5):
        self.ids, self.vectors, self.squares = ids, vectors, np.square(vectors).sum(1)
        self.rng, self.computed = np.random.default_rng(seed), 0
        self.root = self.build(np.arange(len(ids)))

    def build(self, own: np.ndarray):
        """A leaf: indexes. A node: vantage point, distances at which inner vectors end and outer ones begin, both sides. The balance bounds its depth."""
        if len(own) <= LEAF:
            return own
        point = self.vectors[own[self.rng.integers(len(own))]]
        d = distances(self.vectors[own], point[None])[0]
        self.computed += len(own)
        inner = d < np.median(d)
        if min(inner.sum(), (~inner).sum()) < BALANCE * len(own):
            inner = d <= np.median(d)
            if min(inner.sum(), (~inner).sum()) < BALANCE * len(own):
                return own
        return point, float(d[inner].max()), float(d[~inner].min()), self.build(own[inner]), self.build(own[~inner])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = FACTOR, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest of each query (infinite and -1 where there are fewer, or none within its bound), ties to smaller ids."""
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), -1, np.int64)
        limit = np.full(len(queries), np.inf) if bounds is None else bounds

        def visit(node, q: np.ndarray) -> None:
            if not len(q):
                return
            if isinstance(node, np.ndarray):
                for start in range(0, len(node), 1024):
                    self.leaf(node[start : start + 1024], q, query_ids, queries, best, found, limit, k)
                return
            point, last, first, inner, outer = node
            d = distances(queries[q], point[None])[0]
            self.computed += len(q)
            inside = d - last < first - d
            for near, far, own, gap in ((inner, outer, q[inside], first - d[inside]), (outer, inner, q[~inside], d[~inside] - last)):
                visit(near, own)
                # a hair of room for rounding
                visit(far, own[gap * factor <= np.minimum(best[own, -1], limit[own]) * (1 + 1e-9) + 1e-12])

        visit(self.root, np.arange(len(queries)))
        return best, found

    def leaf(self, own: np.ndarray, q: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: np.ndarray, found: np.ndarray, limit: np.ndarray, k: int) -> None:
        x, squares = self.vectors[own], self.squares[own]
        self.computed += len(own) * len(q)
        for start in range(0, len(q), 256):
            part = q[start : start + 256]
            size = np.square(queries[part]).sum(1)
            rough = size[:, None] + squares - 2 * (queries[part] @ x.T)
            reach = np.minimum(best[part, -1], limit[part])
            # room for the rounding of a matrix product
            near = rough <= (np.square(reach) * (1 + 1e-9) + 1e-9 * (size + squares.max()))[:, None]
            near &= self.ids[own] != query_ids[part, None]
            row, col = np.nonzero(near)
            if not len(row):
                continue
            d = np.full(near.shape, np.inf)
            d[row, col] = pair_distances(queries[part[row]], x[col])
            hit = near.any(1)
            part, d = part[hit], d[hit]
            d, ids = np.hstack([best[part], d]), np.hstack([found[part], np.broadcast_to(self.ids[own], d.shape)])
            order = np.lexsort((ids, d), axis=-1)[:, :k]
            best[part], found[part] = np.take_along_axis(d, order, 1), np.take_along_axis(ids, order, 1)


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, row by row. Squares are added in the order of components, as SQL engines do."""
    total = np.zeros(len(a))
    for x, y in zip(a.T, b.T, strict=True):
        total += np.square(x - y)
    return np.sqrt(total)


def distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The same between all of both: a row for each point."""
    return np.stack([pair_distances(vectors, np.broadcast_to(p, vectors.shape)) for p in points]) if len(points) else np.zeros((0, len(vectors)))


def _searched(k: int, factor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = tree = None
        ids: list[np.ndarray] = []
        vectors: list[np.ndarray] = []
        for batch in batches:
            number, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "dim"))
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(dims) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(number)]
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if lo == hi:
                    continue
                own, reach = (batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("id", "bound"))
                x = batch.column("vector").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dims[lo]))
                if (number[lo], dims[lo]) != shard:
                    shard, tree, ids, vectors = (number[lo], dims[lo]), None, [], []
                if kind[lo] == 0:
                    ids.append(own)
                    vectors.append(x)
                    continue
                if not ids:
                    continue
                tree = tree or Tree(np.concatenate(ids), np.concatenate(vectors))
                for start in range(0, len(own), TOGETHER):
                    part = slice(start, start + TOGETHER)
                    d, found = tree.search(own[part], x[part], k, factor, reach[part])
                    row, col = np.nonzero(np.isfinite(d))
                    yield pa.RecordBatch.from_arrays([pa.array(own[part][row]), pa.array(found[row, col]), pa.array(d[row, col])], ["query_id", "vec_id", "score"])

    return run


class Pivots:
    """Some vectors of each dimension, numbered through; the rows of other dimensions share the cell -1."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for dim in {len(v) for v in vectors}:
            own = [k for k, v in enumerate(vectors) if len(v) == dim]
            self.of[dim] = np.array(own), np.array([ids[k] for k in own]), np.array([vectors[k] for k in own])

    def distances(self, dim: int, x: np.ndarray) -> np.ndarray:
        return distances(self.of[dim][2], x)


def _assigned(pivots: Pivots, k: int):
    """For each row its nearest pivot (``cell``) and the distance; for queries also distances to all pivots, and an upper bound of the k-th neighbour's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            dims, ids, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "id", "q"))
            cell, gap, bound = np.full(n, -1, np.int32), np.zeros(n), np.full(n, np.inf)
            ways: list[np.ndarray | None] = [None] * n
            for dim in np.unique(dims).tolist():
                if dim not in pivots.of:
                    continue
                own = np.flatnonzero(dims == dim)
                number, pivot_ids, points = pivots.of[dim]
                x = batch.column("vector").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                for start in range(0, len(own), 256):
                    part = own[start : start + 256]
                    d = distances(points, x[start : start + 256])
                    least = d.argmin(1)
                    cell[part], gap[part] = number[least], d[np.arange(len(part)), least]
                    for row, far in zip(part.tolist(), d, strict=True):
                        if asked[row]:
                            ways[row] = far
                            others = far[pivot_ids != ids[row]]
                            if len(others) >= k:
                                bound[row] = np.partition(others, k - 1)[k - 1]
            arrays = [batch.column(c) for c in ("id", "vector", "dim", "q")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(cell), pa.array(gap), pa.array(bound), pa.array(ways, pa.list_(pa.float64()))], ["id", "vector", "dim", "q", "cell", "gap", "bound", "ways"])

    return run


def _sent(pivots: Pivots, radius: dict[int, float], first: dict[int, int], count: dict[int, int], factor: float):
    """The shards that each query goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = []
            for dim, bound, ways in zip(*(batch.column(c).to_pylist() for c in ("dim", "bound", "ways")), strict=True):
                own = [] if dim in pivots.of else [-1]
                if ways is not None:
                    number = pivots.of[dim][0]
                    reach = np.array(ways) - np.array([radius.get(c, -np.inf) for c in number.tolist()])
                    own = number[np.isfinite(reach) & (reach * factor <= bound * (1 + 1e-9) + 1e-12)].tolist()
                shards.append([first[c] + s for c in own if c in first for s in range(count[c])])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "vector", "dim", "bound")), pa.array(shards, pa.list_(pa.int32()))], ["id", "vector", "dim", "bound", "shards"])

    return run


def sound(vector_col: str):
    """Not null, not zero, all components there and finite."""
    x = F.col(vector_col).cast("array<double>")
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & good & F.exists(x, lambda v: v != 0), F.lit(False))


def nearest(df: DataFrame, is_query, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest rows of each row for which ``is_query`` holds, other than those of its own id.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; vectors of
    other lengths than the query's are no neighbours. Repeated rows are found as often as they stand. Ties go to smaller ids.
    """
    rows = df.filter(sound(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.withColumn("dim", F.size("vector"))
    wanted = max(1, min(PIVOTS, -(-rows.count() // shard_rows)))
    sample = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("vector")).limit(max(wanted, k + 1)).select("id", "vector").collect()  # PIVOTS vectors at most
    pivots = Pivots([r["id"] for r in sample], [r["vector"] for r in sample])
    placed = materialize(rows.select("id", "vector", "dim", "q").mapInArrow(_assigned(pivots, k), "id long, vector array<double>, dim int, q boolean, cell int, gap double, bound double, ways array<double>"), "vectors")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).collect()  # a row for each pivot
    count = {r["cell"]: -(-r["n"] // shard_rows) for r in cells}
    first, shards = {}, 0
    for c, n in sorted(count.items()):
        first[c], shards = shards, shards + n
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, first[c], count[c]) for c in count], "c int, first int, parts int"))
    shard = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    held = placed.join(table, F.col("cell") == F.col("c")).select(shard.alias("shard"), "dim", F.lit(0).alias("kind"), "id", F.lit(None).cast("double").alias("bound"), "vector")
    sent = placed.filter("q").select("id", "vector", "dim", "bound", "ways").mapInArrow(_sent(pivots, {r["cell"]: r["radius"] for r in cells}, first, count, factor), "id long, vector array<double>, dim int, bound double, shards array<int>")
    asked = sent.select(F.explode("shards").alias("shard"), "dim", F.lit(1).alias("kind"), "id", "bound", "vector")
    found = held.union(asked).repartitionById(max(1, shards), "shard").sortWithinPartitions("shard", "dim", "kind", "id").mapInArrow(_searched(k, factor), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
