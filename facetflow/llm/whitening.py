"""Whitening of embeddings by their principal components.

Vectors are quantised to whole numbers, and each distinct one counts once. Its rows, centred, are the distributed matrix
whose singular value decomposition Spark MLlib computes: the products are summed over the tasks, their decomposition is as
large as the vectors are wide. Singular values divided by the root of the number of rows are deviations along the
components. What the components leave out is known from the exact deviations of all rows, which no decomposition enters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

#: Widest vectors that MLlib decomposes from their products in full; wider ones only up to the components asked for.
FULL = 15_000
#: Sums of whole numbers up to here are exact in 64 bits.
EXACT = 1 << 62


@dataclass
class Fit:
    """``n`` distinct rows, their sums by dimension (exact), components as columns, variances along them, the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - sum)^2 for each row, exactly."""
        top = max((abs(int(v)) for v in (x.min(), x.max())), default=0) if x.size else 0
        reach = self.n * top + max(map(abs, self.sums))
        if reach * reach * len(self.sums) < EXACT:
            gap = self.n * x - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", gap, gap).tolist()
        return [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``_id``, ``_x``: whole numbers, rounded down, of rows whose vector is neither null nor empty and has no null or non-finite entry."""
    v = F.col("_v")
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"))
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter((F.size(v) > 0) & ~odd).select("_id", F.transform(v, lambda c: F.floor(c * scale).cast("long")).alias("_x"))


def array_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Rows and their sums by dimension: a partial sum a task, then a row a dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * width, 0
        for batch in batches:
            x = array_of(batch, width)
            if not len(x):
                continue
            top = max(abs(int(x.min())), abs(int(x.max())))
            own = x.sum(0).tolist() if top * len(x) < EXACT else [sum(column) for column in zip(*x.tolist(), strict=True)]
            sums, n = [a + b for a, b in zip(sums, own, strict=True)], n + len(x)
        numbers = pa.array([Decimal(s) for s in [n, *sums]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), numbers], ["d", "s"])

    rows = fit.mapInArrow(partial, "d int, s decimal(38, 0)").groupBy("d").agg(F.sum("s").alias("s")).collect()
    found = {r["d"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), [found.get(d, 0) for d in range(width)]


def summed(fit: DataFrame, width: int, values) -> np.ndarray:
    """Sums of the rows that ``values`` makes of each batch."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = values(array_of(batch, width))
                total = own if total is None else total + own
        made = [] if total is None else total.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array(made, pa.float64())], ["d", "s"])

    found = fit.mapInArrow(partial, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).collect()  # a row an entry
    return np.array([r["s"] for r in sorted(found, key=lambda r: r["d"])])


def fitted(fit: DataFrame, width: int, components: int) -> Fit:
    """The components of distinct rows (``_x``, a written table, which is read four times). Those without variance are left out."""
    n, sums = exact_sums(fit, width)
    out = Fit(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    out.total = float(summed(fit, width, lambda x: np.array([float(sum(out.deviations(x)))]))[0]) / float(n) ** 3
    if not out.total:
        return out
    mean = F.array(*map(F.lit, out.mean.tolist()))
    centred = F.zip_with(F.col("_x").cast("array<double>"), mean, lambda x, m: x - m)
    vectors = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("row")), "row")
    svd = RowMatrix(vectors, n, width).computeSVD(width if width <= FULL else components)
    values = np.array(svd.s.toArray()[:components])
    vectors_found = np.array(svd.V.toArray())[:, : len(values)]
    kept = np.flatnonzero(values > 0)
    found = vectors_found[:, kept]
    out.components = found * np.where(found[np.abs(found).argmax(0), range(len(kept))] < 0, -1, 1)  # the same side at every run
    out.variances = values[kept] ** 2 / n
    centre = summed(fit, width, lambda x: out.whitened(x).sum(0)) / n
    products = summed(fit, width, lambda x: ((w := out.whitened(x) - centre).T @ w).ravel()) / n
    out.identity_error = float(np.abs(products.reshape(len(kept), -1) - np.eye(len(kept))).max())
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """A row for each sound row and component: ``id_col``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are vectors of another length
    than most distinct ones have (the longer of equally many). Entries times ``scale`` beyond 64 bits count as the last
    whole number there. Repeated vectors count once in the fit and have their rows each, null and repeated ids too. There
    are as many components as dimensions at most; one without variance has a null ``whitened`` and ``explained`` 0. A
    ``deviation`` beyond 64 bits is null. An empty table gives no rows.
    """
    rows = quantised(df, id_col, vector_col, scale)
    schema = T.StructType([T.StructField(id_col, rows.schema["_id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    distinct = materialize(rows.select("_x").distinct(), "fit")
    most = distinct.groupBy(F.size("_x").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return df.sparkSession.createDataFrame([], schema)
    width = most["width"]
    alike = F.size("_x") == width
    model = fitted(distinct.filter(alike), width, components)
    shown = min(components, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = len(model.variances)
        explained = np.zeros(shown)
        if found:
            explained[:found] = model.variances / model.total
        for batch in batches:
            if not batch.num_rows:
                continue
            x = array_of(batch, width)
            made = np.zeros((len(x), shown))
            made[:, :found] = model.whitened(x)
            deviation = np.repeat(np.array([d if d < 1 << 63 else None for d in model.deviations(x)], object), shown)
            ids = batch.column("_id").take(pa.array(np.repeat(np.arange(len(x)), shown)))
            number = np.tile(np.arange(shown), len(x))
            columns = [pa.array(number + 1, pa.int32()), pa.array(np.full(len(number), model.n), pa.int64()), pa.array(deviation.tolist(), pa.int64()), pa.array(made.ravel(), mask=number >= found), pa.array(explained[number]), pa.array(np.full(len(number), model.identity_error))]
            yield pa.RecordBatch.from_arrays([ids, *columns], schema.names)

    return rows.filter(alike).mapInArrow(run, schema)
