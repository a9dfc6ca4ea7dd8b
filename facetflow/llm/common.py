"""Shared helpers: scratch tables in the cluster's shared folder, row identities and Arrow batch plumbing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are handed to Python code at a time; bounds the worker's memory.
SLICE_BYTES = 4 << 20
#: The same where texts are encoded: pieces of text that come again within a slice are looked up once.
ENCODED_BYTES = 6 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, set here only where it is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="facetflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system API, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the driver's Python ends."""
    path = f"{scratch_root(spark)}/facetflow/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    atexit.register(clean)
    return path


def materialize(df: DataFrame, name: str, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once as a shared Parquet table and read it again: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is named so (upper and lower case are one to Spark)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, name: str, step: str) -> DataFrame:
    """``df`` with a number for each row in ``name``, written once so that the numbers stay as they are."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()), step)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` (of the files for a plain scan); used to choose numbers of buckets only."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    return min(size, 1 << 60)


_HELD: dict = {}


def held_by_worker(key: tuple, make: Callable):
    """What ``make`` gives, kept by the worker process for later tasks with the same key. One thing is kept at a time, so that operators don't add up."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text at most (a single longer text stays whole)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
