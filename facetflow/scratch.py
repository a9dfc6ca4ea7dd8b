"""Intermediate tables in the cluster's shared folder: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; set here only where it is unset, in local mode: on a cluster a machine's own folder is no use."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="facetflow-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _place(spark: SparkSession, name: str) -> str:
    """A fresh path, removed when the driver's Python ends."""
    path = f"{folder(spark)}/facetflow/{name}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass

    atexit.register(clean)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again; removed by dropped(), or when the driver's Python ends."""
    spark = df.sparkSession
    path = _place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Removes tables that written() gave and nothing reads any more."""
    for df in frames:
        if path := df.__dict__.pop("_scratch", None):
            _delete(df.sparkSession, path)


def released(spark: SparkSession) -> None:
    """Lets Spark remove the files of shuffles that nothing refers to: it does when the driver's garbage is collected, which may come too late."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
