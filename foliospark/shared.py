"""Tables written once in the folder that all executors share; how rows are dealt out and handed to Python."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folders of the scratch() around, the innermost last.
_SCRATCH: ContextVar[tuple[str, ...]] = ContextVar("foliospark_scratch", default=())


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, lasting: bool = False) -> str:
    """A new folder below spark.checkpoint.dir, or below that of the scratch() around; lasting: outside of it.

    Where that setting is unset, a local master gets a temporary folder as its value; on a cluster it is an error, as
    executors there don't see each other's disks.
    """
    around = _SCRATCH.get()[: -1 if lasting else None]
    return f"{around[-1] if around else _root(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df as a table written once in the shared folder: cuts the lineage and survives lost executors. lasting: outside of the scratch() around."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, lasting)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside go when it ends. What is used afterwards must be written as lasting, or not read any of them."""
    path = shared_dir(spark)
    token = _SCRATCH.set((*_SCRATCH.get(), path))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        remove(spark, path)


def spread(df: DataFrame) -> DataFrame:
    """A table read from fewer splits than there are cores (a small file), spread over them; others as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows and 16 MB, so that a batch of long texts stays small. Settings that aren't Spark's defaults stay."""
    for name, default, value in (("maxRecordsPerBatch", ("10000",), rows), ("maxBytesPerBatch", ("67108864b", "64MB"), 16 << 20)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") in default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
