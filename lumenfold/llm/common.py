"""Shared folders, intermediate tables and batch limits of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is unset, as in local tests, a temporary folder of this process stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = "file://" + _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="spark-lumenfold-"))
    if "://" not in base:
        base = "file://" + base if base.startswith("/") else base
    return f"{base.rstrip('/')}/lumenfold/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a shared folder that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that `save` returned."""
    files = df.inputFiles()
    if files:
        drop(df.sparkSession, files[0].rsplit("/", 1)[0])


def drop_tables(*tables: DataFrame) -> None:
    for df in tables:
        drop_table(df)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole documents: at most `rows` rows go to Python at once, so long texts stay within its memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of `rows` rows at most, for steps run inside, whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def filesystem(uri: str):
    """pyarrow's file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does so when the driver collects their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
