"""Session defaults."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "lumenfold", **more: str) -> SparkSession:
    """A session with the engine's defaults; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that spark.checkpoint.dir names, which the executors share.

    Where that setting is unset and Spark runs on this machine alone, as in tests, a temporary folder stands in for it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-lumenfold-"))
    return df.checkpoint()
