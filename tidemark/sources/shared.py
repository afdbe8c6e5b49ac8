"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode, else an error."""
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """A table in the shared folder, so that what follows does not compute it again."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
