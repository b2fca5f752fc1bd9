"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    return "file://" + tempfile.mkdtemp(prefix="kspec-")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that spark.checkpoint.dir names. Where that is unset a local master takes a temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local()
    return f"{base.rstrip('/')}/kspec/{name}-{uuid.uuid4().hex}"


def kept_at(df: DataFrame, name: str) -> str:
    """Where df has been written, as Parquet."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written there once and read again, for what reads it more than once: a plan that names it twice would make it twice."""
    return df.sparkSession.read.schema(df.schema).parquet(kept_at(df, name))
