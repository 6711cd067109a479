"""Cutting lineage in iterations, so that lost executors cost one round at most."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='plotlink-')}"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder in spark.checkpoint.dir; in a temporary one where that is unset, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    folder = folder or _local_folder()
    return f"{folder.rstrip('/')}/plotlink/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Written to and read back from the shared folder."""
    path = shared_path(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df as a side of a join that is dealt out by the key, never sent to every task: Spark takes a side for small by its files, and
    does not see what explodes, groups and compression hide."""
    return df.hint("merge")
