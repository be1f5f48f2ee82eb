"""The folder that driver and executors share, and rows cut from their lineage there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.

    Where that is unset, a local session (driver and executors are one process) gets a folder under /tmp; a cluster raises,
    because its machines would not see each other's files.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file:///tmp/fleetlens-{uuid.uuid4().hex}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions and order, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
