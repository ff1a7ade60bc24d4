"""Shared by operators that write between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(df: DataFrame) -> None:
    """Sets the checkpoint folder from ``spark.checkpoint.dir``; a folder of our own in ``local[...]`` only."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc.getConf().get("spark.checkpoint.dir")
        if not found and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="andamio-"))


def new_folder(spark: SparkSession, what: str) -> str:
    """A folder of its own among the checkpoints, where driver and executors share files."""
    ensure_checkpoints(spark.range(1))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{what}-{uuid.uuid4().hex}"
