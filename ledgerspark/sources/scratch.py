"""A fresh folder for files that a job leaves for its own later steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """Below the shared folder that spark.checkpoint.dir names; where none is set, below a temporary one in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = shared or "file://" + tempfile.mkdtemp(prefix="ledgerspark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
