"""Paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a folder of the machine only where that is unset, as in local tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='difflens-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/difflens-{name}-{uuid.uuid4().hex}"
