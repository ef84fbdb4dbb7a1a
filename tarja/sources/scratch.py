"""Where tables are written on the way: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; a local folder only where that is unset (local runs)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tarja.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tarja-")
        spark.conf.set("spark.tarja.scratch", root)
    return f"{root}/tarja/{name}-{uuid.uuid4().hex}"
