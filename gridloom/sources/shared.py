"""A fresh path in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = named or "file://" + tempfile.mkdtemp(prefix="gridloom-")
    return f"{named.rstrip('/')}/gridloom/{name}-{uuid.uuid4().hex}"
