"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; where a session on one machine names none, as in tests, a
    local one. On a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_touchline_local", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = spark._touchline_local = tempfile.mkdtemp(prefix="touchline-")
    return f"{top.rstrip('/')}/touchline/{label}-{uuid.uuid4().hex}"
