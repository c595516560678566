"""Scratch folders that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tidefold.errors import ParamError


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only where none is named and all runs on one machine, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ParamError("spark.checkpoint.dir must name a folder that all machines share")
        top = tempfile.mkdtemp(prefix="tidefold-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
