"""Where intermediate tables and stream checkpoints go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder that all executors share, in spark.checkpoint.dir; a temporary one only where all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        held = tempfile.TemporaryDirectory(prefix="tidemark-", ignore_cleanup_errors=True)
        atexit.register(held.cleanup)
        base = f"file://{held.name}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
