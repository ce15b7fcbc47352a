"""A folder that all executors reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder under the one in spark.checkpoint.dir, gone when the application ends; one of our own only on a single machine where that is unset."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = tempfile.mkdtemp(prefix="gridloom-")
        sc.setCheckpointDir(base)
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()
