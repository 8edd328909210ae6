"""What jobs need of their session."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_import(spark: SparkSession) -> SparkSession:
    """Python workers must import this package, wherever the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _REPO])
    return spark


def small_methods(spark: SparkSession) -> SparkSession:
    """Java compiles no method of more than 8000 bytes to machine code; Spark is told to make none for plans of many expressions, but small ones."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) > 8000:
        spark.conf.set(limit, "8000")
    return spark


#: Bytes of an Arrow batch for pages, where the session leaves Spark's default of 64 MB; a larger row is a batch of its own.
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> SparkSession:
    """A worker holds the batch that it reads beside what it makes, so it gets batches of few bytes, however many rows a task has."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit) == "67108864b":
        spark.conf.set(limit, str(BATCH_BYTES))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only in local mode, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"sievewell-{os.getuid()}")
    return base.rstrip("/") + "/sievewell"
