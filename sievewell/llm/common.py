"""What the operators share: the scratch folder, written intermediate tables, worker set-up."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Ids that are broadcast at most; more are joined by a shuffle of both sides.
BROADCAST_IDS = 1_000_000
#: Rows of an Arrow batch, where the session leaves Spark's default: a batch of very long texts must fit a worker.
BATCH_ROWS = 2000
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers must import this package, wherever the driver was started; they get batches of bounded size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _REPO])
    return spark


def give_back() -> None:
    """Free memory of this process goes back to the system, where its C library can do that (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """``run``, for mapInArrow, whose worker gives back free memory when a task ends: workers are kept and idle beside the JVM, and later queries load more into them."""

    @functools.wraps(run)
    def whole(parts):
        try:
            yield from run(parts)
        finally:
            give_back()

    return whole


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only in local mode, where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"sievewell-{os.getuid()}")
    return base.rstrip("/") + "/sievewell"


def written(df: DataFrame, label: str, drop_shuffles: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    With ``drop_shuffles`` the shuffle files of this write go when it ends; else they
    stay until the driver collects its garbage, the last query's even longer.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if drop_shuffles:
        before = spark.conf.get(_DROP_SHUFFLES, None)
        spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            if before is None:
                spark.conf.unset(_DROP_SHUFFLES)
            else:
                spark.conf.set(_DROP_SHUFFLES, before)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more and let Spark drop their shuffle files."""
    spark = None
    for t in tables:
        path = getattr(t, "_written_path", None)
        if path:
            spark = t.sparkSession
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if spark is not None:
        gc.collect()
        spark._jvm.System.gc()


def of_ids(df: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``df`` joined with a written table that has few columns by ``key``: ids are broadcast if a count allows it, else both sides are shuffled."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
