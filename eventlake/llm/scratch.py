"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder. It is read from the session; only where it is
unset and the master is local (single-machine tests) a folder of this machine takes its place.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="eventlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/eventlake-{uuid.uuid4().hex}"
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(hadoop)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and a lost
    executor costs only the re-reading of files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame, times: int = 2) -> None:
    """Deletes tables of ``written`` that nothing reads any more, the shuffle files of finished writes and the
    driver's memory of their plans.

    Spark drops shuffle files once the driver has collected the plans that made them, so it is asked to collect.
    """
    sc = spark.sparkContext
    for t in tables:
        where = sc._jvm.org.apache.hadoop.fs.Path(t.staged_at)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    for _ in range(times):
        gc.collect()
        sc._jvm.System.gc()
        time.sleep(0.2)
