"""Cutting the lineage of iterative plans by tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def own_folder(spark: SparkSession) -> str:
    """A folder of this machine, where one machine is all there is."""
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="eventlake-")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to and read from the folder that ``spark.checkpoint.dir`` names.

    Only where the setting is unset (a single machine) a folder of this machine is used.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = own_folder(spark)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/staged-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
