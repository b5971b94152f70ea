"""Session defaults shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """A local session: UTC, adaptive execution, Arrow transfer and the RocksDB state store."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("eventlake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .config("spark.local.dir", os.environ.get("EVENTLAKE_LOCAL_DIR", "/tmp/eventlake-local"))
        .getOrCreate()
    )
