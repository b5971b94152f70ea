"""Structured Streaming forms of the event-time operators.

Each takes a streaming frame with a TIMESTAMP column and returns a streaming frame; ``drain`` runs
one to the end of its input and gives the rows it emitted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.operators.staged import own_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of a table as a stream, with the batch reader's schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # a pattern, since the file source takes a plain path for a directory
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def tumbling(df: DataFrame, ts: str, size: str, delay: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Sums per window, emitted once when the watermark (greatest time less ``delay``) passes its end."""
    grouped = df.withWatermark(ts, delay).groupBy(*keys, F.window(ts, size).alias("__w")).agg(*aggregates)
    rest = [c for c in grouped.columns if c not in (*keys, "__w")]
    return grouped.select(*keys, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *rest)


def deduplicated(df: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark passes its row."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, window: str, delay: str) -> DataFrame:
    """Pairs of equal key whose times differ by ``window`` at most; state is bounded by both watermarks."""
    a = left.withWatermark(left_ts, delay).alias("l")
    b = right.withWatermark(right_ts, delay).withColumnRenamed(key, "__k").alias("r")
    near = F.col(right_ts).between(F.col(left_ts) - F.expr(f"INTERVAL {window}"), F.col(left_ts) + F.expr(f"INTERVAL {window}"))
    return a.join(b, (F.col(key) == F.col("__k")) & near).drop("__k")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs the stream over what its sources hold now and returns what it wrote."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark)
    path = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
