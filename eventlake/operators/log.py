"""Log access: offsets, committed reads, sparse indexes, floor look-ups, range coalescing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_offsets(df: DataFrame, partition: str, order: list[str]) -> DataFrame:
    """Adds ``offset``: the dense position of each row in its partition, from 0."""
    return df.withColumn("offset", (F.row_number().over(Window.partitionBy(partition).orderBy(*order)) - 1).cast("bigint"))


def committed(log: DataFrame, watermarks: DataFrame) -> DataFrame:
    """The rows below their partition's high watermark; partitions without one show nothing."""
    return log.join(watermarks, "partition").filter("offset < high_watermark")


def seek(requested: Column, log_start: Column, high_watermark: Column) -> Column:
    """A requested offset, clamped into [log_start, high_watermark]."""
    return F.least(F.greatest(requested, log_start), high_watermark)


def classify_offset(offset: Column, log_start: Column, log_end: Column) -> Column:
    """'below' the log, 'in' it (its end included) or 'beyond' it."""
    return F.when(offset < log_start, F.lit("below")).when(offset > log_end, F.lit("beyond")).otherwise(F.lit("in"))


def reset_offset(committed: Column, first: Column, high_watermark: Column, policy: str) -> tuple[Column, Column]:
    """(offset, reason): the committed offset if it still exists, else the policy's end of the log."""
    if policy not in ("earliest", "latest"):
        raise ValueError(f"unknown reset policy {policy}")
    target = first if policy == "earliest" else high_watermark
    gone, aged = committed.isNull(), committed < first
    return (
        F.when(gone | aged, target).otherwise(committed),
        F.when(gone, F.lit("missing")).when(aged, F.lit("aged-out")).otherwise(F.lit("committed")),
    )


def time_index(log: DataFrame, interval: int, time: str = "t") -> DataFrame:
    """Every ``interval``-th row of a partition whose time exceeds all indexed times before it."""
    if interval < 1:
        raise ValueError("the interval must be at least 1")
    sparse = log.filter((F.col("offset") + 1) % interval == 0).select("partition", "offset", time)
    before = Window.partitionBy("partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return sparse.withColumn("__m", F.max(time).over(before)).filter(F.col("__m").isNull() | (F.col(time) > F.col("__m"))).drop("__m")


def offset_for_time(log: DataFrame, targets: DataFrame, time: str = "t") -> DataFrame:
    """For each (partition, target): the first offset, in offset order, whose time is at least target.

    Only rows whose time exceeds all times before them can be first; among those, times rise with
    offsets, so the next time up decides. That is a floor look-up in mirrored time.
    """
    before = Window.partitionBy("partition").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    records = log.withColumn("__m", F.max(time).over(before)).filter(F.col("__m").isNull() | (F.col(time) > F.col("__m")))
    index = records.select("partition", (-F.col(time)).alias("__at"), F.col("offset"))
    found = floor_join(targets.select("partition", "target", (-F.col("target")).alias("__at")), index, ["partition"], "__at", "offset")
    ends = log.groupBy("partition").agg((F.max("offset") + 1).alias("__end"))
    return found.join(ends, "partition", "left").select("partition", "target", F.coalesce("offset", "__end").alias("offset"))


def floor_join(probe: DataFrame, index: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Adds ``value`` of the index row with the greatest ``at`` not above the probe's; null if none.

    One union and one window, so both sides are shuffled once on ``keys`` and never paired.
    """
    p = probe.withColumn("__side", F.lit(1)).withColumn("__v", F.lit(None).cast(index.schema[value].dataType))
    extra = [c for c in probe.columns if c not in (*keys, at)]
    i = index.select(*keys, at, *(F.lit(None).cast(probe.schema[c].dataType).alias(c) for c in extra), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = p.select(*keys, at, *extra, "__side", "__v").unionByName(i).withColumn(value, F.last("__v", ignorenulls=True).over(w))
    return both.filter("__side = 1").drop("__side", "__v")


def coalesce_ranges(ranges: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Half-open ranges that overlap or touch become one, with ``members`` and ``raw`` length."""
    order = Window.partitionBy(*keys).orderBy(start, stop)
    reach = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    islands = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        islands.groupBy(*keys, "__island")
        .agg(F.min(start).alias(start), F.max(stop).alias(stop), F.count("*").alias("members"), F.sum(F.col(stop) - F.col(start)).alias("raw"))
        .drop("__island")
    )


def contiguous_prefix(positions: DataFrame, keys: list[str], position: str, done: str) -> DataFrame:
    """(keys, committed): the last acknowledged position before the first unacknowledged one."""
    first_open = Window.partitionBy(*keys)
    marked = positions.withColumn("__open", F.min(F.when(~F.col(done), F.col(position))).over(first_open))
    return marked.groupBy(*keys).agg(F.max(F.when(F.col("__open").isNull() | (F.col(position) < F.col("__open")), F.col(position))).alias("committed"))
