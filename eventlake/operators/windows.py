"""Event-time windows. One builder serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Groups by ``keys`` and the window of ``size`` that holds ``ts``.

    Rows with a null ``ts`` belong to no window and are left out. Returns the keys,
    ``window_start``, ``window_end`` and the aggregates.
    """
    grouped = df.groupBy(*keys, F.window(ts, size).alias("__w")).agg(*aggregates)
    rest = [c for c in grouped.columns if c not in (*keys, "__w")]
    return grouped.select(*keys, F.col("__w.start").alias("window_start"), F.col("__w.end").alias("window_end"), *rest)


def hopping(df: DataFrame, t: str, size: int, hop: int) -> DataFrame:
    """One row per window [start, start + size) that holds integer time ``t``; starts are multiples of ``hop`` from 0 on."""
    if not 0 < hop <= size:
        raise ValueError("the hop must be positive and not exceed the size")
    last = F.floor(F.col(t) / hop).cast("bigint") * hop
    first = F.greatest(F.lit(0).cast("bigint"), (F.floor((F.col(t) - size) / hop).cast("bigint") + 1) * hop)
    return df.withColumn("window_start", F.explode(F.when(last >= first, F.sequence(first, last, F.lit(hop).cast("bigint")))))


def sessions(df: DataFrame, keys: list[str], t: str, gap: int) -> DataFrame:
    """(keys, first, last, events): events of a key whose distance is at most ``gap`` are one session."""
    order = Window.partitionBy(*keys).orderBy(t)
    marked = df.withColumn("__n", F.when(F.col(t) - F.lag(t).over(order) <= gap, 0).otherwise(1))
    numbered = marked.withColumn("__s", F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__s").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("events")).drop("__s")


#: Rows of a range of a total order that one task carries a maximum through.
RANGE_ROWS = 1_000_000


def greatest_before(df: DataFrame, seq: str, value: str, name: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Adds ``name``: the greatest ``value`` of all rows with a lower integer ``seq``; null for the first.

    Ranges of ``rows`` numbers are reduced to their maximum, combined before the shuffle; a window over
    the ranges carries it on, and each range is then ordered by itself. So one total order takes
    as many tasks as it has ranges.
    """
    part = F.floor(F.col(seq) / rows).cast("bigint")
    tops = df.groupBy(part.alias("__r")).agg(F.max(value).alias("__top"))
    carried = tops.withColumn("__carry", F.max("__top").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1))).drop("__top")
    own = F.max(value).over(Window.partitionBy("__r").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__r", part).join(carried, "__r").withColumn(name, F.greatest(own, F.col("__carry"))).drop("__r", "__carry")


def closed_windows(df: DataFrame, t: str, size: int, lateness: int, seq: str, value: Column) -> DataFrame:
    """Tumbling sums replayed in arrival order.

    The watermark of a row is the greatest time that arrived up to it. A row whose window was closed
    before it (watermark at or above the window's end plus ``lateness``) is dropped and counted. The
    greatest time is carried over ranges of the arrival order.
    """
    start = F.floor(F.col(t) / size).cast("bigint") * size
    marked = greatest_before(df, seq, t, "__wm").select(start.alias("window_start"), F.coalesce("__wm", F.lit(-1)).alias("__wm"), value.alias("__v"))
    late = F.col("__wm") >= F.col("window_start") + size + lateness
    return marked.groupBy("window_start").agg(F.sum(F.when(~late, F.col("__v"))).alias("total"), F.count_if(late).alias("dropped"))


def suppress(df: DataFrame, window_end: str, seq: str, value: str, t: str, grace: int) -> DataFrame:
    """The last value of every window that stream time has passed by ``grace``, with what it absorbed."""
    final = df.groupBy(window_end).agg(F.max_by(value, seq).alias("v"), (F.count("*") - 1).alias("absorbed"))
    now = df.agg(F.max(t).alias("__now"))  # one row
    return final.join(F.broadcast(now), F.col("__now") >= F.col(window_end) + grace).drop("__now")


def retractions(df: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """(keys, seq, add, value): every update adds its value and takes the previous one back."""
    old = F.lag(value).over(Window.partitionBy(*keys).orderBy(seq))
    both = df.select(*keys, seq, F.array(F.struct(F.lit(False).alias("add"), old.alias("value")), F.struct(F.lit(True).alias("add"), F.col(value).alias("value"))).alias("__c"))
    return both.select(*keys, seq, F.explode("__c").alias("__c")).select(*keys, seq, "__c.add", "__c.value").filter("value IS NOT NULL")


def late_rows(df: DataFrame, seq: str, t: str, bound: int) -> DataFrame:
    """Rows older than the watermark, which trails the greatest time before them by ``bound``."""
    return greatest_before(df, seq, t, "__wm").withColumn("wm", F.col("__wm") - bound).drop("__wm").filter(F.col(t) < F.col("wm"))
