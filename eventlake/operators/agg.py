"""Mergeable aggregates: means, histograms and percentiles, sketches, replicated values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def partial_means(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, total, n): what a mean can be merged from."""
    return df.groupBy(*group).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def merge_means(partials: DataFrame, group: list[str]) -> DataFrame:
    """The mean of all rows, and the mean of the partial means that it is often mistaken for."""
    return partials.groupBy(*group).agg(
        (F.sum("total") / F.sum("n")).alias("mean"), F.avg(F.col("total") / F.col("n")).alias("mean_of_means"), F.sum("n").alias("n")
    )


def histogram(df: DataFrame, group: list[str], value: Column, width: float) -> DataFrame:
    """(group, bucket, n) with bucket = floor(value / width) * width."""
    return df.groupBy(*group, (F.floor(value / width) * width).alias("bucket")).agg(F.count("*").alias("n"))


def bucket_percentiles(hist: DataFrame, group: list[str], percents: list[float]) -> DataFrame:
    """The first bucket whose running count reaches p per cent of the total, for each p."""
    w = Window.partitionBy(*group).orderBy("bucket")
    running = hist.withColumn("__c", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum("n").over(Window.partitionBy(*group)))
    return running.groupBy(*group).agg(*(F.min(F.when(F.col("__c") * 100.0 >= F.col("__t") * p, F.col("bucket"))).alias(f"p{p:g}".replace(".", "_")) for p in percents))


def ranked(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Adds ``rank`` from 0 and the group's ``size``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(value)) - 1).withColumn("size", F.count("*").over(Window.partitionBy(*group)))


def selected(df: DataFrame, group: list[str], value: str, low: Column, high: Column, buckets: int = 4096) -> DataFrame:
    """(group, rank, value) of the ranks ``low`` to ``high``, from 0, which are columns over ``size``.

    A first pass counts ``buckets`` equal ranges of values per group, combined before the shuffle; only
    rows of the ranges that hold the ranks are then ordered. So a group of any size is counted by all
    tasks, and a sort sees a few thousandths of it, unless most of its values are in one range.
    """
    kept = df.filter(F.col(value).isNotNull())
    span = kept.groupBy(*group).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    place = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * buckets)).otherwise(F.lit(0))
    placed = kept.join(span, group).withColumn("__b", place.cast("bigint")).select(*group, value, "__b")
    counts = placed.groupBy(*group, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*group)
    counts = counts.withColumn("size", F.sum("__n").over(w)).withColumn("__before", F.sum("__n").over(w.orderBy("__b")) - F.col("__n"))
    wanted = counts.withColumn("__low", low).withColumn("__high", high).filter("__before <= __high and __before + __n > __low")
    # the few ranges that hold a rank; their rows are ordered within their range
    inside = placed.join(wanted.drop("__n", "size"), [*group, "__b"])
    rank = F.col("__before") + F.row_number().over(Window.partitionBy(*group, "__b").orderBy(value)) - 1
    return inside.withColumn("rank", rank).filter("rank >= __low and rank <= __high").select(*group, "rank", value)


def kth_percentile(df: DataFrame, group: list[str], value: str, percent: float) -> DataFrame:
    """The value of rank min(n - 1, floor(p n / 100)), an element of the input."""
    at = F.least(F.col("size") - 1, F.floor(F.col("size") * percent / 100))
    return selected(df, group, value, at, at).select(*group, F.col(value).alias("value"))


def medians(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The exact median; the mean of the middle two of an even number."""
    middle = selected(df, group, value, F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2))
    return middle.groupBy(*group).agg(F.avg(value).alias("median"))


def reservoir(df: DataFrame, group: list[str], key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows of each group, every subset equally likely over seeds: those with the least keyed hashes.

    The hash is the order, so samples of parts merge by taking the least again; partial lists are
    combined before the shuffle.
    """
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), 1, 15), 16, 10).cast("bigint")
    rows = df.withColumn("__h", draw)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("__h", key))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= size).drop("__h", "__rank")


def hot(counts: DataFrame, count: str, multiple: float = 3) -> DataFrame:
    """Rows that hold at least ``multiple`` times an even share."""
    even = F.sum(count).over(Window.partitionBy(F.lit(1))) / F.count("*").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col(count) / even).filter(F.col("share") >= multiple)


def newest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last writer wins: the values of the greatest ``order`` of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select(*keys, *(F.col(f"__v.{v}").alias(v) for v in values))


def live_elements(adds: DataFrame, removes: DataFrame, element: str, tag: str) -> DataFrame:
    """Observed-remove set: elements with an add tag that no removal saw."""
    return adds.join(removes, [element, tag], "left_anti").select(element).distinct()


def counter_value(increments: DataFrame, node: str, seen: str) -> DataFrame:
    """Grow-only counter: per-node maximum, summed."""
    return increments.groupBy(node).agg(F.max(seen).alias("__m")).agg(F.sum("__m").alias("value"))


def bloom_size(members: int, false_rate: float) -> tuple[int, int]:
    """(bits, hashes) of a filter that lets about ``false_rate`` of strangers pass."""
    bits = max(64, math.ceil(-members * math.log(false_rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / max(members, 1) * math.log(2)))


def bloom_bits(df: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """The distinct (bit) positions that the keys set in a filter of ``bits`` bits."""
    positions = F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(bits)) for k in range(hashes)))
    return df.select(F.explode(positions).alias("bit")).distinct()


def bloom_may_contain(df: DataFrame, key: str, filter_bits: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Rows whose key may be in the filter; none that is in it is lost."""
    probe = df.select(key).distinct()
    hit = probe.select(key, F.explode(F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(bits)) for k in range(hashes)))).alias("bit")).distinct()
    need = hit.groupBy(key).agg(F.count("*").alias("__need"))
    have = hit.join(filter_bits, "bit").groupBy(key).agg(F.count("*").alias("__have"))
    passed = need.join(have, key).filter("__need = __have").select(key)
    return df.join(passed, key, "left_semi")


def count_min(df: DataFrame, key: str, rows: int, columns: int) -> DataFrame:
    """(row, cell, n): a count-min grid."""
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(F.col(key), F.lit(r)), F.lit(columns)).alias("cell")) for r in range(rows)))
    return df.select(F.explode(cells).alias("c")).select("c.row", "c.cell").groupBy("row", "cell").agg(F.count("*").alias("n"))


def count_min_estimate(keys: DataFrame, key: str, grid: DataFrame, rows: int, columns: int) -> DataFrame:
    """(key, estimate): never below the true count."""
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(F.col(key), F.lit(r)), F.lit(columns)).alias("cell")) for r in range(rows)))
    asked = keys.select(key, F.explode(cells).alias("c")).select(key, "c.row", "c.cell")
    return asked.join(grid, ["row", "cell"], "left").groupBy(key).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
