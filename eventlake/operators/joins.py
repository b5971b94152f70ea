"""Joins over time and over folded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.operators.log import floor_join


def interval_join(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, window: int, how: str = "inner") -> DataFrame:
    """Pairs of equal ``key`` whose times differ by at most ``window``, inclusive.

    Both sides are cut into time buckets of ``window``; a left row meets the buckets before, of and
    behind its own. So the join has an equality on (key, bucket), and a key with many rows is
    spread over its buckets. With ``how='left'`` unmatched left rows come once each with nulls,
    repeated rows and rows with nulls too.
    """
    if window < 1:
        raise ValueError("the window must be positive")
    bucket = lambda c: F.floor(F.col(c) / window).cast("bigint")
    if how == "left":
        left = left.withColumn("__id", F.xxhash64(*left.columns, *(F.col(c).isNull() for c in left.columns)))
    r = right.withColumn("__b", bucket(right_t))
    near = left.withColumn("__b", F.explode(F.array(bucket(left_t) - 1, bucket(left_t), bucket(left_t) + 1)))
    pairs = near.join(r, [key, "__b"]).filter(F.abs(F.col(left_t) - F.col(right_t)) <= window).drop("__b")
    if how == "inner":
        return pairs
    # rows that are alike in all columns match alike, so a hash of the columns and their nulls stands for a row
    missing = left.join(pairs.select("__id").distinct(), "__id", "left_anti")
    return pairs.unionByName(missing, allowMissingColumns=True).drop("__id")


def as_of(probe: DataFrame, versions: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """The latest version with effective time not after the probe's time; null if there is none."""
    return floor_join(probe, versions, keys, at, value)


def enrich(facts: DataFrame, dimension: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Foreign-key look-up; Spark broadcasts the dimension when its size allows."""
    return facts.join(dimension, key, how)


def latest(changelog: DataFrame, keys: list[str], seq: str, value: str) -> DataFrame:
    """The table a changelog folds to: the last value of each key, without keys whose last is null."""
    folded = changelog.groupBy(*keys).agg(F.max_by(F.struct(value), seq).alias("__s"))
    return folded.select(*keys, F.col(f"__s.{value}").alias(value)).filter(F.col(value).isNotNull())


def table_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Inner join of two folded tables; the value is the sum of both."""
    return left.withColumnRenamed(value, "__l").join(right.withColumnRenamed(value, "__r"), keys).select(*keys, (F.col("__l") + F.col("__r")).alias(value))


def cogroup(streams: dict[str, tuple[DataFrame, Column]], key: str) -> DataFrame:
    """Folds several streams into one sum per key, each by its own contribution.

    Also tells how many of the streams contribute to a key.
    """
    parts = [df.select(key, F.lit(name).alias("__s"), c.alias("__c")) for name, (df, c) in streams.items()]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.sum("__c").alias("state"), F.countDistinct("__s").alias("streams"))
