"""Operators over an explicit order: moving statistics, runs, folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_n(keys: list[str], order: list[str], n: int):
    """The window of a row and the n - 1 before it."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, run, value, length): maximal runs of equal values, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    numbered = df.withColumn("__f", fresh).withColumn("run", F.sum("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run", value).agg(F.count("*").alias("length"))


def fold(df: DataFrame, keys: list[str], order: list[str], state: Column, step, finish=None) -> DataFrame:
    """(keys, result): ``step(state, row)`` over each key's rows in order.

    The rows of a key are gathered into one array, so this is for keys of bounded length.
    """
    rows = F.sort_array(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in (*keys, *order)))))
    folded = F.aggregate(F.col("__rows"), state, step, finish) if finish else F.aggregate(F.col("__rows"), state, step)
    return df.groupBy(*keys).agg(rows.alias("__rows")).select(*keys, folded.alias("result"))


#: Numbers of a range of a total order that one task sums through.
RANGE = 1_000_000


def sum_before(df: DataFrame, order: str, value: str, name: str, rows: int = RANGE) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows with a lower integer ``order``; 0 for the first.

    Ranges of ``rows`` numbers are summed before the shuffle; a window over the ranges carries the sums on,
    and each range is then ordered by itself.
    """
    part = F.floor(F.col(order) / rows).cast("bigint")
    sums = df.groupBy(part.alias("__r")).agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("__r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("__r", part).join(sums.select("__r", before.alias("__before")), "__r").withColumn(name, F.col("__before") + own).drop("__r", "__before")


def slope(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """(keys, first, last, slope): change per tick between the first and the last sample."""
    g = df.groupBy(*keys).agg(F.min(t).alias("__a"), F.max(t).alias("__b"), F.min_by(value, t).alias("first"), F.max_by(value, t).alias("last"))
    return g.select(*keys, "first", "last", F.when(F.col("__b") > F.col("__a"), (F.col("last") - F.col("first")) / (F.col("__b") - F.col("__a"))).otherwise(0.0).alias("slope"))
