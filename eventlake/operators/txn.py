"""Compaction, retention, idempotence and transactional visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.operators.log import coalesce_ranges, floor_join


def compact(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key; combined before the shuffle, so a hot key is no burden."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"__last.{c}").alias(c) for c in log.columns))


def reap_tombstones(compacted: DataFrame, value: str, offset: str, born: str, floor: Column, now: Column, retention: int, strict: bool = True) -> DataFrame:
    """Drops tombstones that all consumers have passed and that are older than ``retention``."""
    age = now - F.col(born)
    old = age > retention if strict else age >= retention
    return compacted.filter(~(F.col(value).isNull() & (F.col(offset) < floor) & old))


def dirty_ratio(log: DataFrame, partition: str, keys: list[str]) -> DataFrame:
    """(partition, total, superseded, ratio)."""
    g = log.groupBy(partition).agg(F.count("*").alias("total"), F.countDistinct(*keys).alias("__live"))
    return g.select(partition, "total", (F.col("total") - F.col("__live")).alias("superseded"), ((F.col("total") - F.col("__live")) / F.col("total")).alias("ratio"))


def drop_prefix(segments: DataFrame, partition: str, base: str, size: str, age: str, most_bytes: int, most_age: int, floor: str) -> DataFrame:
    """Marks the oldest segments that retention drops.

    A segment goes while it is too old or the bytes from it on exceed the cap, its end is not above
    the committed ``floor``, and it is not the last; the first that stays ends the prefix.
    """
    w = Window.partitionBy(partition).orderBy(base)
    left = F.sum(size).over(w.rowsBetween(0, Window.unboundedFollowing))
    end = F.lead(base).over(w)
    goes = ((F.col(age) > most_age) | (left > most_bytes)) & end.isNotNull() & (end <= F.col(floor))
    marked = segments.withColumn("__g", goes.cast("int"))
    return marked.withColumn("dropped", F.min("__g").over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("__g")


def absorb_duplicates(produced: DataFrame, producer: list[str], sequence: str, order: str) -> DataFrame:
    """Marks what an idempotent log takes: the first arrival of each sequence number of a producer."""
    first = F.row_number().over(Window.partitionBy(*producer, sequence).orderBy(order)) == 1
    return produced.withColumn("accepted", first)


def sequence_gaps(produced: DataFrame, producer: list[str], sequence: str) -> DataFrame:
    """(producer, after, missing) where sequence numbers are skipped."""
    distinct = produced.select(*producer, sequence).distinct()
    step = F.lead(sequence).over(Window.partitionBy(*producer).orderBy(sequence)) - F.col(sequence)
    return distinct.withColumn("__d", step).filter("__d > 1").select(*producer, F.col(sequence).alias("after"), (F.col("__d") - 1).alias("missing"))


def fence(produced: DataFrame, producer: list[str], epoch: str, order: str) -> DataFrame:
    """Marks rows whose epoch is below one that came before them."""
    seen = F.max(epoch).over(Window.partitionBy(*producer).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return produced.withColumn("fenced", F.col(epoch) < seen)


def without_aborted(log: DataFrame, aborted: DataFrame, producer: str, offset: str) -> DataFrame:
    """Rows that no aborted range (producer, first, last), ends included, covers.

    Ranges that overlap become one; then the range that begins last before a row is the only one
    that can cover it, so one floor look-up decides and no row is paired with all ranges.
    """
    whole = coalesce_ranges(aborted.select(producer, F.col("first").alias("start"), (F.col("last") + 1).alias("stop")), [producer])
    index = whole.select(producer, F.col("start").alias(offset), F.col("stop").alias("__stop"))
    return floor_join(log, index, [producer], offset, "__stop").filter(F.col("__stop").isNull() | (F.col("__stop") <= F.col(offset))).drop("__stop")


def last_stable(watermarks: DataFrame, open_txns: DataFrame) -> DataFrame:
    """(partition, high_watermark, last_stable, withheld)."""
    first = open_txns.groupBy("partition").agg(F.min("first_offset").alias("__f"))
    lso = F.least("high_watermark", F.coalesce("__f", "high_watermark"))
    return watermarks.join(first, "partition", "left").select("partition", "high_watermark", lso.alias("last_stable"), (F.col("high_watermark") - lso).alias("withheld"))


def decide(votes: DataFrame, txn: str, vote: str, expected: int) -> DataFrame:
    """Two-phase commit: 'commit' if all expected voters said yes, 'abort' if one said no, else 'waiting'."""
    g = votes.groupBy(txn).agg(F.count("*").alias("__n"), F.bool_and(vote).alias("__y"))
    return g.select(txn, F.when(~F.col("__y"), "abort").when(F.col("__n") >= expected, "commit").otherwise("waiting").alias("decision"))
