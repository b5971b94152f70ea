"""Greedy byte-bounded segments of a log, and what follows from segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def roll(log: DataFrame, partition: str, offset: str, size: str, most: int) -> DataFrame:
    """(partition, base, next_offset, bytes): a segment ends where the next record would exceed ``most``.

    Where a segment ends depends on all before it, so a partition's records pass one task in their order, batch
    by batch; only the open segment is kept. A record without a size is a segment of its own.
    """
    slim = log.select(partition, F.col(offset).cast("bigint").alias(offset), F.col(size).cast("bigint").alias(size))
    kind = slim.schema[partition].dataType
    schema = T.StructType([T.StructField(partition, kind), *(T.StructField(c, T.LongType()) for c in ("base", "next_offset", "bytes"))])

    # nested, so that workers get it by value and need not import this package
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, types = None, ["base", "next_offset", "bytes"], None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[partition, *names])

        for batch in batches:
            types, ended = [batch.schema.field(0).type, *[pa.int64()] * 3], []
            for key, at, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                after = None if at is None else at + 1
                if last is not None:
                    # of floating keys all NaN are one
                    same = key == last[0] or (key != key and last[0] != last[0])
                    if same and n is not None and last[3] is not None and last[3] + n <= most:
                        last[2], last[3] = after, last[3] + n
                        continue
                    ended.append(last)
                last = [key, at, after, n]
            if ended:
                yield out(ended)
        if last is not None:
            yield out([last])

    return slim.repartition(partition).sortWithinPartitions(partition, offset, size).mapInArrow(run, schema)


def continuity(segments: DataFrame, partition: str, base: str, next_offset: str) -> DataFrame:
    """(partition, base, gap): segments that do not begin where the one before ended."""
    before = F.lag(next_offset).over(Window.partitionBy(partition).orderBy(base))
    return segments.withColumn("gap", F.col(base) - before).filter("gap <> 0").select(partition, base, "gap")
