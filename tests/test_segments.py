"""Rolled segments against a plain loop, and their time on a long partition."""

from __future__ import annotations

import random
import time

from eventlake.operators import segments


def looped(rows, most):
    out = []
    for key, at, size in sorted(rows, key=lambda r: (str(r[0]), r[1], (r[2] is not None, r[2] or 0))):
        fits = out and out[-1][0] == key and None not in (size, out[-1][3]) and out[-1][3] + size <= most
        if fits:
            out[-1][2:] = at + 1, out[-1][3] + size
        else:
            out.append([key, at, at + 1, size])
    return sorted(map(str, out))


def rolled(spark, rows, most, types="p string, o int, n int"):
    df = spark.createDataFrame(rows, types).repartition(5)
    return sorted(str(list(r)) for r in segments.roll(df, "p", "o", "n", most).collect())


def test_segments_equal_a_loop(spark):
    rng = random.Random(5)
    rows = [(f"p{i % 7}" if i % 7 else None, i // 7, rng.choice([0, 1, 5, 40, 99, 100, 101, 500])) for i in range(30_000)]
    rows += [("odd", i, None if i % 5 == 0 else 30) for i in range(40)] + [("one", 3, 20), ("one", 3, 90), ("one", 3, None)]
    assert rolled(spark, rows, 100) == looped(rows, 100)
    numbers = [(float("nan"), i, 40) for i in range(5)] + [(1.5, i, 40) for i in range(5)]
    assert [r.split(",", 1)[1] for r in rolled(spark, numbers, 100, "p double, o int, n int")] == [" 0, 2, 80]", " 2, 4, 80]", " 4, 5, 40]"] * 2
    assert rolled(spark, [], 100) == []


def test_a_long_partition_takes_time_in_proportion(spark):
    rows = [("a", i, 10) for i in range(30_000)]
    start = time.monotonic()
    assert len(rolled(spark, rows, 10)) == 30_000
    assert time.monotonic() - start < 20
