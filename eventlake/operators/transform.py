"""Per-record transforms, routing, event time and record fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chain(df: DataFrame, steps: list) -> DataFrame:
    """Applies frame-to-frame steps in order; Catalyst fuses them into one pass."""
    return reduce(lambda d, step: step(d), steps, df)


def branch(conditions: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first branch whose condition holds; ``default``, or '<dropped>'."""
    out = F.when(conditions[0][1], F.lit(conditions[0][0]))
    for name, c in conditions[1:]:
        out = out.when(c, F.lit(name))
    return out.otherwise(F.lit(default if default is not None else "<dropped>"))


def event_time(raw: Column, arrival: Column, policy: str = "arrival") -> Column:
    """A raw time within 0..10^15, else the arrival time ('arrival') or null ('drop')."""
    if policy not in ("arrival", "drop"):
        raise ValueError(f"unknown policy {policy}")
    valid = raw.between(0, 10**15)
    return F.when(valid, raw).otherwise(arrival if policy == "arrival" else F.lit(None))


def record_checksum(value: Column, key: Column, headers: Column | None = None) -> Column:
    """The first 16 hex digits of SHA-256 over value, key and header parts, joined by a pipe byte."""
    parts = [value.cast("binary"), F.lit(b"|"), F.coalesce(key.cast("binary"), F.lit(b""))]
    body = F.concat(*parts)
    if headers is not None:
        flat = F.array_join(F.flatten(F.transform(headers, lambda h: F.array(h["name"], h["value"]))), "|")
        body = F.when(F.size(headers) > 0, F.concat(body, F.lit(b"|"), flat.cast("binary"))).otherwise(body)
    return F.substring(F.sha2(body, 256), 1, 16)


def record_size(value: Column, key: Column) -> Column:
    return F.octet_length(value) + F.coalesce(F.octet_length(key), F.lit(0))
