"""Stable placement hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha_slot(key: Column, n: int | Column) -> Column:
    """The first eight hex digits of the key's SHA-256, modulo ``n``; null for a null key."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % n
