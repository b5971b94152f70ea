"""Integer event time: whole seconds since 1970-01-01, without any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tick(ts: Column | str) -> Column:
    """Seconds of a TIMESTAMP_NTZ as BIGINT; null for null."""
    c = F.col(ts) if isinstance(ts, str) else ts
    day = F.unix_date(F.to_date(c)).cast("bigint")
    return day * 86400 + F.hour(c).cast("bigint") * 3600 + F.minute(c).cast("bigint") * 60 + F.second(c).cast("bigint")
