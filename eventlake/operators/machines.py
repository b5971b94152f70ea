"""State machines as folds over a key's history in order.

Each returns (keys, result) with a struct of counters. A key's rows are folded in one array, so
keys must have histories that fit a task; the machines themselves keep a few numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.operators.ordered import fold


def _long(x: int | None) -> Column:
    return F.lit(x).cast("bigint")


def circuit_breaker(df: DataFrame, keys: list[str], t: str, seq: str, failed: str, threshold: int, cooldown: int) -> DataFrame:
    """Calls let through and refused by a breaker.

    It opens after ``threshold`` failures in a row, lets one call probe after ``cooldown``, closes on
    the probe's success and opens anew on its failure.
    """
    state = F.struct(_long(0).alias("streak"), _long(None).alias("opened"), _long(0).alias("passed"), _long(0).alias("refused"), _long(0).alias("opens"))

    def step(s, r):
        waiting = s["opened"].isNotNull() & (r[t] - s["opened"] < cooldown)
        probe = s["opened"].isNotNull() & ~waiting
        streak = F.when(r[failed], s["streak"] + 1).otherwise(_long(0))
        opens = r[failed] & (probe | (streak >= threshold))
        through = F.struct(
            F.when(opens, _long(0)).otherwise(streak).alias("streak"), F.when(opens, r[t]).alias("opened"), (s["passed"] + 1).alias("passed"),
            s["refused"].alias("refused"), (s["opens"] + opens.cast("bigint")).alias("opens"),
        )
        held = F.struct(s["streak"].alias("streak"), s["opened"].alias("opened"), s["passed"].alias("passed"), (s["refused"] + 1).alias("refused"), s["opens"].alias("opens"))
        return F.when(waiting, held).otherwise(through)

    return fold(df.select(*keys, t, seq, failed), keys, [t, seq], state, step)


def hysteresis(df: DataFrame, keys: list[str], seq: str, delta: str, high: int, low: int) -> DataFrame:
    """A buffer that pauses its source at ``high`` and resumes it at ``low`` or less; arrivals while paused are put off."""
    state = F.struct(_long(0).alias("level"), F.lit(False).alias("paused"), _long(0).alias("pauses"), _long(0).alias("put_off"))

    def step(s, r):
        off = s["paused"] & (r[delta] > 0)
        level = F.when(off, s["level"]).otherwise(F.greatest(_long(0), s["level"] + r[delta]))
        paused = F.when(level >= high, F.lit(True)).when(level <= low, F.lit(False)).otherwise(s["paused"])
        return F.struct(level.alias("level"), paused.alias("paused"), (s["pauses"] + (paused & ~s["paused"]).cast("bigint")).alias("pauses"), (s["put_off"] + off.cast("bigint")).alias("put_off"))

    return fold(df.select(*keys, seq, delta), keys, [seq], state, step)


def lru_hits(df: DataFrame, keys: list[str], seq: str, item: str, capacity: int) -> DataFrame:
    """Hits and misses of a cache of ``capacity`` items that forgets the least recently used."""
    kind = df.schema[item].dataType.simpleString()
    state = F.struct(F.array().cast(f"array<{kind}>").alias("held"), _long(0).alias("hits"), _long(0).alias("misses"))

    def step(s, r):
        hit = F.array_contains(s["held"], r[item])
        held = F.slice(F.concat(F.array(r[item]), F.array_remove(s["held"], r[item])), 1, capacity)
        return F.struct(held.alias("held"), (s["hits"] + hit.cast("bigint")).alias("hits"), (s["misses"] + (~hit).cast("bigint")).alias("misses"))

    return fold(df.select(*keys, seq, item), keys, [seq], state, step)


def retry_budget(df: DataFrame, keys: list[str], seq: str, failed: str, percent: int) -> DataFrame:
    """Retries granted while they stay within ``percent`` of the requests so far."""
    state = F.struct(_long(0).alias("requests"), _long(0).alias("retries"), _long(0).alias("refused"))

    def step(s, r):
        requests = s["requests"] + 1
        granted = r[failed] & ((s["retries"] + 1) * 100 <= requests * percent)
        return F.struct(requests.alias("requests"), (s["retries"] + granted.cast("bigint")).alias("retries"), (s["refused"] + (r[failed] & ~granted).cast("bigint")).alias("refused"))

    return fold(df.select(*keys, seq, failed), keys, [seq], state, step)


def leases(df: DataFrame, keys: list[str], t: str, seq: str, holder: str, term: int) -> DataFrame:
    """A lock leased for ``term``: grants to new holders raise the fencing token, the holder renews, others are refused."""
    kind = df.schema[holder].dataType.simpleString()
    state = F.struct(F.lit(None).cast(kind).alias("holder"), _long(None).alias("until"), _long(0).alias("token"), _long(0).alias("renewed"), _long(0).alias("refused"))

    def step(s, r):
        mine = s["holder"].eqNullSafe(r[holder]) & (r[t] < s["until"])
        free = s["until"].isNull() | (r[t] >= s["until"])
        won = F.struct(r[holder].alias("holder"), (r[t] + term).alias("until"), (s["token"] + free.cast("bigint")).alias("token"), (s["renewed"] + (~free).cast("bigint")).alias("renewed"), s["refused"].alias("refused"))
        lost = F.struct(s["holder"].alias("holder"), s["until"].alias("until"), s["token"].alias("token"), s["renewed"].alias("renewed"), (s["refused"] + 1).alias("refused"))
        return F.when(free | F.coalesce(mine, F.lit(False)), won).otherwise(lost)

    return fold(df.select(*keys, t, seq, holder), keys, [t, seq], state, step)


def optimistic_writes(df: DataFrame, keys: list[str], seq: str, read_version: str) -> DataFrame:
    """Compare-and-set: a write goes through if it read the version the key has; each success raises it."""
    state = F.struct(_long(0).alias("version"), _long(0).alias("conflicts"))

    def step(s, r):
        ok = r[read_version] == s["version"]
        return F.struct((s["version"] + ok.cast("bigint")).alias("version"), (s["conflicts"] + (~ok).cast("bigint")).alias("conflicts"))

    return fold(df.select(*keys, seq, read_version), keys, [seq], state, step)


def credits(df: DataFrame, keys: list[str], seq: str, grant: str, start: int) -> DataFrame:
    """Credit-based sending: positive rows grant credits, others ask to send one record."""
    state = F.struct(_long(start).alias("credit"), _long(0).alias("sent"), _long(0).alias("blocked"))

    def step(s, r):
        asks = r[grant] <= 0
        ok = asks & (s["credit"] > 0)
        return F.struct(F.when(asks, s["credit"] - ok.cast("bigint")).otherwise(s["credit"] + r[grant]).alias("credit"), (s["sent"] + ok.cast("bigint")).alias("sent"), (s["blocked"] + (asks & ~ok).cast("bigint")).alias("blocked"))

    return fold(df.select(*keys, seq, grant), keys, [seq], state, step)


def dedupe_window(df: DataFrame, keys: list[str], t: str, seq: str, window: int) -> DataFrame:
    """Accepts a key's row unless it comes less than ``window`` after the last accepted one."""
    state = F.struct(_long(None).alias("since"), _long(0).alias("accepted"), _long(0).alias("dropped"))

    def step(s, r):
        again = F.coalesce(r[t] - s["since"] < window, F.lit(False))
        return F.struct(F.when(again, s["since"]).otherwise(r[t]).alias("since"), (s["accepted"] + (~again).cast("bigint")).alias("accepted"), (s["dropped"] + again.cast("bigint")).alias("dropped"))

    return fold(df.select(*keys, t, seq), keys, [t, seq], state, step)


def hybrid_clock(df: DataFrame, keys: list[str], seq: str, wall: str) -> DataFrame:
    """A hybrid logical clock's last reading (time, counter) after local ticks at the given wall times."""
    state = F.struct(_long(-1).alias("time"), _long(0).alias("counter"))

    def step(s, r):
        ahead = r[wall] > s["time"]
        return F.struct(F.greatest(r[wall], s["time"]).alias("time"), F.when(ahead, _long(0)).otherwise(s["counter"] + 1).alias("counter"))

    return fold(df.select(*keys, seq, wall), keys, [seq], state, step)
