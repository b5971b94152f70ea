"""Admission, sizing and durability rules as column expressions.

Every function takes and returns columns, is null for null arguments where its value would depend
on them, and stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ceil_div(a: Column, b: Column) -> Column:
    return F.ceil(a / b).cast("bigint")


# --- fetch and read path ------------------------------------------------------------------------


def partition_share(available: Column, largest: Column, cap: Column) -> Column:
    """Bytes a partition gets of a fetch: up to the cap, but one record whatever its size."""
    return F.when(available == 0, F.lit(0)).when(largest > cap, largest).otherwise(F.least(available, cap))


def cached_from(log_end: Column, cached_bytes: Column, bytes_per_offset: Column) -> Column:
    return log_end - F.floor(cached_bytes / bytes_per_offset)


def read_cost(converts: Column, encrypts: Column) -> Column:
    """CPU for each byte served, as a multiple of an untouched read."""
    return F.when(converts, F.lit(8.0)).when(encrypts, F.lit(2.0)).otherwise(F.lit(1.0))


def follower_may_serve(leader: Column, follower: Column, most_lag: Column, tolerance: Column) -> Column:
    lag = leader - follower
    return (lag <= most_lag) & (lag <= tolerance)


def format_path(client: Column, broker: Column) -> Column:
    return F.when(client > broker, "refused").when(client == broker, "zero-copy").otherwise("converted")


# --- produce path -------------------------------------------------------------------------------


def delivery_guarantee(acks_all: Column, idempotent: Column, transactional: Column, commits_after: Column, commits_in_txn: Column) -> Column:
    """What a consumer that commits after processing, or before it, can count on."""
    exact = idempotent & transactional & commits_in_txn
    return F.when(~acks_all | ~commits_after, "at-most-once").when(exact, "exactly-once").otherwise("at-least-once")


def order_is_safe(in_flight: Column, idempotent: Column) -> Column:
    return (in_flight == 1) | idempotent


def would_reorder(in_flight: Column, idempotent: Column, first_failed: Column) -> Column:
    return ~order_is_safe(in_flight, idempotent) & first_failed


def ack_outcome(mode: Column, in_sync: Column, least: Column) -> Column:
    """What an acknowledgement survives, or that it is refused."""
    return F.when(mode == "none", "nothing").when(mode == "leader", "follower loss").when(in_sync < least, "refused").otherwise("leader loss")


def loses_record(level: Column, leader_fails: Column) -> Column:
    return F.when(level == "none", F.lit(True)).when(level == "leader", leader_fails).otherwise(F.lit(False))


def block_budget_left(budget: Column, metadata: Column, buffer: Column) -> Column:
    return F.greatest(F.lit(0), budget - metadata - buffer)


def durability_source(every_record: Column, copies: Column) -> Column:
    replicated = copies >= 2
    return F.when(replicated & every_record, "both").when(replicated, "replication").when(every_record, "fsync").otherwise("none")


def linger_batch(rate: Column, linger: Column, most: Column) -> Column:
    return F.least(F.floor(rate * linger) + 1, most)


def produce_error(error: Column, idempotent: Column) -> Column:
    retriable = error.isin("not-leader", "request-timeout", "not-enough-replicas", "coordinator-loading")
    return F.when(retriable | ((error == "ack-lost") & idempotent), "retriable").when(error == "ack-lost", "ambiguous").otherwise("fatal")


def first_gate(size: Column, batch_most: Column, request_most: Column, override: Column, broker_most: Column) -> Column:
    """The first size limit that a record exceeds."""
    return F.when(size > batch_most, "batch").when(size > request_most, "request").when(size > F.coalesce(override, broker_most), "message").otherwise("fits")


# --- retention ----------------------------------------------------------------------------------


def compaction_state(age: Column, least: Column, most: Column) -> Column:
    return F.when(age < least, "not-yet-eligible").when(age > most, "overdue").otherwise("eligible")


def tombstone_removable(now: Column, eligible: Column, retention: Column, consumer: Column, offset: Column) -> Column:
    return (now - eligible >= retention) & (consumer > offset)


def grace_over(now: Column, eligible: Column, retention: Column) -> Column:
    return now >= eligible + retention


def roll_triggers(size: Column, age: Column, entries: Column, size_limit: int, age_limit: int, entry_limit: int) -> Column:
    """The limits reached, joined by a plus."""
    return F.concat_ws("+", F.when(size >= size_limit, "size"), F.when(age >= age_limit, "time"), F.when(entries >= entry_limit, "index"))


# --- groups -------------------------------------------------------------------------------------


def active_consumers(consumers: Column, partitions: Column) -> Column:
    return F.least(consumers, partitions)


def idle_consumers(consumers: Column, partitions: Column) -> Column:
    return F.greatest(F.lit(0), consumers - partitions)


def replay_window(rate: Column, interval: Column) -> Column:
    return F.floor(rate * interval).cast("bigint")


def commit_failure(cause: Column, attempt: Column, most: Column) -> Column:
    return F.when((cause == "transient") & (attempt < most), "retry").when(cause == "coordinator-moved", "redirect").otherwise("abandon")


def safe_poll(interval: Column, per_record: Column, margin: float = 0.2) -> Column:
    return F.greatest(F.lit(1), F.floor(interval * (1 - margin) / per_record)).cast("bigint")


def tolerated_misses(session: Column, heartbeat: Column) -> Column:
    return (F.floor(session / heartbeat) - 1).cast("bigint")


def resume_offset(committed: Column) -> Column:
    """The committed offset; -1, not 0, without one."""
    return F.coalesce(committed, F.lit(-1))


# --- replication --------------------------------------------------------------------------------


def catch_up_ticks(boundary: Column, offset: Column, rate: Column) -> Column:
    return F.when(offset >= boundary, F.lit(0)).otherwise(_ceil_div(boundary - offset, rate))


def rack_losses_survived(copies: Column, racks: Column) -> Column:
    return F.greatest(F.lit(0), racks - _ceil_div(copies, racks))


def admits(acks_all: Column, in_sync: Column, floor: Column) -> Column:
    return ~acks_all | (in_sync >= floor)


def epoch_check(request: Column, broker: Column) -> Column:
    return F.when(request < broker, "stale-leader").when(request > broker, "broker-behind").otherwise("current")


def truncation_point(follower_end: Column, epoch_end: Column) -> Column:
    return F.least(follower_end, epoch_end)


def sloppy_outcome(up: Column, substitutes: Column, quorum: Column) -> Column:
    return F.when(up >= quorum, "clean").when(up + substitutes >= quorum, "sloppy").otherwise("failed")


def catch_up_by(position: Column, log_start: Column) -> Column:
    return F.when(position < log_start, "snapshot").otherwise("replay")


def metadata_use(age: Column, write_most: int, read_most: int) -> Column:
    return F.when(age <= write_most, "read-write").when(age <= read_most, "read-only").otherwise("refresh")


def read_index_served(confirmations: Column, voters: Column, applied: Column, index: Column) -> Column:
    return (confirmations >= F.floor(voters / 2) + 1) & (applied >= index)


# --- capacity, quotas, protocol -----------------------------------------------------------------


def planned_partitions(throughput: Column, capacity: Column, parallelism: Column) -> Column:
    floor = F.greatest(_ceil_div(throughput, capacity), parallelism)
    return floor + F.greatest(F.lit(1), F.floor(floor / 4))


def write_amplification(client: Column, copies: Column, rewrites: Column, index: Column) -> Column:
    return (client * copies + client * rewrites + index) / client


def handles_at_risk(segments: Column, connections: Column, limit: Column, files: int = 3, warn: float = 0.9) -> Column:
    return segments * files + connections >= limit * warn


def throttle_ticks(used: Column, allowance: Column, window: Column) -> Column:
    return F.when(used <= allowance, F.lit(0)).otherwise(F.floor(window * (used - allowance) / allowance)).cast("bigint")


def call_verdict(deadline: Column, now: Column, cost: Column) -> Column:
    return F.when(now >= deadline, "expired").when(cost > deadline - now, "refused").otherwise("begins")


def gossip_rounds(nodes: Column, fanout: Column) -> Column:
    return F.when(nodes == 1, F.lit(0)).otherwise(F.ceil(F.round(F.ln(nodes) / F.ln(1 + fanout), 9))).cast("bigint")


def negotiated(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """The greatest version both sides have; null where their ranges do not meet."""
    return F.when((low_a <= high_b) & (low_b <= high_a), F.least(high_a, high_b))


def routed(version: Column, low: Column, high: Column) -> Column:
    return F.when(version < low, "too-old").when(version > high, "too-new").otherwise("routed")


def hedges(waited: Column, delay: Column, responded: Column) -> Column:
    return ~responded & (waited >= delay)


def quota_level(pair: Column, user: Column, client: Column) -> Column:
    """The most specific level at which a quota is set."""
    return F.when(pair.isNotNull(), "user+client").when(user.isNotNull(), "user").when(client.isNotNull(), "client").otherwise("default")
