"""Choice of replicas, planning of fetches, and checks of logs and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def local_replica(replicas: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rack, broker, staleness): the in-sync replica of the reader's rack with the greatest log end, else the leader.

    ``replicas`` has the keys, broker, rack, log_end, in_sync and leader; ``requests`` the keys and rack.
    """
    best = replicas.filter("in_sync").groupBy(*keys, "rack").agg(F.max(F.struct("log_end", (-F.col("broker")).alias("__b"))).alias("__best"))
    leader = replicas.filter("leader").select(*keys, F.col("broker").alias("__leader"), F.col("log_end").alias("__end"))
    found = requests.join(best, [*keys, "rack"], "left").join(leader, keys)
    broker = F.coalesce(-F.col("__best.__b"), F.col("__leader"))
    return found.select(*keys, "rack", broker.alias("broker"), F.greatest(F.lit(0), F.col("__end") - F.coalesce("__best.log_end", "__end")).alias("staleness"))


def closest_replica(replicas: DataFrame, keys: list[str], distance: str, broker: str) -> DataFrame:
    """(keys, broker, skipped): the nearest in-sync replica, the first of equals, and how many nearer ones are out of sync."""
    near = replicas.groupBy(*keys).agg(F.min(F.when(F.col("in_sync"), F.struct(distance, broker))).alias("__n"), F.collect_list(F.when(~F.col("in_sync"), F.col(distance))).alias("__out"))
    skipped = F.size(F.filter("__out", lambda d: d < F.col(f"__n.{distance}"))).cast("bigint")
    return near.filter("__n IS NOT NULL").select(*keys, F.col(f"__n.{broker}").alias(broker), skipped.alias("skipped"))


def plan_fetch(records: DataFrame, keys: list[str], order: str, size: str, least: int, most: int, waited: Column) -> DataFrame:
    """(keys, records, bytes, reason): the records a fetch returns of each key.

    Records are taken in order until ``least`` bytes, never beyond ``most`` but for a first record that is
    larger; with less than ``least`` nothing returns before ``waited`` is true.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    run = records.withColumn("__sum", F.sum(size).over(w)).withColumn("__nth", F.row_number().over(w))
    taken = run.filter((F.col("__sum") - F.col(size) < least) & ((F.col("__nth") == 1) | (F.col("__sum") <= most)))
    g = taken.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(size).alias("b"), F.bool_or(waited).alias("__w"))
    reason = F.when(F.col("b") > most, "oversize").when(F.col("b") >= least, "least").when(F.col("__w"), "waited").otherwise("none")
    none = reason == "none"
    return g.select(*keys, F.when(none, 0).otherwise(F.col("n")).alias("records"), F.when(none, 0).otherwise(F.col("b")).alias("bytes"), reason.alias("reason"))


def long_poll(arrivals: DataFrame, keys: list[str], tick: str, cumulative: str, least: int, most_wait: int) -> DataFrame:
    """(keys, tick, bytes): when a waiting fetch returns and with how much."""
    g = arrivals.groupBy(*keys).agg(
        F.min(F.when((F.col(cumulative) >= least) & (F.col(tick) <= most_wait), F.struct(tick, cumulative))).alias("__hit"),
        F.coalesce(F.max(F.when(F.col(tick) <= most_wait, F.col(cumulative))), F.lit(0)).alias("__last"),
    )
    return g.select(*keys, F.coalesce(f"__hit.{tick}", F.lit(most_wait)).alias("tick"), F.coalesce(f"__hit.{cumulative}", "__last").alias("bytes"))


def incremental_fetch(before: DataFrame, now: DataFrame, key: str, position: str) -> DataFrame:
    """(key, position): what a fetch session sends again, the partitions whose position changed or is new."""
    old = before.select(key, F.col(position).alias("__old"))
    return now.join(old, key, "left").filter(~F.col(position).eqNullSafe(F.col("__old"))).select(key, position)


def index_faults(index: DataFrame, keys: list[str], at: str, position: str) -> DataFrame:
    """(keys, entries, faults): index entries, and those whose position does not rise."""
    fallen = F.col(position) <= F.lag(position).over(Window.partitionBy(*keys).orderBy(at))
    return index.withColumn("__f", F.coalesce(fallen, F.lit(False))).groupBy(*keys).agg(F.count("*").alias("entries"), F.count_if("__f").alias("faults"))


def contiguous_segments(segments: DataFrame, keys: list[str], base: str, end: str) -> DataFrame:
    """(keys, segments, contiguous): whether every segment begins where the one before ended."""
    step = F.col(base) == F.lag(end).over(Window.partitionBy(*keys).orderBy(base))
    return segments.withColumn("__s", F.coalesce(step, F.lit(True))).groupBy(*keys).agg(F.count("*").alias("segments"), F.bool_and("__s").alias("contiguous"))


def deliver_in_order(arrivals: DataFrame, keys: list[str], sequence: str, arrival: str) -> DataFrame:
    """(keys, sequence, delivered_at): total-order broadcast.

    A message goes out with the arrival that completes the sequence up to it, from 0; what is behind a gap
    waits (null), and of repeats the first counts.
    """
    first = arrivals.groupBy(*keys, sequence).agg(F.min(arrival).alias("__a"))
    w = Window.partitionBy(*keys).orderBy(sequence)
    whole = F.row_number().over(w) - 1 == F.col(sequence)
    return first.withColumn("__whole", whole).withColumn("__at", F.max("__a").over(w.rowsBetween(Window.unboundedPreceding, 0))).select(
        *keys, sequence, F.when(F.col("__whole"), F.col("__at")).alias("delivered_at")
    )


def aligned_barriers(rows: DataFrame, keys: list[str], channel: str, arrival: str, barrier: str) -> DataFrame:
    """(keys, aligned_at, buffered): when the barriers of all channels are in, and the rows that waited behind one.

    Keys with a channel without a barrier are not aligned (null), and all rows behind a barrier wait.
    """
    own = rows.groupBy(*keys, channel).agg(F.min(F.when(F.col(barrier), F.col(arrival))).alias("__at"))
    done = own.groupBy(*keys).agg(F.when(F.count("*") == F.count("__at"), F.max("__at")).alias("aligned_at"))
    waits = rows.filter(~F.col(barrier)).join(own, [*keys, channel]).join(done, keys)
    behind = (F.col(arrival) > F.col("__at")) & (F.col("aligned_at").isNull() | (F.col(arrival) < F.col("aligned_at")))
    held = waits.groupBy(*keys).agg(F.count_if(behind).alias("__n"))
    return done.join(held, keys, "left").select(*keys, "aligned_at", F.coalesce("__n", F.lit(0)).alias("buffered"))


def counting_bloom(adds: DataFrame, removes: DataFrame, positions: Column, most: int = 15) -> DataFrame:
    """(cell, count): a counting filter after adds and removals; a counter that reached ``most`` stays there."""
    cells = adds.select(F.explode(positions).alias("cell"), F.lit(1).alias("a"), F.lit(0).alias("r")).unionByName(removes.select(F.explode(positions).alias("cell"), F.lit(0).alias("a"), F.lit(1).alias("r")))
    g = cells.groupBy("cell").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    return g.select("cell", F.when(F.col("a") >= most, most).otherwise(F.greatest(F.lit(0), F.col("a") - F.col("r"))).cast("bigint").alias("count")).filter("count > 0")


def header_map(headers: DataFrame, keys: list[str], order: str, name: str, value: str, reserved: str, most_bytes: int) -> DataFrame:
    """(keys, names, bytes, refused): the ordered header names of each record, without reserved ones.

    A record whose headers exceed ``most_bytes`` is refused as a whole.
    """
    client = ~F.startswith(F.col(name), F.lit(reserved))
    size = F.octet_length(name) + F.octet_length(value)
    g = headers.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(client, F.struct(order, F.col(name).alias("n"))))).alias("__h"), F.coalesce(F.sum(F.when(client, size)), F.lit(0)).alias("bytes"), F.count_if(~client).alias("reserved")
    )
    return g.select(*keys, F.array_join(F.transform("__h", lambda h: h["n"]), ",").alias("names"), "bytes", "reserved", (F.col("bytes") > most_bytes).alias("refused"))


def offline_after(dirs: DataFrame, failed: DataFrame, directory: str) -> DataFrame:
    """Adds ``offline``: whether a partition lives on a failed directory."""
    return dirs.join(failed.select(directory).distinct().withColumn("__f", F.lit(True)), directory, "left").withColumn("offline", F.coalesce("__f", F.lit(False))).drop("__f")


def task_balance(tasks: DataFrame, active: str, standby: str) -> DataFrame:
    """(instances, imbalance, collocated): spread of active tasks, and standbys beside their active task."""
    load = tasks.groupBy(active).agg(F.count("*").alias("n")).agg(F.count("*").alias("instances"), (F.max("n") - F.min("n")).alias("imbalance"))
    return load.join(F.broadcast(tasks.agg(F.count_if(F.col(active) == F.col(standby)).alias("collocated"))))


def static_share(loads: DataFrame, keys: list[str], load: str, limit: float) -> DataFrame:
    """(keys, effective, wasted): what nodes get of a limit dealt evenly, and what of it is lost though wanted."""
    n = loads.join(loads.groupBy(*keys).agg(F.count("*").alias("__n"), F.sum(load).alias("__all")), keys)
    g = n.groupBy(*keys).agg(F.sum(F.least(F.col(load), F.lit(limit) / F.col("__n"))).alias("effective"), F.max("__all").alias("__all"))
    return g.select(*keys, "effective", F.when(F.col("__all") < limit, 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(limit) - F.col("effective"))).alias("wasted"))


def bottleneck(stages: DataFrame, keys: list[str], name: str, rate: str, bounded: str) -> DataFrame:
    """(keys, stage, throughput, stable): the slowest stage, the first of equals, and whether every buffer is bounded."""
    g = stages.groupBy(*keys).agg(F.min(F.struct(rate, name)).alias("__s"), F.bool_and(bounded).alias("stable"))
    return g.select(*keys, F.col(f"__s.{name}").alias("stage"), F.col(f"__s.{rate}").alias("throughput"), "stable")


def compensations(steps: DataFrame, keys: list[str], order: str, done: str) -> DataFrame:
    """(keys, step, undo): the completed steps before the first failure, in the order in which a failed saga undoes them."""
    w = Window.partitionBy(*keys).orderBy(order)
    clean = F.min(F.col(done).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    failed = F.max((~F.col(done)).cast("int")).over(Window.partitionBy(*keys)) == 1
    held = steps.withColumn("__c", clean).withColumn("__x", failed).filter("__c AND __x")
    return held.select(*keys, F.col(order).alias("step"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))).cast("bigint").alias("undo"))


def timers(scheduled: DataFrame, name: str, expiry: str, now: int, slots: int, advance_to: int) -> DataFrame:
    """(name, expiry, verdict): timers within the wheel's horizon fire by ``advance_to`` or wait; others are refused."""
    refused = (F.col(expiry) <= now) | (F.col(expiry) > now + slots)
    return scheduled.select(name, expiry, F.when(refused, "refused").when(F.col(expiry) <= advance_to, "fired").otherwise("pending").alias("verdict"))


def delayed_requests(requests: DataFrame, progress: DataFrame, key: str, now: int) -> DataFrame:
    """(request, verdict, at): a parked request completes when its key's value reaches its threshold by its deadline, else expires.

    ``requests`` has request, key, threshold, deadline; ``progress`` key, tick, value, and values never fall.
    """
    hit = requests.join(progress, key, "left").groupBy("request", "threshold", "deadline").agg(F.min(F.when((F.col("value") >= F.col("threshold")) & (F.col("tick") <= F.col("deadline")), F.col("tick"))).alias("__t"))
    verdict = F.when(F.col("__t").isNotNull(), "complete").when(F.col("deadline") <= now, "expired").otherwise("parked")
    return hit.select("request", verdict.alias("verdict"), F.coalesce("__t", F.when(F.col("deadline") <= now, F.col("deadline"))).alias("at"))
