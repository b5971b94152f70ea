"""State machines over each user's events."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import machines as M
from eventlake.sources.tables import table


def _e(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", tick("ts").alias("t"))
    return e.withColumn("failed", F.col("event_type") == "error")


@register("circuit_breaker")
def circuit_breaker(spark, sf_dir):
    return M.circuit_breaker(_e(spark, sf_dir), ["user_id"], "t", "event_id", "failed", 2, 20000).select("user_id", "result.passed", "result.refused", "result.opens")


@register("prefetch_hysteresis")
def prefetch_hysteresis(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("delta", F.when(F.col("event_type").isin("view", "click"), 3).otherwise(-4).cast("bigint"))
    return M.hysteresis(e, ["user_id"], "event_id", "delta", 10, 3).select("user_id", "result.level", "result.pauses", "result.put_off")


@register("lru_cache")
def lru_cache(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 16).alias("cache"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"), (F.col("l_partkey") % 40).alias("item"))
    return M.lru_hits(li, ["cache"], "seq", "item", 8).select("cache", "result.hits", "result.misses")


@register("retry_budget")
def retry_budget(spark, sf_dir):
    return M.retry_budget(_e(spark, sf_dir), ["user_id"], "event_id", "failed", 15).select("user_id", "result.requests", "result.retries", "result.refused")


@register("lease_lock")
def lease_lock(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("lock", F.col("user_id") % 4)
    return M.leases(e, ["lock"], "t", "event_id", "user_id", 7200).select("lock", "result.token", "result.renewed", "result.refused")


@register("optimistic_lock")
def optimistic_lock(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("read", F.col("event_id") % 9)
    return M.optimistic_writes(e, ["user_id"], "event_id", "read").select("user_id", "result.version", "result.conflicts")


@register("credit_flow")
def credit_flow(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("grant", F.when(F.col("event_type") == "purchase", 3).otherwise(0).cast("bigint"))
    return M.credits(e, ["user_id"], "event_id", "grant", 5).select("user_id", "result.credit", "result.sent", "result.blocked")


@register("dedup_window")
def dedup_window(spark, sf_dir):
    return M.dedupe_window(_e(spark, sf_dir), ["user_id", "event_type"], "t", "event_id", 86400).select("user_id", "event_type", "result.accepted", "result.dropped")


@register("hybrid_clock", "WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT // 7200 AS w, (event_id // 16) * 16 + (event_id * 7) % 16 AS seq FROM events), m AS (SELECT user_id, seq, w, max(w) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM e) SELECT user_id, max(top) AS time, count(*) FILTER (WHERE top = (SELECT max(w) FROM e x WHERE x.user_id = m.user_id)) - 1 AS counter FROM m GROUP BY 1")
def hybrid_clock(spark, sf_dir):
    e = _e(spark, sf_dir).select("user_id", F.expr("(event_id div 16) * 16 + (event_id * 7) % 16").alias("seq"), F.expr("t div 7200").alias("w"))
    return M.hybrid_clock(e, ["user_id"], "seq", "w").select("user_id", "result.time", "result.counter")
