"""Streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.streaming import events as S


def _stream(spark, sf_dir):
    return S.read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@register("stream_tumbling", "WITH w AS (SELECT event_type, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, window_start, window_end, n FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_tumbling(spark, sf_dir):
    out = S.drain(S.tumbling(_stream(spark, sf_dir), "ts", "1 hour", "10 minutes", ["event_type"], [F.count("*").alias("n")]))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@register("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark, sf_dir):
    rows = S.drain(S.deduplicated(_stream(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "3650 days"))
    return rows.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@register("stream_interval_join", "SELECT v.event_id AS v_id, c.event_id AS c_id FROM events v JOIN events c ON v.user_id = c.user_id AND v.event_type = 'view' AND c.event_type = 'click' AND c.ts BETWEEN v.ts - INTERVAL 1 HOUR AND v.ts + INTERVAL 1 HOUR")
def stream_interval_join(spark, sf_dir):
    e = _stream(spark, sf_dir)
    views = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("v_id"), F.col("ts").alias("v_ts"))
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("c_id"), F.col("ts").alias("c_ts"))
    return S.drain(S.interval_join(views, clicks, "user_id", "v_ts", "c_ts", "1 HOUR", "1 hour")).select("v_id", "c_id")
