"""Windowed queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators.windows import closed_windows, hopping, late_rows, retractions, sessions, suppress, tumbling
from eventlake.sources.tables import table


@register(
    "tumbling_sum",
    """SELECT event_type, to_timestamp(floor(epoch(ts) / 3600) * 3600)::TIMESTAMP AS window_start,
              to_timestamp(floor(epoch(ts) / 3600) * 3600 + 3600)::TIMESTAMP AS window_end,
              count(*) AS n, round(sum(value), 2) AS total
       FROM events GROUP BY ALL""",
)
def tumbling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return tumbling(events, "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")])


T = "e AS (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", tick("ts").alias("t"))


@register("hopping_counts", f"WITH {T} SELECT (t // 900 - k) * 900 AS window_start, event_type, count(*) AS n FROM e, range(4) r(k) GROUP BY 1, 2")
def hopping_counts(spark, sf_dir):
    return hopping(_events(spark, sf_dir), "t", 3600, 900).groupBy("window_start", "event_type").agg(F.count("*").alias("n"))


SESSIONS = f"""{T}, m AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 21600 THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM m)"""


@register("session_windows", f"WITH {SESSIONS} SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS events FROM s GROUP BY user_id, sid")
def session_windows(spark, sf_dir):
    return sessions(_events(spark, sf_dir), ["user_id"], "t", 21600)


@register("session_spans", f"WITH {SESSIONS}, g AS (SELECT user_id, max(t) - min(t) AS span, count(*) AS events FROM s GROUP BY user_id, sid) SELECT user_id, count(*) AS sessions, max(span) AS longest, max(events) AS busiest FROM g GROUP BY 1")
def session_spans(spark, sf_dir):
    s = sessions(_events(spark, sf_dir), ["user_id"], "t", 21600)
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max(F.col("last") - F.col("first")).alias("longest"), F.max("events").alias("busiest"))


# arrival order: event ids scrambled within runs of 16
ARRIVAL = "(event_id // 16) * 16 + (event_id * 7) % 16"


@register("late_windows", f"WITH {T}, o AS (SELECT *, {ARRIVAL} AS seq FROM e), m AS (SELECT t // 3600 * 3600 AS window_start, coalesce(max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS wm FROM o) SELECT window_start, (sum(1) FILTER (WHERE wm < window_start + 3900))::BIGINT AS total, count(*) FILTER (WHERE wm >= window_start + 3900) AS dropped FROM m GROUP BY 1")
def late_windows(spark, sf_dir):
    seq = F.expr("(event_id div 16) * 16 + (event_id * 7) % 16")
    return closed_windows(_events(spark, sf_dir).withColumn("seq", seq), "t", 3600, 300, "seq", F.lit(1))


@register("suppressed_finals", f"WITH {T}, w AS (SELECT t // 86400 * 86400 + 86400 AS window_end, arg_max(value, event_id) AS v, count(*) - 1 AS absorbed FROM e GROUP BY 1) SELECT window_end, v, absorbed FROM w WHERE (SELECT max(t) FROM e) >= window_end + 600")
def suppressed_finals(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("window_end", F.floor(F.col("t") / 86400).cast("bigint") * 86400 + 86400)
    return suppress(e, "window_end", "event_id", "value", "t", 600)


@register("retraction_log", f"WITH {T}, w AS (SELECT t // 86400 AS day, event_id, value, lag(value) OVER (PARTITION BY t // 86400 ORDER BY event_id) AS old FROM e) SELECT day, count(*) AS adds, count(old) AS retracts, round(sum(value) - coalesce(sum(old), 0), 4) AS net FROM w GROUP BY 1")
def retraction_log(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400).cast("bigint"))
    changes = retractions(e, ["day"], "event_id", "value")
    return changes.groupBy("day").agg(F.count_if("add").alias("adds"), F.count_if(~F.col("add")).alias("retracts"), F.round(F.sum(F.when(F.col("add"), F.col("value")).otherwise(-F.col("value"))), 4).alias("net"))


@register("watermark_late_rows", f"WITH {T}, o AS (SELECT *, {ARRIVAL} AS seq FROM e), m AS (SELECT seq, t, max(t - 300) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm FROM o) SELECT seq, t, wm FROM m WHERE t < wm")
def watermark_late_rows(spark, sf_dir):
    seq = F.expr("(event_id div 16) * 16 + (event_id * 7) % 16").alias("seq")
    return late_rows(_events(spark, sf_dir).select(seq, "t"), "seq", "t", 300)


@register("punctuation_marks", f"WITH {T} SELECT user_id, max(t) // 3600 - min(t) // 3600 AS fired FROM e GROUP BY 1")
def punctuation_marks(spark, sf_dir):
    hour = F.floor(F.col("t") / 3600).cast("bigint")
    return _events(spark, sf_dir).groupBy("user_id").agg((F.max(hour) - F.min(hour)).alias("fired"))


@register("window_store_live", f"WITH {T}, w AS (SELECT user_id, t // 3600 * 3600 AS window_start, count(*) AS n FROM e GROUP BY 1, 2) SELECT * FROM w WHERE window_start >= (SELECT max(t) FROM e) - 86400")
def window_store_live(spark, sf_dir):
    e = _events(spark, sf_dir)
    w = e.groupBy("user_id", (F.floor(F.col("t") / 3600).cast("bigint") * 3600).alias("window_start")).agg(F.count("*").alias("n"))
    now = e.agg(F.max("t").alias("now"))
    return w.join(F.broadcast(now), F.col("window_start") >= F.col("now") - 86400).drop("now")
