"""Time-series queries over an explicit order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import ordered as O
from eventlake.sources.tables import table


def _e(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", tick("ts").alias("t"))


@register("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def moving_average(spark, sf_dir):
    return _e(spark, sf_dir).select("event_id", F.round(F.avg("value").over(O.last_n(["user_id"], ["event_id"], 5)), 6).alias("mean"))


@register("sliding_max", "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS peak FROM events")
def sliding_max(spark, sf_dir):
    return _e(spark, sf_dir).select("event_id", F.max("value").over(O.last_n(["user_id"], ["event_id"], 7)).alias("peak"))


@register("last_values", "SELECT user_id, list(value ORDER BY event_id) AS vs FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 3 GROUP BY 1")
def last_values(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    e = _e(spark, sf_dir).withColumn("rn", rn).filter("rn <= 3")
    return e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("vs"))


@register("ema_rate", "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema FROM events GROUP BY 1")
def ema_rate(spark, sf_dir):
    seed = F.lit(None).cast("double")
    step = lambda a, r: F.when(a.isNull(), r["value"]).otherwise(0.3 * r["value"] + 0.7 * a)
    return O.fold(_e(spark, sf_dir).select("user_id", "event_id", "value"), ["user_id"], ["event_id"], seed, step).select("user_id", F.round("result", 6).alias("ema"))


@register("run_lengths", "WITH m AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m) SELECT user_id, run::BIGINT AS run, event_type, count(*) AS length FROM r GROUP BY ALL")
def run_lengths(spark, sf_dir):
    return O.runs(_e(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type")


def _deltas(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    delta = F.col("l_partkey") - F.coalesce(F.lag("l_partkey").over(w), F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"), delta.alias("delta"))


@register("delta_encoding", "SELECT l_orderkey, l_linenumber, l_partkey - coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey), 0) AS delta FROM lineitem")
def delta_encoding(spark, sf_dir):
    return _deltas(spark, sf_dir).select("l_orderkey", "l_linenumber", "delta")


@register("delta_decoding", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem")
def delta_decoding(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return _deltas(spark, sf_dir).select("l_orderkey", "l_linenumber", F.sum("delta").over(w).alias("l_partkey"))


@register("prefix_sums", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS total FROM orders")
def prefix_sums(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("total"))


@register("range_max", "SELECT l_orderkey // 100 AS block, max(l_extendedprice) AS peak FROM lineitem WHERE l_orderkey BETWEEN 50 AND 1200 GROUP BY 1")
def range_max(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").between(50, 1200))
    return li.groupBy(F.expr("l_orderkey div 100").alias("block")).agg(F.max("l_extendedprice").alias("peak"))


@register("lag_trend", "WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS t FROM events), d AS (SELECT user_id, t, max(value) AS value FROM e GROUP BY 1, 2), g AS (SELECT user_id, arg_min(value, t) AS first, arg_max(value, t) AS last, CASE WHEN max(t) > min(t) THEN (arg_max(value, t) - arg_min(value, t)) / (max(t) - min(t)) ELSE 0 END AS slope FROM d GROUP BY 1) SELECT user_id, round(slope, 9) AS slope, CASE WHEN slope > 0 THEN 'growing' WHEN slope < 0 THEN 'draining' ELSE 'flat' END AS verdict FROM g")
def lag_trend(spark, sf_dir):
    d = _e(spark, sf_dir).groupBy("user_id", "t").agg(F.max("value").alias("value"))
    s = O.slope(d, ["user_id"], "t", "value")
    return s.select("user_id", F.round("slope", 9).alias("slope"), F.when(F.col("slope") > 0, "growing").when(F.col("slope") < 0, "draining").otherwise("flat").alias("verdict"))


@register("monotonic_stamps", "WITH e AS (SELECT event_id, user_id, floor(epoch(ts))::BIGINT AS t, (event_id // 16) * 16 + (event_id * 7) % 16 AS seq FROM events) SELECT event_id, max(t) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS stamp, max(t) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) > t AS clamped FROM e")
def monotonic_stamps(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("seq", F.expr("(event_id div 16) * 16 + (event_id * 7) % 16"))
    stamp = F.max("t").over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("event_id", stamp.alias("stamp"), (stamp > F.col("t")).alias("clamped"))


@register("quota_window", "WITH e AS (SELECT event_id, user_id, value, floor(epoch(ts))::BIGINT AS t FROM events), u AS (SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW), 4) AS used FROM e) SELECT event_id, used, CASE WHEN used > 150 THEN ceil((used - 150) / 10)::BIGINT ELSE 0 END AS delay FROM u")
def quota_window(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3599, 0)
    u = _e(spark, sf_dir).select("event_id", F.round(F.sum("value").over(w), 4).alias("used"))
    return u.withColumn("delay", F.when(F.col("used") > 150, F.ceil((F.col("used") - 150) / 10)).otherwise(F.lit(0)).cast("bigint"))


BUCKET = """WITH RECURSIVE e AS (SELECT user_id, t, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM (SELECT user_id, event_id, value, floor(epoch(ts))::BIGINT AS t FROM events)),"""


@register(
    "token_bucket",
    f"""{BUCKET} r(user_id, n, t, tokens, served, refused) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 5::DOUBLE, 0::BIGINT, 0::BIGINT FROM e WHERE n = 1
          UNION ALL SELECT user_id, n, t, CASE WHEN x >= 1 THEN x - 1 ELSE x END, served + CASE WHEN x >= 1 THEN 1 ELSE 0 END, refused + CASE WHEN x >= 1 THEN 0 ELSE 1 END
          FROM (SELECT e.user_id, e.n, e.t, least(5::DOUBLE, r.tokens + coalesce((e.t - r.t) / 7200::DOUBLE, 0)) AS x, r.served, r.refused FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
        SELECT user_id, max(served) AS served, max(refused) AS refused FROM r GROUP BY 1""",
)
def token_bucket(spark, sf_dir):
    """Admission of each event by a per-user bucket of 5 tokens, one back every 2 hours."""
    e = _e(spark, sf_dir).select("user_id", "event_id", "t")
    state = F.struct(F.lit(5.0).alias("tokens"), F.lit(None).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("served"), F.lit(0).cast("bigint").alias("refused"))

    def step(s, r):
        now = F.least(F.lit(5.0), s["tokens"] + F.coalesce((r["t"] - s["last"]) / 7200.0, F.lit(0.0)))
        ok = now >= 1
        return F.struct(F.when(ok, now - 1).otherwise(now).alias("tokens"), r["t"].alias("last"), (s["served"] + ok.cast("bigint")).alias("served"), (s["refused"] + (~ok).cast("bigint")).alias("refused"))

    return O.fold(e, ["user_id"], ["t", "event_id"], state, step).select("user_id", "result.served", "result.refused")


@register(
    "leaky_bucket",
    f"""{BUCKET} r(user_id, n, t, level, spilled) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, 0::DOUBLE, 0::DOUBLE FROM e WHERE n = 1
          UNION ALL SELECT user_id, n, t, least(x, 120::DOUBLE), spilled + greatest(x - 120::DOUBLE, 0)
          FROM (SELECT e.user_id, e.n, e.t, greatest(0::DOUBLE, r.level - coalesce((e.t - r.t) * 40::DOUBLE / 3600, 0)) + e.value AS x, r.spilled FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
        SELECT user_id, round(max(spilled), 6) AS spilled FROM r GROUP BY 1""",
)
def leaky_bucket(spark, sf_dir):
    """Spill of each user's bucket of capacity 120 that drains 40 per hour."""
    e = _e(spark, sf_dir).select("user_id", "event_id", "t", "value")
    state = F.struct(F.lit(0.0).alias("level"), F.lit(None).cast("bigint").alias("last"), F.lit(0.0).alias("spilled"))

    def step(s, r):
        level = F.greatest(F.lit(0.0), s["level"] - F.coalesce((r["t"] - s["last"]) * 40.0 / 3600, F.lit(0.0))) + r["value"]
        return F.struct(F.least(level, F.lit(120.0)).alias("level"), r["t"].alias("last"), (s["spilled"] + F.greatest(level - 120.0, F.lit(0.0))).alias("spilled"))

    return O.fold(e, ["user_id"], ["t", "event_id"], state, step).select("user_id", F.round("result.spilled", 6).alias("spilled"))


@register("phi_suspicion", "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT user_id, max(t) AS last, (max(t) - min(t)) / nullif(count(*) - 1, 0) AS mean FROM e GROUP BY 1) SELECT user_id, round(((SELECT max(t) FROM e) - last) / mean, 6) AS phi, ((SELECT max(t) FROM e) - last) / mean >= 1 AS suspect FROM g WHERE mean > 0")
def phi_suspicion(spark, sf_dir):
    e = _e(spark, sf_dir)
    g = e.groupBy("user_id").agg(F.max("t").alias("last"), F.min("t").alias("first"), F.count("*").alias("n")).filter("n > 1 and last > first")
    now = e.agg(F.max("t").alias("now"))
    phi = (F.col("now") - F.col("last")) / ((F.col("last") - F.col("first")) / (F.col("n") - 1))
    return g.join(F.broadcast(now)).select("user_id", F.round(phi, 6).alias("phi"), (phi >= 1).alias("suspect"))


@register("flapping", "WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad FROM events), c AS (SELECT user_id, event_id, CASE WHEN lag(bad) OVER (PARTITION BY user_id ORDER BY event_id) <> bad THEN 1 ELSE 0 END AS changed FROM e), r AS (SELECT user_id, sum(changed) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS recent FROM c) SELECT user_id, max(recent)::BIGINT AS worst, max(recent) >= 4 AS flapping FROM r GROUP BY 1")
def flapping(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _e(spark, sf_dir).withColumn("bad", F.col("event_type") == "error")
    e = e.withColumn("changed", F.when(F.lag("bad").over(w) != F.col("bad"), 1).otherwise(0))
    r = e.withColumn("recent", F.sum("changed").over(O.last_n(["user_id"], ["event_id"], 10)))
    return r.groupBy("user_id").agg(F.max("recent").alias("worst"), (F.max("recent") >= 4).alias("flapping"))


@register("rebalance_storm", "WITH e AS (SELECT event_type AS grp, floor(epoch(ts))::BIGINT AS t FROM events) SELECT grp, count(*) FILTER (WHERE (SELECT max(t) FROM e) - t < 86400) AS recent, count(*) FILTER (WHERE (SELECT max(t) FROM e) - t < 86400) >= 8 AS storm FROM e GROUP BY 1")
def rebalance_storm(spark, sf_dir):
    e = _e(spark, sf_dir)
    now = e.agg(F.max("t").alias("now"))
    x = e.join(F.broadcast(now)).groupBy(F.col("event_type").alias("grp")).agg(F.count_if(F.col("now") - F.col("t") < 86400).alias("recent"))
    return x.withColumn("storm", F.col("recent") >= 8)


@register("idle_topics", "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events), m AS (SELECT max(t) AS now FROM e) SELECT user_id, now - max(t) AS idle FROM e, m GROUP BY user_id, now HAVING now - max(t) > 43200")
def idle_topics(spark, sf_dir):
    e = _e(spark, sf_dir)
    now = e.agg(F.max("t").alias("now"))
    return e.groupBy("user_id").agg(F.max("t").alias("last")).join(F.broadcast(now)).select("user_id", (F.col("now") - F.col("last")).alias("idle")).filter("idle > 43200")


@register("top_n", "SELECT event_type, user_id, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rn FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rn <= 3")
def top_n(spark, sf_dir):
    g = _e(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("n"), "user_id"))
    return g.withColumn("rn", rn).filter("rn <= 3").drop("rn")


@register("merge_dedupe", "SELECT DISTINCT k FROM (SELECT l_orderkey AS k FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT o_orderkey FROM orders)")
def merge_dedupe(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("k"))
    return a.unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))).distinct()


@register(
    "interval_schedule",
    """WITH RECURSIVE i AS (SELECT reader, lo, hi, row_number() OVER (PARTITION BY reader ORDER BY hi, lo) AS n FROM (SELECT o_custkey % 20 AS reader, o_orderkey % 500 AS lo, o_orderkey % 500 + 1 + o_custkey % 25 AS hi FROM orders)),
       r(reader, n, last, chosen) AS (SELECT reader, 0::BIGINT, -1::BIGINT, 0::BIGINT FROM i WHERE n = 1
         UNION ALL SELECT i.reader, i.n, CASE WHEN i.lo >= r.last THEN i.hi ELSE r.last END, r.chosen + CASE WHEN i.lo >= r.last THEN 1 ELSE 0 END FROM r JOIN i ON i.reader = r.reader AND i.n = r.n + 1)
       SELECT reader, max(chosen) AS chosen FROM r GROUP BY 1""",
)
def interval_schedule(spark, sf_dir):
    """The most non-overlapping intervals of each reader, earliest finish first."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 500
    r = o.select((F.col("o_custkey") % 20).alias("reader"), (start + 1 + F.col("o_custkey") % 25).alias("stop"), start.alias("start"))
    state = F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("chosen"))
    step = lambda s, x: F.when(x["start"] >= s["end"], F.struct(x["stop"].alias("end"), (s["chosen"] + 1).alias("chosen"))).otherwise(s)
    return O.fold(r, ["reader"], ["stop", "start"], state, step).select("reader", "result.chosen")
