"""Compaction, retention and transaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import txn as X
from eventlake.plans.log import HW, LOG, event_log, watermarks
from eventlake.sources.tables import table


@register("compacted_orders", "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def compacted_orders(spark, sf_dir):
    return X.compact(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], "o_orderkey")


TOMB = "k AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS born, CASE WHEN event_type <> 'error' THEN event_type END AS v FROM events), c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, born // 86400 ORDER BY event_id DESC) AS rn FROM k) WHERE rn = 1)"


@register("reaped_tombstones", f"WITH {TOMB} SELECT user_id, event_id, v FROM c WHERE NOT (v IS NULL AND event_id < 700 AND (SELECT max(born) FROM k) - born > 172800)")
def reaped_tombstones(spark, sf_dir):
    k = table(spark, sf_dir, "events").select("user_id", "event_id", tick("ts").alias("born"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("v"))
    c = X.compact(k.withColumn("day", F.floor(F.col("born") / 86400)), ["user_id", "day"], "event_id")
    now = k.agg(F.max("born").alias("now"))
    c = c.join(F.broadcast(now))
    return X.reap_tombstones(c, "v", "event_id", "born", F.lit(700), F.col("now"), 172800).select("user_id", "event_id", "v")


@register("dirty_ratio", f"WITH {LOG}, g AS (SELECT partition, count(*) AS total, count(*) - count(DISTINCT key) AS superseded FROM log GROUP BY 1) SELECT partition, total, superseded, round(superseded / total, 6) AS ratio, row_number() OVER (ORDER BY round(superseded / total, 6) DESC, partition) AS rank FROM g")
def dirty_ratio(spark, sf_dir):
    from pyspark.sql import Window

    g = X.dirty_ratio(event_log(spark, sf_dir), "partition", ["key"]).withColumn("ratio", F.round("ratio", 6))
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("ratio"), "partition")).cast("bigint"))


SEG = f"""{LOG}, {HW}, seg AS (SELECT partition, min("offset") AS base, count(*) * 64 AS size, max(t) AS newest FROM log GROUP BY partition, "offset" // 25),
    s AS (SELECT seg.*, high_watermark AS floor, (SELECT max(t) FROM log) - newest AS age FROM seg JOIN hw USING (partition)),
    m AS (SELECT *, CASE WHEN (age > 1728000 OR sum(size) OVER (PARTITION BY partition ORDER BY base ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > 5000) AND lead(base) OVER (PARTITION BY partition ORDER BY base) <= floor THEN 1 ELSE 0 END AS g FROM s)"""


@register("retention_prefix", f"WITH {SEG} SELECT partition, base, size, min(g) OVER (PARTITION BY partition ORDER BY base ROWS UNBOUNDED PRECEDING) = 1 AS dropped FROM m")
def retention_prefix(spark, sf_dir):
    log = event_log(spark, sf_dir)
    seg = log.groupBy("partition", F.expr("offset div 25").alias("s")).agg(F.min("offset").alias("base"), (F.count("*") * 64).alias("size"), F.max("t").alias("newest"))
    now = log.agg(F.max("t").alias("now"))
    s = seg.join(watermarks(log), "partition").join(F.broadcast(now)).select("partition", "base", "size", F.col("high_watermark").alias("floor"), (F.col("now") - F.col("newest")).alias("age"))
    return X.drop_prefix(s, "partition", "base", "size", "age", 5000, 1728000, "floor").select("partition", "base", "size", "dropped")


@register("idempotent_produce", "SELECT user_id, count(*) AS arrived, count(DISTINCT event_id // 3) AS accepted FROM events GROUP BY 1")
def idempotent_produce(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("event_id div 3").alias("sequence"))
    return X.absorb_duplicates(p, ["user_id"], "sequence", "event_id").groupBy("user_id").agg(F.count("*").alias("arrived"), F.count_if("accepted").alias("accepted"))


@register("sequence_gaps", "SELECT conv_id, turn AS after, d - 1 AS missing FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) - turn AS d FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE turn % 3 <> 1)) WHERE d > 1")
def sequence_gaps(spark, sf_dir):
    return X.sequence_gaps(table(spark, sf_dir, "conversations").filter("turn % 3 <> 1"), ["conv_id"], "turn")


@register("fenced_rows", "SELECT user_id, count(*) FILTER (WHERE ep < seen) AS fenced, count(*) AS n FROM (SELECT user_id, l_epoch AS ep, max(l_epoch) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen FROM (SELECT user_id, event_id, (event_id * 13) % 7 AS l_epoch FROM events)) GROUP BY 1")
def fenced_rows(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 13) % 7).alias("epoch"))
    return X.fence(p, ["user_id"], "epoch", "event_id").groupBy("user_id").agg(F.count_if("fenced").alias("fenced"), F.count("*").alias("n"))


ABORTED = "ab AS (SELECT partition, \"offset\" AS first, \"offset\" + 4 AS last FROM log WHERE event_type = 'error' AND event_id % 4 = 0)"


@register("aborted_filter", f"WITH {LOG}, {ABORTED} SELECT l.partition, count(*) AS visible, round(sum(value), 2) AS total FROM log l WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.partition = l.partition AND l.\"offset\" BETWEEN first AND last) GROUP BY 1")
def aborted_filter(spark, sf_dir):
    log = event_log(spark, sf_dir)
    ab = log.filter("event_type = 'error' and event_id % 4 = 0").select("partition", F.col("offset").alias("first"), (F.col("offset") + 4).alias("last"))
    return X.without_aborted(log, ab, "partition", "offset").groupBy("partition").agg(F.count("*").alias("visible"), F.round(F.sum("value"), 2).alias("total"))


@register("last_stable_offset", f"WITH {LOG}, {HW}, o AS (SELECT partition, min(\"offset\") AS f FROM log WHERE event_type = 'signup' AND event_id > 600 AND partition % 3 <> 0 GROUP BY 1) SELECT hw.partition, high_watermark, least(high_watermark, coalesce(f, high_watermark)) AS last_stable, high_watermark - least(high_watermark, coalesce(f, high_watermark)) AS withheld FROM hw LEFT JOIN o USING (partition)")
def last_stable_offset(spark, sf_dir):
    log = event_log(spark, sf_dir)
    open_txns = log.filter("event_type = 'signup' and event_id > 600 and partition % 3 <> 0").select("partition", F.col("offset").alias("first_offset"))
    return X.last_stable(watermarks(log), open_txns)


@register("two_phase_commit", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'abort' WHEN count(*) >= 4 THEN 'commit' ELSE 'waiting' END AS decision FROM lineitem GROUP BY 1")
def two_phase_commit(spark, sf_dir):
    votes = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_returnflag") != "R").alias("vote"))
    return X.decide(votes, "l_orderkey", "vote", 4)


@register("commit_markers", "WITH p AS (SELECT l_orderkey AS txn, l_suppkey % 4 AS partition, bool_or(l_linestatus = 'F') AS marked FROM lineitem GROUP BY ALL) SELECT txn, count(*) AS partitions, count(*) FILTER (WHERE NOT marked) AS outstanding, bool_and(marked) AS committed FROM p GROUP BY 1")
def commit_markers(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("txn"), (F.col("l_suppkey") % 4).alias("partition")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("marked"))
    return p.groupBy("txn").agg(F.count("*").alias("partitions"), F.count_if(~F.col("marked")).alias("outstanding"), F.bool_and("marked").alias("committed"))


@register("lsm_newest_wins", "SELECT key, v FROM (SELECT l_partkey AS key, arg_max({'x': CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END}, (l_orderkey, l_linenumber, l_suppkey, l_extendedprice)).x AS v FROM lineitem GROUP BY 1) WHERE v IS NOT NULL")
def lsm_newest_wins(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    v = F.struct(F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("x"))
    return li.groupBy(F.col("l_partkey").alias("key")).agg(F.max_by(v, order).alias("s")).select("key", F.col("s.x").alias("v")).filter("v IS NOT NULL")


@register("expired_offsets", "WITH e AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS last, count(*) FILTER (WHERE event_type = 'signup') AS members FROM events GROUP BY 1) SELECT user_id, last FROM e WHERE members = 0 AND (SELECT max(last) FROM e) - last > 3600 OR (SELECT max(last) FROM e) - last > 100000")
def expired_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(tick("ts")).alias("last"), F.count_if(F.col("event_type") == "signup").alias("members"))
    now = e.agg(F.max("last").alias("now"))
    idle = F.col("now") - F.col("last")
    return e.join(F.broadcast(now)).filter((F.col("members") == 0) & (idle > 3600) | (idle > 100000)).select("user_id", "last")


@register("read_committed", f"WITH {LOG}, t AS (SELECT partition, event_id // 5 AS txn, CASE WHEN bool_or(event_type = 'error') THEN 'aborted' WHEN max(\"offset\") > 100 THEN 'open' ELSE 'committed' END AS state FROM log GROUP BY ALL) SELECT l.partition, count(*) AS rows FROM log l JOIN t ON l.partition = t.partition AND l.event_id // 5 = t.txn WHERE state = 'committed' GROUP BY 1")
def read_committed(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("txn", F.expr("event_id div 5"))
    state = F.when(F.bool_or(F.col("event_type") == "error"), "aborted").when(F.max("offset") > 100, "open").otherwise("committed")
    t = log.groupBy("partition", "txn").agg(state.alias("state")).filter("state = 'committed'")
    return log.join(t, ["partition", "txn"], "left_semi").groupBy("partition").agg(F.count("*").alias("rows"))
