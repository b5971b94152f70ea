"""Validation, segment and metadata queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import ordered as O
from eventlake.operators import segments as S
from eventlake.plans.control import replicas
from eventlake.plans.log import LOG, event_log
from eventlake.sources.tables import table


@register("rolled_segments")
def rolled_segments(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("size", F.length("event_type") * 20 + F.col("event_id") % 50)
    return S.roll(log, "partition", "offset", "size", 1024)


@register("segment_gaps", f"WITH {LOG}, s AS (SELECT partition, min(\"offset\") AS base, max(\"offset\") + 1 AS nxt FROM log WHERE event_id % 37 <> 5 GROUP BY partition, \"offset\" // 10), g AS (SELECT partition, base, base - lag(nxt) OVER (PARTITION BY partition ORDER BY base) AS gap FROM s) SELECT * FROM g WHERE gap <> 0")
def segment_gaps(spark, sf_dir):
    log = event_log(spark, sf_dir).filter("event_id % 37 <> 5")
    seg = log.groupBy("partition", F.expr("offset div 10").alias("s")).agg(F.min("offset").alias("base"), (F.max("offset") + 1).alias("nxt"))
    return S.continuity(seg, "partition", "base", "nxt")


@register("batch_validation", "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'magic' WHEN o_orderkey % 7 = 0 THEN 'crc' WHEN n < 1 THEN 'empty' WHEN last_delta <> n - 1 THEN 'count' ELSE 'valid' END AS verdict FROM (SELECT o_orderkey, count(l_orderkey) AS n, coalesce(max(l_linenumber), 0) - coalesce(min(l_linenumber), 0) AS last_delta FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def batch_validation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), (F.max("l_linenumber") - F.min("l_linenumber")).alias("d"))
    b = table(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey", "left")
    n, d, k = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0)), F.col("o_orderkey")
    return b.select(k, F.when(k % 13 == 0, "magic").when(k % 7 == 0, "crc").when(n < 1, "empty").when(d != n - 1, "count").otherwise("valid").alias("verdict"))


@register("produce_validation", "SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown topic' WHEN user_id % 4 = 3 THEN 'not authorised' WHEN value < 5 THEN 'empty' WHEN event_id % 9 = 0 THEN 'codec' ELSE 'accepted' END AS verdict FROM events")
def produce_validation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    topics = spark.createDataFrame([("view",), ("click",), ("purchase",)], "event_type string").withColumn("known", F.lit(True))
    x = e.join(topics, "event_type", "left")
    verdict = F.when(F.col("known").isNull(), "unknown topic").when(F.col("user_id") % 4 == 3, "not authorised").when(F.col("value") < 5, "empty").when(F.col("event_id") % 9 == 0, "codec").otherwise("accepted")
    return x.select("event_id", verdict.alias("verdict"))


TXN = "t AS (SELECT o_orderkey AS txn, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'committed' ELSE 'aborting' END AS state, o_orderkey % 100 AS duration FROM orders)"


@register("stuck_transactions", f"WITH {TXN} SELECT state, count(*) AS n, count(*) FILTER (WHERE duration > 60) AS stuck, max(duration) AS longest FROM t WHERE state <> 'committed' GROUP BY 1")
def stuck_transactions(spark, sf_dir):
    s = F.col("o_orderstatus")
    t = table(spark, sf_dir, "orders").select(F.when(s == "O", "open").when(s == "F", "committed").otherwise("aborting").alias("state"), (F.col("o_orderkey") % 100).alias("duration"))
    return t.filter("state <> 'committed'").groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("duration") > 60).alias("stuck"), F.max("duration").alias("longest"))


@register("lso_blockers", f"WITH {LOG} SELECT partition, arg_min(key, (\"offset\", key)) AS blocker, min(\"offset\") AS at FROM log WHERE event_type = 'signup' AND event_id > 300 GROUP BY 1")
def lso_blockers(spark, sf_dir):
    log = event_log(spark, sf_dir).filter("event_type = 'signup' and event_id > 300")
    return log.groupBy("partition").agg(F.min_by("key", F.struct("offset", "key")).alias("blocker"), F.min("offset").alias("at"))


@register("group_listing", "WITH g AS (SELECT user_id AS grp, CASE WHEN count(*) FILTER (WHERE event_type = 'signup') = 0 THEN 'Empty' WHEN count(*) FILTER (WHERE event_type = 'error') > 15 THEN 'Rebalancing' ELSE 'Stable' END AS state FROM events GROUP BY 1) SELECT state, count(*) AS groups FROM g GROUP BY 1")
def group_listing(spark, sf_dir):
    of = lambda k: F.count_if(F.col("event_type") == k)
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(of("signup") == 0, "Empty").when(of("error") > 15, "Rebalancing").otherwise("Stable").alias("state"))
    return g.groupBy("state").agg(F.count("*").alias("groups"))


@register("disk_fill", "WITH d AS (SELECT s_suppkey % 5 AS disk, min(abs(s_acctbal)) AS used, max(abs(s_acctbal)) AS later FROM supplier GROUP BY 1) SELECT disk, round((later - used) / 10, 6) AS rate, CASE WHEN later > used THEN floor((12000 - later) / ((later - used) / 10))::BIGINT END AS ticks_left FROM d")
def disk_fill(spark, sf_dir):
    bal = F.abs("s_acctbal")
    d = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 5).alias("disk")).agg(F.min(bal).alias("used"), F.max(bal).alias("later"))
    rate = (F.col("later") - F.col("used")) / 10
    return d.select("disk", F.round(rate, 6).alias("rate"), F.when(F.col("later") > F.col("used"), F.floor((12000 - F.col("later")) / rate)).alias("ticks_left"))


@register("reassign_progress", "WITH p AS (SELECT l_suppkey AS broker, min(l_orderkey) AS first, max(l_orderkey) AS last, count(*) AS n FROM lineitem GROUP BY 1) SELECT broker, last - first AS moved, CASE WHEN n > 1 AND last > first THEN ceil((2000 - last) / ((last - first) / n))::BIGINT END AS eta FROM p")
def reassign_progress(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("broker")).agg(F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"), F.count("*").alias("n"))
    pace = (F.col("last") - F.col("first")) / F.col("n")
    return p.select("broker", (F.col("last") - F.col("first")).alias("moved"), F.when((F.col("n") > 1) & (F.col("last") > F.col("first")), F.ceil((2000 - F.col("last")) / pace)).alias("eta"))


@register("caught_up_replicas", "WITH r AS (SELECT l_partkey AS partition, l_suppkey AS broker, max(l_shipdate) AS caught FROM lineitem GROUP BY 1, 2), m AS (SELECT partition, max(caught) AS newest FROM r GROUP BY 1) SELECT partition, count(*) AS replicas, count(*) FILTER (WHERE caught >= newest - INTERVAL 400 DAY) AS in_sync FROM r JOIN m USING (partition) GROUP BY 1")
def caught_up_replicas(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("partition"), "l_suppkey").agg(F.max("l_shipdate").alias("caught"))
    newest = F.max("caught").over(Window.partitionBy("partition"))
    r = r.withColumn("newest", newest).withColumn("ok", F.expr("caught >= newest - INTERVAL 400 DAY"))
    return r.groupBy("partition").agg(F.count("*").alias("replicas"), F.count_if("ok").alias("in_sync"))


@register("epoch_ends", f"WITH {LOG}, e AS (SELECT partition, \"offset\" // 30 AS epoch, min(\"offset\") AS start, max(\"offset\") + 1 AS log_end FROM log GROUP BY ALL), m AS (SELECT partition, max(log_end) AS log_end FROM e GROUP BY 1) SELECT e.partition, epoch, start, coalesce(lead(start) OVER (PARTITION BY e.partition ORDER BY epoch), m.log_end) AS end_offset FROM e JOIN m ON e.partition = m.partition")
def epoch_ends(spark, sf_dir):
    e = event_log(spark, sf_dir).groupBy("partition", F.expr("offset div 30").alias("epoch")).agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("log_end"))
    w = Window.partitionBy("partition")
    return e.select("partition", "epoch", "start", F.coalesce(F.lead("start").over(w.orderBy("epoch")), F.max("log_end").over(w)).alias("end_offset"))


@register("log_start_offsets", f"WITH {LOG} SELECT partition, max(\"offset\") FILTER (WHERE event_type = 'purchase' AND \"offset\" < 60) + 1 AS log_start, count(*) FILTER (WHERE \"offset\" > (SELECT 59)) AS fetchable FROM log GROUP BY 1")
def log_start_offsets(spark, sf_dir):
    o = F.col("offset")
    return event_log(spark, sf_dir).groupBy("partition").agg((F.max(F.when((F.col("event_type") == "purchase") & (o < 60), o)) + 1).alias("log_start"), F.count_if(o > 59).alias("fetchable"))


@register("truncated_tails", f"WITH {LOG} SELECT partition, count(*) FILTER (WHERE \"offset\" >= 90) AS dropped, least(count(*), 90) AS log_end FROM log GROUP BY 1")
def truncated_tails(spark, sf_dir):
    return event_log(spark, sf_dir).groupBy("partition").agg(F.count_if(F.col("offset") >= 90).alias("dropped"), F.least(F.count("*"), F.lit(90).cast("bigint")).alias("log_end"))


@register("isolation_ceilings", f"WITH {LOG}, g AS (SELECT partition, (count(*) * 9) // 10 AS hw, min(\"offset\") FILTER (WHERE event_type = 'signup' AND event_id > 600) AS f FROM log GROUP BY 1) SELECT partition, hw AS uncommitted, least(hw, coalesce(f, hw)) AS committed FROM g")
def isolation_ceilings(spark, sf_dir):
    opened = (F.col("event_type") == "signup") & (F.col("event_id") > 600)
    g = event_log(spark, sf_dir).groupBy("partition").agg(F.floor(F.count("*") * 9 / 10).alias("uncommitted"), F.min(F.when(opened, F.col("offset"))).alias("f"))
    return g.select("partition", "uncommitted", F.least("uncommitted", F.coalesce("f", "uncommitted")).alias("committed"))


@register("monotone_commits", f"WITH {LOG}, c AS (SELECT partition, event_id, \"offset\" - event_id % 5 AS asked, max(\"offset\" - event_id % 5) OVER (PARTITION BY partition ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS so_far FROM log WHERE event_type = 'click') SELECT partition, count(*) FILTER (WHERE so_far IS NULL OR asked > so_far) AS advances, count(*) FILTER (WHERE asked <= so_far) AS refused, max(asked) AS committed FROM c GROUP BY 1")
def monotone_commits(spark, sf_dir):
    c = event_log(spark, sf_dir).filter("event_type = 'click'").select("partition", "event_id", (F.col("offset") - F.col("event_id") % 5).alias("asked"))
    c = c.withColumn("so_far", F.max("asked").over(Window.partitionBy("partition").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)))
    up = F.col("so_far").isNull() | (F.col("asked") > F.col("so_far"))
    return c.groupBy("partition").agg(F.count_if(up).alias("advances"), F.count_if(~up).alias("refused"), F.max("asked").alias("committed"))


@register("join_group_leaders", "SELECT event_type AS grp, arg_min(user_id, (ts, event_id)) AS leader, count(DISTINCT user_id) AS members FROM events GROUP BY 1")
def join_group_leaders(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("grp")).agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("leader"), F.countDistinct("user_id").alias("members"))


@register("poll_evictions", "WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e) SELECT user_id, count(*) FILTER (WHERE gap > 172800) AS session, count(*) FILTER (WHERE gap > 86400 AND gap <= 172800) AS poll FROM g GROUP BY 1")
def poll_evictions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", tick("ts").alias("t"))
    g = e.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("t")))
    return g.groupBy("user_id").agg(F.count_if(F.col("gap") > 172800).alias("session"), F.count_if((F.col("gap") > 86400) & (F.col("gap") <= 172800)).alias("poll"))


@register("metadata_deltas", "WITH d AS (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM (SELECT DISTINCT conv_id, turn FROM conversations)) SELECT conv_id, count(*) AS applied, bool_or(nxt <> turn + 1) AS resync FROM d GROUP BY 1")
def metadata_deltas(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    d = d.withColumn("nxt", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return d.groupBy("conv_id").agg(F.count("*").alias("applied"), F.bool_or(F.col("nxt") != F.col("turn") + 1).alias("resync"))


@register("reassign_cancel", "SELECT b AS broker, count(*) AS dropped FROM (SELECT p_partkey, unnest([p_partkey % 6, (p_partkey + 2) % 6]) AS b FROM part) WHERE b NOT IN (0, 1) GROUP BY 1")
def reassign_cancel(spark, sf_dir):
    """Replicas of the target that the original, brokers 0 and 1, does not have."""
    k = F.col("p_partkey")
    target = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(k % 6, (k + 2) % 6)).alias("broker"))
    return target.filter(~F.col("broker").isin(0, 1)).groupBy("broker").agg(F.count("*").alias("dropped"))


@register("shutdown_targets", "WITH r AS (SELECT l_partkey AS partition, l_suppkey AS broker, max(l_orderkey) AS log_end, bool_or(l_returnflag = 'N') AS in_sync FROM lineitem GROUP BY 1, 2) SELECT partition, arg_max(broker, (log_end, -broker)) FILTER (WHERE in_sync AND broker % 5 <> 0) AS target, count(*) FILTER (WHERE in_sync AND broker % 5 <> 0) = 0 AS blocked FROM r GROUP BY 1 HAVING bool_or(broker % 5 = 0)")
def shutdown_targets(spark, sf_dir):
    ok = F.col("in_sync") & (F.col("broker") % 5 != 0)
    g = replicas(spark, sf_dir).groupBy("partition").agg(F.max(F.when(ok, F.struct("log_end", (-F.col("broker")).alias("b")))).alias("x"), F.bool_or(F.col("broker") % 5 == 0).alias("leaving"))
    return g.filter("leaving").select("partition", (-F.col("x.b")).alias("target"), F.col("x").isNull().alias("blocked"))


@register("failed_log_dirs", "SELECT s_suppkey % 6 AS broker, count(*) FILTER (WHERE s_nationkey % 4 = 1) AS offline, bool_and(s_nationkey % 4 = 1) AS broker_down FROM supplier GROUP BY 1")
def failed_log_dirs(spark, sf_dir):
    bad = F.col("s_nationkey") % 4 == 1
    return table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 6).alias("broker")).agg(F.count_if(bad).alias("offline"), F.bool_and(bad).alias("broker_down"))


@register("reaped_connections", "WITH e AS (SELECT user_id, event_type, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT user_id, max(t) AS last, arg_max(event_type, (t, event_type)) AS doing FROM e GROUP BY 1) SELECT user_id, (SELECT max(last) FROM g) - last > 7200 AND doing <> 'purchase' AS closed FROM g")
def reaped_connections(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", tick("ts").alias("t"))
    g = e.groupBy("user_id").agg(F.max("t").alias("last"), F.max_by("event_type", F.struct("t", "event_type")).alias("doing"))
    now = e.agg(F.max("t").alias("now"))  # one row
    return g.join(F.broadcast(now)).select("user_id", ((F.col("now") - F.col("last") > 7200) & (F.col("doing") != "purchase")).alias("closed"))


@register("principal_names", "SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'BUI') THEN 'builder' WHEN starts_with(c_mktsegment, 'M') THEN 'machine' WHEN starts_with(c_mktsegment, '') THEN lower(c_mktsegment) END AS principal FROM customer")
def principal_names(spark, sf_dir):
    s = F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(s.startswith("BUI"), "builder").when(s.startswith("M"), "machine").otherwise(F.lower(s)).alias("principal"))


@register("sequencer_ranges", "SELECT o_custkey, coalesce(sum(n) OVER (ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_id, n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def sequencer_ranges(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return O.sum_before(g, "o_custkey", "n", "first_id").select("o_custkey", "first_id", "n")


@register("priority_order", "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS position FROM orders")
def priority_order(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", rn.cast("bigint").alias("position"))


@register("static_owners", "SELECT p_partkey AS partition, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS owner, p_partkey % 4 IN (1, 3) AS unconsumed FROM part")
def static_owners(spark, sf_dir):
    owners = spark.createDataFrame([(0, "a", True), (1, "b", False), (2, "c", True)], "slot bigint, owner string, present boolean")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partition"), (F.col("p_partkey") % 4).alias("slot"))
    return p.join(owners, "slot", "left").select("partition", "owner", (~F.coalesce("present", F.lit(False))).alias("unconsumed"))


@register("rack_losses", "WITH r AS (SELECT p_partkey AS partition, (p_partkey + k) * (k + 1) % 3 AS rack FROM part, range(3) t(k)), c AS (SELECT partition, rack, count(*) AS n FROM r GROUP BY ALL), o AS (SELECT partition, n, sum(n) OVER (PARTITION BY partition) - sum(n) OVER (PARTITION BY partition ORDER BY n DESC, rack) AS remaining FROM c) SELECT partition, count(*) FILTER (WHERE remaining >= 1) AS survivable FROM o GROUP BY 1")
def rack_losses(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partition"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    c = p.groupBy("partition", ((F.col("partition") + F.col("k")) * (F.col("k") + 1) % 3).alias("rack")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("partition")
    left = F.sum("n").over(w) - F.sum("n").over(w.orderBy(F.desc("n"), "rack").rowsBetween(Window.unboundedPreceding, 0))
    return c.withColumn("remaining", left).groupBy("partition").agg(F.count_if(F.col("remaining") >= 1).alias("survivable"))


@register("verified_reads")
def verified_reads(spark, sf_dir):
    """Names whose stored CRC-32C, spoilt for every sixth nation, still holds."""
    from eventlake.functions.codecs import crc32c

    n = table(spark, sf_dir, "nation").withColumn("crc", crc32c(F.col("n_name")))
    stored = F.when(F.col("n_nationkey") % 6 == 5, F.col("crc").bitwiseXOR(F.lit(1).cast("bigint"))).otherwise(F.col("crc"))
    return n.select("n_nationkey", (stored == F.col("crc")).alias("served"))
