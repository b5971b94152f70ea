"""Queries on replica choice, fetch planning and checks of logs, with tables in the parts of brokers and clients."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import replicas as R
from eventlake.sources.tables import table

#: Line items as replicas: orders are partitions, suppliers brokers, the first line the leader.
REPLICAS = """r AS (SELECT l_orderkey AS partition, 's' || (l_suppkey % 3) AS rack, l_linenumber AS broker, l_partkey % 50 AS log_end, l_returnflag <> 'R' AS in_sync, l_linenumber = first AS leader
    FROM (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)))"""


def _replicas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_returnflag")))
    first = li.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first"))
    return li.join(first, "l_orderkey").select(
        F.col("l_orderkey").alias("partition"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("rack"), F.col("l_linenumber").alias("broker"),
        (F.col("l_partkey") % 50).alias("log_end"), (F.col("l_returnflag") != "R").alias("in_sync"), (F.col("l_linenumber") == F.col("first")).alias("leader"),
    )


@register(
    "local_replica",
    f"""WITH {REPLICAS}, q AS (SELECT partition, unnest(['s0', 's1', 's2']) AS rack FROM (SELECT DISTINCT partition FROM r)),
        b AS (SELECT partition, rack, max(log_end) AS e, arg_max(broker, (log_end, -broker)) AS b FROM r WHERE in_sync GROUP BY ALL), l AS (SELECT partition, broker AS lb, log_end AS le FROM r WHERE leader)
        SELECT q.partition, q.rack, coalesce(b.b, lb) AS broker, greatest(0, le - coalesce(e, le)) AS staleness FROM q LEFT JOIN b USING (partition, rack) JOIN l ON l.partition = q.partition""",
)
def local_replica(spark, sf_dir):
    r = _replicas(spark, sf_dir)
    requests = r.select("partition").distinct().withColumn("rack", F.explode(F.array(*(F.lit(f"s{i}") for i in range(3)))))
    return R.local_replica(r, requests, ["partition"])


@register(
    "closest_replica",
    f"""WITH {REPLICAS}, n AS (SELECT partition, min({{'d': log_end % 4, 'b': broker}}) AS n FROM r WHERE in_sync GROUP BY 1)
        SELECT partition, n.b AS broker, (SELECT count(*) FROM r WHERE r.partition = n.partition AND NOT in_sync AND log_end % 4 < n.d) AS skipped FROM n""",
)
def closest_replica(spark, sf_dir):
    r = _replicas(spark, sf_dir).withColumn("distance", F.col("log_end") % 4)
    return R.closest_replica(r, ["partition"], "distance", "broker")


@register(
    "fetch_plan",
    """WITH s AS (SELECT user_id, event_id, (event_id * 37) % 400 + 1 AS size FROM events), c AS (SELECT *, sum(size) OVER w AS total, row_number() OVER w AS nth FROM s WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
       k AS (SELECT user_id, count(*) AS n, sum(size)::BIGINT AS b FROM c WHERE total - size < 250 AND (nth = 1 OR total <= 350) GROUP BY 1)
       SELECT user_id, CASE WHEN b < 250 AND user_id % 2 = 1 THEN 0 ELSE n END AS records, CASE WHEN b < 250 AND user_id % 2 = 1 THEN 0 ELSE b END AS bytes,
              CASE WHEN b > 350 THEN 'oversize' WHEN b >= 250 THEN 'least' WHEN user_id % 2 = 0 THEN 'waited' ELSE 'none' END AS reason FROM k""",
)
def fetch_plan(spark, sf_dir):
    s = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 37) % 400 + 1).alias("size"))
    return R.plan_fetch(s, ["user_id"], "event_id", "size", 250, 350, F.col("user_id") % 2 == 0)


@register(
    "long_poll",
    """WITH c AS (SELECT user_id, row_number() OVER w AS tick, sum((event_id * 37) % 400 + 1) OVER w AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
       SELECT user_id, coalesce(min(tick) FILTER (WHERE total >= 600 AND tick <= 4), 4) AS tick, coalesce(min(total) FILTER (WHERE total >= 600 AND tick <= 4), max(total) FILTER (WHERE tick <= 4), 0)::BIGINT AS bytes FROM c GROUP BY 1""",
)
def long_poll(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    c = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("tick"), F.sum((F.col("event_id") * 37) % 400 + 1).over(w).alias("total"))
    return R.long_poll(c, ["user_id"], "tick", "total", 600, 4)


@register(
    "incremental_fetch",
    """WITH o AS (SELECT user_id AS partition, max(event_id) FILTER (WHERE event_type <> 'error') AS position FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type <> 'error') > 0), n AS (SELECT user_id AS partition, max(event_id) AS position FROM events GROUP BY 1)
       SELECT partition, n.position FROM n LEFT JOIN o USING (partition) WHERE n.position IS DISTINCT FROM o.position""",
)
def incremental_fetch(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("partition"), F.col("event_id").alias("position"), "event_type")
    position = lambda df: df.groupBy("partition").agg(F.max("position").alias("position"))
    return R.incremental_fetch(position(e.filter("event_type <> 'error'")), position(e), "partition", "position")


@register("index_faults", "WITH i AS (SELECT user_id, event_id, (event_id * 7) % 1000 <= lag((event_id * 7) % 1000) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM events) SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE f) AS faults FROM i GROUP BY 1")
def index_faults(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("event_id") * 7) % 1000).alias("position"))
    return R.index_faults(e, ["user_id"], "event_id", "position")


SEGMENTS = "s AS (SELECT l_orderkey AS dir, l_linenumber AS base, l_linenumber + CASE WHEN max(l_partkey) % 5 = 0 THEN 2 ELSE 1 END AS stop FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@register("contiguous_segments", f"WITH {SEGMENTS}, p AS (SELECT dir, base = lag(stop) OVER (PARTITION BY dir ORDER BY base) AS ok FROM s) SELECT dir, count(*) AS segments, bool_and(coalesce(ok, true)) AS contiguous FROM p GROUP BY 1")
def contiguous_segments(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dir"), F.col("l_linenumber").alias("base")).agg(F.max("l_partkey").alias("k"))
    stop = F.col("base") + F.when(F.col("k") % 5 == 0, 2).otherwise(1)
    return R.contiguous_segments(s.select("dir", "base", stop.alias("stop")), ["dir"], "base", "stop")


@register(
    "atomic_broadcast",
    """WITH a AS (SELECT conv_id, turn AS sequence, min((turn * 7) % 11 * 100 + turn) AS arrived FROM conversations WHERE turn <> 5 GROUP BY ALL),
       w AS (SELECT *, row_number() OVER x - 1 AS nth, max(arrived) OVER x AS through FROM a WINDOW x AS (PARTITION BY conv_id ORDER BY sequence)) SELECT conv_id, sequence, CASE WHEN nth = sequence THEN through END AS delivered_at FROM w""",
)
def atomic_broadcast(spark, sf_dir):
    turn = F.col("turn")
    c = table(spark, sf_dir, "conversations").filter("turn <> 5").select("conv_id", turn.alias("sequence"), ((turn * 7) % 11 * 100 + turn).alias("at"))
    return R.deliver_in_order(c, ["conv_id"], "sequence", "at")


@register(
    "aligned_barriers",
    """WITH e AS (SELECT user_id % 40 AS task, event_type AS channel, event_id AS arrived, event_id % 23 = 0 AS barrier FROM events), o AS (SELECT task, channel, min(arrived) FILTER (WHERE barrier) AS b FROM e GROUP BY ALL),
       d AS (SELECT task, CASE WHEN count(*) = count(b) THEN max(b) END AS aligned_at FROM o GROUP BY 1),
       h AS (SELECT task, count(*) AS n FROM e JOIN o USING (task, channel) JOIN d USING (task) WHERE NOT barrier AND arrived > b AND (aligned_at IS NULL OR arrived < aligned_at) GROUP BY 1)
       SELECT task, aligned_at, coalesce(n, 0) AS buffered FROM d LEFT JOIN h USING (task)""",
)
def aligned_barriers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("task"), F.col("event_type").alias("channel"), F.col("event_id").alias("at"), (F.col("event_id") % 23 == 0).alias("barrier"))
    return R.aligned_barriers(e, ["task"], "channel", "at", "barrier")


@register(
    "counting_bloom",
    """WITH p AS (SELECT event_type, unnest([('0x' || substr(sha256('u' || user_id), 1, 8))::BIGINT % 4096, ('0x' || substr(sha256('u' || user_id), 9, 8))::BIGINT % 4096]) AS cell FROM events),
       c AS (SELECT cell, count(*) AS a, count(*) FILTER (WHERE event_type = 'error') AS r FROM p GROUP BY 1) SELECT * FROM (SELECT cell, CASE WHEN a >= 15 THEN 15 ELSE a - r END AS count FROM c) WHERE count > 0""",
)
def counting_bloom(spark, sf_dir):
    digest = F.sha2(F.concat(F.lit("u"), F.col("user_id").cast("string")), 256)
    cell = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint") % 4096
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    return R.counting_bloom(e, e.filter("event_type = 'error'"), F.array(cell(1), cell(9)))


@register(
    "record_headers",
    """WITH h AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '__lake.' || role ELSE role || (turn % 3) END AS name, text FROM conversations),
       g AS (SELECT conv_id, coalesce(string_agg(name, ',' ORDER BY turn, name) FILTER (WHERE name NOT LIKE '\\_\\_lake.%' ESCAPE '\\'), '') AS names,
         coalesce(sum(octet_length(encode(name)) + octet_length(encode(coalesce(text, '')))) FILTER (WHERE name NOT LIKE '\\_\\_lake.%' ESCAPE '\\'), 0)::BIGINT AS bytes, count(*) FILTER (WHERE name LIKE '\\_\\_lake.%' ESCAPE '\\') AS reserved FROM h GROUP BY 1)
       SELECT conv_id, names, bytes, reserved, bytes > 4096 AS refused FROM g""",
)
def record_headers(spark, sf_dir):
    turn = F.col("turn")
    name = F.when(turn % 5 == 4, F.concat(F.lit("__lake."), "role")).otherwise(F.concat("role", (turn % 3).cast("string")))
    h = table(spark, sf_dir, "conversations").select("conv_id", "turn", name.alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    return R.header_map(h, ["conv_id"], "turn", "name", "text", "__lake.", 4096)


@register("log_dir_failover", "SELECT p_size % 9 AS dir, count(*) AS partitions, p_size % 9 IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS offline FROM part GROUP BY ALL")
def log_dir_failover(spark, sf_dir):
    dirs = table(spark, sf_dir, "part").select((F.col("p_size") % 9).cast("bigint").alias("dir"), "p_partkey")
    failed = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("dir"))
    return R.offline_after(dirs, failed, "dir").groupBy("dir", "offline").agg(F.count("*").alias("partitions"))


@register("task_balance", "WITH t AS (SELECT o_custkey % 17 AS a, o_orderkey % 13 AS s FROM orders), l AS (SELECT a, count(*) AS n FROM t GROUP BY 1) SELECT count(*) AS instances, max(n) - min(n) AS imbalance, (SELECT count(*) FROM t WHERE a = s) AS collocated FROM l")
def task_balance(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 17).alias("a"), (F.col("o_orderkey") % 13).alias("s"))
    return R.task_balance(t, "a", "s")


@register(
    "static_rate_share",
    """WITH l AS (SELECT l_orderkey AS client, l_quantity::DOUBLE AS load FROM lineitem), n AS (SELECT client, count(*) AS n, sum(load) AS total FROM l GROUP BY 1)
       SELECT client, round(sum(least(load, 90 / n)), 6) AS effective, round(CASE WHEN max(total) < 90 THEN 0 ELSE greatest(0, 90 - sum(least(load, 90 / n))) END, 6) AS wasted FROM l JOIN n USING (client) GROUP BY 1""",
)
def static_rate_share(spark, sf_dir):
    loads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("client"), F.col("l_quantity").cast("double").alias("load"))
    return R.static_share(loads, ["client"], "load", 90.0).select("client", F.round("effective", 6).alias("effective"), F.round("wasted", 6).alias("wasted"))


@register("pipeline_bottleneck", "SELECT l_orderkey AS pipeline, min({'r': l_partkey % 100, 's': l_linenumber}).s AS stage, min(l_partkey % 100) AS throughput, bool_and(l_linestatus = 'F') AS stable FROM lineitem GROUP BY 1")
def pipeline_bottleneck(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pipeline"), F.col("l_linenumber").alias("s"), (F.col("l_partkey") % 100).alias("r"), (F.col("l_linestatus") == "F").alias("bounded"))
    return R.bottleneck(s, ["pipeline"], "s", "r", "bounded")


@register(
    "saga_compensations",
    """WITH s AS (SELECT l_orderkey AS saga, l_linenumber AS step, bool_and(l_returnflag <> 'R') AS done FROM lineitem GROUP BY ALL), c AS (SELECT *, bool_and(done) OVER (PARTITION BY saga ORDER BY step) AS clean, bool_and(done) OVER (PARTITION BY saga) AS fine FROM s)
       SELECT saga, step, row_number() OVER (PARTITION BY saga ORDER BY step DESC) AS undo FROM c WHERE clean AND NOT fine""",
)
def saga_compensations(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("saga"), F.col("l_linenumber").alias("step")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("done"))
    return R.compensations(s, ["saga"], "step", "done")


@register("timer_wheel", "SELECT o_orderkey AS name, o_custkey % 90 AS expiry, CASE WHEN o_custkey % 90 <= 10 OR o_custkey % 90 > 70 THEN 'refused' WHEN o_custkey % 90 <= 40 THEN 'fired' ELSE 'pending' END AS verdict FROM orders")
def timer_wheel(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("name"), (F.col("o_custkey") % 90).alias("expiry"))
    return R.timers(o, "name", "expiry", 10, 60, 40)


@register(
    "delayed_requests",
    """WITH n AS (SELECT user_id, floor(epoch(ts))::BIGINT // 86400 AS tick, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT user_id, tick, sum(n) OVER (PARTITION BY user_id ORDER BY tick)::BIGINT AS value FROM n), lo AS (SELECT min(tick) AS lo, max(tick) AS hi FROM p),
       q AS (SELECT user_id AS request, user_id, user_id % 9 + 1 AS threshold, lo + user_id % 40 AS deadline FROM (SELECT DISTINCT user_id FROM events), lo)
       SELECT request, CASE WHEN t IS NOT NULL THEN 'complete' WHEN deadline <= hi - 10 THEN 'expired' ELSE 'parked' END AS verdict, coalesce(t, CASE WHEN deadline <= hi - 10 THEN deadline END) AS at
       FROM (SELECT request, deadline, min(tick) FILTER (WHERE value >= threshold AND tick <= deadline) AS t FROM q LEFT JOIN p USING (user_id) GROUP BY request, deadline), lo""",
)
def delayed_requests(spark, sf_dir):
    day = F.floor(tick("ts") / 86400).cast("bigint")
    per = table(spark, sf_dir, "events").groupBy("user_id", day.alias("tick")).agg(F.count("*").alias("n"))
    p = per.select("user_id", "tick", F.sum("n").over(Window.partitionBy("user_id").orderBy("tick")).alias("value"))
    span = per.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).first()
    q = per.select("user_id").distinct().select(F.col("user_id").alias("request"), "user_id", (F.col("user_id") % 9 + 1).alias("threshold"), (F.col("user_id") % 40 + span["lo"]).alias("deadline"))
    return R.delayed_requests(q, p, "user_id", span["hi"] - 10)


@register("sorted_distinct", "SELECT l_returnflag, l_partkey AS value, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_partkey) AS position FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem)")
def sorted_distinct(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_partkey").alias("value")).distinct()
    return d.withColumn("position", F.row_number().over(Window.partitionBy("l_returnflag").orderBy("value")).cast("bigint"))


@register("offset_deletion", "WITH g AS (SELECT user_id AS partition, bool_or(event_type = 'signup') AS owned, count(*) FILTER (WHERE event_type = 'purchase') AS committed FROM events GROUP BY 1) SELECT CASE WHEN owned THEN 'refused' WHEN committed > 0 THEN 'deleted' ELSE 'skipped' END AS verdict, count(*) AS partitions FROM g GROUP BY 1")
def offset_deletion(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "signup").alias("owned"), F.count_if(F.col("event_type") == "purchase").alias("committed"))
    verdict = F.when(F.col("owned"), "refused").when(F.col("committed") > 0, "deleted").otherwise("skipped")
    return g.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("partitions"))


@register("promoted_watermark", f"WITH {REPLICAS} SELECT partition, min(log_end) FILTER (WHERE in_sync) AS high_watermark, count(*) FILTER (WHERE in_sync) AS in_sync FROM r GROUP BY 1")
def promoted_watermark(spark, sf_dir):
    """What a new leader may expose: the least log end of the in-sync replicas."""
    return _replicas(spark, sf_dir).groupBy("partition").agg(F.min(F.when(F.col("in_sync"), F.col("log_end"))).alias("high_watermark"), F.count_if("in_sync").alias("in_sync"))


@register("partition_limit", "WITH t AS (SELECT s_nationkey AS topic, count(*) AS n FROM supplier GROUP BY 1), c AS (SELECT topic, n, sum(n) OVER (ORDER BY topic)::BIGINT AS total FROM t) SELECT topic, n AS partitions, total, total <= 100 AS within FROM c")
def partition_limit(spark, sf_dir):
    t = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("topic")).agg(F.count("*").alias("partitions"))
    return t.withColumn("total", F.sum("partitions").over(Window.orderBy("topic"))).withColumn("within", F.col("total") <= 100)
