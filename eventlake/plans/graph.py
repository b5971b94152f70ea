"""Graph, clock and anti-entropy queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.operators import graph as G
from eventlake.sources.tables import table

EDGES = "g AS (SELECT DISTINCT p_size AS src, p_size + 1 + p_partkey % 3 AS dst FROM part)"


@register("topological_layers", f"WITH RECURSIVE {EDGES}, r(node, layer) AS (SELECT src, 0 FROM g UNION SELECT g.dst, r.layer + 1 FROM r JOIN g ON g.src = r.node) SELECT node::BIGINT AS node, max(layer)::BIGINT AS layer FROM r GROUP BY 1")
def topological_layers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return G.layers(p.select(F.col("p_size").cast("bigint").alias("src"), (F.col("p_size") + 1 + F.col("p_partkey") % 3).alias("dst")).distinct())


@register("connected_components")
def connected_components(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return G.components(c.select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1 + F.col("c_nationkey") % 2).alias("dst")).distinct())


CLOCKS = "v AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'view') AS a, count(*) FILTER (WHERE event_type = 'click') AS b, count(*) FILTER (WHERE event_type = 'purchase') AS c FROM events GROUP BY 1)"


@register("vector_clock_order", f"WITH {CLOCKS} SELECT x.id AS x, y.id AS y, CASE WHEN x.a = y.a AND x.b = y.b AND x.c = y.c THEN 'equal' WHEN x.a <= y.a AND x.b <= y.b AND x.c <= y.c THEN 'before' WHEN x.a >= y.a AND x.b >= y.b AND x.c >= y.c THEN 'after' ELSE 'concurrent' END AS verdict FROM v x JOIN v y ON y.id = x.id + 1")
def vector_clock_order(spark, sf_dir):
    t = F.col("event_type")
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(*(F.count_if(t == k).alias(n) for k, n in (("view", "a"), ("click", "b"), ("purchase", "c"))))
    x = v.select(F.col("id").alias("x"), F.array("a", "b", "c").alias("p"), (F.col("id") + 1).alias("y"))
    y = v.select(F.col("id").alias("y"), F.array("a", "b", "c").alias("q"))
    return x.join(y, "y").select("x", "y", compare_clocks(F.col("p"), F.col("q")).alias("verdict"))


def compare_clocks(p, q):
    """'equal', 'before', 'after' or 'concurrent' of two arrays of counters of the same nodes."""
    all_of = lambda f: F.forall(F.arrays_zip(p.alias("p"), q.alias("q")), f)
    return F.when(all_of(lambda z: z["p"] == z["q"]), "equal").when(all_of(lambda z: z["p"] <= z["q"]), "before").when(all_of(lambda z: z["p"] >= z["q"]), "after").otherwise("concurrent")


@register("lamport_order", "SELECT event_id, row_number() OVER (ORDER BY event_id // 10, user_id, event_id) AS position FROM events WHERE event_type = 'purchase'")
def lamport_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    rn = F.row_number().over(Window.orderBy(F.expr("event_id div 10"), "user_id", "event_id"))
    return e.select("event_id", rn.cast("bigint").alias("position"))


@register("causal_delivery", "WITH t AS (SELECT conv_id, turn FROM conversations WHERE (conv_id + turn) % 11 <> 10), f AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS gap FROM (SELECT DISTINCT conv_id, turn FROM t)) SELECT conv_id, count(*) FILTER (WHERE gap = -1) AS delivered, count(*) FILTER (WHERE gap <> -1) AS buffered FROM f GROUP BY 1")
def causal_delivery(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").filter("(conv_id + turn) % 11 <> 10").select("conv_id", "turn").distinct()
    gap = F.col("turn") - F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    f = t.withColumn("gap", gap)
    return f.groupBy("conv_id").agg(F.count_if(F.col("gap") == -1).alias("delivered"), F.count_if(F.col("gap") != -1).alias("buffered"))


LEAF = "substr(sha256(c_name || '|' || c_mktsegment), 1, 16)"


@register("merkle_diff", f"SELECT c_custkey FROM (SELECT c_custkey, {LEAF} AS h, substr(sha256(c_name || '|' || CASE WHEN c_custkey % 17 = 0 THEN 'CHANGED' ELSE c_mktsegment END), 1, 16) AS g FROM customer) WHERE h <> g")
def merkle_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    leaf = lambda segment: F.substring(F.sha2(F.concat(F.col("c_name"), F.lit("|"), segment).cast("binary"), 256), 1, 16)
    a = c.select("c_custkey", leaf(F.col("c_mktsegment")).alias("h"))
    b = c.select("c_custkey", leaf(F.when(F.col("c_custkey") % 17 == 0, "CHANGED").otherwise(F.col("c_mktsegment"))).alias("g"))
    return a.join(b, "c_custkey").filter("h <> g").select("c_custkey")


@register("hinted_handoff", "WITH e AS (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'error') SELECT user_id % 3 AS replica, count(*) FILTER (WHERE (SELECT max(t) FROM e) - t < 259200) AS kept, count(*) FILTER (WHERE (SELECT max(t) FROM e) - t >= 259200) AS lost FROM e GROUP BY 1")
def hinted_handoff(spark, sf_dir):
    from eventlake.functions.ticks import tick

    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", tick("ts").alias("t"))
    e = e.join(F.broadcast(e.agg(F.max("t").alias("now"))))
    fresh = F.col("now") - F.col("t") < 259200
    return e.groupBy((F.col("user_id") % 3).alias("replica")).agg(F.count_if(fresh).alias("kept"), F.count_if(~fresh).alias("lost"))
