"""Control-plane relations: replication, elections, quorums, limits.

Replicas are derived from ``lineitem``: partition = part, broker = supplier, log end = the
greatest order key a supplier has of a part, caught-up time = its last ship date.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.codecs import coalesce_first
from eventlake.sources.tables import table

REPLICAS = "r AS (SELECT l_partkey AS partition, l_suppkey AS broker, max(l_orderkey) AS log_end, count(*) AS n, bool_or(l_returnflag = 'N') AS in_sync FROM lineitem GROUP BY 1, 2)"


def replicas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("partition"), F.col("l_suppkey").alias("broker")).agg(
        F.max("l_orderkey").alias("log_end"), F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "N").alias("in_sync")
    )


@register("under_replicated", f"WITH {REPLICAS} SELECT partition, count(*) FILTER (WHERE in_sync) AS isr, count(*) AS replicas, CASE WHEN count(*) FILTER (WHERE in_sync) < 2 THEN 'under-minimum' WHEN count(*) FILTER (WHERE in_sync) = 2 THEN 'at-risk' ELSE 'healthy' END AS state FROM r GROUP BY 1")
def under_replicated(spark, sf_dir):
    g = replicas(spark, sf_dir).groupBy("partition").agg(F.count_if("in_sync").alias("isr"), F.count("*").alias("replicas"))
    return g.withColumn("state", F.when(F.col("isr") < 2, "under-minimum").when(F.col("isr") == 2, "at-risk").otherwise("healthy"))


@register("committable_watermark", f"WITH {REPLICAS} SELECT partition, min(log_end) FILTER (WHERE in_sync) AS watermark, max(log_end) - min(log_end) FILTER (WHERE in_sync) AS uncommitted, arg_min(broker, (log_end, broker)) FILTER (WHERE in_sync) AS pace_setter FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE in_sync) >= 2")
def committable_watermark(spark, sf_dir):
    s = F.col("in_sync")
    g = replicas(spark, sf_dir).groupBy("partition").agg(
        F.min(F.when(s, F.col("log_end"))).alias("watermark"), F.max("log_end").alias("top"),
        F.min(F.when(s, F.struct("log_end", "broker")))["broker"].alias("pace_setter"), F.count_if(s).alias("isr"),
    )
    return g.filter("isr >= 2").select("partition", "watermark", (F.col("top") - F.col("watermark")).alias("uncommitted"), "pace_setter")


@register("elected_leaders", f"WITH {REPLICAS} SELECT partition, coalesce(arg_max(broker, (log_end, -broker)) FILTER (WHERE in_sync), arg_max(broker, (log_end, -broker))) AS leader, count(*) FILTER (WHERE in_sync) = 0 AS unclean FROM r GROUP BY 1")
def elected_leaders(spark, sf_dir):
    best = F.struct("log_end", (-F.col("broker")).alias("b"))
    g = replicas(spark, sf_dir).groupBy("partition").agg(F.max(F.when(F.col("in_sync"), best)).alias("clean"), F.max(best).alias("any"))
    return g.select("partition", (-F.coalesce("clean.b", "any.b")).alias("leader"), F.col("clean").isNull().alias("unclean"))


@register("leader_balance", f"WITH {REPLICAS}, l AS (SELECT partition, arg_max(broker, (log_end, -broker)) AS leader FROM r GROUP BY 1) SELECT leader, count(*) AS partitions FROM l GROUP BY 1")
def leader_balance(spark, sf_dir):
    best = F.max(F.struct("log_end", (-F.col("broker")).alias("b")))
    return replicas(spark, sf_dir).groupBy("partition").agg(best.alias("x")).groupBy((-F.col("x.b")).alias("leader")).agg(F.count("*").alias("partitions"))


@register("commit_index", f"WITH {REPLICAS}, k AS (SELECT partition, log_end, row_number() OVER (PARTITION BY partition ORDER BY log_end DESC) AS rn, count(*) OVER (PARTITION BY partition) AS c FROM r) SELECT partition, log_end AS commit_index FROM k WHERE rn = c // 2 + 1")
def commit_index(spark, sf_dir):
    """The greatest offset that a majority of the replicas has."""
    w = Window.partitionBy("partition")
    k = replicas(spark, sf_dir).withColumn("rn", F.row_number().over(w.orderBy(F.desc("log_end")))).withColumn("c", F.count("*").over(w))
    return k.filter("rn = c div 2 + 1").select("partition", F.col("log_end").alias("commit_index"))


@register("split_votes", "WITH v AS (SELECT l_orderkey AS term, l_suppkey % 3 AS candidate, count(*) AS votes FROM lineitem GROUP BY 1, 2) SELECT term, max(votes) AS best, sum(votes)::BIGINT AS cast_votes, max(votes) * 2 <= sum(votes) AS split FROM v GROUP BY 1")
def split_votes(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("term"), F.col("l_suppkey") % 3).agg(F.count("*").alias("votes"))
    return v.groupBy("term").agg(F.max("votes").alias("best"), F.sum("votes").alias("cast_votes")).withColumn("split", F.col("best") * 2 <= F.col("cast_votes"))


@register("vote_grants", f"WITH {REPLICAS} SELECT c.partition, c.broker AS candidate, count(*) FILTER (WHERE c.log_end >= v.log_end) AS grants, count(*) FILTER (WHERE c.log_end >= v.log_end) * 2 > count(*) AS wins FROM r c JOIN r v ON c.partition = v.partition GROUP BY 1, 2")
def vote_grants(spark, sf_dir):
    """How many replicas of a partition have no longer a log than the candidate: its rank, ties included."""
    w = Window.partitionBy("partition")
    r = replicas(spark, sf_dir).withColumn("grants", F.count("*").over(w.orderBy("log_end").rangeBetween(Window.unboundedPreceding, 0))).withColumn("c", F.count("*").over(w))
    return r.select("partition", F.col("broker").alias("candidate"), "grants", (F.col("grants") * 2 > F.col("c")).alias("wins"))


@register("offline_partitions", f"WITH {REPLICAS} SELECT partition FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE in_sync AND broker % 2 = 0) = 0")
def offline_partitions(spark, sf_dir):
    up = F.col("in_sync") & (F.col("broker") % 2 == 0)
    return replicas(spark, sf_dir).groupBy("partition").agg(F.count_if(up).alias("up")).filter("up = 0").select("partition")


@register("log_divergence", "WITH a AS (SELECT l_orderkey AS part, l_linenumber AS i, min(l_partkey) AS x FROM lineitem GROUP BY 1, 2), b AS (SELECT part, i, CASE WHEN (part + i) % 6 = 0 THEN x + 1 ELSE x END AS y FROM a) SELECT part, coalesce(min(i) FILTER (WHERE x <> y), max(i) + 1) AS agree_until FROM a JOIN b USING (part, i) GROUP BY 1")
def log_divergence(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("part"), F.col("l_linenumber").alias("i")).agg(F.min("l_partkey").alias("x"))
    b = a.select("part", "i", F.when((F.col("part") + F.col("i")) % 6 == 0, F.col("x") + 1).otherwise(F.col("x")).alias("y"))
    j = a.join(b, ["part", "i"])
    return j.groupBy("part").agg(F.coalesce(F.min(F.when(F.col("x") != F.col("y"), F.col("i"))), F.max("i") + 1).alias("agree_until"))


@register("log_dir_balance", "WITH d AS (SELECT s_suppkey % 4 AS dir, count(*) AS partitions, round(sum(abs(s_acctbal)), 2) AS bytes FROM supplier GROUP BY 1) SELECT dir, partitions, bytes, bytes = (SELECT min(bytes) FROM d) AS emptiest FROM d")
def log_dir_balance(spark, sf_dir):
    d = table(spark, sf_dir, "supplier").groupBy((F.col("s_suppkey") % 4).alias("dir")).agg(F.count("*").alias("partitions"), F.round(F.sum(F.abs("s_acctbal")), 2).alias("bytes"))
    return d.withColumn("emptiest", F.col("bytes") == F.min("bytes").over(Window.partitionBy(F.lit(1))))


@register("config_resolution", "SELECT c_custkey AS topic, coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey END, CASE WHEN c_custkey % 3 = 0 THEN 100 END, 7) AS value, CASE WHEN c_custkey % 5 = 0 THEN 'topic' WHEN c_custkey % 3 = 0 THEN 'broker' ELSE 'default' END AS source FROM customer")
def config_resolution(spark, sf_dir):
    own, broker = F.col("c_custkey") % 5 == 0, F.col("c_custkey") % 3 == 0
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("topic"), coalesce_first((own, F.col("c_nationkey")), (broker, F.lit(100)), otherwise=F.lit(7)).alias("value"), coalesce_first((own, F.lit("topic")), (broker, F.lit("broker")), otherwise=F.lit("default")).alias("source"))


@register("acl_decisions", "WITH rules AS (SELECT * FROM (VALUES ('BUILDING', 'allow'), ('MACHINERY', 'deny'), ('*', 'allow'), ('HOUSEHOLD', 'deny'), ('HOUSEHOLD', 'allow')) t(principal, effect)), m AS (SELECT c_custkey, bool_or(effect = 'deny') AS denied, bool_or(effect = 'allow') AS allowed FROM customer JOIN rules ON principal = c_mktsegment OR (principal = '*' AND c_nationkey % 2 = 0) GROUP BY 1) SELECT c.c_custkey, coalesce(allowed AND NOT denied, false) AS allowed FROM customer c LEFT JOIN m USING (c_custkey)")
def acl_decisions(spark, sf_dir):
    """Deny overrides, an allow is needed, the default is deny."""
    rules = spark.createDataFrame([("BUILDING", "allow"), ("MACHINERY", "deny"), ("*", "allow"), ("HOUSEHOLD", "deny"), ("HOUSEHOLD", "allow")], "principal string, effect string")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    asked = c.select("c_custkey", F.explode(F.when(F.col("c_nationkey") % 2 == 0, F.array("c_mktsegment", F.lit("*"))).otherwise(F.array("c_mktsegment"))).alias("principal"))
    m = asked.join(rules, "principal").groupBy("c_custkey").agg(F.bool_or(F.col("effect") == "deny").alias("denied"), F.bool_or(F.col("effect") == "allow").alias("ok"))
    return c.join(m, "c_custkey", "left").select("c_custkey", F.coalesce(F.col("ok") & ~F.col("denied"), F.lit(False)).alias("allowed"))


@register("connection_quota", "WITH h AS (SELECT user_id AS host, count(*) AS n FROM events WHERE event_type IN ('view', 'signup') GROUP BY 1) SELECT host, n, least(n, 25) AS admitted, greatest(n - 25, 0) AS refused FROM h")
def connection_quota(spark, sf_dir):
    h = table(spark, sf_dir, "events").filter("event_type in ('view', 'signup')").groupBy(F.col("user_id").alias("host")).agg(F.count("*").alias("n"))
    return h.select("host", "n", F.least("n", F.lit(25)).alias("admitted"), F.greatest(F.col("n") - 25, F.lit(0)).alias("refused"))


@register("quorum_consistency", "SELECT p_partkey, p_size % 5 + 1 AS r, p_size % 4 + 1 AS w, (p_size % 5 + 1) + (p_size % 4 + 1) > 5 AS consistent FROM part")
def quorum_consistency(spark, sf_dir):
    r, w = (F.col("p_size") % 5 + 1), (F.col("p_size") % 4 + 1)
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r"), w.alias("w"), (r + w > 5).alias("consistent"))


@register("capacity_plan", "SELECT p_partkey, p_size * 3600 * 3 AS stored, p_size * 2 AS egress, ceil(p_size * 1.25 / 10)::BIGINT AS partitions FROM part")
def capacity_plan(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", (s * 3600 * 3).alias("stored"), (s * 2).alias("egress"), F.ceil(s * F.expr("1.25BD") / 10).cast("bigint").alias("partitions"))


@register("backoff_ceilings", "SELECT k AS attempt, least(1000, 10 * 2 ** k)::BIGINT AS ceiling FROM range(0, 12) r(k)")
def backoff_ceilings(spark, sf_dir):
    return spark.range(12).select(F.col("id").alias("attempt"), F.least(F.lit(1000).cast("bigint"), F.expr("10L * CAST(power(2, id) AS BIGINT)")).alias("ceiling"))


@register("error_budget", "WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS bad FROM events GROUP BY 1) SELECT user_id, round(n * 0.25::DOUBLE, 4) AS budget, round(n * 0.25::DOUBLE - bad, 4) AS remaining, round(bad / (n * 0.25::DOUBLE), 6) AS burn FROM g")
def error_budget(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    budget = F.col("n") * 0.25
    return g.select("user_id", F.round(budget, 4).alias("budget"), F.round(budget - F.col("bad"), 4).alias("remaining"), F.round(F.col("bad") / budget, 6).alias("burn"))


@register("live_members", "WITH e AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS beat FROM events GROUP BY 1) SELECT user_id, CASE WHEN (SELECT max(beat) FROM e) - beat > 21600 THEN 'evicted' ELSE 'live' END AS state FROM e")
def live_members(spark, sf_dir):
    from eventlake.functions.ticks import tick

    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(tick("ts")).alias("beat"))
    now = F.max("beat").over(Window.partitionBy(F.lit(1)))
    return e.select("user_id", F.when(now - F.col("beat") > 21600, "evicted").otherwise("live").alias("state"))


@register("feature_flags", "SELECT n_regionkey AS cluster, min(n_nationkey % 7) AS floor, min(n_nationkey % 7) >= 1 AS enabled FROM nation GROUP BY 1")
def feature_flags(spark, sf_dir):
    g = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("cluster")).agg(F.min(F.col("n_nationkey") % 7).alias("floor"))
    return g.withColumn("enabled", F.col("floor") >= 1)
