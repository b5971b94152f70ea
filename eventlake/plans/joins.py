"""Join queries over events, orders and dimensions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import joins as J
from eventlake.sources.tables import table


def _of(spark, sf_dir, kind, suffix):
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return e.select("user_id", F.col("event_id").alias(f"{suffix}_id"), tick("ts").alias(f"{suffix}_t"))


SIDES = """v AS (SELECT user_id, event_id AS v_id, floor(epoch(ts))::BIGINT AS v_t FROM events WHERE event_type = 'view'),
    c AS (SELECT user_id, event_id AS c_id, floor(epoch(ts))::BIGINT AS c_t FROM events WHERE event_type = 'click')"""


@register("interval_join", f"WITH {SIDES} SELECT user_id, v_id, v_t, c_id, c_t FROM v JOIN c USING (user_id) WHERE abs(v_t - c_t) <= 7200")
def interval_join(spark, sf_dir):
    return J.interval_join(_of(spark, sf_dir, "view", "v"), _of(spark, sf_dir, "click", "c"), "user_id", "v_t", "c_t", 7200)


@register("interval_outer_join", f"WITH {SIDES} SELECT v.user_id, v_id, v_t, c_id, c_t FROM v LEFT JOIN c ON v.user_id = c.user_id AND abs(v_t - c_t) <= 7200")
def interval_outer_join(spark, sf_dir):
    return J.interval_join(_of(spark, sf_dir, "view", "v"), _of(spark, sf_dir, "click", "c"), "user_id", "v_t", "c_t", 7200, "left")


LAST_CLICK = "k AS (SELECT user_id, epoch_us(ts) AS us, max(event_id) AS c_id FROM events WHERE event_type = 'click' GROUP BY ALL)"


@register("as_of_join", f"WITH {LAST_CLICK} SELECT p.user_id, p.event_id, c_id FROM (SELECT *, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.us >= k.us")
def as_of_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("c_id"))
    return J.as_of(e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), clicks, ["user_id"], "ts", "c_id").select("user_id", "event_id", "c_id")


@register("as_of_staleness", "WITH k AS (SELECT user_id, floor(epoch(ts))::BIGINT AS e FROM events WHERE event_type = 'click'), d AS (SELECT DISTINCT * FROM k) SELECT p.event_id, p.t - d.e AS staleness FROM (SELECT user_id, event_id, floor(epoch(ts))::BIGINT AS t FROM events WHERE event_type = 'purchase') p ASOF JOIN d ON p.user_id = d.user_id AND p.t >= d.e")
def as_of_staleness(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", tick("ts").alias("t"))
    versions = e.filter("event_type = 'click'").select("user_id", "t", F.col("t").alias("eff")).distinct()
    found = J.as_of(e.filter("event_type = 'purchase'").select("user_id", "t", "event_id"), versions, ["user_id"], "t", "eff")
    return found.filter("eff IS NOT NULL").select("event_id", (F.col("t") - F.col("eff")).alias("staleness"))


@register("broadcast_enrich", "SELECT c_custkey, c_nationkey, n_name AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def broadcast_enrich(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return J.enrich(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nation, "c_nationkey")


@register("broadcast_enrich_inner", "SELECT c_mktsegment, n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY ALL")
def broadcast_enrich_inner(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    return J.enrich(table(spark, sf_dir, "customer"), nation, "c_nationkey", "inner").groupBy("c_mktsegment", "nation").agg(F.count("*").alias("customers"))


@register("enrich_miss_rate", "SELECT count(*) AS n, count(*) FILTER (WHERE n_nationkey IS NULL) AS misses, round(count(*) FILTER (WHERE n_nationkey IS NULL) / count(*), 6) AS miss_rate FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def enrich_miss_rate(spark, sf_dir):
    joined = broadcast_enrich(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.col("nation").isNull()).alias("misses"))
    return joined.withColumn("miss_rate", F.round(F.col("misses") / F.col("n"), 6))


SPEND = "spend AS (SELECT o_custkey AS cust, arg_max(v, o_orderkey) AS v FROM (SELECT o_custkey, o_orderkey, {'x': CASE WHEN o_orderstatus = 'P' THEN NULL ELSE round(o_totalprice, 2) END} AS v FROM orders) GROUP BY 1)"
BAL = "bal AS (SELECT c_custkey AS cust, c_acctbal AS b FROM customer WHERE c_custkey % 3 <> 0)"


def _spend(spark, sf_dir):
    value = F.when(F.col("o_orderstatus") != "P", F.round("o_totalprice", 2)).alias("v")
    return J.latest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), "o_orderkey", value), ["cust"], "o_orderkey", "v")


@register("changelog_table", f"WITH {SPEND} SELECT cust, v.x AS v FROM spend WHERE v.x IS NOT NULL")
def changelog_table(spark, sf_dir):
    return _spend(spark, sf_dir)


@register("table_join", f"WITH {SPEND}, {BAL} SELECT cust, v.x + b AS v FROM spend JOIN bal USING (cust) WHERE v.x IS NOT NULL")
def table_join(spark, sf_dir):
    bal = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("cust"), F.col("c_acctbal").alias("v"))
    return J.table_join(_spend(spark, sf_dir), bal, ["cust"], "v")


@register("half_present_keys", f"WITH {SPEND}, {BAL}, s AS (SELECT * FROM spend WHERE v.x IS NOT NULL) SELECT count(*) FILTER (WHERE s.cust IS NOT NULL AND bal.cust IS NOT NULL) AS both_sides, count(*) FILTER (WHERE bal.cust IS NULL) AS left_only, count(*) FILTER (WHERE s.cust IS NULL) AS right_only FROM s FULL JOIN bal ON s.cust = bal.cust")
def half_present_keys(spark, sf_dir):
    left = _spend(spark, sf_dir).select("cust", F.lit(1).alias("l"))
    right = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("cust"), F.lit(1).alias("r"))
    both = left.join(right, "cust", "full")
    l, r = F.col("l").isNotNull(), F.col("r").isNotNull()
    return both.agg(F.count_if(l & r).alias("both_sides"), F.count_if(l & ~r).alias("left_only"), F.count_if(r & ~l).alias("right_only"))


@register("cogroup_state", "SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 100 WHEN 'error' THEN -30 ELSE 1 END)::BIGINT AS state, count(DISTINCT event_type) AS streams FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY 1")
def cogroup_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type")
    of = lambda kind, amount: (e.filter(F.col("event_type") == kind), F.lit(amount).cast("bigint"))
    return J.cogroup({"purchase": of("purchase", 100), "error": of("error", -30), "signup": of("signup", 1)}, "user_id")


@register("merged_watermark", "WITH w AS (SELECT event_type AS input, max(floor(epoch(ts))::BIGINT) - 5 AS watermark FROM events GROUP BY 1) SELECT min(watermark) AS merged, arg_min(input, (watermark, input)) AS laggard, max(watermark) - min(watermark) AS spread FROM w")
def merged_watermark(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("input")).agg((F.max(tick("ts")) - 5).alias("watermark"))
    return w.agg(F.min("watermark").alias("merged"), F.min_by("input", F.struct("watermark", "input")).alias("laggard"), (F.max("watermark") - F.min("watermark")).alias("spread"))
