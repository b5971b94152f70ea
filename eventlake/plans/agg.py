"""Aggregation, sketch and replica-merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import agg as A
from eventlake.sources.tables import table


@register("mean_merge", "WITH p AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS total, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(sum(total) / sum(n), 6) AS mean, round(avg(total / n), 6) AS mean_of_means, sum(n)::BIGINT AS n FROM p GROUP BY 1")
def mean_merge(spark, sf_dir):
    p = A.partial_means(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_quantity")
    m = A.merge_means(p, ["l_returnflag"])
    return m.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("mean_of_means", 6).alias("mean_of_means"), "n")


@register("latency_histogram", "SELECT l_linestatus, floor(l_extendedprice / 5000) * 5000 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL")
def latency_histogram(spark, sf_dir):
    h = A.histogram(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_extendedprice"), 5000.0)
    return h.withColumn("bucket", F.col("bucket").cast("double"))


HIST = "h AS (SELECT l_linestatus, floor(l_extendedprice / 500) * 500 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY l_linestatus ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY l_linestatus) AS t FROM h)"


@register("latency_percentiles", f"WITH {HIST} SELECT l_linestatus, min(bucket) FILTER (WHERE c * 100 >= t * 50) AS p50, min(bucket) FILTER (WHERE c * 100 >= t * 99) AS p99, min(bucket) FILTER (WHERE c * 100 >= t * 99.9) AS p99_9 FROM r GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    h = A.histogram(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_extendedprice"), 500.0).withColumn("bucket", F.col("bucket").cast("double"))
    return A.bucket_percentiles(h, ["l_linestatus"], [50, 99, 99.9])


@register("latency_hidden_tail", "WITH h AS (SELECT event_type, floor(value / 10) * 10 AS bucket, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY event_type) AS t FROM h) SELECT event_type, round(sum((bucket + 5) * n) / sum(n), 6) AS mean, min(bucket) FILTER (WHERE c * 100 >= t * 99) AS p99, min(bucket) FILTER (WHERE c * 100 >= t * 99) > 3 * round(sum((bucket + 5) * n) / sum(n), 6) AS hidden_tail FROM r GROUP BY 1")
def latency_hidden_tail(spark, sf_dir):
    h = A.histogram(table(spark, sf_dir, "events"), ["event_type"], F.col("value"), 10.0).withColumn("bucket", F.col("bucket").cast("double"))
    mean = h.groupBy("event_type").agg(F.round(F.sum((F.col("bucket") + 5) * F.col("n")) / F.sum("n"), 6).alias("mean"))
    return mean.join(A.bucket_percentiles(h, ["event_type"], [99]), "event_type").withColumn("hidden_tail", F.col("p99") > 3 * F.col("mean"))


@register("merged_histograms", f"WITH s AS (SELECT l_suppkey % 4 AS source, floor(l_quantity / 10) * 10 AS bucket, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT bucket, sum(n)::BIGINT AS n FROM s GROUP BY 1) SELECT bucket, n, sum(n) OVER (ORDER BY bucket)::BIGINT AS cumulative FROM m")
def merged_histograms(spark, sf_dir):
    from pyspark.sql import Window

    s = A.histogram(table(spark, sf_dir, "lineitem").withColumn("source", F.col("l_suppkey") % 4), ["source"], F.col("l_quantity"), 10.0)
    m = s.groupBy(F.col("bucket").cast("double").alias("bucket")).agg(F.sum("n").alias("n"))
    return m.withColumn("cumulative", F.sum("n").over(Window.orderBy("bucket")))


@register("kth_percentile", "WITH r AS (SELECT l_returnflag, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS rk, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, l_extendedprice AS value FROM r WHERE rk = least(n - 1, floor(n * 90 / 100))")
def kth_percentile(spark, sf_dir):
    return A.kth_percentile(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice", 90)


@register("kth_smallest", "SELECT o_orderpriority, o_totalprice AS value FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS rk FROM orders) WHERE rk = 7")
def kth_smallest(spark, sf_dir):
    r = A.selected(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", F.lit(7), F.lit(7))
    return r.select("o_orderpriority", F.col("o_totalprice").alias("value"))


@register("exact_median", "SELECT o_orderstatus, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def exact_median(spark, sf_dir):
    m = A.medians(table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice"), ["o_orderstatus"], "o_totalprice")
    return m.select("o_orderstatus", F.round("median", 4).alias("median"))


@register("hot_partition", "WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(n / (SELECT sum(n) / count(*) FROM c), 6) AS share FROM c WHERE n / (SELECT sum(n) / count(*) FROM c) >= 1.0")
def hot_partition(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return A.hot(c, "n", 1.0).withColumn("share", F.round("share", 6))


@register("slow_outlier", "WITH b AS (SELECT s_nationkey AS broker, round(avg(abs(s_acctbal)), 4) AS latency FROM supplier GROUP BY 1), m AS (SELECT median(latency) AS med FROM b) SELECT broker, latency, CASE WHEN latency >= 5 * med THEN 'remove' WHEN latency >= 3 * med THEN 'slow' WHEN latency >= 1.3 * med THEN 'watch' ELSE 'fine' END AS verdict FROM b, m")
def slow_outlier(spark, sf_dir):
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("broker")).agg(F.round(F.avg(F.abs("s_acctbal")), 4).alias("latency"))
    med = A.medians(b.withColumn("__g", F.lit(1)), ["__g"], "latency").select("median")
    x = b.join(F.broadcast(med))
    verdict = F.when(F.col("latency") >= 5 * F.col("median"), "remove").when(F.col("latency") >= 3 * F.col("median"), "slow").when(F.col("latency") >= 1.3 * F.col("median"), "watch").otherwise("fine")
    return x.select("broker", "latency", verdict.alias("verdict"))


@register("g_counter", "SELECT (sum(m))::BIGINT AS value FROM (SELECT user_id, max(event_id) AS m FROM events GROUP BY 1)")
def g_counter(spark, sf_dir):
    return A.counter_value(table(spark, sf_dir, "events"), "user_id", "event_id")


@register("lww_register", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def lww_register(spark, sf_dir):
    return A.newest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


@register("or_set", "WITH a AS (SELECT l_partkey AS element, l_orderkey AS tag FROM lineitem), d AS (SELECT l_partkey AS element, l_orderkey AS tag FROM lineitem WHERE l_returnflag <> 'N') SELECT DISTINCT element FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.element = a.element AND d.tag = a.tag)")
def or_set(spark, sf_dir):
    adds = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("element"), F.col("l_orderkey").alias("tag"), "l_returnflag")
    return A.live_elements(adds.drop("l_returnflag"), adds.filter("l_returnflag <> 'N'").drop("l_returnflag"), "element", "tag")


VERSIONS = "v AS (SELECT l_partkey AS key, l_suppkey % 3 AS replica, max(l_orderkey) AS version FROM lineitem GROUP BY ALL)"


@register("read_repair", f"WITH {VERSIONS}, m AS (SELECT key, max(version) AS newest FROM v GROUP BY 1) SELECT key, newest, count(*) FILTER (WHERE version < newest) AS behind FROM v JOIN m USING (key) GROUP BY key, newest")
def read_repair(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("key"), (F.col("l_suppkey") % 3).alias("replica")).agg(F.max("l_orderkey").alias("version"))
    per = v.groupBy("key", "version").agg(F.count("*").alias("n"))
    m = per.groupBy("key").agg(F.max(F.struct("version", "n")).alias("top"), F.sum("n").alias("all"))
    return m.select("key", F.col("top.version").alias("newest"), (F.col("all") - F.col("top.n")).alias("behind"))


@register("approx_distinct")
def approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("approx"), F.countDistinct("l_partkey").alias("exact"))


@register("heavy_hitters", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) * 100 >= (SELECT count(*) FROM events)")
def heavy_hitters(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id")
    grid = A.count_min(e, "user_id", 4, 64)
    total = e.agg(F.count("*").alias("total"))
    likely = A.count_min_estimate(e.distinct(), "user_id", grid, 4, 64).join(F.broadcast(total)).filter("estimate * 100 >= total").select("user_id", "total")
    # estimates are never too low, so the exact count of the likely ones decides
    return e.join(likely, "user_id").groupBy("user_id", "total").agg(F.count("*").alias("n")).filter("n * 100 >= total").select("user_id", "n")


@register("bloom_membership", "SELECT (SELECT count(*) FROM labels) AS members, (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS passed_members, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS strangers, true AS few_strangers_pass")
def bloom_membership(spark, sf_dir):
    """Probes every document against a filter of the labelled ones: no member is lost, and under 1 in 20 others pass."""
    labels, docs = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id")
    size = A.bloom_size(labels.count(), 0.01)
    passed = A.bloom_may_contain(docs, "doc_id", A.bloom_bits(labels, "doc_id", *size), *size).withColumn("passed", F.lit(True))
    known = docs.join(labels.distinct().withColumn("member", F.lit(True)), "doc_id", "left").join(passed.distinct(), "doc_id", "left")
    member, through = F.coalesce("member", F.lit(False)), F.coalesce("passed", F.lit(False))
    found = known.agg(F.count_if(member & through).alias("passed_members"), F.count_if(~member).alias("strangers"), F.count_if(~member & through).alias("false"))
    return labels.agg(F.count("*").alias("members")).join(F.broadcast(found)).select("members", "passed_members", "strangers", (F.col("false") * 20 <= F.col("strangers") + 20).alias("few_strangers_pass"))


@register("reservoir_sample", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ('0x' || substr(sha256('7:' || event_id), 1, 15))::BIGINT, event_id) AS rn FROM events) WHERE rn <= 5")
def reservoir_sample(spark, sf_dir):
    return A.reservoir(table(spark, sf_dir, "events").select("event_type", "event_id"), ["event_type"], "event_id", 5, seed=7)


@register("fan_out_ratio", "SELECT count(*) AS records, sum(len(w)) AS words, round(sum(len(w)) / count(*), 6) AS ratio FROM (SELECT list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)")
def fan_out_ratio(spark, sf_dir):
    words = F.size(F.filter(F.split("text", " ", -1), lambda x: x != ""))
    d = table(spark, sf_dir, "documents").select(words.alias("w")).agg(F.count("*").alias("records"), F.sum("w").alias("words"))
    return d.withColumn("ratio", F.round(F.col("words") / F.col("records"), 6))


@register("group_lag", "WITH p AS (SELECT user_id AS partition, count(*) AS end_offset, count(*) FILTER (WHERE event_type <> 'error') AS committed FROM events GROUP BY 1) SELECT partition, committed, end_offset, end_offset - committed AS lag, row_number() OVER (ORDER BY end_offset - committed DESC, partition) AS worst FROM p")
def group_lag(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("partition")).agg(F.count("*").alias("end_offset"), F.count_if(F.col("event_type") != "error").alias("committed"))
    p = p.withColumn("lag", F.col("end_offset") - F.col("committed"))
    return p.withColumn("worst", F.row_number().over(Window.orderBy(F.desc("lag"), "partition")).cast("bigint"))


@register("time_lag", "WITH e AS (SELECT user_id, max(floor(epoch(ts))::BIGINT) AS newest, max(floor(epoch(ts))::BIGINT) FILTER (WHERE event_type = 'purchase') AS read FROM events GROUP BY 1) SELECT user_id, newest - read AS lag FROM e WHERE read IS NOT NULL")
def time_lag(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", tick("ts").alias("t"))
    g = e.groupBy("user_id").agg(F.max("t").alias("newest"), F.max(F.when(F.col("event_type") == "purchase", F.col("t"))).alias("read"))
    return g.filter("read IS NOT NULL").select("user_id", (F.col("newest") - F.col("read")).alias("lag"))
