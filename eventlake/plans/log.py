"""Log queries: ``events`` dealt over eight partitions by user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.hashing import sha_slot
from eventlake.functions.ticks import tick
from eventlake.operators import log as L
from eventlake.sources.tables import table

LOG = """log AS (SELECT user_id % 8 AS partition, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS "offset",
    'u' || user_id AS key, event_type, value, floor(epoch(ts))::BIGINT AS t, event_id FROM events)"""
HW = """hw AS (SELECT partition, (count(*) * 9) // 10 AS high_watermark, count(*) AS log_end FROM log GROUP BY partition)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("partition"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"),
        "event_type", "value", tick("ts").alias("t"), "event_id",
    )
    return L.with_offsets(e, "partition", ["event_id"])


def watermarks(log: DataFrame) -> DataFrame:
    return log.groupBy("partition").agg(F.floor(F.count("*") * 9 / 10).alias("high_watermark"), F.count("*").alias("log_end"))


@register("log_offsets", f"WITH {LOG} SELECT partition, \"offset\", key, event_id FROM log")
def log_offsets(spark, sf_dir):
    return event_log(spark, sf_dir).select("partition", "offset", "key", "event_id")


@register("committed_read", f"WITH {LOG}, {HW} SELECT partition, count(*) AS readable, round(sum(value), 2) AS total FROM log JOIN hw USING (partition) WHERE \"offset\" < high_watermark GROUP BY partition")
def committed_read(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return L.committed(log, watermarks(log)).groupBy("partition").agg(F.count("*").alias("readable"), F.round(F.sum("value"), 2).alias("total"))


@register("partition_lag", f"WITH {LOG}, {HW} SELECT partition, high_watermark, log_end, log_end - high_watermark AS lag FROM hw")
def partition_lag(spark, sf_dir):
    return watermarks(event_log(spark, sf_dir)).select("partition", "high_watermark", "log_end", (F.col("log_end") - F.col("high_watermark")).alias("lag"))


@register("key_slots", "SELECT ('0x' || substr(sha256('u' || user_id), 1, 8))::BIGINT % 12 AS slot, count(*) AS n, count(DISTINCT user_id) AS keys FROM events GROUP BY 1")
def key_slots(spark, sf_dir):
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return table(spark, sf_dir, "events").select("user_id", sha_slot(key, 12).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("keys"))


@register("round_robin_slots", "SELECT (rn - 1) % 6 AS slot, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")
def round_robin_slots(spark, sf_dir):
    rn = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").select(((rn - 1) % 6).cast("bigint").alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))


@register(
    "time_index",
    f"""WITH {LOG}, s AS (SELECT partition, "offset", t, max(t) OVER (PARTITION BY partition ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
        FROM log WHERE ("offset" + 1) % 16 = 0) SELECT partition, "offset", t FROM s WHERE m IS NULL OR t > m""",
)
def time_index(spark, sf_dir):
    return L.time_index(event_log(spark, sf_dir), 16)


TARGETS = "targets AS (SELECT partition, min(t) + (max(t) - min(t)) * k // 4 AS target FROM log, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k) GROUP BY partition, k)"


def _targets(log: DataFrame) -> DataFrame:
    span = log.groupBy("partition").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    k = F.explode(F.array(*map(F.lit, range(6)))).alias("k")
    return span.select("partition", "lo", "hi", k).select("partition", (F.col("lo") + F.expr("(hi - lo) * k div 4")).alias("target"))


@register(
    "offset_for_time",
    f"""WITH {LOG}, {TARGETS} SELECT g.partition, target, coalesce(min("offset") FILTER (WHERE t >= target), max("offset") + 1) AS "offset"
        FROM targets g JOIN log USING (partition) GROUP BY g.partition, target""",
)
def offset_for_time(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return L.offset_for_time(log, _targets(log))


@register("list_offsets", f"WITH {LOG}, {HW} SELECT partition, min(\"offset\") AS earliest, max(high_watermark) AS latest FROM log JOIN hw USING (partition) GROUP BY partition")
def list_offsets(spark, sf_dir):
    log = event_log(spark, sf_dir)
    return log.join(watermarks(log), "partition").groupBy("partition").agg(F.min("offset").alias("earliest"), F.max("high_watermark").alias("latest"))


SEGMENTS = "seg AS (SELECT partition, min(\"offset\") AS base FROM log GROUP BY partition, \"offset\" // 100)"


@register("seek_clamped", f"WITH {LOG}, {HW} SELECT partition, k - 50 AS requested, least(greatest(k - 50, 10), high_watermark) AS position FROM hw, range(0, 3000, 250) r(k)")
def seek_clamped(spark, sf_dir):
    hw = watermarks(event_log(spark, sf_dir)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2750), F.lit(250)))).withColumn("requested", F.col("k").cast("bigint") - 50)
    return hw.select("partition", "requested", L.seek(F.col("requested"), F.lit(10).cast("bigint"), F.col("high_watermark")).alias("position"))


@register("out_of_range", f"WITH {LOG}, {HW} SELECT partition, k AS \"offset\", CASE WHEN k < 100 THEN 'below' WHEN k > log_end THEN 'beyond' ELSE 'in' END AS verdict FROM hw, range(0, 3000, 130) r(k)")
def out_of_range(spark, sf_dir):
    hw = watermarks(event_log(spark, sf_dir)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2990), F.lit(130)))).withColumn("offset", F.col("k").cast("bigint"))
    return hw.select("partition", "offset", L.classify_offset(F.col("offset"), F.lit(100), F.col("log_end")).alias("verdict"))


COMMITTED = "com AS (SELECT partition, max(\"offset\") FILTER (WHERE event_type = 'purchase' AND \"offset\" < 40 + 40 * (partition % 3)) AS committed FROM log GROUP BY partition)"


@register("offset_reset", f"WITH {LOG}, {HW}, {COMMITTED} SELECT partition, CASE WHEN committed IS NULL OR committed < 60 THEN 60 ELSE committed END AS position, CASE WHEN committed IS NULL THEN 'missing' WHEN committed < 60 THEN 'aged-out' ELSE 'committed' END AS reason FROM com")
def offset_reset(spark, sf_dir):
    log = event_log(spark, sf_dir)
    com = log.groupBy("partition").agg(F.max(F.when((F.col("event_type") == "purchase") & (F.col("offset") < 40 + 40 * (F.col("partition") % 3)), F.col("offset"))).alias("committed"))
    position, reason = L.reset_offset(F.col("committed"), F.lit(60).cast("bigint"), F.lit(0), "earliest")
    return com.select("partition", position.alias("position"), reason.alias("reason"))


@register("range_slice", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey BETWEEN 100 AND 500")
def range_slice(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter(F.col("l_orderkey").between(100, 500)).select("l_orderkey", "l_linenumber", "l_partkey")


@register("range_selectivity", "SELECT count(*) FILTER (WHERE l_orderkey BETWEEN 100 AND 500) AS hits, count(*) AS total, round(count(*) FILTER (WHERE l_orderkey BETWEEN 100 AND 500) / count(*), 6) AS selectivity FROM lineitem")
def range_selectivity(spark, sf_dir):
    hit = F.col("l_orderkey").between(100, 500)
    agg = table(spark, sf_dir, "lineitem").agg(F.count_if(hit).alias("hits"), F.count("*").alias("total"))
    return agg.withColumn("selectivity", F.round(F.col("hits") / F.col("total"), 6))


@register("bitset_density", "SELECT user_id, count(DISTINCT event_id % 1000) AS members, round(count(DISTINCT event_id % 1000) / 1000, 6) AS density FROM events GROUP BY user_id")
def bitset_density(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 1000).alias("p"))
    # remainders are -999 to 999, each a bit of its own (bitmap_bit_position puts n and 1 - n, so 1 and 0, on one)
    bits = e.groupBy("user_id").agg(F.bitmap_count(F.bitmap_construct_agg(F.col("p") + 999)).alias("members"))
    return bits.withColumn("density", F.round(F.col("members") / 1000, 6))


RANGES = "r AS (SELECT o_custkey % 50 AS reader, o_orderkey % 2000 AS start, o_orderkey % 2000 + 1 + o_custkey % 40 AS stop FROM orders)"


@register(
    "fetch_coalesce",
    f"""WITH {RANGES}, m AS (SELECT *, max(stop) OVER (PARTITION BY reader ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY reader ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM m)
        SELECT reader, min(start) AS start, max(stop) AS stop, count(*) AS members, sum(stop - start)::BIGINT AS raw FROM i GROUP BY reader, island""",
)
def fetch_coalesce(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderkey") % 2000
    return L.coalesce_ranges(o.select((F.col("o_custkey") % 50).alias("reader"), start.alias("start"), (start + 1 + F.col("o_custkey") % 40).alias("stop")), ["reader"])


ACKS = "acks AS (SELECT partition, \"offset\", (event_type <> 'error' OR \"offset\" < 20) AS done FROM log)"


@register("contiguous_commit", f"WITH {LOG}, {ACKS}, o AS (SELECT *, min(\"offset\") FILTER (WHERE NOT done) OVER (PARTITION BY partition) AS first_open FROM acks) SELECT partition, max(\"offset\") FILTER (WHERE first_open IS NULL OR \"offset\" < first_open) AS committed FROM o GROUP BY partition")
def contiguous_commit(spark, sf_dir):
    log = event_log(spark, sf_dir).withColumn("done", (F.col("event_type") != "error") | (F.col("offset") < 20))
    return L.contiguous_prefix(log.select("partition", "offset", "done"), ["partition"], "offset", "done")


@register("segment_lookup", f"WITH {LOG}, {SEGMENTS} SELECT p.partition, p.\"offset\", event_id, base FROM log p ASOF LEFT JOIN seg ON p.partition = seg.partition AND p.\"offset\" >= seg.base")
def segment_lookup(spark, sf_dir):
    log = event_log(spark, sf_dir)
    seg = log.groupBy("partition", F.expr("offset div 100").alias("s")).agg(F.min("offset").alias("base")).select("partition", F.col("base").alias("offset"), "base")
    return L.floor_join(log.select("partition", "offset", "event_id"), seg, ["partition"], "offset", "base")


@register("offset_index_floor", f"WITH {LOG}, ix AS (SELECT partition, \"offset\" AS o, \"offset\" * 64 AS position FROM log WHERE \"offset\" % 50 = 49) SELECT p.partition, p.\"offset\", coalesce(position, 0) AS position FROM log p ASOF LEFT JOIN ix ON p.partition = ix.partition AND p.\"offset\" >= ix.o")
def offset_index_floor(spark, sf_dir):
    log = event_log(spark, sf_dir)
    index = log.filter("offset % 50 = 49").select("partition", "offset", (F.col("offset") * 64).alias("position"))
    found = L.floor_join(log.select("partition", "offset"), index, ["partition"], "offset", "position")
    return found.withColumn("position", F.coalesce("position", F.lit(0).cast("bigint")))


@register("mirror_translation", f"WITH {LOG}, m AS (SELECT partition, \"offset\" AS source, row_number() OVER (PARTITION BY partition ORDER BY \"offset\") - 1 AS target FROM log WHERE event_type <> 'view') SELECT * FROM m")
def mirror_translation(spark, sf_dir):
    copied = event_log(spark, sf_dir).filter("event_type <> 'view'").select("partition", F.col("offset").alias("source"))
    return L.with_offsets(copied, "partition", ["source"]).withColumnRenamed("offset", "target")


@register("checkpoint_translation", f"WITH {LOG}, c AS (SELECT partition, \"offset\" AS s, \"offset\" * 2 + 5 AS target FROM log WHERE \"offset\" % 40 = 0) SELECT l.partition, l.\"offset\", target, l.\"offset\" - s AS reprocessing FROM log l ASOF LEFT JOIN c ON l.partition = c.partition AND l.\"offset\" >= c.s")
def checkpoint_translation(spark, sf_dir):
    log = event_log(spark, sf_dir)
    points = log.filter("offset % 40 = 0").select("partition", "offset", F.struct(F.col("offset").alias("s"), (F.col("offset") * 2 + 5).alias("target")).alias("c"))
    found = L.floor_join(log.select("partition", "offset"), points, ["partition"], "offset", "c")
    return found.select("partition", "offset", "c.target", (F.col("offset") - F.col("c.s")).alias("reprocessing"))


@register("outbox_unpublished", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def outbox_unpublished(spark, sf_dir):
    published = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(published, "o_orderkey", "left_anti")
