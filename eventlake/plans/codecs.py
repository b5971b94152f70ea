"""Codec queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions import codecs as C
from eventlake.sources.tables import table


@register("zigzag_codes", "SELECT o_orderkey, CASE WHEN d >= 0 THEN 2 * d ELSE -2 * d - 1 END AS z FROM (SELECT o_orderkey, o_custkey - 70 AS d FROM orders)")
def zigzag_codes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.zigzag(F.col("o_custkey") - 70).alias("z"))


@register("zigzag_round_trip", "SELECT o_orderkey, o_custkey - 70 AS n FROM orders")
def zigzag_round_trip(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.unzigzag(C.zigzag(F.col("o_custkey") - 70)).alias("n"))


VARINT = "CASE WHEN n < 128 THEN printf('%02x', n) WHEN n < 16384 THEN printf('%02x', n % 128 + 128) || printf('%02x', n // 128) ELSE printf('%02x', n % 128 + 128) || printf('%02x', n // 128 % 128 + 128) || printf('%02x', n // 16384) END"


@register("varint_bytes", f"SELECT n, {VARINT} AS bytes FROM (SELECT DISTINCT l_partkey * 97 AS n FROM lineitem)")
def varint_bytes(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 97).alias("n")).distinct()
    return n.select("n", C.varint_hex(F.col("n")).alias("bytes"))


@register("wire_envelopes", "SELECT n_nationkey, '00' || printf('%08x', n_regionkey) || lower(hex(encode(n_name))) AS wire FROM nation")
def wire_envelopes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", C.envelope_hex(F.col("n_regionkey"), F.col("n_name")).alias("wire"))


@register("length_frames", "SELECT n_nationkey, printf('%08x', octet_length(encode(n_name))) || lower(hex(encode(n_name))) AS frame FROM nation")
def length_frames(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", C.frame_hex(F.col("n_name")).alias("frame"))


@register("crc32c_checks")
def crc32c_checks(spark, sf_dir):
    """CRC-32C of each nation's name, and of the published check string."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("data")).unionByName(spark.range(1).select(F.lit("123456789").alias("data")))
    return n.select("data", F.lower(F.hex(C.crc32c(F.col("data")))).alias("crc"))


@register("prefix_compression", "WITH p AS (SELECT c_name, lag(c_name) OVER (ORDER BY c_name) AS prev FROM customer), s AS (SELECT c_name, coalesce((SELECT max(i) FROM range(0, 60) r(i) WHERE i <= least(length(c_name), length(prev)) AND substr(c_name, 1, i) = substr(prev, 1, i)), 0) AS shared FROM p) SELECT c_name, shared::BIGINT AS shared, substr(c_name, shared + 1) AS suffix FROM s")
def prefix_compression(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_name")
    prev = F.lag("c_name").over(Window.orderBy("c_name"))
    s = c.withColumn("prev", prev).withColumn("shared", F.coalesce(C.shared_prefix(F.col("c_name"), F.col("prev")), F.lit(0)))
    return s.select("c_name", F.col("shared").cast("bigint").alias("shared"), F.substr("c_name", F.col("shared") + 1).alias("suffix"))


@register("batch_headers", "WITH b AS (SELECT o_custkey AS batch, min(o_orderkey) AS base, max(o_orderkey) - min(o_orderkey) AS last_delta, count(*) AS n FROM orders GROUP BY 1) SELECT batch, base, base + last_delta + 1 AS next_base, n = last_delta + 1 AS dense FROM b")
def batch_headers(spark, sf_dir):
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.min("o_orderkey").alias("base"), (F.max("o_orderkey") - F.min("o_orderkey")).alias("d"), F.count("*").alias("n"))
    return b.select("batch", "base", (F.col("base") + F.col("d") + 1).alias("next_base"), (F.col("n") == F.col("d") + 1).alias("dense"))


@register("batch_bytes", "SELECT o_custkey AS batch, sum(length(o_orderpriority) + 30)::BIGINT AS unbatched, (sum(length(o_orderpriority)) + 60)::BIGINT AS batched FROM orders GROUP BY 1")
def batch_bytes(spark, sf_dir):
    size = F.length("o_orderpriority").cast("bigint")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.sum(size + 30).alias("unbatched"), (F.sum(size) + 60).alias("batched"))
