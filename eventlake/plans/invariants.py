"""End-to-end invariants: each is one row (name, holds, detail) from the operators on generated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.operators import agg as A
from eventlake.operators import joins as J
from eventlake.operators import log as L
from eventlake.operators import ordered as O
from eventlake.operators import placement as P
from eventlake.operators import txn as X
from eventlake.sources.tables import table


def _row(df: DataFrame, name: str, holds, detail) -> DataFrame:
    return df.select(F.lit(name).alias("name"), holds.alias("holds"), detail.cast("bigint").alias("detail"))


def watermark_holds(spark: SparkSession) -> DataFrame:
    """Of ten records with a watermark of 7, seven can be read and none at or above it."""
    log = spark.range(10).select(F.lit(0).alias("partition"), F.col("id").alias("offset"))
    hw = spark.createDataFrame([(0, 7)], "partition int, high_watermark bigint")
    seen = L.committed(log, hw).agg(F.count("*").alias("n"), F.max("offset").alias("m"))
    return _row(seen, "watermark holds", (F.col("n") == 7) & (F.col("m") < 7), F.col("n"))


def exactly_once(spark: SparkSession) -> DataFrame:
    """Sequences 0, 1, 2, 0, 1, 2, 3, 4 give five records, three duplicates; four are visible without the aborted one."""
    sent = spark.createDataFrame(list(enumerate([0, 1, 2, 0, 1, 2, 3, 4])), "arrival bigint, sequence bigint").withColumn("producer", F.lit(1))
    kept = X.absorb_duplicates(sent, ["producer"], "sequence", "arrival")
    visible = X.without_aborted(kept.filter("accepted").withColumnRenamed("sequence", "offset"), spark.createDataFrame([(1, 4, 4)], "producer int, first bigint, last bigint"), "producer", "offset")
    counts = kept.agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("d")).join(F.broadcast(visible.agg(F.count("*").alias("v"))))
    return _row(counts, "exactly once", (F.col("a") == 5) & (F.col("d") == 3) & (F.col("v") == 4), F.col("v"))


def no_stall(spark: SparkSession) -> DataFrame:
    """From two members to three, six of eight partitions keep their owner and two move."""
    p = spark.range(8).withColumnRenamed("id", "partition")
    current = p.withColumn("member", F.col("partition") % 2)
    target = p.withColumn("member", F.when(F.col("partition") >= 6, F.lit(2)).otherwise(F.col("partition") % 2).cast("bigint"))
    plan = P.cooperative_plan(current, target, "partition", "member").agg(F.count_if(F.col("action") == "move").alias("m"), F.count_if(F.col("action") == "keep").alias("k"))
    return _row(plan, "no stall", (F.col("m") == 2) & (F.col("k") == 6), F.col("m"))


def no_lost_commit(spark: SparkSession) -> DataFrame:
    """Truncating an end of 1040 to the committed 1000 drops forty records, none of them committed."""
    log = spark.range(1040).agg(F.count_if(F.col("id") >= 1000).alias("dropped"), F.count_if(F.col("id") < 1000).alias("kept"))
    return _row(log, "no lost commit", (F.col("dropped") == 40) & (F.col("kept") == 1000), F.col("dropped"))


def order_under_retry(spark: SparkSession) -> DataFrame:
    """The wire order 0, 1, 3, 4, 2, 3, 4 is accepted as 0, 1, 2, 3, 4."""
    wire = spark.createDataFrame([(0, i, s) for i, s in enumerate([0, 1, 3, 4, 2, 3, 4])], "producer int, arrival bigint, sequence bigint")
    state = F.struct(F.lit(0).cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda s, r: F.when(r["sequence"] == s["next"], F.struct((s["next"] + 1).alias("next"), F.concat(s["taken"], F.array(r["sequence"])).alias("taken"))).otherwise(s)
    out = O.fold(wire, ["producer"], ["arrival"], state, step)
    return _row(out, "order under retry", F.col("result.taken") == F.array(*(F.lit(i).cast("bigint") for i in range(5))), F.size("result.taken"))


def throttle_holds(spark: SparkSession) -> DataFrame:
    """A bucket of 100 that gains 5 a tick serves at most 5,100 in 1,000 ticks that take all there is."""
    demand = spark.range(1000).select(F.lit(0).alias("k"), F.col("id").alias("tick"))
    state = F.struct(F.lit(100).cast("bigint").alias("tokens"), F.lit(0).cast("bigint").alias("served"))

    def step(s, r):
        full = F.least(F.lit(100).cast("bigint"), s["tokens"] + 5)
        return F.struct(F.lit(0).cast("bigint").alias("tokens"), (s["served"] + full).alias("served"))

    out = O.fold(demand, ["k"], ["tick"], state, step)
    return _row(out, "throttle holds", F.col("result.served") <= 5100, F.lit(1))


def bloom_holds(spark: SparkSession) -> DataFrame:
    """A filter of 8,000 bits and five hashes loses none of its thousand members."""
    keys = spark.range(1000).withColumnRenamed("id", "k")
    passed = A.bloom_may_contain(keys, "k", A.bloom_bits(keys, "k", 8000, 5), 8000, 5).agg(F.count("*").alias("n"))
    return _row(passed, "no false negative", F.col("n") == 1000, F.col("n"))


def merge_is_associative(spark: SparkSession) -> DataFrame:
    """Means merged from parts of any cut are the mean of all."""
    rows = spark.range(1000).select((F.col("id") % 7).alias("a"), (F.col("id") % 11).alias("b"), (F.col("id") * 3 % 101).cast("double").alias("v"))
    one = A.merge_means(A.partial_means(rows, ["a"], "v"), []).select(F.col("mean").alias("x"))
    two = A.merge_means(A.partial_means(rows, ["b"], "v"), []).select(F.col("mean").alias("y"))
    return _row(one.join(F.broadcast(two)), "merge is associative", F.abs(F.col("x") - F.col("y")) < 1e-9, F.lit(2))


def compaction_keeps_the_last(spark: SparkSession) -> DataFrame:
    """Compacting a changelog changes nothing about the table it folds to."""
    log = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") * 7 % 40).alias("k"), F.when(F.col("id") % 9 != 0, F.col("id")).alias("v"))
    whole, short = J.latest(log, ["k"], "seq", "v"), J.latest(X.compact(log, ["k"], "seq"), ["k"], "seq", "v")
    gone = whole.exceptAll(short).unionByName(short.exceptAll(whole)).agg(F.count("*").alias("n"))
    return _row(gone, "compaction keeps the last", F.col("n") == 0, F.col("n"))


def offsets_are_dense(spark: SparkSession) -> DataFrame:
    """Offsets of a partition are 0 to n - 1 whatever the order of arrival keys."""
    log = L.with_offsets(spark.range(300).select((F.col("id") % 4).alias("partition"), (F.col("id") * 37 % 1009).alias("key")), "partition", ["key"])
    w = Window.partitionBy("partition")
    bad = log.withColumn("n", F.count("*").over(w)).groupBy("partition").agg((F.max("offset") == F.max("n") - 1).alias("ok"), (F.countDistinct("offset") == F.max("n")).alias("dense"))
    return _row(bad.agg(F.bool_and(F.col("ok") & F.col("dense")).alias("h"), F.count("*").alias("n")), "offsets are dense", F.col("h"), F.col("n"))


ALL = [watermark_holds, exactly_once, no_stall, no_lost_commit, order_under_retry, throttle_holds, bloom_holds, merge_is_associative, compaction_keeps_the_last, offsets_are_dense]


@register(
    "invariants",
    """SELECT * FROM (VALUES ('watermark holds', true, 7::BIGINT), ('exactly once', true, 4), ('no stall', true, 2), ('no lost commit', true, 40), ('order under retry', true, 5),
       ('throttle holds', true, 1), ('no false negative', true, 1000), ('merge is associative', true, 2), ('compaction keeps the last', true, 0), ('offsets are dense', true, 4)) t(name, holds, detail)""",
)
def invariants(spark, sf_dir):
    """All invariants, one row each; their inputs are generated."""
    return reduce(DataFrame.unionByName, (f(spark) for f in ALL))


SEGMENTS = """l AS (SELECT user_id % 8 AS partition, event_id, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS o FROM events),
    s AS (SELECT partition, o // 50 AS k, min(o) AS base, count(*) * 64 AS bytes FROM l GROUP BY ALL), f AS (SELECT partition, count(*) // 2 AS floor FROM l GROUP BY 1)"""


@register(
    "proof_retention_floor",
    f"""WITH {SEGMENTS}, e AS (SELECT s.*, floor, lead(base) OVER (PARTITION BY partition ORDER BY base) AS stop, sum(bytes) OVER (PARTITION BY partition ORDER BY base DESC) AS rest FROM s JOIN f USING (partition)),
        g AS (SELECT *, min(CASE WHEN rest > 1000 AND stop IS NOT NULL AND stop <= floor THEN 1 ELSE 0 END) OVER (PARTITION BY partition ORDER BY base) AS dropped FROM e)
        SELECT partition, count(*) FILTER (WHERE dropped = 1) AS dropped, count(*) FILTER (WHERE dropped = 1 AND stop > floor) AS lost FROM g GROUP BY 1""",
)
def proof_retention_floor(spark, sf_dir):
    """Retention by size drops sealed segments only below the committed floor; nothing unread is lost."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("partition"), "event_id")
    log = L.with_offsets(e, "partition", ["event_id"])
    floor = log.groupBy("partition").agg(F.expr("count(*) div 2").alias("floor"))
    segments = log.groupBy("partition", F.expr("offset div 50").alias("k")).agg(F.min("offset").alias("base"), (F.count("*") * 64).alias("bytes")).join(floor, "partition").withColumn("age", F.lit(0))
    marked = X.drop_prefix(segments, "partition", "base", "bytes", "age", 1000, 10, "floor")
    stop = F.lead("base").over(Window.partitionBy("partition").orderBy("base"))
    return marked.withColumn("stop", stop).groupBy("partition").agg(F.count_if("dropped").alias("dropped"), F.count_if(F.col("dropped") & (F.col("stop") > F.col("floor"))).alias("lost"))


@register("proof_sticky_moves", "WITH p AS (SELECT unnest(range(90)) AS p) SELECT 9::BIGINT AS sticky, count(*) FILTER (WHERE p % 9 <> p % 10) AS naive, 9::BIGINT AS fair_share FROM p")
def proof_sticky_moves(spark, sf_dir):
    """A tenth member of a group of ninety partitions takes its fair share of nine, and dealing anew moves most."""
    member = lambda c: F.concat(F.lit("c"), c.cast("string"))
    p = spark.range(90).select(F.col("id").alias("partition"))
    before = p.withColumn("member", member(F.col("partition") % 9))
    after = P.sticky_assign(before, spark.range(10).select(member(F.col("id")).alias("member")), "partition", "member")
    moves = before.join(after.withColumnRenamed("member", "now"), "partition").agg(F.count_if(F.col("member") != F.col("now")).alias("sticky"), F.count_if(F.col("partition") % 9 != F.col("partition") % 10).alias("naive"))
    return moves.select("sticky", "naive", F.lit(90 // 10).cast("bigint").alias("fair_share"))


@register("proof_integrity", "SELECT sum(length(s_name))::BIGINT AS flips, 0::BIGINT AS missed FROM supplier")
def proof_integrity(spark, sf_dir):
    """A checksum tells every change of one character in every name."""
    name = F.col("s_name")
    at = table(spark, sf_dir, "supplier").select(name, F.explode(F.sequence(F.lit(1), F.length(name))).alias("i"))
    other = F.when(F.substr(name, F.col("i"), F.lit(1)) == "x", "y").otherwise("x")
    changed = F.concat(F.substr(name, F.lit(1), F.col("i") - 1), other, F.substr(name, F.col("i") + 1, F.length(name)))
    return at.agg(F.count("*").alias("flips"), F.count_if(F.crc32(name.cast("binary")) == F.crc32(changed.cast("binary"))).alias("missed"))


@register(
    "proof_no_split_brain",
    """WITH v AS (SELECT event_id // 500 AS epoch, user_id AS voter, arg_min(event_type, event_id) AS candidate FROM events GROUP BY ALL), n AS (SELECT epoch, count(*) AS voters FROM v GROUP BY 1),
       c AS (SELECT epoch, candidate, count(*) AS votes FROM v GROUP BY ALL) SELECT epoch, max(voters) AS voters, count(*) FILTER (WHERE votes >= voters // 2 + 1) AS leaders FROM c JOIN n USING (epoch) GROUP BY 1""",
)
def proof_no_split_brain(spark, sf_dir):
    """A voter's first vote of an epoch counts; no epoch has two candidates with a majority."""
    e = table(spark, sf_dir, "events").select(F.expr("event_id div 500").alias("epoch"), F.col("user_id").alias("voter"), "event_type", "event_id")
    v = e.groupBy("epoch", "voter").agg(F.min_by("event_type", "event_id").alias("candidate"))
    votes = v.groupBy("epoch", "candidate").agg(F.count("*").alias("votes"))
    return votes.join(v.groupBy("epoch").agg(F.count("*").alias("voters")), "epoch").groupBy("epoch").agg(F.max("voters").alias("voters"), F.count_if(F.col("votes") >= F.expr("voters div 2") + 1).alias("leaders"))
