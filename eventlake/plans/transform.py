"""Transform, routing and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlake.catalog import register
from eventlake.functions.ticks import tick
from eventlake.operators import transform as R
from eventlake.sources.tables import table


@register("branch_counts", "SELECT CASE WHEN o_totalprice >= 200000 THEN 'high' WHEN o_totalprice >= 50000 THEN 'mid' WHEN o_totalprice >= 5000 THEN 'low' ELSE '<dropped>' END AS branch, count(*) AS n FROM orders GROUP BY 1")
def branch_counts(spark, sf_dir):
    p = F.col("o_totalprice")
    b = R.branch([("high", p >= 200000), ("mid", p >= 50000), ("low", p >= 5000)])
    return table(spark, sf_dir, "orders").groupBy(b.alias("branch")).agg(F.count("*").alias("n"))


@register("flat_map_words", "SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> '' GROUP BY 1")
def flat_map_words(spark, sf_dir):
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", " ", -1)).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


@register("transform_chain", "SELECT user_id AS uid, upper(event_type) AS kind, round(value * 2, 4) AS doubled FROM events WHERE event_type <> 'error' AND value > 20")
def transform_chain(spark, sf_dir):
    steps = [
        lambda d: d.filter("event_type <> 'error'"),
        lambda d: d.withColumnRenamed("user_id", "uid"),
        lambda d: d.withColumn("kind", F.upper("event_type")),
        lambda d: d.filter("value > 20").withColumn("doubled", F.round(F.col("value") * 2, 4)),
        lambda d: d.select("uid", "kind", "doubled"),
    ]
    return R.chain(table(spark, sf_dir, "events"), steps)


@register("event_time_fallback", "SELECT event_id, CASE WHEN raw BETWEEN 0 AND 1000000000000000 THEN raw ELSE floor(epoch(ts))::BIGINT END AS t FROM (SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -event_id ELSE event_id * 1000 END AS raw FROM events)")
def event_time_fallback(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, -i).otherwise(i * 1000)
    return table(spark, sf_dir, "events").select("event_id", R.event_time(raw, tick("ts")).alias("t"))


@register("control_records", "SELECT user_id, count(*) FILTER (WHERE event_type IN ('signup', 'error')) AS control, count(*) FILTER (WHERE event_type NOT IN ('signup', 'error')) AS data FROM events GROUP BY 1")
def control_records(spark, sf_dir):
    control = F.col("event_type").isin("signup", "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(control).alias("control"), F.count_if(~control).alias("data"))


@register("skew_rejects", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY")
def skew_rejects(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    joined = table(spark, sf_dir, "lineitem").join(o, "l_orderkey")
    return joined.filter(F.expr("l_shipdate > o_orderdate + INTERVAL 60 DAY")).select("l_orderkey", "l_linenumber", "l_shipdate")


@register("record_checksums", "SELECT event_id, substr(sha256(event_type || '|' || 'u' || user_id), 1, 16) AS checksum, octet_length(encode(event_type)) + octet_length(encode('u' || user_id)) AS size FROM events")
def record_checksums(spark, sf_dir):
    key = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    value = F.col("event_type")
    return table(spark, sf_dir, "events").select("event_id", R.record_checksum(value, key).alias("checksum"), R.record_size(value, key).cast("bigint").alias("size"))


FIELDS = "f AS (SELECT n_regionkey AS v, n_name AS name, n_nationkey % 2 = 0 AS required FROM nation)"


@register("schema_compatibility", f"WITH {FIELDS}, p AS (SELECT a.v AS old, b.v AS new FROM (SELECT DISTINCT v FROM f) a, (SELECT DISTINCT v FROM f) b WHERE b.v = a.v + 1) SELECT old, new, (SELECT count(*) FROM f WHERE v = old AND required AND name NOT IN (SELECT name FROM f g WHERE g.v = new)) AS removed_required, (SELECT count(*) FROM f WHERE v = new AND required AND name NOT IN (SELECT name FROM f g WHERE g.v = old)) AS added_required FROM p")
def schema_compatibility(spark, sf_dir):
    f = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("v"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 2 == 0).alias("required"))
    old = f.select((F.col("v") + 1).alias("new"), "name", F.col("required").alias("was"))
    new = f.select(F.col("v").alias("new"), "name", F.col("required").alias("is"))
    pairs = f.select("v").distinct()
    pairs = pairs.join(pairs.select((F.col("v") + 1).alias("n")), F.col("v") == F.col("n")).select(F.col("v").alias("new"))
    both = old.join(new, ["new", "name"], "full").join(pairs, "new")
    g = both.groupBy("new").agg(F.count_if(F.col("was") & F.col("is").isNull()).alias("removed_required"), F.count_if(F.col("is") & F.col("was").isNull()).alias("added_required"))
    return g.select((F.col("new") - 1).alias("old"), "new", "removed_required", "added_required")


@register("schema_projection", "SELECT c_custkey AS id, c_name AS name, 'unknown' AS region FROM customer")
def schema_projection(spark, sf_dir):
    """Reader fields id and name, and region with a default that the writer lacks."""
    return project(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal"), [("id", "bigint", None), ("name", "string", None), ("region", "string", "unknown")])


def project(df, reader: list[tuple[str, str, object]]):
    """The reader's fields of ``df``; a missing one takes its default, or raises if it has none."""
    have = dict(df.dtypes)
    out = []
    for name, kind, default in reader:
        if name in have:
            if have[name] != kind:
                raise TypeError(f"{name} is {have[name]}, the reader wants {kind}")
            out.append(F.col(name))
        elif default is None:
            raise ValueError(f"{name} is missing and has no default")
        else:
            out.append(F.lit(default).cast(kind).alias(name))
    return df.select(*out)


@register("schema_registry_latest", "SELECT n_regionkey AS subject, max(n_nationkey) AS version, arg_max(n_name, n_nationkey) AS schema FROM nation GROUP BY 1")
def schema_registry_latest(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("subject")).agg(F.max("n_nationkey").alias("version"), F.max_by("n_name", "n_nationkey").alias("schema"))


@register("dead_letters", "WITH f AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS streak FROM events), s AS (SELECT user_id, streak, count(*) FILTER (WHERE event_type = 'error') AS failures, max(event_id) AS last FROM f GROUP BY 1, 2) SELECT user_id, failures, last FROM s WHERE failures >= 2")
def dead_letters(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("streak", F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(w))
    s = e.groupBy("user_id", "streak").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.max("event_id").alias("last"))
    return s.filter("failures >= 2").select("user_id", "failures", "last")


@register("retry_tiers", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'retry-1' WHEN 1 THEN 'retry-2' WHEN 2 THEN 'retry-3' ELSE 'dead-letter' END AS topic, CASE event_id % 5 WHEN 0 THEN 10 WHEN 1 THEN 60 WHEN 2 THEN 600 END AS delay FROM events WHERE event_type = 'error'")
def retry_tiers(spark, sf_dir):
    delays = F.array(*map(F.lit, (10, 60, 600)))
    attempt = (F.col("event_id") % 5).cast("int")
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("delay", F.get(delays, attempt))
    return e.select("event_id", F.when(F.col("delay").isNull(), "dead-letter").otherwise(F.concat(F.lit("retry-"), (attempt + 1).cast("string"))).alias("topic"), "delay")
