"""Placement of keys, partitions and replicas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlake.functions.hashing import sha_slot
from eventlake.operators.log import floor_join


def range_assign(partitions: DataFrame, members: DataFrame, partition: str, member: str) -> DataFrame:
    """(partition, member): contiguous ranges in order; the first members take one more if it does not come out even."""
    tile = partitions.withColumn("__i", F.row_number().over(Window.orderBy(partition)) - 1).withColumn("__p", F.count("*").over(Window.partitionBy(F.lit(1))))
    seat = members.withColumn("__m", F.row_number().over(Window.orderBy(member)) - 1)
    n = members.agg(F.count("*").alias("__n"))
    x = tile.join(F.broadcast(n))
    base, extra = F.expr("__p div __n"), F.col("__p") % F.col("__n")
    wide = extra * (base + 1)
    m = F.when(F.col("__i") < wide, F.floor(F.col("__i") / (base + 1))).otherwise(extra + F.floor((F.col("__i") - wide) / F.greatest(base, F.lit(1))))
    return x.withColumn("__m", m.cast("int")).join(seat, "__m").select(partition, member)


def weighted_shares(members: DataFrame, member: str, weight: str, total: int) -> DataFrame:
    """(member, share): ``total`` dealt by weight, the largest remainders first, then by name."""
    exact = F.lit(total) * F.col(weight) / F.sum(weight).over(Window.partitionBy(F.lit(1)))
    df = members.withColumn("__e", exact).withColumn("__f", F.floor("__e"))
    df = df.withColumn("__left", F.lit(total) - F.sum("__f").over(Window.partitionBy(F.lit(1))))
    rn = F.row_number().over(Window.orderBy(F.desc(F.col("__e") - F.col("__f")), member))
    return df.select(member, (F.col("__f") + (rn <= F.col("__left")).cast("bigint")).alias("share"))


def assignment_faults(assigned: DataFrame, all_partitions: DataFrame, partition: str, member: str) -> DataFrame:
    """(partition, fault): owned twice, or by nobody."""
    g = all_partitions.join(assigned.groupBy(partition).agg(F.countDistinct(member).alias("__n")), partition, "left")
    fault = F.when(F.col("__n").isNull(), "orphaned").when(F.col("__n") > 1, "double-owned")
    return g.select(partition, fault.alias("fault")).filter("fault IS NOT NULL")


def replica_brokers(partitions: DataFrame, partition: str, brokers: int, factor: int) -> DataFrame:
    """(partition, replica, broker): replica i of partition p on broker (p + i) mod n."""
    if factor > brokers:
        raise ValueError("more replicas than brokers")
    r = partitions.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))
    return r.select(partition, "replica", ((F.col(partition) + F.col("replica")) % brokers).alias("broker"))


def rendezvous(keys: DataFrame, key: str, nodes: list[str]) -> DataFrame:
    """(key, node): the node whose hash with the key is greatest. ``nodes`` is a parameter list."""
    scores = F.array(*(F.struct(F.xxhash64(F.col(key), F.lit(n)).alias("h"), F.lit(n).alias("node")) for n in nodes))
    return keys.select(key, F.array_max(scores)["node"].alias("node"))


def cooperative_plan(current: DataFrame, target: DataFrame, partition: str, member: str) -> DataFrame:
    """(partition, action, from, to): what is revoked first and assigned after."""
    both = current.withColumnRenamed(member, "from").join(target.withColumnRenamed(member, "to"), partition, "full")
    action = F.when(F.col("from") == F.col("to"), "keep").when(F.col("from").isNull(), "assign").when(F.col("to").isNull(), "revoke").otherwise("move")
    return both.select(partition, action.alias("action"), "from", "to")


def longest_prefix(names: DataFrame, name: str, rules: DataFrame, prefix: str, value: str, depth: int) -> DataFrame:
    """(name, prefix, value) of the longest rule that begins the name, up to ``depth`` characters."""
    cut = names.select(name, F.explode(F.sequence(F.lit(1), F.least(F.length(name), F.lit(depth)))).alias("__n"))
    hit = cut.withColumn(prefix, F.substr(F.col(name), F.lit(1), F.col("__n"))).join(rules, prefix)
    return hit.groupBy(name).agg(F.max_by(F.struct(prefix, value), "__n").alias("__b")).select(name, f"__b.{prefix}", f"__b.{value}")


def churn(old: Column, new: Column) -> Column:
    """The share of rows that moved, in per cent."""
    return F.round(100.0 * F.avg((old != new).cast("int")), 4)


#: Arcs of a hash ring that are searched apart.
ARCS = 256


def ring_owner(keys: DataFrame, key: str, nodes: DataFrame, node: str, virtual: int) -> DataFrame:
    """(key, node): the first virtual node clockwise of the key's place on a ring of 2^32 places."""
    place = lambda c: sha_slot(c, 2**32)
    vnodes = nodes.withColumn("__v", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))))
    ring = vnodes.select(place(F.concat_ws("#", F.col(node), F.col("__v").cast("string"))).alias("at"), node)
    # the next place up is the floor in the mirrored order, sought within an arc of the ring; where an arc
    # has none, the first place of the arcs behind it counts. The ring is nodes times virtual rows.
    arc = lambda c: F.floor(c / (2**32 // ARCS)).cast("int")
    mirrored = ring.select(arc(F.col("at")).alias("__k"), (-F.col("at")).alias("at"), node)
    probe = keys.select(place(F.col(key)).alias("at"), key).select(arc(F.col("at")).alias("__k"), (-F.col("at")).alias("at"), key)
    first = ring.agg(F.min_by(node, "at").alias("__first"))
    arcs = keys.sparkSession.range(ARCS).select(F.col("id").cast("int").alias("__k"))
    heads = arcs.join(ring.groupBy(arc(F.col("at")).alias("__k")).agg(F.min_by(node, "at").alias("__head")), "__k", "left")
    behind = F.first("__head", ignorenulls=True).over(Window.orderBy("__k").rowsBetween(1, Window.unboundedFollowing))
    following = heads.select("__k", behind.alias("__next")).join(F.broadcast(first)).select("__k", F.coalesce("__next", "__first").alias("__next"))
    return floor_join(probe, mirrored, ["__k"], "at", node).join(F.broadcast(following), "__k").select(key, F.coalesce(node, "__next").alias(node))


def sticky_assign(current: DataFrame, members: DataFrame, partition: str, member: str) -> DataFrame:
    """(partition, member): balanced to within one, moving as few partitions as that allows.

    ``current`` has every partition, with its owner or null. Members that own most keep the larger
    shares; what they own beyond their share, and what has no living owner, fills the others up.
    """
    n = current.agg(F.count("*").alias("__n")).join(F.broadcast(members.agg(F.count("*").alias("__m"))))
    own = current.join(members, member, "left_semi").groupBy(member).agg(F.count("*").alias("__c"))
    seats = members.join(own, member, "left").withColumn("__c", F.coalesce("__c", F.lit(0)))
    seats = seats.withColumn("__i", F.row_number().over(Window.orderBy(F.desc("__c"), member))).join(F.broadcast(n))
    seats = seats.select(member, (F.expr("__n div __m") + (F.col("__i") <= F.col("__n") % F.col("__m")).cast("bigint")).alias("__q"))
    ranked = current.join(seats, member, "left").withColumn("__r", F.row_number().over(Window.partitionBy(member).orderBy(partition)))
    kept = ranked.filter("__r <= __q").select(partition, member)
    loose = ranked.filter("__q IS NULL OR __r > __q").select(partition).withColumn("__k", F.row_number().over(Window.orderBy(partition)))
    have = kept.groupBy(member).agg(F.count("*").alias("__h"))
    gaps = seats.join(have, member, "left").withColumn("__g", F.col("__q") - F.coalesce("__h", F.lit(0))).filter("__g > 0")
    gaps = gaps.withColumn("__s", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__g")))).withColumn("__k", F.row_number().over(Window.orderBy(member, "__s")))
    return kept.unionByName(loose.join(gaps, "__k").select(partition, member))
