"""Small inputs with known outputs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from eventlake.functions import codecs as C
from eventlake.functions.hashing import sha_slot
from eventlake.operators import agg as A
from eventlake.operators import graph as G
from eventlake.operators import joins as J
from eventlake.operators import log as L
from eventlake.operators import ordered as O
from eventlake.operators import placement as P
from eventlake.operators import transform as R
from eventlake.operators import txn as X
from eventlake.operators import windows as W


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_hopping(spark):
    df = spark.createDataFrame([(12,), (3,), (10,)], "t long")
    assert rows(W.hopping(df, "t", 10, 5)) == [(3, 0), (10, 5), (10, 10), (12, 5), (12, 10)]
    with pytest.raises(ValueError):
        W.hopping(df, "t", 5, 10)


def test_sessions(spark):
    df = spark.createDataFrame([("a", 0), ("a", 8), ("a", 5), ("b", 0), ("b", 5), ("b", 100)], "k string, t long")
    assert rows(W.sessions(df, ["k"], "t", 10)) == [("a", 0, 8, 3), ("b", 0, 5, 2), ("b", 100, 100, 1)]


def test_late_windows(spark):
    df = spark.createDataFrame([(0, 10, 1), (1, 65, 1), (2, 20, 5), (3, 140, 1), (4, 30, 7)], "seq long, t long, v long")
    assert rows(W.closed_windows(df, "t", 60, 10, "seq", F.col("v"))) == [(0, 6, 1), (60, 1, 0), (120, 1, 0)]


def test_interval_and_as_of_joins(spark):
    left = spark.createDataFrame([("k", 1000), ("q", 1)], "k string, l long")
    right = spark.createDataFrame([("k", 1050), ("k", 1200), ("k", 900)], "k string, r long")
    assert rows(J.interval_join(left, right, "k", "l", "r", 100)) == [("k", 1000, 900), ("k", 1000, 1050)]
    outer = J.interval_join(left, right, "k", "l", "r", 100, "left").collect()
    assert ("q", 1, None) in [tuple(r) for r in outer] and len(outer) == 3
    versions = spark.createDataFrame([("x", 100, "A"), ("x", 200, "B"), ("x", 300, "C")], "k string, t long, v string")
    probe = spark.createDataFrame([("x", 250), ("x", 200), ("x", 150), ("x", 50)], "k string, t long")
    assert {(r.t, r.v) for r in J.as_of(probe, versions, ["k"], "t", "v").collect()} == {(250, "B"), (200, "B"), (150, "A"), (50, None)}


def test_tables(spark):
    log = spark.createDataFrame([(1, "k", 5), (2, "k", 10), (3, "gone", 1), (4, "gone", None)], "seq long, k string, v long")
    left = J.latest(log, ["k"], "seq", "v")
    assert rows(left) == [("k", 10)]
    right = spark.createDataFrame([("k", 20)], "k string, v long")
    assert rows(J.table_join(left, right, ["k"], "v")) == [("k", 30)]
    one = lambda v: (spark.createDataFrame([("u",)], "k string"), F.lit(v))
    assert rows(J.cogroup({"orders": one(100), "tickets": one(-30)}, "k")) == [("u", 70, 2)]


def test_ranges_and_prefixes(spark):
    df = spark.createDataFrame([(1, 0, 15), (1, 10, 30), (2, 0, 10), (2, 10, 20), (3, 0, 5), (3, 6, 7)], "k long, start long, stop long")
    assert rows(L.coalesce_ranges(df, ["k"]), "k", "start", "stop") == [(1, 0, 30), (2, 0, 20), (3, 0, 5), (3, 6, 7)]
    acks = spark.createDataFrame([("a", 0, True), ("a", 4, True), ("a", 9, False), ("a", 12, True), ("b", 3, True)], "k string, p long, done boolean")
    assert rows(L.contiguous_prefix(acks, ["k"], "p", "done")) == [("a", 4), ("b", 3)]


def test_aggregates(spark):
    p = spark.createDataFrame([("g", 100.0, 10), ("g", 5.0, 1)], "g string, total double, n long")
    r = A.merge_means(p, ["g"]).first()
    assert (round(r.mean, 2), r.mean_of_means) == (9.55, 7.5)
    h = spark.createDataFrame([("g", b, n) for b, n in ((10, 50), (50, 30), (100, 15), (500, 5))], "g string, bucket long, n long")
    assert A.bucket_percentiles(h, ["g"], [90]).first().p90 == 100
    v = spark.createDataFrame([("g", x) for x in (5, 3, 8, 1, 9)], "g string, v long")
    assert [r.v for r in A.ranked(v, ["g"], "v").orderBy("rank").collect()] == [1, 3, 5, 8, 9]
    assert A.medians(spark.createDataFrame([("g", x) for x in (1, 2, 3, 4)], "g string, v long"), ["g"], "v").first().median == 2.5
    c = spark.createDataFrame([(0, 900), (1, 30), (2, 40), (3, 30)], "p long, n long")
    assert rows(A.hot(c, "n", 3), "p") == [(0,)]


def test_bloom_loses_no_member(spark):
    keys = spark.range(1000).withColumnRenamed("id", "k")
    bits = A.bloom_bits(keys, "k", 8000, 5)
    assert A.bloom_may_contain(keys, "k", bits, 8000, 5).count() == 1000
    assert A.bloom_may_contain(spark.range(5000, 6000).withColumnRenamed("id", "k"), "k", bits, 8000, 5).count() < 120


def test_ordered(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, 1, 2, 2, 3])], "k string, i long, v long")
    assert rows(O.runs(df, ["k"], ["i"], "v"), "v", "length") == [(1, 3), (2, 2), (3, 1)]
    nulls = spark.createDataFrame([("a", 0, None), ("a", 1, None), ("a", 2, 5)], "k string, i long, v long")
    assert {(r.v, r.length) for r in O.runs(nulls, ["k"], ["i"], "v").collect()} == {(None, 2), (5, 1)}


def test_codecs(spark):
    df = spark.createDataFrame([(0,), (-1,), (1,), (-2,), (300,), (-(2**62),)], "n long")
    z = {r.n: (r.z, r.back, r.b) for r in df.select("n", C.zigzag(F.col("n")).alias("z"), C.unzigzag(C.zigzag(F.col("n"))).alias("back"), C.varint_hex(C.zigzag(F.col("n"))).alias("b")).collect()}
    assert [z[n][0] for n in (0, -1, 1, -2)] == [0, 1, 2, 3] and all(z[n][1] == n for n in z)
    assert z[0][2] == "00" and z[300][2] == "d804"
    crc = spark.range(1).select(C.crc32c(F.lit(b"123456789")).alias("c"), C.crc32c(F.lit(b"")).alias("e")).first()
    assert (crc.c, crc.e) == (0xE3069283, 0)
    assert spark.range(1).select(C.shared_prefix(F.lit("orders-2024-01"), F.lit("orders-2024-02"))).first()[0] == 13


def test_compaction_and_visibility(spark):
    log = spark.createDataFrame([(0, "u1", "a"), (1, "u2", "x"), (2, "u1", "b"), (3, "u1", "c"), (4, "u2", "y")], "offset long, k string, v string")
    assert rows(X.compact(log, ["k"], "offset"), "offset") == [(3,), (4,)]
    data = spark.createDataFrame([(7, 15), (7, 25), (8, 15)], "producer long, offset long")
    aborted = spark.createDataFrame([(7, 10, 20)], "producer long, first long, last long")
    assert rows(X.without_aborted(data, aborted, "producer", "offset")) == [(7, 25), (8, 15)]
    hw = spark.createDataFrame([(0, 100), (1, 50)], "partition long, high_watermark long")
    txns = spark.createDataFrame([(0, 60), (0, 40)], "partition long, first_offset long")
    assert rows(X.last_stable(hw, txns)) == [(0, 100, 40, 60), (1, 50, 50, 0)]


def test_transforms(spark):
    v = F.col("v")
    df = spark.createDataFrame([(5000,), (500,), (5,)], "v long")
    assert [r[0] for r in df.select(R.branch([("high", v >= 1000), ("mid", v >= 100)], "low")).collect()] == ["high", "mid", "low"]
    t = spark.createDataFrame([(1000, 1), (None, 9999), (-5, 7)], "raw long, arrival long")
    assert [r[0] for r in t.select(R.event_time(F.col("raw"), F.col("arrival"))).collect()] == [1000, 9999, 7]


def test_placement_and_graphs(spark):
    w = spark.createDataFrame([("big", 2.0), ("small", 1.0)], "m string, w double")
    assert rows(P.weighted_shares(w, "m", "w", 9)) == [("big", 6), ("small", 3)]
    parts = spark.range(7).withColumnRenamed("id", "p")
    members = spark.createDataFrame([("a",), ("b",), ("c",)], "m string")
    assert [r[1] for r in rows(P.range_assign(parts, members, "p", "m"))] == ["a", "a", "a", "b", "b", "c", "c"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")], "src string, dst string")
    assert rows(G.layers(edges)) == [("a", 0), ("b", 1), ("c", 2), ("x", 0), ("y", 1)]
    assert rows(G.components(edges)) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]
    with pytest.raises(ValueError, match="cycle"):
        G.layers(spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string"))


def test_stable_slot(spark):
    import hashlib

    keys = [f"u{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.s for r in df.select("k", sha_slot(F.col("k"), 12).alias("s")).collect()} == {k: int(hashlib.sha256(k.encode()).hexdigest()[:8], 16) % 12 for k in keys}
