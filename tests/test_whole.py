"""The queries over whole tables that SQL is too slow for, against plain Python; every row is there."""

from __future__ import annotations

from eventlake import catalog
from tests.test_oracle import SF


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def test_connected_components_of_all_customers(spark):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in rows_of(spark, "customer"):
        a, b = sorted((root(r.c_custkey), root(r.c_custkey + 1 + r.c_nationkey % 2)))
        up[b] = a
    got = {r.node: r.component for r in catalog.QUERIES["connected_components"](spark, SF).collect()}
    assert got == {x: root(x) for x in up}


def test_layers_of_all_parts(spark):
    edges = {(r.p_size, r.p_size + 1 + r.p_partkey % 3) for r in rows_of(spark, "part")}
    layer = dict.fromkeys({x for e in edges for x in e}, 0)
    for a, b in sorted(edges):
        layer[b] = max(layer[b], layer[a] + 1)
    assert {r.node: r.layer for r in catalog.QUERIES["topological_layers"](spark, SF).collect()} == layer


def test_every_row_is_looked_up_and_ranked(spark):
    n = len(rows_of(spark, "events"))
    for name in ("segment_lookup", "offset_index_floor", "checkpoint_translation"):
        assert catalog.QUERIES[name](spark, SF).count() == n
    assert catalog.QUERIES["priority_order"](spark, SF).count() == len(rows_of(spark, "orders"))
